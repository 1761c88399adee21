import math
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import sizing
from corpusloom.functions.models import BatchChat, BatchEmbedder, BatchReranker, ColumnChat, LetterEmbedder
from corpusloom.operators import chunking, dense, lexical, merge, ranking
from corpusloom.plans import retrieval as rt
from corpusloom.session import scratch_path

TEXTS = {
    "d1": "the adder adds two numbers", "d2": "the latch holds the bit", "d3": "时序 电路 adder", "d4": "",
    "d5": "the the the", "d6": "the adder adds two numbers",
}


def words(text):
    return re.findall(r"[a-z]+|[一-鿿]", text.lower())


def plain_bm25(texts, query):
    tokens = {k: words(t) for k, t in texts.items()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / max(len(tokens), 1)
    df = Counter(t for ws in tokens.values() for t in set(ws))

    def vector(ws):
        out = {}
        for t, f in Counter(ws).items():
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) if df[t] else math.log(n + 1)
            out[t] = idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(ws) / max(avg, 1)))
        return out

    q = vector(words(query))
    scores = {k: sum(w * q.get(t, 0) for t, w in vector(ws).items()) for k, ws in tokens.items()}
    return sorted(((round(-s, 9), k) for k, s in scores.items() if s > 0))


@pytest.mark.parametrize("bound", [1 << 20, 200, 0])
def test_bm25_search_matches_brute_force(spark, bound):
    docs = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    queries = {1: "the adder", 2: "电 latch unknownword", 3: "nothing here", 4: "", 5: "the the adder"}
    asked = spark.createDataFrame(list(queries.items()), "question_id long, query string")
    hits = lexical.search(lexical.term_rows(docs, "id", "text"), asked, 3, "id", max_broadcast_bytes=bound).collect()
    for qid, text in queries.items():
        mine = sorted((r for r in hits if r.question_id == qid), key=lambda r: r["rank"])
        want = plain_bm25(TEXTS, text)[:3]
        assert [(round(-r.score, 9), r.id) for r in mine] == want


def test_joined_search_makes_terms_once_and_agrees_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELL_BYTES", 4000)
    monkeypatch.setattr(lexical, "WEIGHTS", 30)
    monkeypatch.setattr(lexical, "PRODUCTS", 16)
    texts = {f"t{i:02}": " ".join(f"w{'abcdefgh'[(i * j) % 8]}" for j in range(i % 7 + 1)) for i in range(60)}
    made = spark.sparkContext.accumulator(0)

    def seen(text):
        made.add(1)
        return text

    docs = spark.createDataFrame(list(texts.items()), "id string, text string").withColumn("text", F.udf(seen, "string")("text"))
    queries = {i: f"w{'abcdefgh'[i % 8]} wa w{'hgfedcba'[i % 5]}" for i in range(90)}
    asked = spark.createDataFrame(list(queries.items()), "question_id long, query string")
    hits = lexical.search(lexical.term_rows(docs, "id", "text"), asked, 3, "id", max_broadcast_bytes=0).collect()
    assert made.value == len(texts)
    found = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        found.setdefault(r.question_id, []).append((round(-r.score, 9), r.id))
    assert found == {i: plain_bm25(texts, text)[:3] for i, text in queries.items()}


def test_weights_drop_nothing_positive_and_empty_corpus(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    weights = lexical.weights(lexical.term_rows(docs, "id", "text"), "id").collect()
    assert {(r.id, r.token) for r in weights} == {(k, t) for k, v in TEXTS.items() for t in words(v)}
    totals = lexical.corpus_totals(lexical.term_rows(docs.limit(0), "id", "text")).first()
    assert (totals.n_docs, totals.avg_len) == (0, 1.0)
    none = lexical.search(lexical.term_rows(docs.limit(0), "id", "text"), docs.select(F.lit(1).alias("question_id"), F.lit("the").alias("query")).limit(1), 3, "id")
    assert none.count() == 0


@pytest.mark.parametrize("bound", [1 << 26, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_search_matches_brute_force(spark, bound, kind):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8))
    vectors[100:400] = vectors[100]  # one vector holds nearly half of the rows: ties go to the smaller id
    name = (lambda i: i) if kind == "long" else (lambda i: f"v{i:04d}")
    corpus = spark.createDataFrame([(name(i), [float(x) for x in v]) for i, v in enumerate(vectors)], f"id {kind}, vec array<double>")
    asked = spark.createDataFrame(
        [(i, [float(x) for x in vectors[i]]) for i in range(0, 700, 2)], "question_id long, query_vector array<double>"
    )
    hits = dense.search(corpus, asked, 7, "id", "vec", max_broadcast_bytes=bound).collect()
    assert len(hits) == 350 * 7
    for q in (0, 100, 250, 698):
        scores = np.round(vectors @ vectors[q], 9)
        want = [name(i) for i in sorted(range(700), key=lambda i: (-scores[i], i))[:7]]
        assert [r.id for r in sorted((r for r in hits if r.question_id == q), key=lambda r: r["rank"])] == want


def test_fusion_ranks(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 15)], "q int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, id string, rank int")
    fused = {r.id: r.score for r in ranking.reciprocal_rank_fusion([a, b], "q", "id", 5).collect()}
    assert fused["z"] == pytest.approx(1 / 75) and fused["y"] == pytest.approx(1 / 62 + 1 / 61)
    assert max(fused.values()) <= 2 / 61


FIELDS = "question_id int, pos int, score double, text string, filename string, file_type string, page_number long, chunk_id string, parent_chunk_id string, root_chunk_id string, chunk_level long, chunk_idx long, rrf_rank int, rerank_score double"


def hit(q, pos, score, cid, parent, root):
    return (q, pos, score, f"t-{cid}", "f", "PDF", 0, cid, parent, root, 3, pos, pos, None)


def parent(cid, up, root, level):
    return (f"t-{cid}", "f", "PDF", 0, cid, up, root, level, 0)


def merged(spark, hits, parents, **options):
    rt.shared_dir(spark)
    h = spark.createDataFrame(hits, FIELDS)
    p = spark.createDataFrame(
        parents, "text string, filename string, file_type string, page_number long, chunk_id string, parent_chunk_id string, root_chunk_id string, chunk_level long, chunk_idx long"
    )
    rows = merge.auto_merge(h, p, "question_id", 5, **options).collect()
    return sorted(rows, key=lambda r: (r.question_id, r["rank"]))


PARENTS = [parent("m1", "r1", "r1", 2), parent("m2", "r1", "r1", 2), parent("r1", "", "r1", 1)]


def test_merge_two_siblings_takes_first_childs_score(spark):
    rows = merged(spark, [hit(1, 1, 0.2, "a", "m1", "r1"), hit(1, 2, 0.9, "b", "m1", "r1"), hit(1, 3, 0.5, "c", "m9", "r9")], PARENTS)
    assert [(r.chunk_id, r.score, r.merged_child_count) for r in rows] == [("c", 0.5, None), ("m1", 0.2, 2)]
    assert {r.replaced for r in rows} == {2} and {r.merge_steps for r in rows} == {1}
    best = merged(spark, [hit(1, 1, 0.2, "a", "m1", "r1"), hit(1, 2, 0.9, "b", "m1", "r1")], PARENTS, score="max")
    assert [(r.chunk_id, r.score) for r in best] == [("m1", 0.9)]


def test_merge_runs_up_to_the_root_and_keeps_the_rest(spark):
    hits = [
        hit(1, 1, 0.9, "a", "m1", "r1"), hit(1, 2, 0.8, "b", "m2", "r1"), hit(1, 3, 0.7, "c", "m1", "r1"), hit(1, 4, 0.6, "d", "m2", "r1"),
        hit(2, 1, 0.9, "a", "m1", "r1"),
        hit(3, 1, 0.9, "e", "gone", "gone"), hit(3, 2, 0.8, "f", "gone", "gone"),
        hit(4, 1, 0.9, "g", " ", ""), hit(4, 2, 0.8, "h", " ", ""),
    ]
    rows = merged(spark, hits, PARENTS)
    got = {q: [(r.chunk_id, r.replaced) for r in rows if r.question_id == q] for q in (1, 2, 3, 4)}
    assert got == {1: [("r1", 6)], 2: [("a", 0)], 3: [("e", 0), ("f", 0)], 4: [("g", 0), ("h", 0)]}
    off = merged(spark, hits[:4], PARENTS, enabled=False)
    assert [r.chunk_id for r in off] == ["a", "b", "c", "d"]


def test_merge_by_ids_equals_merge_of_whole_hits(spark):
    """Many hits carry ids alone through the passes; the same rows come out, with all fields."""
    hits = [hit(q, pos, 1 / (pos + q), f"c{pos % 9}", f"m{pos % 3}", "r1") for q in range(5) for pos in range(1, 8 - q)]
    hits += [hit(9, 1, 0.9, " ", "", ""), hit(9, 2, 0.8, " ", "", ""), hit(8, 1, 0.7, "c9", "gone", "gone")]
    for options in ({}, {"order_by": "rerank", "score": "max"}):
        whole = merged(spark, hits, PARENTS, **options)
        assert merged(spark, hits, PARENTS, small=False, **options) == whole
        named = [h for h in hits if h[0] != 9]
        h = spark.createDataFrame(named, FIELDS)
        leaves = h.select(*merge.CHUNK_FIELDS).dropDuplicates(["chunk_id"])
        parents = spark.createDataFrame(PARENTS, leaves.select("text", "filename", "file_type", "page_number", "chunk_id", "parent_chunk_id", "root_chunk_id", "chunk_level", "chunk_idx").schema)
        ids = merge.auto_merge(h.drop("text", "filename", "file_type", "page_number", "root_chunk_id", "chunk_level", "chunk_idx"), parents, "question_id", 5, leaves=leaves, **options)
        got = sorted(ids.collect(), key=lambda r: (r.question_id, r["rank"]))
        assert [r.asDict() for r in got] == [r.asDict() for r in whole if r.question_id != 9]


def test_rows_of_many_files_are_not_dealt_again(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for files, exchanges in ((cores, 0), (1, 1)):
        path = str(tmp_path / str(files))
        spark.range(100).repartition(files).write.parquet(path)
        dealt = sizing.spread_table(spark.read.parquet(path), "id")
        assert dealt._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == exchanges
        assert sorted(r.id for r in dealt.collect()) == list(range(100))


@pytest.fixture(scope="module")
def kb(spark):
    pages = spark.createDataFrame(
        [(f"f{i}.pdf", 0, "PDF", f"topic{chr(97 + i)} " * 5 + "common words about circuits. " * 30) for i in range(6)],
        "filename string, page_number long, file_type string, text string",
    )
    chunks = chunking.chunk_pages(pages, chunking.separator_levels(F.col("text")), keep=["file_type"])
    return rt.store_index(chunks.withColumnRenamed("page_chunk_idx", "chunk_idx"), LetterEmbedder(), scratch_path(spark, "kb"))


def test_failed_reranker_leaves_fused_order(spark, kb):
    asked = spark.createDataFrame([(1, "topica circuits"), (2, "topicb")], "question_id int, query string")

    def broken(queries, texts):
        raise RuntimeError("HTTP 500")

    plain = rt.retrieve(kb, asked, rt.Settings(auto_merge=False))
    failed = rt.retrieve(kb, asked, rt.Settings(auto_merge=False, reranker=BatchReranker(broken)))
    view = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, r.rrf_rank) for r in df.collect())
    assert view(plain) == view(failed) and len(view(plain)) == 10


def test_modes_and_unknown_mode(spark, kb):
    asked = spark.createDataFrame([(1, "topica")], "question_id int, query string")
    assert rt.candidates(kb, asked, rt.Settings(mode="dense_fallback")).count() == 15
    with pytest.raises(ValueError):
        rt.candidates(kb, asked, rt.Settings(mode="failed"))


def test_fallback_per_question(spark, kb):
    texts = {1: "topica circuits", 2: "topicb poison", 3: "123", 4: "poison 456", 5: "7 \u2620", 6: None, 7: ""}
    asked = spark.createDataFrame(list(texts.items()), "question_id int, query string").repartition(2)

    def call(batch):
        if any("poison" in t or "\u2620" in t for t in batch):
            raise RuntimeError("HTTP 400")
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in batch]

    some = replace(kb, embedder=BatchEmbedder(call))
    hits, status = rt.retrieve_with_fallback(some, asked, rt.Settings(auto_merge=False))
    modes = {r.question_id: r.retrieval_mode for r in status.collect()}
    assert modes == {1: "hybrid", 2: "sparse_fallback", 3: "dense_fallback", 4: "sparse_fallback", 5: "failed", 6: "failed", 7: "dense_fallback"}
    view = lambda df, ids: sorted((r.question_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect() if r.question_id in ids)
    plain = rt.retrieve(some, asked.filter("question_id = 1"), rt.Settings(auto_merge=False))
    assert view(hits, {1}) == view(plain, {1}) and len(view(hits, {1})) == 5
    alone = [(r.question_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in rt.sparse_hits(kb, asked.filter("question_id = 2"), 5).collect()]
    assert view(hits, {2}) == sorted(alone) and alone
    assert not view(hits, {5, 6}) and len(view(hits, {3})) == 5
    meta = {r.question_id: r for r in rt.retrieval_meta(asked, hits, rt.Settings(), status=status).collect()}
    assert len(meta) == 7 and meta[5].rerank_error == "retrieve_failed" and meta[2].rerank_error is None


def test_collection_without_statistics_and_errors_of_the_engine(spark, kb):
    asked = spark.createDataFrame([(1, "topica"), (2, "topicb")], "question_id int, query string")
    hits, status = rt.retrieve_with_fallback(replace(kb, has_statistics=False), asked)
    assert {r.retrieval_mode for r in status.collect()} == {"dense_fallback"} and hits.select("question_id").distinct().count() == 2
    lost = replace(kb, terms=kb.terms.withColumn("terms", F.raise_error("lost table").cast("array<struct<token:string,tf:int>>")))
    with pytest.raises(Exception, match="lost table"):
        rt.retrieve_with_fallback(lost, asked)[0].collect()
    none, status = rt.retrieve_with_fallback(kb, asked.limit(0))
    assert none.count() == 0 and status.count() == 0


def test_flow_routes_on_the_grade(spark, kb):
    asked = spark.createDataFrame([(1, "topica"), (2, "topicb 45")], "question_id int, query string")
    grader = ColumnChat(lambda p: F.when(p.endswith("\ntopica"), '{"score": "YES "}').otherwise('{"score": "yes sir"}'))
    writer = rt.Rewriter(step_back_question=ColumnChat(lambda p: F.lit(" What are circuits? ")))
    out = {r.question_id: r for r in rt.answer_contexts(kb, asked, grader, writer).collect()}
    assert (out[1].route, out[1].stage) == ("generate_answer", "initial")
    assert out[2].route == "rewrite_question" and out[2].expansion_type == "step_back" and out[2].context.startswith("[1] ")
    nograde = rt.answer_contexts(kb, asked, None, writer).collect()
    assert {r.route for r in nograde} == {"rewrite_question"}


def test_step_back_texts(spark):
    asked = spark.createDataFrame([(1, "q")], "question_id int, query string")
    full = rt.Rewriter(
        router=ColumnChat(lambda p: F.lit("complex")), step_back_question=ColumnChat(lambda p: F.lit("why")),
        step_back_answer=ColumnChat(lambda p: F.lit("so")), hypothetical=ColumnChat(lambda p: F.lit("doc")),
    )
    row = rt.rewrite(asked, full).first()
    assert row.expanded_query == "q\n\n退步问题：why\n退步问题答案：so" and row.hypothetical_doc == "doc"
    bare = rt.rewrite(asked, rt.Rewriter()).first()
    assert (bare.expansion_type, bare.expanded_query, bare.hypothetical_doc) == ("step_back", "q", "")


def test_search_table_function(spark, kb):
    rt.register_search(kb)
    got = spark.sql("SELECT chunk_id, score FROM search_knowledge_base('topicc circuits', 3) ORDER BY rank").collect()
    asked = spark.createDataFrame([(1, "topicc circuits")], "question_id int, query string")
    want = rt.sparse_hits(kb, asked, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [r.chunk_id for r in want]
    assert [round(r.score, 9) for r in got] == [round(r.score, 9) for r in want]


def test_tool_answer_without_hits(spark):
    asked = spark.createDataFrame([(1, "q")], "question_id int, query string")
    none = spark.createDataFrame([], "question_id int, context string")
    assert rt.tool_answer(none, asked).first().answer == "No relevant documents found in the knowledge base."


def test_fetch_by_list_and_by_join(spark, kb, monkeypatch):
    wanted = kb.leaves.select("chunk_id").orderBy("chunk_id").limit(4).checkpoint()
    listed = {r.chunk_id for r in merge.fetch(kb.leaves, wanted, "chunk_id", True).collect()}
    monkeypatch.setattr(merge, "MAX_LITERAL_IDS", 2)
    joined = {r.chunk_id for r in merge.fetch(kb.leaves, wanted, "chunk_id", True).collect()}
    shuffled = {r.chunk_id for r in merge.fetch(kb.leaves, wanted, "chunk_id", False).collect()}
    assert listed == joined == shuffled and len(listed) == 4


def test_models_are_asked_once_per_text(spark, kb):
    asked_for = spark.sparkContext.accumulator(0)
    routed = spark.sparkContext.accumulator(0)

    def letters(texts):
        asked_for.add(len(texts))
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    def router(prompts):
        routed.add(len(prompts))
        return ["complex"] * len(prompts)

    questions = spark.createDataFrame([(i, f"topic{c}") for i, c in enumerate("abcde")], "question_id long, query string")
    counted = replace(kb, embedder=BatchEmbedder(letters))
    rt.retrieve(counted, questions).collect()
    assert asked_for.value == 5
    chat = lambda text: ColumnChat(lambda p: F.lit(text))
    rewriter = rt.Rewriter(router=BatchChat(router), step_back_question=chat("why"), step_back_answer=chat("so"), hypothetical=chat("doc"))
    rt.retrieve_expanded(kb, rt.rewrite(questions.withColumn("context", F.lit("")), rewriter)).collect()
    assert routed.value == 5

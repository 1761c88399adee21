"""Search and retrieval queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom import sizing
from corpusloom.functions import arrays, text as tx
from corpusloom.functions.models import ColumnChat, LetterEmbedder, LetterRowEmbedder, OverlapReranker
from corpusloom.operators import cells, chunking, dense, lexical, merge, postings
from corpusloom.operators.ranking import reciprocal_rank_fusion
from corpusloom.plans import retrieval as rt, statements as st
from corpusloom.plans.registry import query, table
from corpusloom.session import scratch_path

_DOC = st.terms("doc", "documents", "doc_id", "text")
_ASK = st.terms("ask", "question", "question_id", "query")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_rows(sizing.spread_table(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))


@query(st.with_(_DOC) + " SELECT token, df FROM doc_df")
def bm25_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents holding each token."""
    return lexical.document_frequency(_documents(spark, sf_dir))


@query(st.with_(_DOC) + " SELECT n_docs::BIGINT AS n_docs, round(avg_len, 6) AS avg_len FROM doc_tot")
def bm25_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus size and mean length in tokens."""
    return lexical.corpus_totals(_documents(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


@query(st.with_(_DOC) + " SELECT doc_id, token, tf FROM doc_tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts per document."""
    return lexical.postings(_documents(spark, sf_dir), "doc_id").select("doc_id", "token", F.col("tf").cast("long").alias("tf"))


@query(
    st.with_(_DOC)
    + f"""
SELECT doc_id, token, round(w, 6) AS weight FROM (
  SELECT doc_id, token, {st.IDF} * {st.saturation("tf", "doc_len")} AS w
  FROM doc_tf JOIN doc_df USING (token) JOIN doc_len USING (doc_id), doc_tot) WHERE w > 0"""
)
def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 vector of every document, long form."""
    w = lexical.weights(_documents(spark, sf_dir), "doc_id")
    return w.select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(
    st.with_(st.QUESTIONS, _DOC, _ASK, st.bm25_search("hit", "doc", "doc_id", "ask", "question_id", 10))
    + " SELECT question_id, doc_id, round(score, 6) AS score, rank FROM hit"
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents per benchmark passage by BM25."""
    hits = lexical.search(_documents(spark, sf_dir), questions(spark, sf_dir), 10, "doc_id")
    return hits.withColumn("score", F.round("score", 6))


@query(
    st.with_(st.QUESTIONS, _DOC, _ASK, st.bm25_search("hit", "doc", "doc_id", "ask", "question_id", 10))
    + " SELECT question_id, doc_id, round(score, 6) AS score, rank FROM hit"
)
def bm25_topk_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk`` on the shuffled grid that needs no broadcast of the question batch."""
    hits = lexical.search(_documents(spark, sf_dir), questions(spark, sf_dir), 10, "doc_id", max_broadcast_bytes=0)
    return hits.withColumn("score", F.round("score", 6))


_EMB = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _dense_sql(where: str) -> str:
    return f"""
SELECT question_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS question_id, c.vec_id, list_inner_product(q.v, c.v) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, c.v), 9) DESC, c.vec_id) AS rank
  FROM v q, v c WHERE {where}) WHERE rank <= 5"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector"))


@query(st.with_(_EMB) + _dense_sql("true"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector by inner product, exact."""
    corpus, asked = _vectors(spark, sf_dir)
    hits = dense.search(sizing.spread(corpus), asked, 5, "vec_id", "embedding")
    return hits.withColumn("score", F.round("score", 6))


@query(st.with_(_EMB) + _dense_sql("c.label = 3"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over one label only: the predicate reaches the scan, as the leaf-level filter does."""
    corpus, asked = _vectors(spark, sf_dir)
    hits = dense.search(corpus.filter("label = 3"), asked, 5, "vec_id", "embedding")
    return hits.withColumn("score", F.round("score", 6))


@query(st.with_(_EMB) + _dense_sql("true"))
def dense_topk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dense_topk`` on the shuffled grid used when the question batch exceeds the broadcast bound."""
    corpus, asked = _vectors(spark, sf_dir)
    hits = dense.search(corpus, asked, 5, "vec_id", "embedding", max_broadcast_bytes=0)
    return hits.withColumn("score", F.round("score", 6))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizing.spread_table(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.lit(0).cast("long").alias("page_number"),
        F.lit("PDF").alias("file_type"),
        "text",
    )


_CHUNK_COLUMNS = [
    "filename", "page_number", "text", "chunk_level", "chunk_id", "parent_chunk_id", "root_chunk_id", "page_chunk_idx",
]


@query(st.with_(st.chunks()) + f" SELECT {', '.join(_CHUNK_COLUMNS)} FROM chunk")
def chunk_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested levels with no natural separator: ids, parents and preorder positions."""
    return chunking.chunk_pages(_pages(spark, sf_dir), chunking.window_levels(F.col("text"))).select(*_CHUNK_COLUMNS)


@query()
def chunk_three_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested levels cut at natural separators."""
    return chunking.chunk_pages(_pages(spark, sf_dir), chunking.separator_levels(F.col("text"))).select(*_CHUNK_COLUMNS)


_SOURCE_PAGES = "(SELECT source AS filename, doc_id AS page_number, text FROM documents)"


@query(
    st.with_(st.chunks(_SOURCE_PAGES))
    + """, n AS (SELECT filename, page_number, count(*) AS n FROM chunk GROUP BY ALL),
ahead AS (SELECT filename, page_number, coalesce(sum(n) OVER (PARTITION BY filename ORDER BY page_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n)
SELECT chunk_id, (page_chunk_idx + ahead)::BIGINT AS chunk_idx FROM chunk JOIN ahead USING (filename, page_number)"""
)
def chunk_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preorder numbers running across the pages of a file: sources as files, documents as pages."""
    docs = sizing.spread_table(table(spark, sf_dir, "documents"), "doc_id")
    pages = docs.select(F.col("source").alias("filename"), F.col("doc_id").alias("page_number"), "text")
    path = scratch_path(spark, "chunks")
    chunking.chunk_pages(pages, chunking.window_levels(F.col("text"))).drop("text").write.parquet(path)
    return chunking.number_chunks(spark.read.parquet(path), pages_per_block=100).select("chunk_id", "chunk_idx")


_STORED: dict[tuple[str, str], rt.KnowledgeBase] = {}


def knowledge_base(spark: SparkSession, sf_dir: str) -> rt.KnowledgeBase:
    """The documents as a stored index, built once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        chunks = chunking.chunk_pages(_pages(spark, sf_dir), chunking.window_levels(F.col("text")), keep=["file_type"])
        chunks = chunks.withColumnRenamed("page_chunk_idx", "chunk_idx")
        path = scratch_path(spark, "chunks")
        chunks.write.option("compression", "zstd").parquet(path)
        _STORED[key] = rt.store_index(spark.read.parquet(path), LetterRowEmbedder(), scratch_path(spark, "index"))
    return _STORED[key]


SETTINGS = rt.Settings(reranker=OverlapReranker())


@query(
    st.with_(st.QUESTIONS, st.INDEX, st.hybrid("hit", "question", "question_id"))
    + " SELECT question_id, chunk_id, round(score, 6) AS score, rrf_rank FROM hit"
)
def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen fused leaf candidates per question from thirty dense and thirty BM25 hits."""
    kb = knowledge_base(spark, sf_dir)
    return rt.candidates(kb, questions(spark, sf_dir), SETTINGS).withColumn("score", F.round("score", 6))


@query(
    st.with_(
        st.QUESTIONS, st.INDEX, st.vectors("asked", "question", "question_id", "query"),
        st.dense_search("hit", "leaf_v", "chunk_id", "asked", "question_id", 15),
    )
    + " SELECT question_id, chunk_id, round(score, 6) AS score, rank AS rrf_rank FROM hit"
)
def dense_fallback_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense-only candidates, the mode for a collection without term statistics."""
    hits = rt.candidates(knowledge_base(spark, sf_dir), questions(spark, sf_dir), rt.Settings(mode="dense_fallback"))
    return hits.withColumn("score", F.round("score", 6))


_HIT_COLUMNS = ["question_id", "rank", "chunk_id", "chunk_level", "text", "rrf_rank", "merged_child_count"]


def _final(hits: DataFrame) -> DataFrame:
    return hits.select(*_HIT_COLUMNS, F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


@query(
    st.with_(st.QUESTIONS, st.INDEX, st.hybrid("hit", "question", "question_id"), st.reranked("best", "hit", "question", "question_id"))
    + " SELECT question_id, chunk_id, rrf_rank, pos, round(rerank_score, 6) AS rerank_score FROM best"
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five of the fused candidates by the offline overlap reranker."""
    kb, asked = knowledge_base(spark, sf_dir), questions(spark, sf_dir)
    found = rt.candidates(kb, asked, SETTINGS)
    small = rt.small_batch(asked, SETTINGS.candidate_k)
    hits = kb.leaves.select("chunk_id", "text").join(F.broadcast(found) if small else found, "chunk_id")
    best = rt.rerank(hits, asked, SETTINGS)
    return best.select("question_id", "chunk_id", "rrf_rank", "pos", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    st.with_(st.QUESTIONS, st.INDEX, st.hybrid("hit", "question", "question_id"))
    + """, reply AS (SELECT question_id, rrf_rank AS reply_order, count(*) OVER (PARTITION BY question_id) - rrf_rank AS index FROM hit)
SELECT question_id, chunk_id, rrf_rank, pos FROM (
  SELECT h.question_id, h.chunk_id, h.rrf_rank, row_number() OVER (PARTITION BY h.question_id ORDER BY reply_order) AS pos
  FROM hit h JOIN reply r ON r.question_id = h.question_id AND r.index = h.rrf_rank - 1) WHERE pos <= 5"""
)
def rerank_index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerank service's answer by list index: here the candidates in reverse."""
    hits = rt.candidates(knowledge_base(spark, sf_dir), questions(spark, sf_dir), SETTINGS)
    sizes = hits.groupBy("question_id").agg(F.count("*").alias("n"))
    reply = hits.join(sizes, "question_id").select(
        "question_id",
        F.col("rrf_rank").alias("reply_order"),
        (F.col("n") - F.col("rrf_rank")).alias("index"),
        (1.0 / F.col("rrf_rank")).alias("relevance_score"),
    )
    return rt.rerank_by_index(hits, reply, 5).select("question_id", "chunk_id", "rrf_rank", "pos")


_SAMPLE_HITS = """
sample0 AS (SELECT page_number AS question_id, * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY md5(chunk_id), chunk_id) AS pos
  FROM leaf)),
sample AS (SELECT filename AS question_id, pos, 1e0 / (60 + pos) AS score, chunk_id, text, filename, page_number, parent_chunk_id,
  root_chunk_id, chunk_level, pos AS rrf_rank, NULL::DOUBLE AS rerank_score FROM sample0)"""


@query(
    st.with_(st.chunks(), _SAMPLE_HITS, st.auto_merged("final", "sample", "question_id"))
    + """ SELECT question_id, rank, chunk_id, chunk_level, text, rrf_rank, merged_child_count, round(score, 6) AS score,
    replaced::BIGINT AS replaced, merge_steps::INT AS merge_steps FROM final"""
)
def auto_merge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merge passes over all leaves of every document, in a pseudo-random order of hits; the five best parents and leaves stay."""
    kb = knowledge_base(spark, sf_dir)
    mixed = kb.leaves.select("filename", *merge.LINK_FIELDS).withColumn("_at", F.md5(F.col("chunk_id").cast("binary")))
    order = Window.partitionBy("filename").orderBy("_at", "chunk_id")
    hits = mixed.withColumn("pos", F.row_number().over(order)).select(
        F.col("filename").alias("question_id"), "pos", (1.0 / (F.col("pos") + 60)).alias("score"), *merge.LINK_FIELDS,
        F.col("pos").alias("rrf_rank"), F.lit(None).cast("double").alias("rerank_score"),
    )
    rt.shared_dir(spark)
    final = merge.auto_merge(hits, kb.parents, "question_id", 5, leaves=kb.leaves)
    return final.select(
        "question_id", "rank", "chunk_id", "chunk_level", "text", "rrf_rank", "merged_child_count",
        F.round("score", 6).alias("score"), "replaced", "merge_steps",
    )


_RETRIEVED = st.with_(st.QUESTIONS, st.INDEX, st.retrieved("final", "question", "question_id"))


@query(
    _RETRIEVED
    + """ SELECT question_id, rank, chunk_id, chunk_level, text, rrf_rank, merged_child_count, round(score, 6) AS score,
    round(rerank_score, 6) AS rerank_score FROM final"""
)
def retrieve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search, rerank and auto-merge for the whole question batch."""
    return _final(rt.retrieve(knowledge_base(spark, sf_dir), questions(spark, sf_dir), SETTINGS))


@query(
    _RETRIEVED
    + """ SELECT q.question_id, true AS rerank_enabled, true AS rerank_applied, NULL::VARCHAR AS rerank_error, 'hybrid' AS retrieval_mode, 15 AS candidate_k, 3 AS leaf_retrieve_level,
  true AS auto_merge_enabled, coalesce(max(replaced), 0) > 0 AS auto_merge_applied, 2 AS auto_merge_threshold,
  coalesce(max(replaced), 0)::BIGINT AS auto_merge_replaced_chunks, coalesce(max(merge_steps), 0)::INT AS auto_merge_steps
FROM question q LEFT JOIN final f USING (question_id) GROUP BY q.question_id"""
)
def retrieval_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each retrieval applied."""
    asked = questions(spark, sf_dir)
    hits, status = rt.retrieve_with_fallback(knowledge_base(spark, sf_dir), asked, SETTINGS)
    return rt.retrieval_meta(asked, hits, SETTINGS, status=status)


class _FailingOnSome(LetterEmbedder):
    """The offline embedder, down for texts of every fifth length."""

    def try_embed(self, text: Column) -> Column:
        return F.when(F.length(text) % 5 != 2, self.embed(text))


# Every seventh question is stripped of its terms.
_SOME_WITHOUT_TERMS = r"""question AS (SELECT item_id AS question_id, CASE WHEN item_id % 7 = 3 THEN regexp_replace(text, '[A-Za-z\x{4e00}-\x{9fff}]', '', 'g') ELSE text END AS query FROM benchmark)"""


@query(
    st.with_(_SOME_WITHOUT_TERMS, st.INDEX, st.hybrid("h", "question", "question_id"))
    + f""", state AS (SELECT question_id, CASE WHEN by_vector AND by_terms THEN 'hybrid' WHEN by_vector THEN 'dense_fallback' WHEN by_terms THEN 'sparse_fallback' ELSE 'failed' END AS retrieval_mode
  FROM (SELECT question_id, length(query) % 5 <> 2 AS by_vector, len({st.tokens("query")}) > 0 AS by_terms FROM question)),
found AS (
  SELECT question_id, chunk_id, score, rrf_rank FROM h JOIN state USING (question_id) WHERE retrieval_mode = 'hybrid'
  UNION ALL SELECT question_id, chunk_id, score, rank FROM h_d JOIN state USING (question_id) WHERE retrieval_mode = 'dense_fallback' AND rank <= 15
  UNION ALL SELECT question_id, chunk_id, score, rank FROM h_b JOIN state USING (question_id) WHERE retrieval_mode = 'sparse_fallback' AND rank <= 15)
SELECT question_id, retrieval_mode, chunk_id, round(score, 6) AS score, rrf_rank FROM state LEFT JOIN found USING (question_id)"""
)
def fallback_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a batch in which the embedder fails on some questions and others have no terms."""
    asked = questions(spark, sf_dir).withColumn(
        "query", F.when(F.col("question_id") % 7 == 3, F.regexp_replace("query", r"[A-Za-z\x{4e00}-\x{9fff}]", "")).otherwise(F.col("query"))
    )
    kb = replace(knowledge_base(spark, sf_dir), embedder=_FailingOnSome())
    encoded = rt.encoded_questions(kb, asked)
    found = rt.candidates_by_mode(kb, encoded, SETTINGS).withColumn("score", F.round("score", 6))
    return encoded.select("question_id", "retrieval_mode").join(found, "question_id", "left")


@query(
    _RETRIEVED + "," + st.context("ctx", "final", "question_id")
    + " SELECT question_id, 'Retrieved Chunks:' || chr(10) || context AS answer FROM ctx"
)
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text the search tool returns."""
    asked = questions(spark, sf_dir)
    hits = rt.retrieve(knowledge_base(spark, sf_dir), asked, SETTINGS)
    return rt.tool_answer(rt.format_context(hits), asked)


# Offline model replies, each a plain function of the prompt.
def _overlap_grade(parts: Column) -> Column:
    asked = F.array_distinct(tx.tokens(F.get(parts, F.lit(1))))
    found = F.size(F.array_intersect(asked, tx.tokens(F.get(parts, F.lit(0)))))
    return F.when(found * 10 >= F.size(asked) * 9, '```json\n{"score": "yes"}\n```').otherwise('{"score": "no"}')


GRADER = ColumnChat(
    lambda prompt: arrays.let(F.split(F.substring_index(prompt, "\n\nPassage:\n", -1), "\n\nQuestion:\n"), _overlap_grade)
)
_GRADED_SQL = f"""graded AS (SELECT q.question_id, q.query, c.context,
  len(list_intersect(list_distinct({st.tokens("q.query")}), {st.tokens("c.context")})) * 10 >= len(list_distinct({st.tokens("q.query")})) * 9 AS good
  FROM question q JOIN ctx c USING (question_id))"""


def _task(prompt):
    return F.substring_index(prompt, "\n", -1)


REWRITER = rt.Rewriter(
    router=ColumnChat(
        lambda p: F.when(F.length(p) % 3 == 0, "hyde").when(F.length(p) % 3 == 1, "complex").otherwise("other")
    ),
    step_back_question=ColumnChat(lambda p: F.concat(F.lit("What is behind "), F.substring(_task(p), 1, 20))),
    step_back_answer=ColumnChat(lambda p: F.concat(F.lit("In general: "), F.right(_task(p), F.lit(20)))),
    hypothetical=ColumnChat(lambda p: F.concat(F.lit("Passage. "), F.substring(_task(p), 1, 60))),
)
_ROUTER_PROMPT = len("Choose a query expansion strategy: step_back, hyde or complex.\n")
_LAST_LINE = "regexp_extract(query, '[^\\n]*$')"
_TRIMMED = lambda e: f"trim({e}, {st.WS})"
_REWRITTEN_SQL = f"""
kind AS (SELECT *, CASE (length(query) + {_ROUTER_PROMPT}) % 3 WHEN 0 THEN 'hyde' WHEN 1 THEN 'complex' ELSE 'step_back' END AS expansion_type
  FROM asked),
sbq AS (SELECT *, CASE WHEN expansion_type = 'hyde' THEN '' ELSE {_TRIMMED(f"'What is behind ' || substr({_LAST_LINE}, 1, 20)")} END AS step_back_question FROM kind),
sba AS (SELECT *, CASE WHEN step_back_question = '' THEN '' ELSE {_TRIMMED("'In general: ' || right(step_back_question, 20)")} END AS step_back_answer FROM sbq),
rewritten AS (SELECT *,
  CASE WHEN step_back_question = '' THEN query ELSE query || chr(10) || chr(10) || '退步问题：' || step_back_question || chr(10) || '退步问题答案：' || step_back_answer END AS expanded_query,
  CASE WHEN expansion_type = 'step_back' THEN '' ELSE {_TRIMMED(f"'Passage. ' || substr({_LAST_LINE}, 1, 60)")} END AS hypothetical_doc
  FROM sba)"""


@query(
    _RETRIEVED + "," + st.context("ctx", "final", "question_id") + "," + _GRADED_SQL
    + """ SELECT question_id, CASE WHEN good THEN 'yes' ELSE 'no' END AS grade_score,
  CASE WHEN good THEN 'generate_answer' ELSE 'rewrite_question' END AS route FROM graded"""
)
def grade_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance grade (offline stand-in) and the route taken."""
    asked = questions(spark, sf_dir)
    contexts = rt.format_context(rt.retrieve(knowledge_base(spark, sf_dir), asked, SETTINGS))
    return rt.grade(asked, contexts, GRADER).select("question_id", "grade_score", "route")


@query(
    st.with_(st.QUESTIONS, "asked AS (SELECT * FROM question)", _REWRITTEN_SQL)
    + " SELECT question_id, expansion_type, step_back_question, step_back_answer, expanded_query, hypothetical_doc FROM rewritten"
)
def rewrite_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite strategy and expanded queries (offline stand-ins); an unknown strategy means step-back."""
    return rt.rewrite(questions(spark, sf_dir), REWRITER).drop("query")


_SEARCHES_SQL = """
search AS (SELECT question_id, 0 AS source_order, question_id || '/0' AS search_id, hypothetical_doc AS query FROM rewritten WHERE expansion_type <> 'step_back'
  UNION ALL SELECT question_id, 1, question_id || '/1', expanded_query FROM rewritten WHERE expansion_type <> 'hyde')"""
_EXPANDED_SQL = """
exp0 AS (SELECT s.question_id, s.source_order, e.* FROM ext e JOIN search s USING (search_id)),
exp1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, filename, page_number, text ORDER BY source_order, rank) AS first_one
  FROM exp0) WHERE first_one = 1),
expanded AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY source_order, rank) AS rank,
  chunk_id, chunk_level, text, filename, page_number, source_order, score FROM exp1)"""


@query(
    st.with_(st.QUESTIONS, st.INDEX, "asked AS (SELECT * FROM question)", _REWRITTEN_SQL, _SEARCHES_SQL, st.retrieved("ext", "search", "search_id"), _EXPANDED_SQL)
    + " SELECT question_id, rank, chunk_id, chunk_level, source_order, round(score, 6) AS score FROM expanded"
)
def expanded_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second retrieval for every question: HyDE list, then step-back list, first occurrence wins."""
    rewritten = rt.rewrite(questions(spark, sf_dir), REWRITER)
    hits = rt.retrieve_expanded(knowledge_base(spark, sf_dir), rewritten, SETTINGS)
    return hits.select("question_id", "rank", "chunk_id", "chunk_level", "source_order", F.round("score", 6).alias("score"))


@query(
    _RETRIEVED + "," + st.context("ctx", "final", "question_id") + "," + _GRADED_SQL
    + ", asked AS (SELECT question_id, query FROM graded WHERE NOT good)," + _REWRITTEN_SQL + "," + _SEARCHES_SQL
    + "," + st.retrieved("ext", "search", "search_id") + "," + _EXPANDED_SQL + "," + st.context("ctx2", "expanded", "question_id")
    + """ SELECT question_id, 'generate_answer' AS route, 'initial' AS stage, NULL::VARCHAR AS expansion_type, context FROM graded WHERE good
UNION ALL SELECT r.question_id, 'rewrite_question', 'expanded', r.expansion_type, coalesce(c.context, '')
  FROM rewritten r LEFT JOIN ctx2 c USING (question_id)"""
)
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow for the question batch: retrieve, grade, rewrite, retrieve again."""
    out = rt.answer_contexts(knowledge_base(spark, sf_dir), questions(spark, sf_dir), GRADER, REWRITER, SETTINGS)
    return out.drop("query")


@query(
    """SELECT doc_id AS question_id, bool_or(toxic = 1) AS rerank_enabled, bool_or(quality = 1) AS rerank_applied,
  nullif(string_agg(CASE WHEN toxic = 1 THEN CASE WHEN s = 0 THEN 'hyde' ELSE 'step_back' END || ':HTTP 50' || s END, '; ' ORDER BY s), '') AS rerank_error,
  CASE WHEN bool_or(quality = 1) THEN 'hybrid' ELSE 'dense_fallback' END AS retrieval_mode,
  15 AS candidate_k, bool_or(quality = 1) AS auto_merge_applied,
  sum(quality * (s + 2))::BIGINT AS auto_merge_replaced_chunks, sum(s)::BIGINT AS auto_merge_steps
FROM labels, (SELECT unnest([0, 1]) AS s) GROUP BY doc_id"""
)
def combine_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two search metas per labelled document folded into one."""
    both = table(spark, sf_dir, "labels").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    metas = both.select(
        F.col("doc_id").alias("question_id"),
        "s",
        F.when(F.col("s") == 0, "hyde").otherwise("step_back").alias("source"),
        bad.alias("rerank_enabled"),
        good.alias("rerank_applied"),
        F.when(bad, F.concat(F.lit("HTTP 50"), F.col("s").cast("string"))).alias("rerank_error"),
        F.when(good, "hybrid").when(F.col("s") == 1, "dense_fallback").alias("retrieval_mode"),
        F.when(F.col("s") == 1, 15).alias("candidate_k"),
        good.alias("auto_merge_applied"),
        (F.col("quality") * (F.col("s") + 2)).alias("auto_merge_replaced_chunks"),
        F.col("s").alias("auto_merge_steps"),
    )
    return rt.combine_meta(metas, "s")


@query(
    st.with_(st.QUESTIONS, st.INDEX, st.hybrid("hit", "question", "question_id", 5))
    + " SELECT question_id, chunk_id, round(score, 6) AS score, rrf_rank FROM hit"
)
def rrf_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two ranked lists of ten, best five."""
    kb, asked = knowledge_base(spark, sf_dir), questions(spark, sf_dir)
    legs = [rt.dense_hits(kb, asked, 10), rt.sparse_hits(kb, asked, 10)]
    return reciprocal_rank_fusion(legs, "question_id", "chunk_id", 5).withColumn("score", F.round("score", 6))


@query(
    st.with_("question AS (SELECT item_id AS question_id, text AS query FROM benchmark)", st.INDEX, _ASK,
             st.bm25_search("hit", "leaf", "chunk_id", "ask", "question_id", 3))
    + " SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM hit"
)
def bm25_leaf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best leaf chunks per benchmark passage from the stored term counts."""
    kb = knowledge_base(spark, sf_dir)
    return lexical.search(kb.term_rows(), questions(spark, sf_dir), 3, "chunk_id").withColumn("score", F.round("score", 6))


@query(
    st.with_(st.QUESTIONS, _DOC, _ASK, st.bm25_search("hit", "doc", "doc_id", "ask", "question_id", 10))
    + " SELECT question_id, doc_id, round(score, 6) AS score, rank FROM hit"
)
def bm25_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents per benchmark passage from stored posting blocks, those out of reach skipped."""
    documents = sizing.spread_table(table(spark, sf_dir, "documents"), "doc_id")
    index = postings.build(documents, "doc_id", "text", scratch_path(spark, "postings"))
    return postings.search(index, questions(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(
    st.with_("question AS (SELECT item_id AS question_id, text AS query FROM benchmark)", st.INDEX, _ASK,
             st.bm25_search("hit", "leaf", "chunk_id", "ask", "question_id", 3))
    + " SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM hit"
)
def bm25_stored_leaf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best leaf chunks per benchmark passage from stored posting blocks."""
    index = postings.build_counted(knowledge_base(spark, sf_dir).term_rows(), "chunk_id", scratch_path(spark, "leaf-postings"))
    return postings.search(index, questions(spark, sf_dir), 3).withColumn("score", F.round("score", 6))


@query(st.with_(_EMB) + _dense_sql("true"))
def dense_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector from stored k-means cells, those out of reach skipped."""
    corpus, asked = _vectors(spark, sf_dir)
    stored = cells.build(corpus, "vec_id", "embedding", scratch_path(spark, "cells"))
    return cells.search(stored, asked, 5).withColumn("score", F.round("score", 6))

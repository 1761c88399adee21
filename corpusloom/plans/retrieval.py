"""Answering a batch of questions: search, fuse, rerank, merge, grade, rewrite, search again.

The unit of work is a table of questions, not one question: each stage is one distributed pass
for the whole batch, and the rewritten queries of all questions share a second pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import sizing
from corpusloom.session import shared_dir
from corpusloom.functions import text as tx
from corpusloom.functions.models import ChatModel, Embedder, Reranker
from corpusloom.operators import dense, lexical, merge
from corpusloom.operators.curation import ask
from corpusloom.operators.ranking import first_wins, reciprocal_rank_fusion, top_k

# Retrieval parameters.
TOP_K = 5
CANDIDATES = 3
OVERFETCH = 2
RRF_K = 60
LEAF_LEVEL = 3
MERGE_THRESHOLD = 2
SEPARATOR = "\n\n---\n\n"
STEP_BACK_QUESTION = "退步问题："
STEP_BACK_ANSWER = "退步问题答案："


@dataclass(frozen=True)
class KnowledgeBase:
    """Chunk tables to search. ``leaves`` need ``vector`` for the dense leg; ``terms`` may hold the
    stored output of ``lexical.term_rows`` so that texts are not tokenised again. ``has_statistics`` is
    False for a collection that can't be searched by terms."""

    leaves: DataFrame
    parents: DataFrame
    embedder: Embedder
    vector: str = "vector"
    terms: DataFrame | None = None
    has_statistics: bool = True

    def searchable(self) -> DataFrame:
        leaves = self.leaves.filter(F.col("chunk_level") == LEAF_LEVEL)
        if self.vector in leaves.columns:
            return leaves
        return leaves.withColumn(self.vector, self.embedder.embed(F.col("text")))

    def term_rows(self) -> DataFrame:
        if self.terms is not None:
            return self.terms
        return lexical.term_rows(self.leaves.filter(F.col("chunk_level") == LEAF_LEVEL), "chunk_id", "text")


def store_index(chunks: DataFrame, embedder: Embedder, path: str, vector: str = "vector") -> KnowledgeBase:
    """Write the searchable tables of a chunk table and return them.

    Leaves carry their vector and term counts, so a search reads narrow columns and neither embeds
    nor tokenises text again; Bloom filters on the chunk id let lookups of hits skip row groups. Statistics are not stored: they are taken over the whole table at
    search time and so never go stale.
    """
    spark = chunks.sparkSession
    leaves = chunks.filter(F.col("chunk_level") == LEAF_LEVEL).withColumn(vector, embedder.embed(F.col("text")))
    stored_as = {"parquet.bloom.filter.enabled#chunk_id": "true", "compression": "zstd"}
    lexical.add_terms(leaves, "text").write.mode("overwrite").options(**stored_as).parquet(f"{path}/leaves")
    chunks.filter(F.col("chunk_level") != LEAF_LEVEL).write.mode("overwrite").options(**stored_as).parquet(f"{path}/parents")
    stored = spark.read.parquet(f"{path}/leaves")
    return KnowledgeBase(
        stored, spark.read.parquet(f"{path}/parents"), embedder, vector, stored.select("chunk_id", "doc_len", "terms")
    )


@dataclass(frozen=True)
class Settings:
    top_k: int = TOP_K
    rrf_k: int = RRF_K
    mode: str = "hybrid"
    reranker: Reranker | None = None
    auto_merge: bool = True
    threshold: int = MERGE_THRESHOLD
    order_by: str = "rrf"
    merge_score: str = "first"

    @property
    def candidate_k(self) -> int:
        return max(self.top_k * CANDIDATES, self.top_k)


def dense_hits(kb: KnowledgeBase, questions: DataFrame, k: int, question: str = "question_id") -> DataFrame:
    asked = questions.select(question, kb.embedder.embed(F.col("query")).alias("query_vector"))
    return dense.search(kb.searchable(), asked, k, "chunk_id", kb.vector, question)


def sparse_hits(kb: KnowledgeBase, questions: DataFrame, k: int, question: str = "question_id") -> DataFrame:
    return lexical.search(kb.term_rows(), questions, k, "chunk_id", question)


def candidates(kb: KnowledgeBase, questions: DataFrame, settings: Settings, question: str = "question_id") -> DataFrame:
    """(question, chunk_id, score, rrf_rank): the fused candidate list, or the dense list alone.

    Mode "dense_fallback" serves a collection without term statistics; its scores are inner
    products.
    """
    k = settings.candidate_k
    if settings.mode == "dense_fallback":
        return dense_hits(kb, questions, k, question).withColumnRenamed("rank", "rrf_rank")
    if settings.mode != "hybrid":
        raise ValueError(f"unknown retrieval mode {settings.mode!r}")
    legs = [f(kb, questions, k * OVERFETCH, question) for f in (dense_hits, sparse_hits)]
    return reciprocal_rank_fusion(legs, question, "chunk_id", k, settings.rrf_k)


def rerank(hits: DataFrame, questions: DataFrame, settings: Settings, question: str = "question_id") -> DataFrame:
    """Best ``top_k`` candidates in reranked order as ``pos``.

    Without a reranker, and for questions none of whose candidates got a score, the fused order
    stands and ``rerank_score`` is NULL.
    """
    if settings.reranker is None:
        scored = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        asked = questions.select(question, "query")
        scored = hits.join(asked, question).withColumn("rerank_score", settings.reranker.score(F.col("query"), F.col("text")))
        scored = scored.drop("query")
    any_score = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy(question))
    ranked = scored.withColumn("_any", any_score).filter(F.col("rerank_score").isNotNull() | ~F.col("_any"))
    order = [F.desc_nulls_last(F.round("rerank_score", 9)), F.asc("rrf_rank")]
    return top_k(ranked, [question], order, settings.top_k, "pos").drop("_any")


def rerank_by_index(hits: DataFrame, results: DataFrame, top: int, question: str = "question_id") -> DataFrame:
    """Apply a rerank service's answer: rows of (question, reply_order, index, relevance_score).

    ``index`` is the zero-based position in the candidate list; indexes outside it are ignored.
    """
    placed = hits.withColumn("index", F.col("rrf_rank") - 1)
    joined = placed.join(results, [question, "index"]).withColumn("rerank_score", F.col("relevance_score"))
    return top_k(joined, [question], [F.asc("reply_order")], top, "pos").drop("index", "reply_order", "relevance_score")


def small_batch(questions: DataFrame, per_question: int) -> bool:
    """Whether ``per_question`` rows for each question are few enough to broadcast."""
    return sizing.is_small(questions, sizing.MAX_BROADCAST_ROWS // max(per_question, 1))


def retrieve(kb: KnowledgeBase, questions: DataFrame, settings: Settings = Settings(), question: str = "question_id") -> DataFrame:
    """Final hits per question: chunk fields, score, ranks, ``rank`` and the merge bookkeeping.

    Candidates and chosen hits (questions x a few rows) are checkpointed, so the searches run once
    although the later steps look at the hits repeatedly.
    """
    shared_dir(questions.sparkSession)
    return _finished(kb, questions, candidates(kb, questions, settings, question).checkpoint(), settings, question)


def _finished(kb: KnowledgeBase, questions: DataFrame, found: DataFrame, settings: Settings, question: str) -> DataFrame:
    """Reranked and merged hits of stored candidates."""
    small = small_batch(questions, settings.candidate_k)
    leaves = kb.leaves.filter(F.col("chunk_level") == LEAF_LEVEL).select(*merge.CHUNK_FIELDS)
    fields = merge.fetch(leaves, found, "chunk_id", small)
    hits = fields.join(F.broadcast(found) if small else found, "chunk_id")
    chosen = rerank(hits, questions, settings, question).checkpoint()
    return merge.auto_merge(
        chosen, kb.parents, question, settings.top_k, settings.threshold, settings.auto_merge, small,
        settings.order_by, settings.merge_score,
    )


def encoded_questions(kb: KnowledgeBase, questions: DataFrame, question: str = "question_id") -> DataFrame:
    """(question, query, query_vector, retrieval_mode), stored: what each question can be searched by.

    hybrid: it has a vector and terms; dense_fallback: no terms, or a collection without statistics; sparse_fallback: the
    embedder failed on this question alone; failed: neither. A NULL or empty question has no terms.
    """
    shared_dir(questions.sparkSession)
    embed = getattr(kb.embedder, "try_embed", kb.embedder.embed)
    asked = questions.select(question, "query", embed(F.col("query")).alias("query_vector"))
    by_vector = F.col("query_vector").isNotNull()
    by_terms = F.coalesce(F.size(tx.tokens(F.col("query"))) > 0, F.lit(False)) & F.lit(kb.has_statistics)
    mode = (
        F.when(by_vector & by_terms, "hybrid").when(by_vector, "dense_fallback").when(by_terms, "sparse_fallback").otherwise("failed")
    )
    return asked.withColumn("retrieval_mode", mode).checkpoint()


def candidates_by_mode(kb: KnowledgeBase, encoded: DataFrame, settings: Settings, question: str = "question_id") -> DataFrame:
    """``candidates`` of ``encoded_questions``, each by its own mode: fused lists, or the best of the one leg it has.

    One pass per leg serves all questions, whatever their modes; the legs (questions x a few rows) are stored, since the
    fused and the single lists both read them.
    """
    k = settings.candidate_k
    modes = encoded.select(question, "retrieval_mode")
    by_vector = encoded.filter(F.col("retrieval_mode").isin("hybrid", "dense_fallback"))
    by_terms = encoded.filter(F.col("retrieval_mode").isin("hybrid", "sparse_fallback"))
    legs = [dense.search(kb.searchable(), by_vector, k * OVERFETCH, "chunk_id", kb.vector, question)]
    if kb.has_statistics:
        legs.append(sparse_hits(kb, by_terms, k * OVERFETCH, question))
    small = small_batch(modes, 1)
    legs = [leg.join(F.broadcast(modes) if small else modes, question).checkpoint() for leg in legs]
    fused = reciprocal_rank_fusion([leg.filter("retrieval_mode = 'hybrid'") for leg in legs], question, "chunk_id", k, settings.rrf_k)
    for leg in legs:
        alone = leg.filter(F.col("retrieval_mode") != "hybrid").filter(F.col("rank") <= k)
        fused = fused.unionByName(alone.select(question, "chunk_id", "score", F.col("rank").alias("rrf_rank")))
    return fused


def retrieve_with_fallback(
    kb: KnowledgeBase, questions: DataFrame, settings: Settings = Settings(), question: str = "question_id"
) -> tuple[DataFrame, DataFrame]:
    """``retrieve`` with a fallback per question: the hits, and (question, retrieval_mode) of all questions.

    A question that the embedder fails on is searched by its terms, one without terms by its vector, one with neither has no
    hits and mode "failed"; the others are searched as ever. Errors of the engine, such as a lost table, surface.
    """
    encoded = encoded_questions(kb, questions, question)
    found = candidates_by_mode(kb, encoded, settings, question).checkpoint()
    return _finished(kb, questions, found, settings, question), encoded.select(question, "retrieval_mode")


def retrieval_meta(
    questions: DataFrame, hits: DataFrame, settings: Settings, question: str = "question_id", status: DataFrame | None = None
) -> DataFrame:
    """One row per question: what was applied and how much was merged.

    ``status`` holds (question, retrieval_mode) where modes differ between questions; else all have that of the settings.
    """
    per = hits.groupBy(question).agg(F.max("replaced").alias("replaced"), F.max("merge_steps").alias("steps"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    asked = questions.select(question, F.lit(settings.mode).alias("retrieval_mode")) if status is None else status.select(question, "retrieval_mode")
    failed = F.col("retrieval_mode") == "failed"
    return asked.join(per, question, "left").select(
        question,
        F.lit(settings.reranker is not None).alias("rerank_enabled"),
        (F.lit(settings.reranker is not None) & ~failed).alias("rerank_applied"),
        F.when(failed, "retrieve_failed").alias("rerank_error"),
        "retrieval_mode",
        F.lit(settings.candidate_k).alias("candidate_k"),
        F.lit(LEAF_LEVEL).alias("leaf_retrieve_level"),
        F.lit(settings.auto_merge).alias("auto_merge_enabled"),
        (count("replaced") > 0).alias("auto_merge_applied"),
        F.lit(settings.threshold).alias("auto_merge_threshold"),
        count("replaced").alias("auto_merge_replaced_chunks"),
        count("steps").alias("auto_merge_steps"),
    )


def combine_meta(metas: DataFrame, order: str, question: str = "question_id") -> DataFrame:
    """Fold the meta rows of several searches of one question: any, first known, sum, joined errors.

    ``source`` names the search (hyde, step_back) in front of its error.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    errors = F.array_sort(
        F.collect_list(
            F.when(
                F.col("rerank_error").isNotNull(),
                F.struct(order, F.concat_ws(":", "source", "rerank_error").alias("e")),
            )
        )
    )
    return metas.groupBy(question).agg(
        F.bool_or("rerank_enabled").alias("rerank_enabled"),
        F.bool_or("rerank_applied").alias("rerank_applied"),
        F.nullif(F.array_join(F.transform(errors, lambda e: e["e"]), "; "), F.lit("")).alias("rerank_error"),
        first("retrieval_mode"),
        first("candidate_k"),
        F.bool_or("auto_merge_applied").alias("auto_merge_applied"),
        F.sum("auto_merge_replaced_chunks").alias("auto_merge_replaced_chunks"),
        F.sum("auto_merge_steps").alias("auto_merge_steps"),
    )


def format_context(hits: DataFrame, question: str = "question_id", rank: str = "rank") -> DataFrame:
    """(question, context): numbered hits with file and page. At most ten short hits per question."""
    line = F.format_string("[%d] %s (Page %d):\n%s", rank, "filename", "page_number", "text")
    lines = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("at"), line.alias("line"))))
    return hits.groupBy(question).agg(F.array_join(F.transform(lines, lambda x: x["line"]), SEPARATOR).alias("context"))


def tool_answer(contexts: DataFrame, questions: DataFrame, question: str = "question_id") -> DataFrame:
    """What the search tool hands to the agent, also for questions without any hit."""
    answer = F.when(
        F.coalesce("context", F.lit("")) != "", F.concat(F.lit("Retrieved Chunks:\n"), F.col("context"))
    ).otherwise("No relevant documents found in the knowledge base.")
    return questions.select(question).join(contexts, question, "left").select(question, answer.alias("answer"))


def grade_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("Is the passage relevant to the question? Reply with a JSON object holding score, yes or no.\n\nPassage:\n"),
        context, F.lit("\n\nQuestion:\n"), question,
    )


def grade(questions: DataFrame, contexts: DataFrame, grader: ChatModel | None, question: str = "question_id") -> DataFrame:
    """Add context, grade_score, route: only an exact "yes" goes on to answering."""
    joined = questions.join(contexts, question, "left").withColumn("context", F.coalesce("context", F.lit("")))
    if grader is None:
        graded = joined.withColumn("grade_score", F.lit("unknown"))
    else:
        prompt = grade_prompt(F.col("query"), F.col("context"))
        replied = ask(joined, grader, prompt, "score string, binary_score string", "_grade")
        score = F.lower(tx.strip(F.coalesce("_grade.score", "_grade.binary_score", F.lit(""))))
        graded = replied.withColumn("grade_score", score).drop("_grade")
    return graded.withColumn("route", F.when(F.col("grade_score") == "yes", "generate_answer").otherwise("rewrite_question"))


@dataclass(frozen=True)
class Rewriter:
    """The four model calls of a rewrite. A missing model behaves like a failed call."""

    router: ChatModel | None = None
    step_back_question: ChatModel | None = None
    step_back_answer: ChatModel | None = None
    hypothetical: ChatModel | None = None
    strategies: tuple[str, ...] = field(default=("step_back", "hyde", "complex"))


def _said(model: ChatModel | None, prompt: Column) -> Column:
    if model is None:
        return F.lit("")
    return F.coalesce(tx.strip(model.reply(prompt)), F.lit(""))


def rewrite(questions: DataFrame, rewriter: Rewriter) -> DataFrame:
    """Add expansion_type, step_back_question, step_back_answer, expanded_query, hypothetical_doc.

    Each model call has a projection of its own; a call whose result a row does not need gets a
    NULL prompt, which a batch client can skip.
    """
    query = F.col("query")
    task = lambda text, about=query: F.concat(F.lit(text + "\n"), about)
    steps, hypo = F.col("expansion_type").isin("step_back", "complex"), F.col("expansion_type").isin("hyde", "complex")
    out = questions.withColumn("_route", _said(rewriter.router, task("Choose a query expansion strategy: step_back, hyde or complex.")))
    known = F.col("_route").isin(*rewriter.strategies)
    out = out.withColumn("expansion_type", F.when(known, F.col("_route")).otherwise("step_back")).drop("_route")
    out = out.withColumn(
        "step_back_question",
        _said(rewriter.step_back_question, F.when(steps, task("State the general question behind this one."))),
    )
    asked = F.col("step_back_question")
    out = out.withColumn(
        "step_back_answer",
        _said(rewriter.step_back_answer, F.when(asked != "", task("Answer briefly with general principles.", asked))),
    )
    out = out.withColumn(
        "hypothetical_doc",
        _said(rewriter.hypothetical, F.when(hypo, task("Write a passage that could answer this question."))),
    )
    expanded = F.concat(
        query,
        F.lit("\n\n" + STEP_BACK_QUESTION), asked,
        F.lit("\n" + STEP_BACK_ANSWER), F.col("step_back_answer"),
    )
    either = (asked != "") | (F.col("step_back_answer") != "")
    return out.withColumn("expanded_query", F.when(either, expanded).otherwise(query))


def expansion_queries(rewritten: DataFrame, question: str = "question_id") -> DataFrame:
    """The searches a rewrite asks for: (search_id, question, source_order, query), HyDE first."""
    kind = F.col("expansion_type")
    searches = F.array_compact(
        F.array(
            F.when(kind.isin("hyde", "complex"), F.struct(F.lit(0).alias("source_order"), F.col("hypothetical_doc").alias("query"))),
            F.when(kind.isin("step_back", "complex"), F.struct(F.lit(1).alias("source_order"), F.col("expanded_query").alias("query"))),
        )
    )
    rows = rewritten.select(question, F.inline(searches))
    return rows.withColumn("search_id", F.concat_ws("/", F.col(question).cast("string"), "source_order"))


def merge_expanded(hits: DataFrame, question: str = "question_id") -> DataFrame:
    """One list per question from its searches: first occurrence wins, ranks renumbered in list order."""
    order = [F.asc("source_order"), F.asc("rank")]
    unique = first_wins(hits, [question, "filename", "page_number", "text"], order)
    renumbered = F.row_number().over(Window.partitionBy(question).orderBy(*order))
    return unique.withColumn("_at", renumbered).drop("rank", "rrf_rank").withColumnRenamed("_at", "rank")


def retrieve_expanded(
    kb: KnowledgeBase, rewritten: DataFrame, settings: Settings = Settings(), question: str = "question_id"
) -> DataFrame:
    shared_dir(rewritten.sparkSession)
    searches = expansion_queries(rewritten, question).checkpoint()  # the models behind them are asked once
    hits = retrieve(kb, searches.select("search_id", "query"), settings, "search_id")
    named = hits.join(searches.select("search_id", question, "source_order"), "search_id")
    return merge_expanded(named.drop("search_id"), question)


def answer_contexts(
    kb: KnowledgeBase,
    questions: DataFrame,
    grader: ChatModel | None,
    rewriter: Rewriter = Rewriter(),
    settings: Settings = Settings(),
    question: str = "question_id",
) -> DataFrame:
    """The whole flow: (question, query, route, stage, expansion_type, context) for every question.

    Rows carrying model replies are checkpointed: a model is asked once per question.
    """
    first = format_context(retrieve(kb, questions, settings, question), question)
    graded = grade(questions, first, grader, question).checkpoint()
    done = graded.filter("route = 'generate_answer'").select(
        question, "query", "route", F.lit("initial").alias("stage"), F.lit(None).cast("string").alias("expansion_type"), "context"
    )
    rewritten = rewrite(graded.filter("route = 'rewrite_question'"), rewriter).checkpoint()
    second = format_context(retrieve_expanded(kb, rewritten, settings, question), question)
    again = rewritten.drop("context").join(second, question, "left").select(
        question, "query", "route", F.lit("expanded").alias("stage"), "expansion_type", F.coalesce("context", F.lit("")).alias("context")
    )
    return done.unionByName(again)


def register_search(kb: KnowledgeBase, name: str = "search_knowledge_base") -> None:
    """A SQL table function ``name(query STRING, k INT)`` over the BM25 leg.

    It is a plain SQL function on two temporary views, so Catalyst plans it with the calling query.
    """
    spark = kb.leaves.sparkSession
    lexical.postings(kb.term_rows(), "chunk_id").createOrReplaceTempView(f"{name}_postings")
    kb.leaves.filter(F.col("chunk_level") == LEAF_LEVEL).createOrReplaceTempView(f"{name}_leaves")
    spark.sql(
        rf"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, k INT)
        RETURNS TABLE(chunk_id STRING, text STRING, score DOUBLE, rank INT)
        RETURN
        WITH asked AS (
          SELECT token, count(*) AS q_tf, any_value(n) AS q_len
          FROM (SELECT explode(w) AS token, size(w) AS n
                FROM (SELECT regexp_extract_all(lower(q), r'{tx.TOKEN_PATTERN}', 1) AS w))
          GROUP BY token),
        totals AS (
          SELECT count(*) AS n_docs, coalesce(avg(size(regexp_extract_all(lower(text), r'{tx.TOKEN_PATTERN}', 1))), 1D) AS avg_len
          FROM {name}_leaves),
        known AS (
          SELECT p.token, count(*) AS df FROM {name}_postings p LEFT SEMI JOIN asked a ON p.token = a.token GROUP BY p.token),
        weighted AS (
          SELECT a.token, avg_len, ln((n_docs - df + 0.5D) / (df + 0.5D) + 1D) AS idf,
                 q_tf * 2.5D / (q_tf + 1.5D * (0.25D + 0.75D * q_len / greatest(avg_len, 1D))) AS q_part
          FROM asked a JOIN known k2 ON a.token = k2.token JOIN totals),
        scored AS (
          SELECT p.chunk_id, sum(w.idf * w.idf * w.q_part * p.tf * 2.5D
                 / (p.tf + 1.5D * (0.25D + 0.75D * p.doc_len / greatest(w.avg_len, 1D)))) AS score
          FROM {name}_postings p JOIN weighted w ON p.token = w.token GROUP BY p.chunk_id),
        ranked AS (
          SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
        SELECT r.chunk_id, l.text, r.score, r.rank FROM ranked r JOIN {name}_leaves l ON r.chunk_id = l.chunk_id
        WHERE r.rank <= k
        """
    )

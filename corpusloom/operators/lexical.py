"""BM25 over a corpus table: statistics, weights and top-k search.

Term counts are built inside each row, so the only shuffles are one over the vocabulary (document
frequency) and one that brings the few survivors of each query together. Query terms are keyed by
the token string, and statistics always describe the whole corpus given.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom import sizing
from corpusloom.functions import arrays, text as tx
from corpusloom.operators import blocks
from corpusloom.operators.ranking import by_score, top_k
from corpusloom.session import scratch_path

K1 = 1.5
B = 0.75
TEXT_STEP = 512
#: Products of postings and questions that are held at a time, unless a single text has more; they fit a core's cache.
PRODUCTS = 1 << 18
#: Weights of a cell's questions that are held at a time, unless a single question has more.
WEIGHTS = 1 << 22
ROW_BYTES = 64  # of a weighted query term, about
TERM_BYTES = 32  # of a text's term, about
CELL_BYTES = 32 * 1024 * 1024


def add_terms(df: DataFrame, text: str) -> DataFrame:
    """Add ``doc_len`` and ``terms`` (token counts) of a text column, row by row."""
    counted = df.withColumn("_tokens", tx.tokens(F.coalesce(text, F.lit(""))))
    return counted.withColumns({"doc_len": F.size("_tokens"), "terms": arrays.counts(F.col("_tokens"))}).drop("_tokens")


def term_rows(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, doc_len, terms): one row per text with its term counts, no shuffle."""
    return add_terms(df.select(item, F.col(text).alias("_text")), "_text").select(item, "doc_len", "terms")


def postings(rows: DataFrame, item: str) -> DataFrame:
    """(item, doc_len, token, tf) from ``term_rows``.

    The outer generator is deliberate: Spark infers ``size(terms) > 0`` below a plain one and
    would evaluate the whole term expression once more for that filter.
    """
    return rows.select(item, "doc_len", F.inline_outer("terms")).filter("token is not null")


def document_frequency(rows: DataFrame) -> DataFrame:
    tokens = rows.select(F.explode_outer("terms.token").alias("token")).filter("token is not null")
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


def corpus_totals(rows: DataFrame) -> DataFrame:
    """One row: number of texts and their mean token count (1 for an empty corpus)."""
    return rows.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.avg(F.col("doc_len").cast("double")), F.lit(1.0)).alias("avg_len"),
    )


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); ln(N + 1) for a token the corpus lacks."""
    n = n_docs.cast("double")
    seen = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    return F.when(F.coalesce(df, F.lit(0)) == 0, F.ln(n + 1.0)).otherwise(seen)


def saturation(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """Term-frequency part of the BM25 weight."""
    norm = (1.0 - B) + B * doc_len / F.greatest(avg_len, F.lit(1.0))
    return tf * (K1 + 1.0) / (tf + K1 * norm)


def saturated(tf: np.ndarray, doc_len: np.ndarray, avg_len: float) -> np.ndarray:
    """``saturation`` inside tasks."""
    return tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * doc_len / max(avg_len, 1.0)))


def _with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add n_docs and avg_len from one scalar subquery."""
    both = totals.select(F.struct("n_docs", "avg_len")).scalar()
    return df.withColumn("_totals", both).select("*", "_totals.n_docs", "_totals.avg_len").drop("_totals")


def weights(rows: DataFrame, item: str) -> DataFrame:
    """Sparse vector of every text in long form: (item, token, weight), weights above zero only."""
    counted = sizing.counted_key_join(postings(rows, item), document_frequency(rows), "token", "df", [item])
    scored = _with_totals(counted, corpus_totals(rows)).withColumn(
        "weight", idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    )
    return scored.filter("weight > 0").select(item, "token", "tf", "df", "weight")


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, q_len, token, q_tf) of the question batch."""
    return postings(term_rows(queries, query, text), query).select(
        query, F.col("doc_len").alias("q_len"), "token", F.col("tf").alias("q_tf")
    )


def query_weights(terms: DataFrame, rows: DataFrame, query: str, small: bool) -> DataFrame:
    """Weight of each query term against the corpus: (query, token, idf, q_weight, avg_len).

    ``small`` says that the terms were measured to fit a broadcast; then only the queries' own
    vocabulary is counted in the corpus.
    """
    vocabulary = terms.select("token").distinct()
    frequency = document_frequency(rows)
    if small:
        corpus_tokens = rows.select(F.explode_outer("terms.token").alias("token"))
        found = corpus_tokens.join(F.broadcast(vocabulary), "token", "left_semi").groupBy("token")
        frequency = found.agg(F.count("*").alias("df"))
    known = terms.join(frequency, "token", "left")
    return (
        _with_totals(known, corpus_totals(rows))
        .withColumn("idf", idf(F.col("n_docs"), F.col("df")))
        .withColumn("q_weight", F.col("idf") * saturation(F.col("q_tf"), F.col("q_len"), F.col("avg_len")))
        .filter("q_weight > 0")
        .select(query, "token", "idf", "q_weight", "avg_len", "df")
    )


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    item: str,
    query: str = "question_id",
    text: str = "query",
    max_broadcast_bytes: int = sizing.MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Best ``k`` texts per query by the inner product of BM25 vectors: (query, item, score, rank).

    ``rows`` is the output of ``term_rows``, whose terms of a text lie in one row; they are made once and stored under the
    shared folder, from where the statistics and the scores read them. When the batch's terms are measured to fit, they are
    broadcast and every task scores its texts on its own, handing on at most k per query: the corpus is not shuffled. A larger
    batch is dealt into shards of queries that fit, one pass over the texts each. ``max_broadcast_bytes=0`` asks for no
    broadcast at all: both sides are shuffled onto a grid of bounded cells, each of which hands on at most k texts per query.
    """
    terms = query_terms(queries, query, text)
    count, size = sizing.measure(terms)
    small = count <= sizing.MAX_BROADCAST_ROWS and size <= max_broadcast_bytes
    rows = _stored(rows, item)
    weighted = query_weights(terms, rows, query, small)
    if max_broadcast_bytes == 0:
        scored = _score_grid(rows, weighted.checkpoint(), k, item, query)
    else:
        if not small:
            weighted = weighted.checkpoint()
            count = weighted.count()
            size = count * ROW_BYTES
        shards = max(1, -(-size // max_broadcast_bytes), -(-count // sizing.MAX_BROADCAST_ROWS))
        shard = F.pmod(F.xxhash64(query), F.lit(shards))
        parts = [weighted.filter(shard == i) if shards > 1 else weighted for i in range(shards)]
        scored = functools.reduce(DataFrame.unionAll, (_score_blocks(rows, p, k, item, query, max_broadcast_bytes) for p in parts))
    return top_k(scored, [query], by_score("score", item), k).select(query, item, "score", "rank")


def _stored(rows: DataFrame, item: str) -> DataFrame:
    """``term_rows`` and their number of terms, written once: making the terms costs far more than reading them again."""
    path, counted = scratch_path(rows.sparkSession, "terms"), rows.select(item, "doc_len", "terms", F.size("terms").alias("n_terms"))
    counted.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(counted.schema).parquet(path)


def _score_grid(rows: DataFrame, weighted: DataFrame, k: int, item: str, query: str) -> DataFrame:
    """Query shard x text bucket cells, each small enough for one task and a task of its own."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    asked = weighted.count() * ROW_BYTES
    stored = rows.agg(F.sum(F.col("n_terms").cast("long") * TERM_BYTES + ROW_BYTES)).first()[0] or 0
    shards = max(1, -(-asked // CELL_BYTES))
    buckets = max(-(-stored // CELL_BYTES), -(-cores // shards))
    shape = blocks.hit_schema(weighted.schema[query], rows.schema[item])
    schema = blocks.arrow_schema(shape)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    texts = rows.select(item, "doc_len", F.col("terms.token").alias("tokens"), F.col("terms.tf").alias("tfs")).filter("n_terms > 0")
    placed_texts = texts.withColumn("_bucket", F.pmod(F.xxhash64(item), F.lit(buckets).cast("long"))).withColumn("_shard", every(shards))
    placed_queries = weighted.select(
        query, "token", (F.col("idf") * F.col("q_weight")).alias("w"), "avg_len", F.pmod(F.xxhash64(query), F.lit(shards).cast("long")).alias("_shard")
    ).withColumn("_bucket", every(buckets))

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        hits = []
        if asked.num_rows and found.num_rows:
            mean = max(asked.column("avg_len")[0].as_py(), 1.0)
            for ids, vocabulary, matrix in _matrices(asked):
                best = blocks.Best(k)
                for batch in found.to_batches(max_chunksize=blocks.ROW_STEP):
                    _score_batch(best, batch, mean, [(0, vocabulary, matrix)])
                hits += best.emit(ids, schema)
        return pa.Table.from_batches(hits, schema=schema)

    cell, tasks = ["_shard", "_bucket"], shards * buckets  # a number given is kept: cells are few bytes but much work
    return (
        placed_queries.repartition(tasks, *cell)
        .groupBy(*cell)
        .cogroup(placed_texts.repartition(tasks, *cell).groupBy(*cell))
        .applyInArrow(score, shape)
    )


def _matrices(weighted: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(query ids, vocabulary, weights) of consecutive queries, a dense matrix of a bounded size unless one query has more terms."""
    ids, number = np.unique(blocks.ids_of(weighted.column(0).combine_chunks()), return_inverse=True)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number, minlength=len(ids)))
    tokens, weights_ = weighted.column("token").combine_chunks(), weighted.column("w").to_numpy()
    first = 0
    while first < len(ids):
        begin = ends[first - 1] if first else 0
        n = np.arange(1, min(blocks.QUERY_STEP, len(ids) - first) + 1)
        last = first + max(1, int(np.count_nonzero(n * (ends[first : first + len(n)] - begin) <= WEIGHTS)))
        here = order[begin : ends[last - 1]]
        coded = tokens.take(pa.array(here)).dictionary_encode()
        matrix = np.zeros((len(coded.dictionary), last - first))
        matrix[coded.indices.to_numpy(zero_copy_only=False), number[here] - first] = weights_[here]
        yield ids[first:last], coded.dictionary, matrix
        first = last


def _score_blocks(rows: DataFrame, weighted: DataFrame, k: int, item: str, query: str, max_bytes: int) -> DataFrame:
    """Scores of the texts against blocks of queries, each block with its own small vocabulary.

    A block's weights are a dense matrix. Blocks are broadcast together up to ``max_bytes`` of matrices, the
    next ones in a pass of their own.
    """
    shape = blocks.hit_schema(weighted.schema[query], rows.schema[item])
    schema = blocks.arrow_schema(shape)
    table = weighted.select(query, "token", (F.col("idf") * F.col("q_weight")).alias("w"), "avg_len").toArrow()
    ids = np.array([])
    groups: list[list[tuple[int, pa.Array, np.ndarray]]] = [[]]
    held = 0
    avg_len = 1.0
    if table.num_rows:
        avg_len = max(table.column("avg_len")[0].as_py(), 1.0)
        tokens = table.column("token").combine_chunks()
        weights_ = table.column("w").to_numpy()
        ids, number = np.unique(blocks.ids_of(table.column(0).combine_chunks()), return_inverse=True)
        for block, at in enumerate(range(0, len(ids), blocks.QUERY_STEP)):
            here = np.nonzero((number >= at) & (number < at + blocks.QUERY_STEP))[0]
            coded = tokens.take(pa.array(here)).dictionary_encode()
            matrix = np.zeros((len(coded.dictionary), min(blocks.QUERY_STEP, len(ids) - at)))
            matrix[coded.indices.to_numpy(zero_copy_only=False), number[here] - at] = weights_[here]
            if held and held + matrix.nbytes > max_bytes:
                groups.append([])
                held = 0
            groups[-1].append((block, coded.dictionary, matrix))
            held += matrix.nbytes
    scored = (_score_group(rows, item, shape, schema, k, ids, avg_len, group) for group in groups)
    return functools.reduce(DataFrame.unionAll, scored)


def _score_group(
    rows: DataFrame, item: str, shape: T.StructType, schema: pa.Schema, k: int, ids: np.ndarray, avg_len: float, group: list[tuple[int, pa.Array, np.ndarray]]
) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, avg_len, group))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, mean, query_blocks = shared.value
        best = blocks.Best(k)
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.ROW_STEP):
                _score_batch(best, batch.slice(at, blocks.ROW_STEP), mean, query_blocks)
        yield from best.emit(query_ids, schema)

    return rows.select(item, "doc_len", F.col("terms.token").alias("tokens"), F.col("terms.tf").alias("tfs")).mapInArrow(score, shape)


def _score_batch(best: blocks.Best, batch: pa.RecordBatch, mean: float, query_blocks: list[tuple[int, pa.Array, np.ndarray]]) -> None:
    lists = batch.column(2)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    tokens = pc.list_flatten(lists)
    tf = pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.float64)
    length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
    norm = K1 * ((1.0 - B) + B * length / mean)
    weight = tf * (K1 + 1.0) / (tf + norm[owner])
    items = blocks.ids_of(batch.column(0))
    for block, vocabulary, matrix in query_blocks:
        found = pc.index_in(tokens, value_set=vocabulary)
        known = np.nonzero(found.is_valid().to_numpy(zero_copy_only=False))[0]
        if not len(known):
            continue
        places = found.take(pa.array(known)).to_numpy(zero_copy_only=False)
        texts, starts = np.unique(owner[known], return_index=True)
        bounds = np.append(starts, len(known))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PRODUCTS // matrix.shape[1], side="right")) - 1)
            span = slice(bounds[first], bounds[last])
            parts = matrix[places[span]] * weight[known[span], None]
            sums = np.add.reduceat(parts, starts[first:last] - bounds[first], axis=0)
            best.feed(block, items[texts[first:last]], sums, positive=True)
            first = last

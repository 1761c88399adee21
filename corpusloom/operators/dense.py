"""Exact top-k by inner product.

Scoring is a block matrix product inside Arrow tasks that keeps a running top-k, so a task emits
at most k rows per query however many vectors it reads; a window then merges the survivors. The
question batch reaches the tasks as a broadcast matrix when it is measured to fit; beyond that
both sides are shuffled onto a grid of bounded cells, which gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom import sizing
from corpusloom.operators import blocks
from corpusloom.operators.ranking import by_score, top_k
from corpusloom.session import shared_dir

CELL_BYTES = 32 * 1024 * 1024
#: A cell of more pairs is cut while there are fewer than four cells per core.
CELL_PAIRS = 1 << 24


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    item: str,
    vector: str,
    query: str = "question_id",
    query_vector: str = "query_vector",
    max_broadcast_bytes: int = sizing.MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Best ``k`` corpus vectors per query: (query, item, score, rank). Filter the corpus first.

    Query ids must be unique. Vectors that are NULL are skipped on either side.
    """
    corpus = corpus.select(item, F.col(vector).cast("array<double>").alias("_v")).filter("_v is not null")
    queries = queries.select(query, F.col(query_vector).cast("array<double>").alias("_q")).filter("_q is not null")
    shape = blocks.hit_schema(queries.schema[query], corpus.schema[item])
    shared_dir(queries.sparkSession)
    queries = queries.checkpoint()  # the embedder behind the vectors is asked once
    if fits(queries, k, max_broadcast_bytes):
        best = _scan(corpus, queries, k, shape)
    else:
        best = _grid(corpus, queries, k, item, query, shape)
    return top_k(best, [query], by_score("score", item), k)


def fits(queries: DataFrame, k: int, max_bytes: int = sizing.MAX_BROADCAST_BYTES) -> bool:
    """Whether a task can hold all questions with their ``k`` hits each."""
    rows, size = sizing.measure(queries)
    return rows <= sizing.MAX_BROADCAST_ROWS and size + rows * k * blocks.HIT_BYTES <= max_bytes


def _scan(corpus: DataFrame, queries: DataFrame, k: int, shape: T.StructType) -> DataFrame:
    table = queries.toArrow()
    ids = np.array([])
    matrix = np.zeros((0, 0))
    if table.num_rows:
        ids, matrix = blocks.ids_of(table.column(0).combine_chunks()), _matrix(table.column(1).combine_chunks())
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = blocks.arrow_schema(shape)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        best = blocks.Nearest(query_matrix, k)
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.ROW_STEP):
                part = batch.slice(at, blocks.ROW_STEP)
                best.feed(blocks.ids_of(part.column(0)), _matrix(part.column(1)))
        yield from best.emit(query_ids, schema)

    return corpus.mapInArrow(score, shape)


def _grid(corpus: DataFrame, queries: DataFrame, k: int, item: str, query: str, shape: T.StructType) -> DataFrame:
    """Query shard x corpus bucket cells, each small enough for one task and a task of its own."""

    def rows_and_bytes(df: DataFrame, col: str, more: int = 0) -> tuple[int, int]:
        row = df.agg(F.count("*"), F.sum(F.size(col).cast("long") * 8 + 64 + more)).first()
        return row[0], row[1] or 0

    asked, asked_bytes = rows_and_bytes(queries, "_q", k * blocks.HIT_BYTES)
    stored, stored_bytes = rows_and_bytes(corpus, "_v")
    shards, buckets = max(1, -(-asked_bytes // (2 * CELL_BYTES))), max(1, -(-stored_bytes // CELL_BYTES))
    while shards * buckets < 4 * corpus.sparkSession.sparkContext.defaultParallelism and asked * stored > shards * buckets * CELL_PAIRS:
        # A shard more sends the corpus once more, a bucket more the questions and their hits.
        if stored_bytes * shards <= asked_bytes * buckets:
            shards *= 2
        else:
            buckets *= 2
    lit = lambda n: F.lit(n).cast("long")
    placed_queries = queries.withColumn("_shard", F.pmod(F.xxhash64(query), lit(shards))).withColumn(
        "_bucket", F.explode(F.sequence(lit(0), lit(buckets - 1)))
    )
    placed_corpus = corpus.withColumn("_bucket", F.pmod(F.xxhash64(item), lit(buckets))).withColumn(
        "_shard", F.explode(F.sequence(lit(0), lit(shards - 1)))
    )
    schema = blocks.arrow_schema(shape)

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return schema.empty_table()
        best = blocks.Nearest(_matrix(asked.column(1).combine_chunks()), k)
        for batch in found.to_batches(max_chunksize=blocks.ROW_STEP):
            best.feed(blocks.ids_of(batch.column(0)), _matrix(batch.column(1)))
        return pa.Table.from_batches(best.emit(blocks.ids_of(asked.column(0).combine_chunks()), schema), schema=schema)

    cell, tasks = ["_shard", "_bucket"], shards * buckets  # a number given is kept: cells are few bytes but much work
    return (
        placed_queries.select(query, "_q", *cell)
        .repartition(tasks, *cell)
        .groupBy(*cell)
        .cogroup(placed_corpus.select(item, "_v", *cell).repartition(tasks, *cell).groupBy(*cell))
        .applyInArrow(score, shape)
    )

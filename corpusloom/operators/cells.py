"""Exact vector search over stored k-means cells.

``build`` puts every vector into the cell of its nearest centre and keeps each cell's centre c and radius r, the largest
distance of a member. No member of a cell scores more than ``q.c + |q| r`` against a question q. ``search`` first reads the
cells of the highest such bounds that together hold k vectors for some question; their k-th score is the question's floor. Then
it reads only cells whose bound reaches the floor of some question, and within a cell scores only the questions whose floor
it reaches. Centres come from a bounded sample; results don't depend on them, only the number of vectors read does.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import sizing
from corpusloom.operators import blocks, dense
from corpusloom.operators.ranking import by_score, top_k
from corpusloom.session import shared_dir

#: Bounds of what the driver holds: vectors that train the centres, and centres.
SAMPLE = 20_000
MAX_CELLS = 1024
ROUNDS = 12
SLACK = 1e-9


class Cells(NamedTuple):
    """Stored vectors by cell, and per cell its number, size, radius and centre."""

    vectors: DataFrame  # item, vector, cell
    table: DataFrame  # cell, n, radius, centre
    item: str


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from distinct vectors of the sample; a cell that gets empty keeps its centre."""
    distinct = np.unique(sample, axis=0)
    draw = np.random.default_rng(seed)
    found = distinct[draw.permutation(len(distinct))[:cells]].copy()
    for _ in range(rounds):
        near = _nearest(sample, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(found))
        found[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return found


def _nearest(vectors: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each vector, and the distance to it."""
    near = np.argmin((found * found).sum(axis=1) - 2 * vectors @ found.T, axis=1)
    return near, np.sqrt(((vectors - found[near]) ** 2).sum(axis=1))


def build(corpus: DataFrame, item: str, vector: str, path: str, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Write all vectors by cell under ``path``, a new folder that all executors share.

    Null vectors are left out. ``cells`` defaults to the square root of the number of vectors, ``MAX_CELLS`` at most; the
    centres are fitted on about ``sample`` vectors, chosen by the hash of their item. A cell may hold any share of all vectors:
    its rows are dealt to files by item.
    """
    spark = corpus.sparkSession
    rows = corpus.select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("vector")).filter("vector is not null")
    n = rows.count()
    cells = min(cells or max(1, int(n**0.5)), MAX_CELLS)
    chosen = rows.filter(F.pmod(F.xxhash64("item", F.lit("cells")), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))) if n > sample else rows
    fitted = _matrix(chosen.select("vector").toArrow().column(0).combine_chunks())
    shared = spark.sparkContext.broadcast(centres(fitted, cells) if len(fitted) else np.zeros((1, 0)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.ROW_STEP):
                part = batch.slice(at, blocks.ROW_STEP)
                near, far = _nearest(_matrix(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["item", "vector", "cell", "far"])

    kinds = dict(rows.dtypes)
    dealt = rows.mapInArrow(placed, f"item {kinds['item']}, vector array<double>, cell int, far double")
    dealt.repartitionByRange("cell", "item").write.partitionBy("cell").parquet(os.path.join(path, "vectors"))
    stored = spark.read.schema(dealt.schema).parquet(os.path.join(path, "vectors"))
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toArrow().sort_by("cell").to_pylist()  # MAX_CELLS rows
    described = [(r["cell"], r["n"], r["radius"], [float(x) for x in shared.value[r["cell"]]]) for r in sizes]
    spark.createDataFrame(described, "cell int, n long, radius double, centre array<double>").coalesce(1).write.parquet(os.path.join(path, "cells"))
    return open_cells(spark, path, item, kinds["item"])


def open_cells(spark: SparkSession, path: str, item: str, kind: str = "long") -> Cells:
    shape = f"item {kind}, vector array<double>, far double, cell int"
    return Cells(spark.read.schema(shape).parquet(os.path.join(path, "vectors")), spark.read.parquet(os.path.join(path, "cells")), item)


def _pass(
    stored: DataFrame, wanted: list[int], asked: tuple[np.ndarray, ...], reach: dict[int, np.ndarray], k: int, schema: pa.Schema, shape
) -> DataFrame:
    """Best ``k`` rows of the wanted cells per task and question; ``reach`` holds a bit per question for each cell."""
    shared = stored.sparkSession.sparkContext.broadcast((*asked, reach))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, floor, of_cell = shared.value
        best = blocks.Nearest(matrix, k, floor)
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                part = batch.filter(pa.array(cells == cell))
                reached = np.unpackbits(of_cell[cell], count=len(ids)).astype(bool)
                for at in range(0, part.num_rows, blocks.ROW_STEP):
                    some = part.slice(at, blocks.ROW_STEP)
                    best.feed(blocks.ids_of(some.column(0)), _matrix(some.column(1)), reached)
        yield from best.emit(ids, schema)

    return stored.filter(F.col("cell").isin(wanted)).select("item", "vector", "cell").mapInArrow(score, shape)


def search(
    cells: Cells, queries: DataFrame, k: int, query: str = "question_id", query_vector: str = "query_vector",
    max_broadcast_bytes: int = sizing.MAX_BROADCAST_BYTES, report: dict[str, int] | None = None,
) -> DataFrame:
    """Best ``k`` vectors per question: (query, item, score, rank), ties by item; exact.

    Question ids are unique; null vectors are skipped. ``report`` receives the pairs of questions and vectors there are
    (``all``) and the ones that were scored (``floor``, ``near``). A batch of questions beyond the bound is searched without
    cells, on a grid of bounded blocks, with the same result.
    """
    shared_dir(queries.sparkSession)
    asked = queries.select(query, F.col(query_vector).cast("array<double>").alias("_q")).filter("_q is not null").checkpoint()
    stored = cells.vectors.withColumnRenamed("item", cells.item)
    if not dense.fits(asked, k, max_broadcast_bytes):
        return dense.search(stored, asked, k, cells.item, "vector", query, "_q", max_broadcast_bytes)
    stored = stored.select(F.col(cells.item).alias("item"), "vector", "cell")
    shape = blocks.hit_schema(asked.schema[query], cells.vectors.schema["item"])
    schema = blocks.arrow_schema(shape)
    table, known = asked.toArrow(), cells.table.toArrow()
    name = lambda df: df.withColumnRenamed("item", cells.item)
    if not table.num_rows or not known.num_rows:
        return top_k(name(queries.sparkSession.createDataFrame([], shape)), [query], by_score("score", cells.item), k)
    ids, matrix = blocks.ids_of(table.column(0).combine_chunks()), _matrix(table.column(1).combine_chunks())
    number, n, radius = (known.column(c).to_numpy() for c in ("cell", "n", "radius"))
    centre = _matrix(known.column("centre").combine_chunks())
    length = np.sqrt((matrix * matrix).sum(axis=1))

    chosen = np.zeros((len(known), len(ids)), dtype=bool)
    steps = range(0, len(ids), blocks.QUERY_STEP)
    bound_of = lambda at: matrix[at : at + blocks.QUERY_STEP] @ centre.T + length[at : at + blocks.QUERY_STEP, None] * radius + SLACK
    for at in steps:
        order = np.argsort(-bound_of(at), axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]  # vectors in the cells of higher bounds
        rows, places = np.nonzero(before < k)
        chosen[order[rows, places], at + rows] = True
    packed = lambda reached: {int(number[c]): np.packbits(reached[c]) for c in np.flatnonzero(reached.any(axis=1))}
    floor = np.full(len(ids), -np.inf)
    reach = packed(chosen)
    found = _pass(stored, sorted(reach), (ids, matrix, floor.copy()), reach, k, schema, shape)
    found = top_k(name(found), [query], by_score("score", cells.item), k).checkpoint()
    kth = found.filter(F.col("rank") == k).select(query, "score").toArrow()
    place = {q: i for i, q in enumerate(ids.tolist())}
    for q, s in zip(kth.column(0).to_pylist(), kth.column(1).to_pylist()):
        floor[place[q]] = s - SLACK
    rest = np.zeros_like(chosen)
    for at in steps:
        rest[:, at : at + blocks.QUERY_STEP] = (bound_of(at) >= floor[at : at + blocks.QUERY_STEP, None]).T
    rest &= ~chosen  # those pairs are in ``found``
    reach = packed(rest)
    more = name(_pass(stored, sorted(reach), (ids, matrix, floor - SLACK), reach, k, schema, shape))
    if report is not None:
        report |= {"all": len(ids) * int(n.sum()), "floor": int(chosen.sum(axis=1) @ n), "near": int(rest.sum(axis=1) @ n)}
    return top_k(found.drop("rank").unionByName(more.drop("rank") if "rank" in more.columns else more), [query], by_score("score", cells.item), k)

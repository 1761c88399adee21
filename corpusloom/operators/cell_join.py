"""Exact top-k between two vector tables of any size, over stored cells.

Neither side is broadcast, and not all pairs are scored. The cells of the highest bounds that together hold k vectors give each
anchor a floor, its k-th score there; after that an anchor meets only cells whose bound ``q.c + |q| r`` reaches its floor.
Cells are packed into bins of bounded size and larger ones are cut into slices, one bin each, so an anchor is sent once per
bin that it reaches; a bin's anchors are dealt to shards of bounded size. What the driver holds are the cells' descriptions
and the numbers of anchors per bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.operators import blocks
from corpusloom.operators.cells import SLACK, Cells, _matrix
from corpusloom.operators.dense import CELL_BYTES
from corpusloom.operators.ranking import SCORE_DIGITS, by_score, top_k
from corpusloom.session import shared_dir

#: Rows that a task hands on at a time while it deals anchors to bins.
DEALT_ROWS = 4096


def bins(sizes: np.ndarray, room: float) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of each cell: cells share a bin while they fit in, a cell beyond ``room`` has several."""
    first, parts, at, filled = [], [], 0, 0.0
    for size in sizes.tolist():
        slices = max(1, int(np.ceil(size / room)))
        if filled and (slices > 1 or filled + size > room):
            at, filled = at + 1, 0.0
        first.append(at)
        parts.append(slices)
        if slices > 1:
            at += slices
        else:
            filled += size
    return np.array(first, dtype=np.int64), np.array(parts, dtype=np.int64)


def _bounds(vectors: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    return vectors @ centre.T + np.sqrt((vectors * vectors).sum(axis=1))[:, None] * radius + SLACK


def _nonzero_lists(wanted: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(wanted.sum(axis=1))]).astype(np.int32), np.nonzero(wanted)[1].astype(np.int32))


def nearest(cells: Cells, anchors: DataFrame, k: int, anchor: str, vector: str, report: dict[str, int] | None = None, bin_bytes: int = CELL_BYTES) -> DataFrame:
    """Best ``k`` stored vectors per anchor: (anchor, item, score, rank), ties by item; exact.

    Anchor ids are unique; null vectors are skipped on either side, empty tables give no rows. ``report`` receives the pairs
    there are (``all``) and those scored for the floors and beyond (``floor``, ``near``).
    """
    spark = anchors.sparkSession
    shared_dir(spark)
    item = cells.item
    asked = anchors.select(anchor, F.col(vector).cast("array<double>").alias("_q")).filter("_q is not null")
    shape = blocks.hit_schema(asked.schema[anchor], T.StructField(item, cells.vectors.schema["item"].dataType))
    known = cells.table.orderBy("cell").toArrow()  # MAX_CELLS rows
    if not known.num_rows:
        return top_k(spark.createDataFrame([], shape), [anchor], by_score("score", item), k)
    number, n, radius = (known.column(c).to_numpy() for c in ("cell", "n", "radius"))
    centre = _matrix(known.column("centre").combine_chunks())
    width = 8 * centre.shape[1] + 64
    room = max(width, min(bin_bytes, int(n.sum()) * width / (2 * spark.sparkContext.defaultParallelism)))
    first_bin, parts = bins(n * width, room)
    described = spark.sparkContext.broadcast((centre, radius, n, first_bin, parts))
    placed = spark.createDataFrame(list(zip(number.tolist(), range(len(number)), first_bin.tolist(), parts.tolist())), "cell int, _cell int, _first long, _parts long")
    stored = cells.vectors.select(F.col("item").alias(item), F.col("vector").alias("_v"), "cell").join(F.broadcast(placed), "cell")
    stored = stored.withColumn("_bin", F.col("_first") + F.pmod(F.xxhash64(item), "_parts")).select(item, "_v", "_cell", "_bin")
    kind = dict(asked.dtypes)[anchor]

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, radius, n, _, _ = described.value
        for batch in batches:
            for at in range(0, batch.num_rows, blocks.QUERY_STEP):
                part = batch.slice(at, blocks.QUERY_STEP)
                order = np.argsort(-_bounds(_matrix(part.column(1)), centre, radius), axis=1, kind="stable")
                wanted = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(wanted, order, np.cumsum(n[order], axis=1) - n[order] < k, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, _nonzero_lists(wanted)], names=[anchor, "_q", "_read"])

    def dealt(beyond: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, radius, _, first_bin, parts = described.value
            for batch in batches:
                for at in range(0, batch.num_rows, blocks.QUERY_STEP):
                    part = batch.slice(at, blocks.QUERY_STEP)
                    read = part.column(2)
                    wanted = np.zeros((part.num_rows, len(radius)), dtype=bool)
                    wanted[np.repeat(np.arange(part.num_rows), read.value_lengths().to_numpy()), read.flatten().to_numpy()] = True
                    if beyond:
                        wanted = ~wanted & (_bounds(_matrix(part.column(1)), centre, radius) >= part.column(3).to_numpy()[:, None] - SLACK)
                    row, cell = np.nonzero(wanted)
                    of = np.repeat(np.arange(len(cell)), parts[cell])
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                    row, cell = row[of], cell[of]
                    number = first_bin[cell] + nth
                    starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(number, prepend=-1))  # cells of a bin follow each other
                    edges = np.append(starts, len(row)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(edges, cell.astype(np.int32)) if len(starts) else pa.array([], pa.list_(pa.int32()))
                    for first in range(0, len(starts), DEALT_ROWS):
                        some = starts[first : first + DEALT_ROWS]
                        taken = part.take(pa.array(row[some]))
                        yield pa.RecordBatch.from_arrays(
                            [taken.column(0), taken.column(1), taken.column(3), pa.array(number[some]), lists.slice(first, len(some))],
                            names=[anchor, "_q", "_floor", "_bin", "_cells"],
                        )

        return rows

    opened = asked.mapInArrow(opening, f"{anchor} {kind}, _q array<double>, _read array<int>").checkpoint()
    if report is not None:
        report |= {"all": opened.count() * int(n.sum()), "floor": 0, "near": 0}
    schema = blocks.arrow_schema(shape)

    def scored(floors: DataFrame, beyond: bool) -> DataFrame:
        sent = floors.select(anchor, "_q", "_read", "_floor").mapInArrow(dealt(beyond), f"{anchor} {kind}, _q array<double>, _floor double, _bin long, _cells array<int>")
        if report is not None:
            counts = sent.select(F.explode("_cells").alias("c"), "_bin").groupBy("c", "_bin").count().groupBy("c").agg(F.max("count").alias("m")).collect()  # a row per cell
            report["near" if beyond else "floor"] = sum(int(n[r.c]) * r.m for r in counts)
        # A shard holds anchors with their k hits; the number of bins is the stored bytes over ``bin_bytes``.
        shards = F.ceil(F.count("*") * F.lit(width + 32 * k) / F.lit(bin_bytes)).cast("long")
        asked_of = sent.groupBy("_bin").agg(shards.alias("_shards")).checkpoint()
        left = sent.join(asked_of, "_bin").withColumn("_shard", F.pmod(F.xxhash64(anchor), "_shards")).drop("_shards")
        right = stored.join(asked_of, "_bin").withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shards") - 1))).drop("_shards")
        key = ["_bin", "_shard"]
        tasks = max(1, asked_of.agg(F.sum("_shards")).first()[0] or 0)  # a number given is kept: a shard is few bytes but much work
        left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scorer(anchor, item, k, schema), shape)

    found = top_k(scored(opened.withColumn("_floor", F.lit(float("-inf"))), False), [anchor], by_score("score", item), k).checkpoint()
    kth = found.filter(F.col("rank") == k).select(anchor, F.col("score").alias("_kth"))
    floors = opened.join(kth, anchor, "left").withColumn("_floor", F.coalesce("_kth", F.lit(float("-inf")))).drop("_kth")
    return top_k(found.drop("rank").unionByName(scored(floors, True)), [anchor], by_score("score", item), k)


def _scorer(anchor: str, item: str, k: int, schema: pa.Schema):
    """Best ``k`` of a bin's vectors per anchor of a shard, among the cells that the anchor reaches and the scores from its floor."""

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return schema.empty_table()
        ids, matrix = blocks.ids_of(asked.column(anchor).combine_chunks()), _matrix(asked.column("_q").combine_chunks())
        best = blocks.Nearest(matrix, k, np.round(asked.column("_floor").to_numpy() - SLACK, SCORE_DIGITS))
        lists = asked.column("_cells").combine_chunks()
        reached, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        order = np.argsort(reached, kind="stable")
        numbers, starts = np.unique(reached[order], return_index=True)
        cell_of = found.column("_cell").to_numpy()
        for cell, rows in zip(numbers.tolist(), np.split(who[order], starts[1:])):
            asks = np.zeros(len(ids), dtype=bool)
            asks[rows] = True
            for batch in found.filter(pa.array(cell_of == cell)).to_batches(max_chunksize=blocks.ROW_STEP):
                best.feed(blocks.ids_of(batch.column(item)), _matrix(batch.column("_v")), asks)
        return pa.Table.from_batches(best.emit(ids, schema), schema=schema)

    return score

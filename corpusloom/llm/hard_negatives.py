"""Hard negatives by a secondary-sort shuffle of pair scores.

Anchors are scored against all rows in blocks of a matrix product. The scores go into the shuffle under the key (anchor,
descending score, kind, id); every task reads its anchors in that order as a stream: the first rows of an anchor's own label
open windows of scores, and rows of other labels that fall into an open window go out at once. Nothing of an anchor is kept
but its windows.

What can't matter stays out of the shuffle. A first pass finds the scores of each anchor's positives (a few numbers per anchor and
task are shuffled). The second pass knows all windows, so a task hands on only rows that reach the positives' scores and, for
each window, its own first few rows within it; rows behind these have that many better ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import sizing
from corpusloom.session import shared_dir

POSITIVES = 5
NEGATIVES = 3
#: A negative scores from 50 % to 95 % of its positive.
LOW, HIGH = 50, 95
CELL_BYTES = 16 << 20
_ROWS, _ANCHORS = 2048, 512
_LEAST = -np.iinfo(np.int64).max  # can be negated
_NO_ID = np.iinfo(np.int64).max
_EXACT = 1 << 53


class Rule(NamedTuple):
    """How many positives and negatives, and the window in per cent of the positive's score."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, as double; null for a vector with a null or non-finite component."""
    doubles = vector.cast("array<double>")
    odd = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~odd, F.transform(doubles, lambda x: F.floor(x * scale)))


def _matrix(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length of vector."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, values[first[rows][:, None] + np.arange(size)]))
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact; those beyond 64 bits stop at its ends."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], dtype=object).reshape(b.shape).T
    return np.clip(whole, _LEAST + 1, _NO_ID).astype(np.int64)


class _Best:
    """The first ``k`` different (score, id) of some lists, by descending score, then id, kept while rows stream by."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.scores = np.full((lists, k), _LEAST)
        self.ids = np.full((lists, k), _NO_ID)

    def feed(self, at: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (lists of ``at``, rows), ``_LEAST`` where a row doesn't count; ``ids`` of the rows, ascending and different."""
        last = self.scores[at, -1]
        better = (scores >= last[:, None]) & (scores > _LEAST)
        for i in np.flatnonzero(better.any(axis=1)):
            rows = np.flatnonzero(better[i])
            if len(rows) > 8 * self.k:  # all above the k-th score, and those equal to it
                rows = rows[scores[i, rows] >= np.partition(scores[i, rows], -self.k)[-self.k]]
            s = np.concatenate([self.scores[at.start + i], scores[i, rows]])
            n = np.concatenate([self.ids[at.start + i], ids[rows]])
            order = np.lexsort((n, -s))
            s, n = s[order], n[order]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])
            s, n = s[new][: self.k], n[new][: self.k]
            self.scores[at.start + i, : len(s)], self.ids[at.start + i, : len(n)] = s, n

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of what is kept."""
        lists, places = np.nonzero(self.scores > _LEAST)
        return lists, self.scores[lists, places], self.ids[lists, places]


class _Anchors(NamedTuple):
    """Anchors of one length of vector; ``windows`` (anchor, positive): their scores, empty in the first pass."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: np.ndarray


def _anchor_groups(table: pa.Table, positives: int) -> list[_Anchors]:
    """Columns number, id, label, vector and, in the second pass, windows."""
    if not table.num_rows:
        return []
    columns = [c.combine_chunks() for c in table.columns]
    number, ids, labels = (c.to_numpy(zero_copy_only=False) for c in columns[:3])
    windows = np.full((table.num_rows, positives), _LEAST)
    if len(columns) > 4:
        sizes = np.diff(columns[4].offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        windows[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = columns[4].flatten().to_numpy(zero_copy_only=False)
    return [_Anchors(number[r], ids[r], labels[r], v, windows[r]) for r, v in _matrix(columns[3])]


class _Scorer:
    """Scores streams of rows (id, label, vector) against anchors and keeps what can matter."""

    def __init__(self, groups: list[_Anchors], rule: Rule, second: bool):
        self.groups, self.rule, self.second = groups, rule, second
        self.own = [_Best(len(g.ids), rule.positives) for g in groups]
        self.other = [[_Best(len(g.ids), rule.negatives) for _ in range(rule.positives)] if second else [] for g in groups]

    def feed(self, ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> None:
        all_ids, all_labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
        for rows, matrix in _matrix(vectors):
            known, number = np.unique(all_ids[rows], return_inverse=True)
            first = np.arange(len(rows))
            if len(known) < len(rows):  # equal rows count once
                label = np.unique(all_labels[rows], return_inverse=True)[1]
                first = np.unique(np.column_stack([number, label, matrix]), axis=0, return_index=True)[1]
            first = first[np.argsort(number[first], kind="stable")]
            id_, label, matrix = all_ids[rows][first], all_labels[rows][first], matrix[first]
            for k, group in enumerate(self.groups):
                if group.vectors.shape[1] == matrix.shape[1]:
                    for at in range(0, len(group.ids), _ANCHORS):
                        self.feed_block(k, slice(at, min(at + _ANCHORS, len(group.ids))), id_, label, matrix)

    def feed_block(self, k: int, at: slice, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        group = self.groups[k]
        scores = _products(group.vectors[at], matrix)
        same = group.labels[at, None] == labels
        self.own[k].feed(at, np.where(same & (group.ids[at, None] != ids), scores, _LEAST), ids)
        if self.second:
            others = np.where(same, _LEAST, scores)
            for place, best in enumerate(self.other[k]):
                low, high = bounds(group.windows[at, place], self.rule)
                inside = (others >= low[:, None]) & (others <= high[:, None])
                if inside.any():
                    best.feed(at, np.where(inside, others, _LEAST), ids)

    def emit(self) -> Iterator[pa.RecordBatch]:
        for group, own, other in zip(self.groups, self.own, self.other):
            place, score, ids = own.rows()
            if self.second:  # below the last positive's score nothing is one
                reach = np.where(group.windows > _LEAST, group.windows, _NO_ID).min(axis=1)
                enough = score >= reach[place]
                place, score, ids = place[enough], score[enough], ids[enough]
            parts = [(place, score, ids, np.zeros(len(ids), dtype=np.int32))]
            parts += [(p, s, i, np.ones(len(i), dtype=np.int32)) for p, s, i in (best.rows() for best in other)]
            place, score, ids, kind = (np.concatenate(c) for c in zip(*parts))
            columns = [group.number[place], group.ids[place], kind, score, ids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "anchor", "kind", "score", "id"])


_PAIRS = "number long, anchor long, kind int, score long, id long"


def bounds(score: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score in the window of a positive's score; an empty window where there is no positive."""
    there = score > _LEAST
    known = np.where(there, score, 0)
    # By quotient and remainder, as a product by hundred could leave 64 bits.
    low = known // 100 * rule.low + -(-(known % 100 * rule.low) // 100)
    high = known // 100 * rule.high + known % 100 * rule.high // 100
    return np.where(there, low, 1), np.where(there, high, 0)


def _scan(rows: DataFrame, anchors: DataFrame, rule: Rule, second: bool) -> DataFrame:
    """One pass over the rows with all anchors, measured to be few, at hand."""
    shared = rows.sparkSession.sparkContext.broadcast(_anchor_groups(anchors.toArrow(), rule.positives))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value, rule, second)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                scorer.feed(*batch.slice(at, _ROWS).columns)
        yield from scorer.emit()

    return rows.mapInArrow(score, _PAIRS)


def _grid(rows: DataFrame, anchors: DataFrame, rule: Rule, second: bool, cell_bytes: int) -> DataFrame:
    """Blocks of anchors and blocks of rows of bounded size, each pair of blocks in one task."""

    def parts(df: DataFrame) -> int:
        size = df.agg(F.sum(F.size("vector").cast("long") * 8 + 64)).first()[0] or 0
        return max(1, -(-int(size) // cell_bytes))

    wide, deep, names = parts(anchors), parts(rows), anchors.columns
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    # Anchors are rows of the same table: under names of their own the two sides share no attribute.
    left = anchors.select(*(F.col(c).alias(f"asked_{c}") for c in names), block(wide, "number").alias("_a"), every(deep).alias("_r"))
    # Equal rows go to different blocks only if their ids do, so hot ids are dealt by label and vector, too.
    right = rows.withColumn("_r", block(deep, "id", "label", "vector")).withColumn("_a", every(wide))

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        scorer = _Scorer(_anchor_groups(asked.select([f"asked_{c}" for c in names]), rule.positives), rule, second)
        for batch in found.select(["id", "label", "vector"]).to_batches(max_chunksize=_ROWS):
            scorer.feed(*batch.columns)
        shape = pa.schema([("number", pa.int64()), ("anchor", pa.int64()), ("kind", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
        return pa.Table.from_batches(scorer.emit(), schema=shape)

    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(score, _PAIRS)


def _mined(rule: Rule):
    """Streams rows in the order (number, descending score, kind, id) and emits negatives of open windows."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, windows = None, None, []  # windows: [positive, its score, least, greatest score, negatives so far]
        for batch in batches:
            out: list[tuple] = []
            for number, anchor, kind, score, id_ in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    now, last, windows = number, None, []
                if (kind, score, id_) == last:
                    continue  # a repeated row, or one that several windows asked for
                last = (kind, score, id_)
                if kind == 0:
                    if len(windows) < rule.positives:
                        low, high = (int(x[0]) for x in bounds(np.array([score]), rule))
                        windows.append([id_, score, low, high, 0])
                    continue
                for window in windows:
                    if window[4] < rule.negatives and window[2] <= score <= window[3]:
                        window[4] += 1
                        out.append((anchor, window[0], window[4], id_, window[1], score))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], type=k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def mined(
    items: DataFrame,
    anchors: Column,
    id_: str = "id",
    label: str = "label",
    vector: str = "vector",
    rule: Rule = Rule(),
    max_broadcast_bytes: int = sizing.MAX_BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Per anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is the condition on ``items`` that makes a row an anchor; ``vector`` holds whole numbers, as ``scaled`` gives
    them. Scores are inner products; higher ones come first, ties by smaller id. An anchor's positives are its first other
    rows of the same label, its negatives rows of other labels within ``rule.low`` to ``rule.high`` per cent of the positive's
    score. Rows with a null id, label or vector take no part; vectors of another length than the anchor's are not compared
    with it; an empty vector scores 0. Equal rows count once; rows that share an id but differ are rows of their own, save
    that none is a positive of an anchor of the same id. Long vectors are read whole; products beyond 64 bits stop at its
    ends. Other columns are not read; an empty table gives none.

    Anchors reach the tasks as a broadcast where they are measured to be few, else blocks of anchors meet blocks of rows.
    """
    shared_dir(items.sparkSession)
    rows = items.select(
        F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), anchors.alias("chosen")
    ).filter("id is not null and label is not null and vector is not null")
    chosen = rows.filter("chosen").drop("chosen").distinct()
    chosen = chosen.select(F.monotonically_increasing_id().alias("number"), "id", "label", "vector").checkpoint()
    rows = rows.drop("chosen")
    few = sizing.is_small(chosen, max_bytes=max_broadcast_bytes)

    def scored(asked: DataFrame, second: bool) -> DataFrame:
        return _scan(rows, asked, rule, second) if few else _grid(rows, asked, rule, second, cell_bytes)

    nearest = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    # Equal rows of two tasks come twice: one of them goes before they are counted.
    near = scored(chosen, False).select("number", "score", "id").distinct().withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= rule.positives)
    windows = near.groupBy("number").agg(F.sort_array(F.collect_list("score"), asc=False).alias("windows"))
    asked = chosen.join(windows, "number").checkpoint()
    ordered = scored(asked, True).repartition("number").sortWithinPartitions("number", F.desc("score"), "kind", "id")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return ordered.mapInArrow(_mined(rule), shape)

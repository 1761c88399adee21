"""Running top-k over score blocks inside Arrow tasks, shared by the dense and the lexical search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from corpusloom.operators.ranking import SCORE_DIGITS

QUERY_STEP = 256
ROW_STEP = 8192
#: Vectors that meet a step of questions at a time; their scores fit a core's cache.
TILE = 2048
#: What a kept hit takes while it is merged, at most.
HIT_BYTES = 32
#: Longer vectors are not scored in single precision.
HUGE = 1e18


class Best:
    """Best k (item, score) per query over the blocks fed; ties go to the smaller item."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict[int, tuple[np.ndarray, ...]] = {}

    def feed(self, block: int, ids: np.ndarray, scores: np.ndarray, positive: bool = False) -> None:
        """Take the scores (items x queries of the block) of one batch of items.

        Comparison is at nine decimals, as in the final ranking; the score itself is kept as it is.
        """
        if not scores.size:
            return
        compared = np.round(scores, SCORE_DIGITS)
        wanted = scores > 0 if positive else np.ones(scores.shape, dtype=bool)
        if len(ids) > self.k:
            cut = np.partition(compared, len(ids) - self.k, axis=0)[len(ids) - self.k]
            wanted &= compared >= cut
        if block in self.kept:
            old = self.kept[block]
            floor = np.full(scores.shape[1], -np.inf)
            full = np.bincount(old[0], minlength=scores.shape[1]) >= self.k
            np.minimum.at(worst := np.full(scores.shape[1], np.inf), old[0], old[2])
            floor[full] = worst[full]
            wanted &= compared >= floor
        row, query = np.nonzero(wanted)
        if not len(row):
            return
        parts = (query, ids[row], compared[row, query], scores[row, query])
        if block in self.kept:
            parts = tuple(np.concatenate(pair) for pair in zip(self.kept[block], parts))
        order = np.lexsort((parts[1], -parts[2], parts[0]))
        parts = tuple(p[order] for p in parts)
        nth = np.arange(len(order)) - np.searchsorted(parts[0], parts[0], side="left")
        self.kept[block] = tuple(p[nth < self.k] for p in parts)

    def emit(self, query_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for block, (query, item, _, score) in self.kept.items():
            columns = [query_ids[query + block * QUERY_STEP].tolist(), item.tolist(), score]
            arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class Nearest:
    """Best k items per question by inner product over the vectors fed; ties at nine decimals go to the smaller item, NaN is first.

    All products are formed in single precision; those that can reach a question's floor, allowing for their largest error, are
    formed again in double precision, and only these count. The floor is the k-th score so far, or a higher one given. New hits
    wait until they are half as many as can be kept, so that merging costs little; memory stays below ``HIT_BYTES`` a kept hit.
    """

    def __init__(self, questions: np.ndarray, k: int, floor: np.ndarray | None = None):
        n = len(questions)
        self.k, self.questions = k, questions
        with np.errstate(over="ignore"):
            self.short, self.length = questions.astype(np.float32), np.sqrt((questions * questions).sum(axis=1))
        self.floor = np.full(n, -np.inf) if floor is None else np.array(floor, dtype=np.float64)
        self.full, self.last = np.zeros(n, dtype=bool), None
        self.steps = [slice(at, min(at + QUERY_STEP, n)) for at in range(0, n, QUERY_STEP)]
        self.kept: list[tuple[np.ndarray, ...] | None] = [None] * len(self.steps)
        self.waiting: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.steps]

    def feed(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Score vectors against all questions, or those that ``asked`` marks."""
        for at in range(0, len(ids), TILE):
            items, tile = ids[at : at + TILE], vectors[at : at + TILE]
            with np.errstate(over="ignore"):
                short, longest = tile.astype(np.float32), np.sqrt((tile * tile).sum(axis=1).max())
            for step, span in enumerate(self.steps):
                which = span
                if asked is not None and not asked[span].all():
                    which = span.start + np.flatnonzero(asked[span])
                    if not len(which):
                        continue
                self._meet(step, which, items, tile, short, longest)

    def _meet(self, step: int, which, items: np.ndarray, tile: np.ndarray, short: np.ndarray, longest: float) -> None:
        n, floor, length = len(items), self.floor[which], self.length[which]
        fits = bool(longest <= HUGE and length.max() <= HUGE)  # NaN doesn't
        if fits:
            scores = self.short[which] @ short.T
            # Twice the error of a sum of n products of rounded factors, and the rounding of scores.
            slack = (tile.shape[1] + 4) * 2.0**-23 * longest * length + 2 * 10.0**-SCORE_DIGITS
            if n > self.k and np.isneginf(floor).any():
                floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k] - slack)
            found = np.flatnonzero(scores >= (floor - slack).astype(np.float32)[:, None])
        else:
            found = np.arange(len(length) * n)
        if not len(found):
            return
        query, row = np.divmod(found, n)
        asked = self.questions[which]
        if len(found) * 16 > len(length) * n:
            with np.errstate(over="ignore", invalid="ignore"):
                score = (asked @ tile.T).ravel()[found]
        else:
            score = np.einsum("ij,ij->i", asked[query], tile[row])
        query = query + which.start if isinstance(which, slice) else which[query]
        compared, floor = _compared(score), self.floor[query]
        high = compared >= floor
        if self.last is not None:
            high &= (compared > floor) | ~self.full[query] | (items[row] < self.last[query])
        if not high.any():
            return
        waiting = self.waiting[step]
        waiting.append((query[high].astype(np.int32), items[row[high]], score[high]))
        if self.kept[step] is None or sum(len(w[0]) for w in waiting) * 2 >= self.k * (self.steps[step].stop - self.steps[step].start):
            self._merge(step)

    def _merge(self, step: int) -> None:
        parts = self.waiting[step] + ([] if self.kept[step] is None else [self.kept[step]])
        self.waiting[step] = []
        if not parts:
            return
        query, item, score = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((item, -_compared(score), query))
        nth = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
        order = order[nth < self.k]
        query, item, score = self.kept[step] = query[order], item[order], score[order]
        end = np.flatnonzero(nth[nth < self.k] == self.k - 1)  # the k-th hit of each question that has so many
        if self.last is None:
            self.last = np.zeros(len(self.full), dtype=item.dtype)
        elif self.last.dtype != item.dtype:  # strings of another length
            self.last = self.last.astype(np.promote_types(self.last.dtype, item.dtype))
        self.floor[query[end]], self.last[query[end]], self.full[query[end]] = _compared(score[end]), item[end], True

    def hits(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(question's place, item, score) of the kept hits, a step of questions at a time."""
        for step in range(len(self.steps)):
            self._merge(step)
            if self.kept[step] is not None:
                yield self.kept[step]

    def emit(self, query_ids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for query, item, score in self.hits():
            columns = [query_ids[query].tolist(), item.tolist(), score]
            yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, schema)], schema=schema)


def _compared(score: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(score), np.inf, np.round(score, SCORE_DIGITS))


def ids_of(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def hit_schema(query: T.StructField, item: T.StructField) -> T.StructType:
    return T.StructType([query, item, T.StructField("score", T.DoubleType())])


def arrow_schema(shape: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}
    return pa.schema([(f.name, kinds.get(f.dataType, pa.string())) for f in shape.fields])

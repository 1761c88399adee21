"""Stretches of words that repeat with a period, found by an online sparse diagonal pass.

A word that equals the word ``lag`` places before it lies on the diagonal of that lag. Word by word, the earlier
occurrences open diagonals or lengthen those that are active, and a diagonal that ends long enough gives its run at once.

Three proven bounds keep the set of diagonals sparse; none of them loses a run:

* A run of length n and period q has a match of n - q >= 16 words on its diagonal (for 24 words and three periods), so
  earlier occurrences are looked up by the eight words that end at a word. Words of whose eight none stood before end all
  diagonals; those between two such words form a segment, found by numpy for a whole block of texts.
* A match lies within one segment, so lags of more than half a segment (its eight words included) can't make a run.
* While a diagonal p with a match of 2p words or more is active, a diagonal q > p that opens has all its matches within a
  stretch of period p; if they come to 2q words, the whole stretch of q has a smaller period. Only lags below p are kept
  then. A diagonal is measured backwards when it opens, so one that goes on past the stretch is opened whole at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import blocks

MIN_LENGTH = 24
REPEATS = 3
SEED = 8

Run = tuple[int, int, int]  # start, length, period

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SHAPE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def shortest_match(min_length: int, repeats: int) -> int:
    """Words that any run matches on its diagonal at least: max(min_length - q, (repeats - 1) q) is least at q = min_length / repeats."""
    return min(max(min_length - q, (repeats - 1) * q) for q in range(1, min_length + 1))


def segments(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where each gram stood last (-1: nowhere), and first and end place of every stretch of grams that stood before."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    before = np.full(len(grams), -1, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    seen = np.zeros(len(grams) + 2, dtype=np.int8)
    seen[1:-1] = before >= 0
    step = np.diff(seen)
    return before, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class _Diagonals:
    """The active diagonals of one segment of grams: lag and first matching word. ``before`` is indexed by gram."""

    def __init__(self, words: list[int], before: list[int], widest: int, seed: int, min_length: int, repeats: int):
        self.words, self.before, self.widest, self.seed = words, before, widest, seed
        self.min_length, self.repeats = min_length, repeats
        self.active: dict[int, int] = {}
        self.inside = 0  # smallest lag that matches two of its periods or more

    def ended(self, at: int, lags: list[int]) -> Iterator[Run]:
        """Runs of the diagonals whose match ends before the word ``at``."""
        for lag in lags:
            begin = self.active.pop(lag)
            if at - begin + lag >= self.min_length and at - begin >= (self.repeats - 1) * lag:
                yield begin - lag, at - begin + lag, lag

    def open(self, gram: int, below: int) -> None:
        """A diagonal for every earlier occurrence of the gram at less than ``below`` words, measured backwards."""
        words, at = self.words, gram + self.seed - 1
        place = self.before[gram]
        while place >= 0 and gram - place < below:
            lag = gram - place
            if lag not in self.active:
                begin = at + 1
                while begin > lag and words[begin - 1] == words[begin - 1 - lag]:
                    begin -= 1
                if at - begin + 1 >= self.seed:  # else the hashes of two grams met
                    self.active[lag] = begin
            place = self.before[place]

    def step(self, gram: int) -> Iterator[Run]:
        words, active, at = self.words, self.active, gram + self.seed - 1
        word = words[at]
        yield from self.ended(at, [lag for lag in active if words[at - lag] != word])
        known = self.inside if self.inside in active else 0
        self.open(gram, known or self.widest + 1)
        self.inside = min((lag for lag, begin in active.items() if at - begin + 1 >= 2 * lag), default=0)
        if self.inside and self.inside != known:
            self.open(gram, self.widest + 1)  # what went on unopened in another stretch
            start = active[self.inside] - self.inside
            for lag in [lag for lag, begin in active.items() if lag > self.inside and begin >= start]:
                del active[lag]  # within this stretch so far; opened again where it goes on past the end


def diagonal_runs(words: list[int], before: list[int], first: int, end: int, seed: int, min_length: int, repeats: int) -> Iterator[Run]:
    """Runs, not yet freed of larger periods, of the segment of grams ``first`` to ``end``."""
    diagonals = _Diagonals(words, before, (end - first + seed - 1) // (repeats - 1), seed, min_length, repeats)
    for gram in range(first, end):
        yield from diagonals.step(gram)
    yield from diagonals.ended(end + seed - 1, list(diagonals.active))


def smallest_periods(found: Iterator[Run]) -> list[Run]:
    """Runs by start, then period. Two periods of one stretch are multiples of its smallest."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((start, length, period) for (start, length), period in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without the repeats of runs, joined by one space."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def block_runs(data: np.ndarray, offsets: np.ndarray, seed: int, min_length: int, repeats: int) -> tuple[list[int], list[list[Run]], list[bytes]]:
    """Number of words, runs and collapsed text of each row of a block."""
    starts, ends, bounds = blocks.spans(data, offsets, blocks.NOT_SPACE)
    rows = len(offsets) - 1
    grams = blocks.grams(blocks.hashes(data, starts, ends, lower=False), seed)
    owner = np.repeat(np.arange(rows), np.diff(bounds))[: len(grams)]
    inner = blocks.inner(bounds, seed, len(grams))
    grams = np.where(inner, blocks.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(len(grams), dtype=np.uint64))
    before, firsts, stops = segments(grams)
    before[~inner] = -1
    long_enough = stops - firsts + seed - 1 >= shortest_match(min_length, repeats)
    by_row: dict[int, list[tuple[int, int]]] = {}
    for first, stop in zip(firsts[long_enough].tolist(), stops[long_enough].tolist()):
        by_row.setdefault(int(owner[first]), []).append((first, stop))
    counts, runs, texts = np.diff(bounds).tolist(), [], []
    raw = data.tobytes()
    for row in range(rows):
        words = raw[offsets[row] : offsets[row + 1]].split()  # at the six ASCII spaces
        found: list[Run] = []
        if row in by_row:
            numbers: dict[bytes, int] = {}
            ids = [numbers.setdefault(word, len(numbers)) for word in words]
            shift = int(bounds[row])
            earlier = (before[shift : bounds[row + 1]] - shift).tolist()
            found = smallest_periods(r for a, b in by_row[row] for r in diagonal_runs(ids, earlier, a - shift, b - shift, seed, min_length, repeats))
        runs.append(found)
        texts.append(collapsed(words, found))
    return counts, runs, texts


def _found(min_length: int, repeats: int):
    seed = min(SEED, shortest_match(min_length, repeats))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks.blocks(batch.column(1)):
                counts, runs, texts = block_runs(data, offsets, seed, min_length, repeats)
                flat = [r for row in runs for r in row]
                sizes = np.cumsum([0, *map(len, runs)])
                listed = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], type=pa.int64()) for k in range(3)], fields=list(_RUN))
                columns = [
                    batch.column(0).slice(first, end - first), pa.array(counts, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), listed), pa.array(texts, type=pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return rows


def found(documents: DataFrame, id_: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """Per document row: id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least max(min_length, repeats * q) words that no neighbouring
    word extends; ``collapsed`` leaves the first q words of each. Words are ``[^\\x20\\x09-\\x0D]+``. Null counts as the empty
    text: no words, no runs, the empty text. A text of any length is read whole, as a block of its own if it is over a
    megabyte. Equal rows get equal results, one row each; other columns are not read; an empty table gives none. Equal
    stretches tie: each place is a run of its own. ``repeats`` is 3 or more, as the bounds above need it.
    """
    if repeats < 3 or min_length < 1:
        raise ValueError("repeats must be 3 or more, min_length 1 or more")
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_found(min_length, repeats), f"id {dict(rows.dtypes)['id']}, {_SHAPE}")

"""Quality rules: repetition coverage by rolling hashes.

For several lengths n the hashes of all n-grams of words of a text are compared; every word inside an n-gram
that occurs twice or more counts with its characters, so overlapping repeats count once. Lines equal to an
earlier line count with all their word characters. All rows of a block are worked on at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm import blocks

LENGTHS = (5, 8, 13)
#: Largest share of word characters inside repeated n-grams by n, and inside repeated lines.
LIMITS = {5: 0.30, 8: 0.30, 13: 0.25}
LINE_LIMIT = 0.35
BASE_WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CHARACTER = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_NOT_LINE_END = np.ones(256, dtype=bool)
_NOT_LINE_END[0x0A] = False


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    return blocks.mix(values + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated_words(words: np.ndarray, bounds: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each word of a block, whether it lies in an n-gram found twice or more in its row."""
    out = np.zeros(len(words) + 1, dtype=np.int64)
    grams = blocks.grams(words, n)
    at = np.flatnonzero(blocks.inner(bounds, n, len(grams)))
    if not len(at):
        return out[:-1] > 0
    values = _in_row(grams[at], row[at])
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out[at[twice]] += 1
    out[at[twice] + n] -= 1
    return np.cumsum(out)[:-1] > 0


def later_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of a block that hold a word and equal an earlier line of their row, and their rows."""
    starts, ends, bounds = blocks.spans(data, offsets, _NOT_LINE_END)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    filled = np.concatenate([[0], np.cumsum(blocks.NOT_SPACE[data])])
    some = filled[ends] > filled[starts]
    starts, ends, row = starts[some], ends[some], row[some]
    values = _in_row(blocks.hashes(data, starts, ends, lower=False), row)
    order = np.argsort(values, kind="stable")
    later = order[1:][values[order][1:] == values[order][:-1]]
    return starts[later], ends[later], row[later]


def _measured(lengths: tuple[int, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks.blocks(batch.column(1)):
                starts, ends, bounds = blocks.spans(data, offsets, blocks.NOT_SPACE)
                row = np.repeat(np.arange(end - first), np.diff(bounds))
                words = blocks.hashes(data, starts, ends, lower=False)
                before = np.concatenate([[0], np.cumsum(_CHARACTER[data] & blocks.NOT_SPACE[data])])
                size = before[ends] - before[starts]
                a, b, line_row = later_lines(data, offsets)
                n = end - first
                covered = [np.where(repeated_words(words, bounds, row, k), size, 0) for k in lengths]
                columns = [
                    np.diff(bounds),
                    _row_sums(size, bounds),
                    _row_sums(_SYMBOL[data], offsets),
                    np.bincount(line_row, minlength=n),
                    _row_sums(repeated_words(words, bounds, row, BASE_WINDOW), bounds),
                    np.bincount(line_row, weights=before[b] - before[a], minlength=n).astype(np.int64),
                ]
                shares = np.stack([_row_sums(c, bounds) for c in covered], axis=1).ravel()
                lists = blocks.list_array(shares, np.arange(n + 1) * len(lengths), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), *(pa.array(c.astype(np.int64)) for c in columns), lists],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "dup_gram_chars"],
                )

    return rows


def measured(documents: DataFrame, id_: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Per document row: id and its counts; dup_gram_chars holds word characters inside repeated n-grams, one number per length.

    Null and empty texts count 0 everywhere; equal rows get equal counts, one row each; an empty table gives none.
    """
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long"
    return rows.mapInArrow(_measured(lengths), f"id {dict(rows.dtypes)['id']}, {counts}, dup_gram_chars array<long>")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


def passed(lengths: tuple[int, ...] = LENGTHS, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> Column:
    """The verdict on columns of ``measured``: all shares of repeated characters are within their limits."""
    limits = limits or LIMITS
    ok = F.col("dup_line_chars") <= F.col("word_chars") * line_limit
    for i, n in enumerate(lengths):
        ok = ok & (F.get("dup_gram_chars", i) <= F.col("word_chars") * limits[n])
    return ok

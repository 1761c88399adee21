"""Benchmark decontamination by winnowed fingerprints.

Of the k-gram hashes in every window of ``n`` words the smallest is a fingerprint. Two texts that
share ``n`` consecutive words share all k-grams of that window, so they share its fingerprint: no
shared span of ``n`` words or more is missed, while only about ``2 / (n - k + 2)`` of the k-grams are
looked up. The fingerprints of the test set form a filter of fixed size, broadcast to the tasks.
Around each fingerprint of a document that passes it, the windows of ``n`` words that hold it are
hashed, filtered once more and joined with the windows of the test items; matching windows extend
each other to the hit spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm import bitmaps, blocks
from corpusloom.llm.registry import fresh
from corpusloom.sizing import is_small

WINDOW = 13
GRAM = 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out, reach = pick(out[:-step], out[step:]), reach + step
    return out


def winnow(words: np.ndarray, bounds: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the smallest of some window of ``n`` words of a row."""
    grams = blocks.grams(words, k)
    ok = blocks.inner(bounds, k, len(grams))
    width = n - k + 1
    if not ok.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    values = np.concatenate([np.full(width - 1, _NONE), np.where(ok, grams, _NONE), np.full(width - 1, _NONE)])
    least = _sliding(values, width, np.minimum)
    chosen = np.flatnonzero(ok & (grams == _sliding(least, width, np.maximum)))
    return chosen, grams[chosen]


def _windows_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The same hashes as ``blocks.grams`` gives, only at some positions."""
    out = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[at + k]
    return blocks.mix(out)


def _item_rows(n: int, k: int):
    """Windows (with their length) and fingerprints (length 0) of the test items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in blocks.blocks(batch.column(1)):
                starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
                words = blocks.hashes(data, starts, ends, lower=True)
                size = np.diff(bounds)
                at, value = winnow(words, bounds, n, k)
                found = [(at, value, np.zeros(len(at), dtype=np.int32))]
                grams = blocks.grams(words, n)
                at = np.flatnonzero(blocks.inner(bounds, n, len(grams)))
                found.append((at, grams[at], np.full(len(at), n, dtype=np.int32)))
                for m in np.unique(size[(size > 0) & (size < n)]):
                    at = bounds[:-1][size == m]
                    found.append((at, _windows_at(words, at, int(m)), np.full(len(at), m, dtype=np.int32)))
                at, value, length = (np.concatenate(x) for x in zip(*found))
                row = first + np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(value.view(np.int64)), pa.array(length)], names=["item", "h", "m"]
                )

    return rows


def _candidates(packed: Broadcast, short: list[int], n: int, k: int):
    """Per document its number of words and the windows that may be windows of a test item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = packed.value
        for batch in batches:
            for first, end, data, offsets in blocks.blocks(batch.column(1)):
                starts, ends, bounds = blocks.spans(data, offsets, blocks.ALNUM)
                words = blocks.hashes(data, starts, ends, lower=True)
                at, value = winnow(words, bounds, n, k)
                at = at[bitmaps.maybe(filter_, value)]
                around = np.unique((at[:, None] - np.arange(n - k + 1)).ravel())
                around = around[(around >= 0) & (around + n <= len(words))]
                around = around[np.searchsorted(bounds, around, side="right") == np.searchsorted(bounds, around + n - 1, side="right")]
                found = [(around, _windows_at(words, around, n))]
                for m in short:
                    grams = blocks.grams(words, m)
                    at = np.flatnonzero(blocks.inner(bounds, m, len(grams)))
                    found.append((at, grams[at]))
                at, value = (np.concatenate(x) for x in zip(*found))
                keep = bitmaps.maybe(filter_, value)
                at, value = at[keep], value[keep]
                order = np.argsort(at, kind="stable")
                at, value = at[order], value[order]
                windows = pa.StructArray.from_arrays([pa.array(at), pa.array(value.view(np.int64))], names=["at", "h"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), windows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), lists], names=["row", "n_words", "windows"]
                )

    return rows


def _covered(windows: Column) -> Column:
    """Words inside any of the (start, length) windows, each once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to"))

    def step(acc: Column, w: Column) -> Column:
        to = F.greatest(acc["to"], w["at"] + w["m"])
        return F.struct((acc["n"] + to - F.greatest(acc["to"], F.least(w["at"], to))).alias("n"), to.alias("to"))

    return F.aggregate(F.array_sort(windows), start, step)["n"]


def hits(documents: DataFrame, benchmark: DataFrame, row: str, text: str = "text", item: str = "item_id", item_text: str = "text",
         n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Per document row: ``row``, n_words, n_hit, items (sorted strings).

    ``row`` names a column that identifies the row. Null text has no words; a null item id hits but is
    not listed; an empty test set hits nothing; equal rows get equal results, one each.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    found = items.mapInArrow(_item_rows(n, k), "item string, h long, m int").checkpoint()
    packed = bitmaps.build(found, "h")
    short = sorted(r.m for r in found.filter((F.col("m") > 0) & (F.col("m") < n)).select("m").distinct().collect())
    windows = found.filter("m > 0").groupBy("h", "m").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = windows.select(F.col("h").alias("window"), F.col("m").cast("long").alias("m"), "items")
    if is_small(windows.select("window", F.size("items").alias("n"))) and is_small(found.select("item")):
        windows = F.broadcast(windows)
    kind = dict(documents.dtypes)[row]
    scan = documents.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(
        _candidates(packed, short, n, k), f"row {kind}, n_words long, windows array<struct<at:long,h:long>>"
    )
    one = scan.select("row", "n_words", F.explode_outer("windows").alias("w"))
    # A document without candidates takes a key of its own, which spreads such rows and matches nothing.
    one = one.select("row", "n_words", "w.at", F.coalesce(F.col("w.h"), F.xxhash64("row")).alias("h"))
    joined = one.join(windows, (one.h == windows.window) & one["at"].isNotNull(), "left")
    hit = F.when(F.col("m").isNotNull(), F.struct("at", "m"))
    return (
        joined.groupBy("row", "n_words")
        .agg(F.collect_list(hit).alias("hit"), F.collect_set("items").alias("items"))
        .select(F.col("row").alias(row), "n_words", _covered(F.col("hit")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    )


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words lies inside windows of the test set."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def remove(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    The verdict depends on the text alone, so contaminated texts are removed by two hashes of the text.
    """
    a, b, n_words, n_hit = fresh(documents, "text_a", "text_b", "n_words", "n_hit")
    key = [F.xxhash64(F.col(text)), F.xxhash64(F.lit("second"), F.col(text))]
    keyed = documents.select(F.struct(key[0].alias("a"), key[1].alias("b")).alias("row"), F.col(text).alias("text"))
    bad = hits(keyed, benchmark, "row").filter(contaminated(F.col("n_words"), F.col("n_hit")))
    bad = bad.select(F.col("row.a").alias(a), F.col("row.b").alias(b)).distinct().checkpoint()
    bad = F.broadcast(bad) if is_small(bad) else bad
    return documents.withColumns({a: key[0], b: key[1]}).join(bad, [a, b], "left_anti").select(*documents.columns)

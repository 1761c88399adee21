"""Language identification by character trigrams.

A naive Bayes profile per language: counts of hashed trigrams over all labelled texts, as integer log-probabilities. Texts are
counted and scored where they lie, in Arrow batches: the trigrams' buckets are made once per stretch of texts and counted by
language, or summed over each language's profile. Only counts are shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.ranking import top_k

BUCKETS = 4_096
SMOOTHING = 0.5
#: Log-probabilities are kept in thousandths, so that sums are exact.
UNIT = 1_000
#: Bytes of texts that become code points at a time, unless a single text is longer.
BLOCK_BYTES = 1 << 20
#: Trigrams that are held at a time.
STRETCH = 1 << 18
#: Languages whose counts a task holds before it hands them on.
HELD = 64


@dataclass(frozen=True)
class Profiles:
    """Languages in order of name and, for each, the log-probability of every bucket in thousandths."""

    languages: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]
    buckets: int = BUCKETS


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def fit(
    labelled: DataFrame,
    language: str,
    text: str,
    row_key: str,
    rows_per_language: int | None = None,
    max_languages: int | None = None,
    buckets: int = BUCKETS,
) -> Profiles:
    """Profiles of all languages from all labelled texts, whole.

    Rows without a language or a text take no part. As options, ``max_languages`` keeps the languages with most texts and
    ``rows_per_language`` the rows of least md5 of ``row_key``, ties by text. Only the counts per language and bucket reach the
    driver, ``buckets`` rows a language at most.
    """
    known = labelled.filter(F.col(language).isNotNull() & (F.length(text) > 0)).select(F.col(language).alias("language"), F.col(text).alias("text"), F.md5(F.col(row_key).cast("string")).alias("key"))
    if max_languages is not None:
        often = known.groupBy("language").count().orderBy(F.desc("count"), "language").limit(max_languages)
        known = known.join(F.broadcast(often.select("language")), "language", "left_semi")
    if rows_per_language is not None:
        known = top_k(known, ["language"], [F.asc("key"), F.asc("text")], rows_per_language)
    padded = known.select("language", _padded(F.col("text")).alias("padded"))
    counted = padded.mapInArrow(lambda batches: _counted(batches, buckets), "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect()
    names = sorted({r.language for r in counted})
    counts = {n: [0] * buckets for n in names}
    for r in counted:
        counts[r.language][r.bucket] = r.n
    weights = tuple(
        tuple(round(UNIT * math.log((n + SMOOTHING) / (total + SMOOTHING * buckets))) for n in counts[name]) for name, total in zip(names, map(sum, map(counts.get, names)))
    )
    return Profiles(tuple(names), weights, buckets)


def identified(text: Column, profiles: Profiles) -> Column:
    """struct(language, margin): the likeliest language and by how many thousandths it leads the next one.

    Ties go to the first name. The whole text counts. A NULL or empty text has neither, nor has any text without profiles;
    with one profile there is no margin.
    """
    kind = "struct<language:string,margin:long>"
    if not profiles.languages:
        return F.lit(None).cast(kind)

    weights = np.array(profiles.weights, dtype=np.int32)

    @F.arrow_udf(kind)
    def best(padded: pa.Array) -> pa.Array:
        names = pa.array(profiles.languages, type=pa.string())
        found = [_best(*block, weights, profiles.buckets) for block in _blocks(padded)]
        first, margin, none = (np.concatenate([f[k] for f in found]) if found else np.array([], dtype=kind) for k, kind in enumerate((np.int64, np.int64, bool)))
        language = names.take(pa.array(first, mask=none))
        return pa.StructArray.from_arrays([language, pa.array(margin, mask=none | (len(names) < 2))], ["language", "margin"], mask=pa.array(none))

    return best(_padded(text))


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of consecutive texts of at most ``BLOCK_BYTES``, and n + 1 places where those of each begin."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        part = texts.slice(row, end - row)
        lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        yield points, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        row = end


def _grams(points: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket of each three code points in a row, a stretch at a time, and where the stretch begins."""
    for at in range(0, len(points) - 2, STRETCH):
        p = points[at : at + STRETCH + 2]
        yield at, ((p[:-2] * np.uint32(961) + p[1:-1] * np.uint32(31) + p[2:]) % np.uint32(buckets)).astype(np.intp)


def _counted(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) of batches (language, padded text), summed over ``HELD`` languages at a time; languages may come again."""
    places: dict[str, int] = {}
    counts = np.zeros((HELD, buckets), dtype=np.int64)

    def held() -> pa.RecordBatch:
        place, bucket = np.nonzero(counts)
        n = pa.array(counts[place, bucket])
        names = pa.array(list(places), type=pa.string()).take(pa.array(place))
        return pa.RecordBatch.from_arrays([names, pa.array(bucket.astype(np.int32)), n], names=["language", "bucket", "n"])

    for batch in batches:
        names, at = batch.column(0).to_pylist(), 0
        while at < len(names):
            rows: list[int] = []
            for name in itertools.islice(names, at, None):
                if name not in places and len(places) == HELD:
                    break
                rows.append(places.setdefault(name, len(places)))
            _count(counts, np.array(rows), batch.column(1).slice(at, len(rows)))
            at += len(rows)
            if at < len(names):
                yield held()
                places.clear()
                counts[:] = 0
    yield held()


def _count(counts: np.ndarray, places: np.ndarray, texts: pa.Array) -> None:
    """Add the trigrams of each text to the row of ``counts`` at its place."""
    buckets, row = counts.shape[1], 0
    for points, bounds in _blocks(texts):
        mine = places[row : row + len(bounds) - 1]
        row += len(mine)
        for at, grams in _grams(points, buckets):
            cells = grams + buckets * np.repeat(mine, np.diff(np.clip(bounds - at, 0, len(grams))))
            past = np.concatenate([bounds[1:] - 1, bounds[1:] - 2]) - at  # no trigram of a text begins at its last two code points
            whole = np.ones(len(grams), dtype=bool)
            whole[past[(past >= 0) & (past < len(grams))]] = False
            counts += np.bincount(cells[whole], minlength=counts.size).reshape(counts.shape)


def _best(points: np.ndarray, bounds: np.ndarray, weights: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the place of the likeliest language, its lead over the next one, and whether the text has no trigram."""
    some = np.flatnonzero(np.diff(bounds) > 2)
    begins, ends = bounds[some], bounds[some + 1] - 2  # of the trigrams of a text
    sums = np.zeros((len(weights), len(some)), dtype=np.int64)
    for at, grams in _grams(points, buckets):
        here = slice(np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + len(grams), side="left"))
        edges = np.clip(np.stack([begins[here], ends[here]], axis=1) - at, 0, len(grams)).ravel()
        if len(edges):
            for total, profile in zip(sums, weights):
                total[here] += np.add.reduceat(np.append(profile[grams], 0), edges, dtype=np.int64)[::2]
    none = np.ones(len(bounds) - 1, dtype=bool)
    none[some] = False
    first, margin = np.zeros(len(none), dtype=np.int64), np.zeros(len(none), dtype=np.int64)
    first[some] = sums.argmax(axis=0)
    if len(weights) > 1 and len(some):
        second, top = np.partition(sums, len(sums) - 2, axis=0)[-2:]
        margin[some] = top - second
    return first, margin, none

"""Checkpoints that tell how many rows they hold, so that a broadcast needs no count of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

MAX_ROWS = 1_000_000
MAX_BYTES = 64 << 20


def stored(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """The table, written to the shared folder, with ``rows`` and other sums taken while it was written."""
    seen = Observation()
    taken = [F.count(F.lit(1)).alias("rows"), *(F.coalesce(c, F.lit(0)).alias(name) for name, c in sums.items())]
    out = df.observe(seen, *taken).checkpoint()
    return out, seen.get


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose columns are numbers and which has at most ``rows`` rows, to be broadcast if that is little."""
    return F.broadcast(df) if rows <= MAX_ROWS and rows * 8 * (1 + len(df.columns)) <= MAX_BYTES else df

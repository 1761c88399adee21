"""Size checks before broadcasts, and joins that survive hot keys.

A side is broadcast only after its size was measured (``broadcast_if_small``) or is bounded by
construction. Beyond the bound the join shuffles with the hot keys spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 16
HEAVY_SHARE = 1 / 1000


def _width(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(value), F.lit(0)) * 8 + 32
    return F.lit(16)


def measure(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[int, int]:
    """(rows, approximate bytes), reading no more than ``max_rows + 1`` rows."""
    widths = [_width(f) for f in df.schema.fields]
    total = widths[0]
    for w in widths[1:]:
        total = total + w
    # Only a number per row goes to the one task that the limit needs.
    widths = df.select(total.cast("long").alias("width")).limit(max_rows + 1)
    row = widths.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    rows, size = measure(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows of a small input over all cores, before costly per-row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys)


def spread_table(df: DataFrame, *keys: str) -> DataFrame:
    """``spread`` for a scan of a stored table; one of a file per core or more is dealt already and stays where it is."""
    return df if len(df.inputFiles()) >= df.sparkSession.sparkContext.defaultParallelism else spread(df, *keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    row_key: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Shuffle join whose hot keys on the left are spread over ``salts`` reducers.

    ``row_key`` names left columns that differ between rows of one hot key. The right side is
    repeated once per salt, so keep it deduplicated and narrow.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    row_key: list[str],
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join a large left side with a lookup: broadcast when measured small, else salted shuffle."""
    if is_small(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, how, row_key)


def counted_key_join(
    rows: DataFrame,
    counts: DataFrame,
    key: str,
    count: str,
    row_key: list[str],
    heavy_share: float = HEAVY_SHARE,
) -> DataFrame:
    """Add ``count`` to every row when ``counts`` holds the number of ``rows`` per string ``key``.

    Keys holding more than ``heavy_share`` of all rows number fewer than ``1 / heavy_share`` by
    arithmetic, so they are broadcast; their rows then take a salted key that matches nothing and
    spread evenly through the shuffle join that serves all the light keys.
    """
    threshold = counts.agg(F.sum(count) * F.lit(heavy_share)).scalar()
    heavy = counts.filter(F.col(count) > threshold).select(F.col(key), F.col(count).alias("_heavy"))
    light = counts.filter(F.col(count) <= threshold).select(F.col(key).alias("_light_key"), F.col(count).alias("_light"))
    salted = F.concat(F.lit("\u0000"), F.xxhash64(*row_key).cast("string"))
    return (
        rows.join(F.broadcast(heavy), key, "left")
        .withColumn("_light_key", F.when(F.col("_heavy").isNull(), F.col(key)).otherwise(salted))
        .join(light, "_light_key", "left")
        .withColumn(count, F.coalesce("_heavy", "_light"))
        .drop("_heavy", "_light", "_light_key")
    )

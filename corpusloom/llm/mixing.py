"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, a target per source follows from its weight, and the repetition rate of a
source is target over size. Each document is emitted floor(rate) times, plus once more when its keyed
hash, read as a number in [0, 1), lies below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusloom.llm.registry import fresh
from corpusloom.sizing import is_small

SPACES = " \t\n\x0b\x0c\r"
SHARE = 1.5
CEILING = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).otherwise(F.lit(0)).cast("long")


def chance(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id, the text and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def ranked_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``: the weights in turn over the sources by code point, null last.

    One row per source goes through one task; sizes must be summed per source before.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def targets(sizes: DataFrame, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight).

    A source gets its weight's part of ``share`` times all sizes, at most ``ceiling`` times its own size; what
    is cut off goes to the others by weight until none is above. In order of size over weight the cut sources
    come first, so the common level of the others follows from running sums. A source without words gets 0.
    """
    cap = F.col("source_size") * F.lit(ceiling)
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    levels = sizes.withColumn("cap", cap).withColumn("level", left / weights).withColumn("cut", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.max(F.when(~F.col("cut"), F.col("level"))).over(every)
    target = F.when(F.col("cut"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return levels.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, weights: DataFrame | None = None, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Targets of the sources of rows (source, size); ``weights`` (source, weight) replaces the weights in turn."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size")).checkpoint()
    if weights is None:
        weighed = ranked_weights(sizes)
    else:
        other = weights.select(F.col("source").alias("other"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(other, F.col("source").eqNullSafe(F.col("other")), "left").drop("other").fillna(0.0, ["weight"])
    return targets(weighed, share, ceiling).checkpoint()


def copies(size: Column, target: Column, source_size: Column, chance_: Column) -> Column:
    """How often a document is emitted."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(chance_ < rate - F.floor(rate), F.lit(1)).otherwise(F.lit(0))).cast("long")


def counted(documents: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """Per document row: id, source, size, source_size, target, copies.

    Null text has no words; null is a source of its own; equal rows are emitted equally often; an empty
    table gives no rows.
    """
    whole = F.col(text).cast("string")
    sized = documents.select(
        F.col(id_).alias("id"), F.col(source).alias("source"), word_count(whole).alias("size"), chance(F.col(id_), whole, seed).alias("u")
    ).checkpoint()
    table = plan(sized).withColumnRenamed("source", "other")
    table = F.broadcast(table) if is_small(table) else table
    joined = sized.join(table, F.col("source").eqNullSafe(F.col("other")))
    return joined.select("id", "source", "size", "source_size", "target", copies(F.col("size"), F.col("target"), F.col("source_size"), F.col("u")).alias("copies"))


def mixed(documents: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The documents with all their columns, each repeated as often as the mix takes it, and the number of the copy.

    The copies lie side by side in the output of their task, so nothing but the sums per source is shuffled.
    """
    whole = F.col(text).cast("string")
    table = plan(documents.select(F.col(source).alias("source"), word_count(whole).alias("size")))
    table = F.broadcast(table) if is_small(table) else table
    other, size, target, times, copy = fresh(documents, "other", "source_size", "target", "times", "copy")
    table = table.select(F.col("source").alias(other), F.col("source_size").alias(size), F.col("target").alias(target))
    joined = documents.join(table, F.col(source).eqNullSafe(F.col(other)))
    joined = joined.withColumn(times, copies(F.lit(0), F.col(target), F.col(size), chance(F.col(id_), whole, seed)))
    joined = joined.filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return joined.select(*documents.columns, copy)

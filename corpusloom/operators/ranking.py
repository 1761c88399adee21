"""Top-k per group, first-wins deduplication and rank fusion.

``row_number() <= k`` is planned as a WindowGroupLimit below the shuffle: each map task passes on
at most k rows per group, so a group holding a third of all rows never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SCORE_DIGITS = 9


def by_score(score: str, *ties: str) -> list[Column]:
    """Order by descending score, then by the tie columns.

    Scores are compared at nine decimals so that the order does not depend on the order in
    which a floating-point sum was formed.
    """
    return [F.desc(F.round(F.col(score), SCORE_DIGITS)), *[F.asc(t) for t in ties]]


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_wins(df: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") == 1).drop("_nth")


def reciprocal_rank_fusion(ranked: list[DataFrame], query: str, item: str, k: int, rrf_k: int = 60) -> DataFrame:
    """Fuse ranked lists: score = sum of 1 / (rrf_k + rank), ranks from 1, best ``k`` per query."""
    lists = [r.select(query, item, (F.lit(1.0) / (F.col("rank") + rrf_k)).alias("part")) for r in ranked]
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    fused = union.groupBy(query, item).agg(F.sum("part").alias("score"))
    return top_k(fused, [query], by_score("score", item), k, "rrf_rank")

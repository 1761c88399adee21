"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.stored import stored


def _mark() -> Column:
    """A sum that differs, in all likelihood, when any link does."""
    return F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))


def _least(edges: DataFrame) -> DataFrame:
    """Per node the smaller of itself and its smallest neighbour in ``edges`` (u, v)."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, label), and a bound of its rows, for every node of the undirected links (a, b) of longs; the label is the smallest node reachable.

    Rounds of large-star and small-star: every node's larger neighbours, then its smaller ones, are linked to
    the smallest. The number of links never grows, hubs shrink to stars, and the result stays a table.
    """
    edges, before = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), mark=_mark())
    while before["rows"]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct().checkpoint()
        near = _least(large)
        less = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        edges, after = stored(less.filter("u != v").distinct().select(F.col("u").alias("a"), F.col("v").alias("b")), mark=_mark())
        if after == before:
            break
        before = after
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")))
    return labels.distinct(), 2 * before["rows"]

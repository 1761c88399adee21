"""Removal of lines spread over many sites, with DataFrame functions only.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation, so a
line that a third of all documents holds still sends one sketch per task. Lines whose estimate lies near the
threshold, which falls with the number of words, are counted exactly. The first occurrence of a spread line stays, all others go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.arrays import let
from corpusloom.llm.mixing import SPACES
from corpusloom.llm.registry import fresh
from corpusloom.sizing import is_small

Least = int | Sequence[tuple[int, int]]
#: From so many words on a line is spread if it occurs on so many sites: short lines repeat by chance, long ones hardly.
LEAST_SITES = ((1, 6), (4, 3), (21, 2))
LOG_SIZE = 12
#: Relative width of the zone in which an estimate isn't trusted: three standard errors of a sketch.
ZONE = 3 * 1.04 / 2 ** (LOG_SIZE / 2)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _rows(documents: DataFrame, text: str, *columns: Column) -> DataFrame:
    """One row per line that isn't blank: the columns, its place and its hash."""
    cut = documents.select(*columns, F.posexplode(lines(F.col(text).cast("string"))).alias("place", "line"))
    trimmed = F.btrim("line", F.lit(SPACES))
    return cut.withColumn("line", trimmed).filter(F.length("line") > 0).withColumn("h", F.xxhash64("line"))


def least_sites(line: Column, least: Least = LEAST_SITES) -> Column:
    """Number of sites from which on a line is spread: one for all lines, or by their number of words."""
    if isinstance(least, int):
        return F.lit(least)
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    (_, found), *longer = sorted(least)
    needed = F.lit(found)
    for n_words, sites in longer:
        needed = F.when(words >= n_words, sites).otherwise(needed)
    return needed


def spread_lines(documents: DataFrame, text: str = "text", site: str = "source", min_sites: Least = LEAST_SITES) -> DataFrame:
    """(h): hashes of the lines that occur on enough sites for their length (``least_sites``); null is a site of its own."""
    rows = _rows(documents, text, F.xxhash64(F.lit("site"), F.col(site)).alias("site"))
    rows = rows.withColumn("least", least_sites(F.col("line"), min_sites)).drop("line")
    estimated = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("least").alias("least"), F.hll_sketch_agg("site", F.lit(LOG_SIZE)).alias("sketch"))
    # A line can't be on more sites than it has occurrences.
    estimated = estimated.filter(F.col("n") >= F.col("least")).select("h", "least", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = F.col("least") * (1 - ZONE) - 0.5, F.col("least") * (1 + ZONE) + 0.5
    estimated = estimated.filter(F.col("sites") >= low).checkpoint()
    near = _small(estimated.filter(F.col("sites") < high).select("h"))
    exact = rows.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites"), F.min("least").alias("least"))
    sure = estimated.filter(F.col("sites") >= high).select("h")
    return sure.union(exact.filter(F.col("sites") >= F.col("least")).select("h"))


def removals(documents: DataFrame, id_: str = "doc_id", text: str = "text", site: str = "source", min_sites: Least = LEAST_SITES) -> DataFrame:
    """(ra, rb, drops): per document row hash the places of the lines to remove.

    The first occurrence of a line is in the document with the smallest id (null last), at its first place.
    Rows with equal id and text share one decision.
    """
    keys = [k.alias(n) for k, n in zip(row_keys(F.col(id_), F.col(text).cast("string")), ("ra", "rb"))]
    spread = _small(spread_lines(documents, text, site, min_sites).checkpoint())
    found = _rows(documents, text, F.col(id_).alias("id"), *keys).drop("line").join(spread, "h", "left_semi").checkpoint()
    order = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("ra").alias("ra"), F.col("rb").alias("rb"), F.col("place").alias("place"))
    first = found.groupBy("h").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.ra").alias("ra"), F.col("first.rb").alias("rb"), F.col("first.place").alias("place"))
    rest = found.select("ra", "rb", "place").join(first, ["ra", "rb", "place"], "left_anti")
    return rest.groupBy("ra", "rb").agg(F.collect_set("place").alias("drops"))


def row_keys(id_: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(id_, text), F.xxhash64(F.lit("second"), id_, text)


def cleaned(documents: DataFrame, id_: str = "doc_id", text: str = "text", site: str = "source", min_sites: Least = LEAST_SITES, report: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The documents with all their columns, spread lines cut out of the text; ``n_chars`` follows where it exists.

    A text of spread lines alone becomes empty; with ``drop_emptied`` its row goes, as all of its lines stand elsewhere. No
    other row is dropped: null and empty texts stay as they are, other lines keep their order and white space. Texts of any
    length are cut whole. ``report`` adds n_lines and n_removed.
    """
    whole = F.col(text).cast("string")
    ra, rb, drops, n_lines, n_removed = fresh(documents, "ra", "rb", "drops", "n_lines", "n_removed")
    gone = removals(documents, id_, text, site, min_sites).checkpoint()
    gone = _small(gone.select(F.col("ra").alias(ra), F.col("rb").alias(rb), F.col("drops").alias(drops)))
    a, b = row_keys(F.col(id_), whole)
    joined = documents.withColumns({ra: a, rb: b}).join(gone, [ra, rb], "left")
    every = F.sequence(F.lit(0), F.size(lines(whole)) - 1)
    kept = let(lines(whole), lambda parts: F.transform(F.array_except(every, F.col(drops)), lambda i: F.get(parts, i)))
    out = joined.withColumn(n_lines, F.greatest(F.size(lines(whole)), F.lit(0)).cast("long"))
    out = out.withColumn(n_removed, F.coalesce(F.greatest(F.size(drops), F.lit(0)), F.lit(0)).cast("long"))
    out = out.withColumn(text, F.when(F.col(drops).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(drops).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(documents.dtypes)["n_chars"]))
    if drop_emptied:
        out = out.filter(~((F.col(n_removed) > 0) & (F.length(F.btrim(text, F.lit(SPACES))) == 0)))
    return out.select(*documents.columns, *((n_lines, n_removed) if report else ()))

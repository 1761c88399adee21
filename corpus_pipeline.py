"""From raw documents to a training mix: five stages, each on all rows that its predecessor kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of docs. Null, empty and very long texts, repeated rows and empty
tables pass through with the results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontamination, line_dedup, mixing, ngram_join, toxicity
from corpusloom.llm.registry import prepare, table
from corpusloom.session import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labelled rows of docs."""
    prepare(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over sites stay once; a document goes if nothing is left of it, as all of its lines stand elsewhere."""
    prepare(spark)
    return line_dedup.cleaned(docs, drop_emptied=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    prepare(spark)
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, and the number of the copy."""
    prepare(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A learned score and a similarity join over arrays of shingles are no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is kept in the shared folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

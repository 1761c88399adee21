"""JSON-lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import text as tx


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Lines that are not blank, stripped, unparsed."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(tx.strip(F.col("value")).alias("value")).filter("value <> ''")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, glob: str | None = None) -> DataFrame:
    """Permissive scan with a declared schema: blank and malformed lines are dropped, no inference pass."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON array per file. A file is one task here, so use JSON lines for large data."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_arrow_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A data set exported as Parquet (its train split)."""
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append; a task's rows appear when it commits, so an interrupted run resumes by anti-join."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def concat_lines(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Concatenate line files without parsing them, leaving out blank lines."""
    read_lines(spark, paths).write.mode("overwrite").text(out)
    return spark.read.text(out)

"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.registry import Query, table
from corpusloom.session import shared_dir, ship_package

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

__all__ = ["ORACLES", "QUERIES", "fresh", "prepare", "query", "table"]


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and name the checkpoint folder."""
    ship_package(spark)
    shared_dir(spark)


def query(sql: str | None = None):
    """Register a function under its own name, optionally with its SQL statement."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each prefixed until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

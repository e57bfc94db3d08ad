"""Where queries and their oracles are registered, and what both are written with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.plans import relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, relation: str | None = None):
    """Registers a query by its name; with ``relation`` it gets that relation and its oracle the same as ``x``."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(rel.relation(spark, sf_dir, relation)) if relation else f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH x AS ({relation}) " if relation else "") + sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Registry of the named queries over the driver's tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function; doubles are rounded to 6 places on both sides."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of sums doesn't show; -0 is 0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])

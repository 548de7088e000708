"""Registration of queries: a Spark callable and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 10


def query(name: str, oracle: str | None = None):
    """Register the decorated function under ``name`` together with its oracle SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All double columns rounded, as the oracles do, so that summation order does not show."""
    return df.select(
        *[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def big(column: Column) -> Column:
    return column.cast("bigint")


def sql_round(columns: list[str], digits: int = DIGITS) -> str:
    return ", ".join(f"ROUND({c}, {digits}) + 0.0 AS {c}" for c in columns)

"""Table, report and prediction sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """Parquet table; with ``order_by`` its files follow one another in that order (a range shuffle, no single task)."""
    _ordered(df, order_by).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """CSV report with header, in as many files as the plan has partitions, in order if asked for."""
    _ordered(df, order_by).write.mode("overwrite").option("header", True).csv(path)


def _ordered(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by) if order_by else df


def write_predictions(df: DataFrame, path: str, experiment_id: str, split: str) -> None:
    """Predictions partitioned by experiment and split; writing a pair again replaces only that pair."""
    tagged = df.withColumns({"experiment_id": F.lit(experiment_id), "split": F.lit(split)})
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("experiment_id", "split").parquet(path)

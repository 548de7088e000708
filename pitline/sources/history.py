"""Back-filled price history: derived columns, types, and the resumable day-partitioned write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRICE_COLUMNS = ["date", "symbol", "isin", "open", "high", "low", "close", "prev_close", "volume", "traded_value"]
NUMERIC = ["open", "high", "low", "close", "prev_close", "volume", "traded_value"]


def with_prev_close_and_value(history: DataFrame) -> DataFrame:
    """Previous close within the symbol and close × volume (one row per symbol and day)."""
    w = Window.partitionBy("symbol").orderBy("date")
    return history.withColumn("prev_close", F.lag("close").over(w)).withColumn(
        "traded_value", F.col("close") * F.col("volume")
    )


def normalize_types(history: DataFrame) -> DataFrame:
    """Typed columns, trimmed identifiers, rows without date, symbol or close dropped."""
    typed = {c: F.col(c).try_cast("double") for c in NUMERIC if c in history.columns}
    typed["date"] = F.col("date").try_cast("date")
    typed |= {c: F.trim(F.col(c)) for c in ("symbol", "isin") if c in history.columns}
    return history.withColumns(typed).dropna(subset=["date", "symbol", "close"])


#: Folder of the commit records inside a day-partitioned table; readers of the table skip names with an underscore.
COMMITS = "_commits"
COMMIT_SCHEMA = "date date, rows long, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def committed_days(spark: SparkSession, path: str) -> DataFrame:
    """(date, rows, batch): the days whose write has ended, one row per day; none where nothing was written yet."""
    folder = f"{path}/{COMMITS}"
    if not _exists(spark, folder):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(folder)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed days; what a lost write left behind isn't read. Days are partitions, so others aren't scanned."""
    rows = spark.read.parquet(path)
    # one row per day: bounded by the calendar
    return rows.withColumn("date", F.col("date").cast("date")).join(F.broadcast(committed_days(spark, path).select("date")), "date", "left_semi")


def append_new_days(history: DataFrame, path: str) -> None:
    """Writes the days that have no commit record yet, each whole, and then their records.

    A day's record is written last, so a day without one is half a day at most, whatever stopped the write: its folder is
    replaced by the next run that brings the day, while committed days stay as they are. Rows without a date are left out.
    The rows are clustered by day before the write, so each day becomes few files; they are read once, and the driver gets
    the set of their days. A set is the same when a task runs twice.
    """
    spark = history.sparkSession
    known = committed_days(spark, path).select("date")
    # one row per day: bounded by the calendar
    new = history.where(F.col("date").isNotNull()).join(F.broadcast(known), "date", "left_anti")
    if new.isEmpty():
        return
    seen = Observation()
    dated = new.observe(seen, F.collect_set("date").alias("days"))
    dated.repartition("date").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    days = spark.createDataFrame([(d,) for d in seen.get["days"]], "date date")
    written = spark.read.parquet(path).withColumn("date", F.col("date").cast("date")).join(F.broadcast(days), "date")
    counted = written.groupBy("date").agg(F.count(F.lit(1)).alias("rows")).withColumn("batch", F.lit(uuid.uuid4().hex))
    counted.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")

"""As-of joins and nearest-in-time joins as unions plus windows.

A range join on an inequality would fall back to a nested loop. Here both sides are placed on one time axis
per key and a running ``last(ignore nulls)`` carries the right side onto the left rows: one shuffle, one sort.

``bucket_days`` splits each key's time axis, so that a key holding a large share of all rows is spread over many
tasks; what has to be known from earlier buckets travels as one carried row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DAY_SECONDS = 86_400


def _bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(time.cast("timestamp")) / F.lit(days * _DAY_SECONDS)).cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    carry: Sequence[str],
    direction: str = "backward",
    bucket_days: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Each left row with the ``carry`` columns of the closest right row at or before (after) its time.

    Ties on time match. Among right rows of one key and time any may be taken, so the right side should be
    unique on ``by + [right_on]``. Left rows without a match (or without a time) keep NULLs. ``tasks`` deals the keys over
    that many tasks (see ``tasks_for``).
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    by = list(by)
    time_left, time_right = F.col(left_on).cast("timestamp_ntz"), F.col(right_on).cast("timestamp_ntz")
    left_rows = left.select(
        *by, time_left.alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left")
    )
    right_rows = right.where(F.col(right_on).isNotNull()).select(
        *by, time_right.alias("__t"), F.lit(0).alias("__side"), F.struct(*carry).alias("__right")
    )
    rows = left_rows.unionByName(right_rows, allowMissingColumns=True)
    backward = direction == "backward"
    keys = by
    if bucket_days is not None:
        rows = rows.withColumn("__bucket", _bucket(F.col("__t"), bucket_days))
        rows = rows.unionByName(_carried_rows(rows, by, backward), allowMissingColumns=True)
        keys = by + ["__bucket"]
    if tasks is not None:
        rows = rows.repartition(tasks, *keys)
    time_order = F.col("__t").asc() if backward else F.col("__t").desc()
    order = Window.partitionBy(*keys).orderBy(time_order, F.col("__side"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = rows.withColumn("__match", F.last("__right", ignorenulls=True).over(running))
    return matched.where(F.col("__side") == 1).select(
        "__left.*", *[F.when(F.col("__t").isNotNull(), F.col(f"__match.{c}")).alias(c) for c in carry]
    )


def _carried_rows(rows: DataFrame, by: list[str], backward: bool) -> DataFrame:
    """One right row per key and bucket: the state every bucket inherits from those before it."""
    pick = F.max_by if backward else F.min_by
    per_bucket = (
        rows.where(F.col("__bucket").isNotNull())
        .groupBy(*by, "__bucket")
        .agg(pick("__right", F.when(F.col("__side") == 0, F.col("__t"))).alias("__right"))
    )
    bucket_order = F.col("__bucket").asc() if backward else F.col("__bucket").desc()
    before = (
        Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.withColumn("__right", F.last("__right", ignorenulls=True).over(before))
    edge = F.lit("0001-01-01" if backward else "9999-12-31").cast("timestamp_ntz")
    return carried.where(F.col("__right").isNotNull()).select(
        *by, "__bucket", edge.alias("__t"), F.lit(0).alias("__side"), "__right"
    )


def nearest_within(
    points: DataFrame,
    anchors: DataFrame,
    by: Sequence[str],
    on: str,
    carry: str,
    tolerance_days: int,
) -> DataFrame:
    """For each distinct (``by``, ``on``) of ``points`` the ``carry`` value of the nearest anchor within tolerance.

    Equal gaps go to the earlier anchor. Anchors must be unique on ``by + [on]``. The time axis is cut into
    buckets as wide as the tolerance and every anchor is visible in its own bucket and both neighbours, so the
    nearest admissible anchor is always in the bucket of the point: exact, and no key becomes one task.
    """
    by = list(by)
    bucket = _bucket(F.col(on), tolerance_days)
    wanted = points.where(F.col(on).isNotNull()).select(*by, on).distinct()
    wanted = wanted.select(*by, on, F.lit(1).alias("__side"), bucket.alias("__bucket"))
    seen = anchors.where(F.col(on).isNotNull()).select(
        *by,
        on,
        F.lit(0).alias("__side"),
        F.struct(F.col(on).alias("t"), F.col(carry).alias("v")).alias("__anchor"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__bucket"),
    )
    rows = wanted.unionByName(seen, allowMissingColumns=True)
    back = Window.partitionBy(*by, "__bucket").orderBy(F.col(on).asc(), "__side")
    ahead = Window.partitionBy(*by, "__bucket").orderBy(F.col(on).desc(), "__side")
    span = (Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("__b", F.last("__anchor", ignorenulls=True).over(back.rowsBetween(*span))).withColumn(
        "__f", F.last("__anchor", ignorenulls=True).over(ahead.rowsBetween(*span))
    )
    seconds = F.unix_seconds(F.col(on).cast("timestamp"))
    gap_back = seconds - F.unix_seconds(F.col("__b.t").cast("timestamp"))
    gap_ahead = F.unix_seconds(F.col("__f.t").cast("timestamp")) - seconds
    use_ahead = gap_ahead.isNotNull() & (gap_back.isNull() | (gap_ahead < gap_back))
    limit = F.lit(tolerance_days * _DAY_SECONDS)
    return (
        both.where(F.col("__side") == 1)
        .select(
            *by,
            on,
            F.when(use_ahead, F.col("__f.v")).otherwise(F.col("__b.v")).alias(carry),
            F.when(use_ahead, gap_ahead).otherwise(gap_back).alias("gap_seconds"),
        )
        .where(F.col("gap_seconds") <= limit)
    )

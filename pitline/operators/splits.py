"""Chronological splits with trading-day embargoes.

Split boundaries are scalars: each fit is one aggregation whose single row reaches the driver. The rows only get a
``split`` column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.operators.calendar import at_day, day_lookup

WEEKDAYS_BETWEEN = "size(filter(sequence({a}, {b}, INTERVAL 1 DAY), d -> d > {a} AND d < {b} AND weekday(d) < 5))"


def temporal_split(df: DataFrame, train_end: str, val_end: str, on: str = "period_ended") -> DataFrame:
    """train up to ``train_end``, val up to ``val_end``, test after; rows without a date get no split."""
    day = F.col(on)
    split = (
        F.when(day <= F.lit(train_end).cast("date"), "train")
        .when(day <= F.lit(val_end).cast("date"), "val")
        .when(day.isNotNull(), "test")
    )
    return df.withColumn("split", split)


def split_summary(df: DataFrame, on: str = "period_ended") -> DataFrame:
    """Rows, distinct periods and date range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(on).alias("periods"),
        F.min(on).alias("first_period"),
        F.max(on).alias("last_period"),
    )


def require_chronology(df: DataFrame, on: str = "period_ended") -> None:
    """Raise unless train, val and test follow one another and no event key is in two splits."""
    row = df.agg(
        *[F.expr(f"{f}(CASE WHEN split = '{s}' THEN {on} END)").alias(f"{s}_{f}") for s in ("train", "val", "test") for f in ("min", "max")]
    ).first()
    empty = [s for s in ("train", "val", "test") if row[f"{s}_min"] is None]
    if empty:
        raise ValueError(f"splits without a {on}: {empty}")
    if not (row["train_max"] < row["val_min"] and row["val_max"] < row["test_min"]):
        raise ValueError(f"splits are not chronological: {row}")
    shared = df.groupBy("event_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if shared:
        raise ValueError("duplicate event keys across splits")


def nth_weekday_after(day: dt.date, n: int, last: dt.date) -> dt.date:
    """The n-th Monday-to-Friday day strictly after ``day``, or the last weekday up to ``last``."""
    current, left = day, n
    while left and current < last:
        current += dt.timedelta(days=1)
        left -= current.weekday() < 5
    while current.weekday() >= 5:
        current -= dt.timedelta(days=1)
    return current


def embargo_split(
    df: DataFrame,
    train_end: str,
    val_end: str,
    embargo_days: int = 5,
    on: str = "period_ended",
    cutoff: str = "feature_cutoff_date",
    buffer_days: int = 30,
) -> DataFrame:
    """Temporal split in which val (test) rows whose cutoff is too close to train (val) become ``embargoed``.

    A row may stay from the ``embargo_days``-th weekday after the last cutoff of the split before it.
    """
    split = temporal_split(df, train_end, val_end, on)
    first = split.agg(
        F.expr(f"max(CASE WHEN split = 'train' THEN {cutoff} END) AS train_max"), F.max(cutoff).alias("last")
    ).first()
    if first["train_max"] is None:
        raise ValueError(f"no training row up to {train_end} has a {cutoff}")
    last = first["last"] + dt.timedelta(days=buffer_days)
    val_start = nth_weekday_after(first["train_max"], embargo_days, last)
    in_val = (F.col("split") == "val") & (F.col(cutoff) >= F.lit(val_start))
    val_max = split.agg(F.max(F.when(in_val, F.col(cutoff)))).first()[0]
    # without a validation row left, the test rows keep their distance from the training rows
    test_start = nth_weekday_after(val_max or first["train_max"], embargo_days, last)
    too_early = ((F.col("split") == "val") & ~F.coalesce(F.col(cutoff) >= F.lit(val_start), F.lit(False))) | (
        (F.col("split") == "test") & ~F.coalesce(F.col(cutoff) >= F.lit(test_start), F.lit(False))
    )
    return split.withColumn("split", F.when(too_early, "embargoed").otherwise(F.col("split")))


def verify_embargo(df: DataFrame, embargo_days: int = 5, cutoff: str = "feature_cutoff_date") -> DataFrame:
    """One row: cutoff ranges and weekdays strictly between neighbouring splits, and whether they reach the embargo.

    A split that starts exactly on the ``embargo_days``-th weekday has one weekday less strictly in between.
    """
    edge = df.agg(
        F.expr(f"max(CASE WHEN split = 'train' THEN {cutoff} END) AS train_max_cutoff"),
        F.expr(f"min(CASE WHEN split = 'val' THEN {cutoff} END) AS val_min_cutoff"),
        F.expr(f"max(CASE WHEN split = 'val' THEN {cutoff} END) AS val_max_cutoff"),
        F.expr(f"min(CASE WHEN split = 'test' THEN {cutoff} END) AS test_min_cutoff"),
    )
    between = lambda a, b: f"CASE WHEN {a} >= {b} THEN 0 ELSE {WEEKDAYS_BETWEEN.format(a=a, b=b)} END"
    return edge.selectExpr(
        "*",
        f"{between('train_max_cutoff', 'val_min_cutoff')} AS train_val_days_between",
        f"{between('val_max_cutoff', 'test_min_cutoff')} AS val_test_days_between",
    ).selectExpr(
        "*",
        f"coalesce(train_val_days_between >= {embargo_days}, false) AS train_val_ok",
        f"coalesce(val_test_days_between >= {embargo_days}, false) AS val_test_ok",
    )


def _add_months(day: dt.date, months: int) -> dt.date:
    """Same day of the month, or the month's last day when it has no such day."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    for last in (day.day, 30, 29, 28):
        try:
            return dt.date(year, month + 1, last)
        except ValueError:
            continue
    raise ValueError(day)


def walk_forward(
    df: DataFrame,
    initial_train_end: dt.date,
    val_end: dt.date,
    step_months: int = 3,
    embargo_days: int = 5,
    min_train_periods: int = 4,
    strict_gap: int | None = None,
    on: str = "period_ended",
    cutoff: str = "feature_cutoff_date",
    buffer_days: int = 30,
    val_axis: str | None = None,
) -> DataFrame:
    """Expanding folds: (fold, train_end, val_start, val_end, train_rows, val_rows, train_max_cutoff, val_min_cutoff).

    The candidate folds follow from the arguments alone. Two aggregations over the data, with a few columns per
    candidate, give the embargo dates and then the counts. Validation rows lie after the training periods and from
    the embargo date on along the cutoff axis (or another column's, named by ``val_axis``). Folds with too few training periods, without validation rows or with
    fewer than ``strict_gap`` (default: the embargo) weekdays strictly in between are left out.
    """
    edges, end = [], initial_train_end
    while _add_months(end, 1) <= val_end and (not edges or end < val_end):
        edges.append((end, min(_add_months(_add_months(end, 1), step_months) - dt.timedelta(days=1), val_end)))
        end = _add_months(end, step_months)
    lit = lambda d: f"DATE '{d}'"
    ends = df.agg(
        F.max(cutoff).alias("last"),
        *[F.expr(f"max(CASE WHEN {on} <= {lit(t)} THEN {cutoff} END) AS m{i}") for i, (t, _) in enumerate(edges)],
    ).first()
    last = ends["last"] + dt.timedelta(days=buffer_days)
    kept = [(t, v, nth_weekday_after(ends[f"m{i}"], embargo_days, last)) for i, (t, v) in enumerate(edges) if ends[f"m{i}"]]
    columns = []
    for i, (t, v, start) in enumerate(kept):
        train = f"{on} <= {lit(t)}"
        val = f"{on} > {lit(t)} AND {on} <= {lit(v)} AND {val_axis or cutoff} >= {lit(start)}"
        columns += [
            f"sum(CASE WHEN {train} THEN n ELSE 0 END) AS tr{i}",
            f"count(DISTINCT CASE WHEN {train} THEN {on} END) AS tp{i}",
            f"max(CASE WHEN {train} THEN {cutoff} END) AS tm{i}",
            f"sum(CASE WHEN {val} THEN n ELSE 0 END) AS vr{i}",
            f"min(CASE WHEN {val} THEN {cutoff} END) AS vm{i}",
        ]
    # counted per (period, cutoff) first: a table bounded by periods and days, on which the distinct counts are cheap
    stats = df.groupBy(on, cutoff).agg(F.count(F.lit(1)).alias("n")).agg(*[F.expr(c) for c in columns])
    entries = ", ".join(
        f"struct({lit(t)} AS train_end, {lit(s)} AS val_start, {lit(v)} AS val_end, tr{i} AS train_rows, vr{i} AS val_rows,"
        f" tp{i} AS train_periods, tm{i} AS train_max_cutoff, vm{i} AS val_min_cutoff)"
        for i, (t, v, s) in enumerate(kept)
    )
    folds = stats.selectExpr(f"explode(array({entries})) AS f").selectExpr("f.*")
    gap = f"CASE WHEN val_min_cutoff <= train_max_cutoff THEN 0 ELSE {WEEKDAYS_BETWEEN.format(a='train_max_cutoff', b='val_min_cutoff')} END"
    usable = folds.where(f"val_rows > 0 AND train_periods >= {min_train_periods}").withColumn("days_between", F.expr(gap))
    usable = usable.where(F.col("days_between") >= (embargo_days if strict_gap is None else strict_gap))
    # at most one row per candidate fold
    return usable.selectExpr("row_number() OVER (ORDER BY train_end) - 1 AS fold", "*")


def fraction_split(df: DataFrame, fractions: Sequence[float] = (0.6, 0.8), on: str = "period_ended") -> DataFrame:
    """Split by shares of the distinct periods: first 60 % train, next 20 % val, rest test."""
    # one row per reporting period: the ranking and the broadcast are bounded by the number of periods
    periods = df.where(F.col(on).isNotNull()).select(on).distinct()
    ranked = periods.selectExpr(on, f"row_number() OVER (ORDER BY {on}) AS r", "count(*) OVER () AS n").selectExpr(
        on,
        f"CASE WHEN r <= floor(n * {fractions[0]}) THEN 'train' WHEN r <= floor(n * {fractions[1]}) THEN 'val' ELSE 'test' END AS split",
    )
    return df.join(F.broadcast(ranked), on, "left")


def announcement_folds(df: DataFrame, on: str = "result_announcement_datetime", folds: int = 3, embargo_days: int = 7) -> DataFrame:
    """Folds over the distinct announcement times: train the first 50 % (+20 % per fold), val the next 20 %.

    Ranks are built in two levels, within each day and over the days, so no task orders all times. ``embargo_events``
    counts training events within ``embargo_days`` calendar days before validation starts.
    """
    times = df.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    days = times.groupBy(F.expr("cast(ts AS date) AS day")).agg(F.count(F.lit(1)).alias("times"))
    offsets = days.selectExpr(
        "day",
        "coalesce(sum(times) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        "sum(times) OVER () AS total",
    )
    ranked = times.withColumn("day", F.expr("cast(ts AS date)")).join(F.broadcast(offsets), "day").selectExpr(
        "ts", "n", "total", "before + row_number() OVER (PARTITION BY day ORDER BY ts) - 1 AS rank"
    )
    columns = []
    for i in range(folds):
        a, b = f"(floor(0.5 * total) + {i} * floor(total / 5))", f"(floor(0.5 * total) + {i + 1} * floor(total / 5))"
        columns += [
            f"min(CASE WHEN rank < {a} THEN ts END) AS ts{i}",
            f"max(CASE WHEN rank < {a} THEN ts END) AS te{i}",
            f"min(CASE WHEN rank >= {a} AND rank < {b} THEN ts END) AS vs{i}",
            f"max(CASE WHEN rank >= {a} AND rank < {b} THEN ts END) AS ve{i}",
            f"sum(CASE WHEN rank < {a} THEN n ELSE 0 END) AS tn{i}",
            f"sum(CASE WHEN rank >= {a} AND rank < {b} THEN n ELSE 0 END) AS vn{i}",
            f"bool_or({b} >= total) AS over{i}",
        ]
    stats = ranked.agg(*[F.expr(c) for c in columns])
    entries = ", ".join(
        f"struct({i + 1} AS fold, ts{i} AS train_start, te{i} AS train_end, vs{i} AS val_start, ve{i} AS val_end,"
        f" tn{i} AS train_events, vn{i} AS val_events, over{i} AS over)"
        for i in range(folds)
    )
    table = stats.selectExpr(f"explode(array({entries})) AS f").selectExpr("f.*").where("NOT over").drop("over")
    near = (
        df.where(F.col(on).isNotNull())
        .select(F.col(on).alias("ts"))
        .join(F.broadcast(table.selectExpr("fold", "train_start", "train_end", "val_start")), F.expr(
            f"ts <= train_end AND ts > val_start - INTERVAL {embargo_days} DAYS"))
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("embargo_events"))
    )
    return table.join(near, "fold", "left").fillna(0, ["embargo_events"])


def label_contamination(
    df: DataFrame,
    train_end: str,
    val_end: str,
    on: str = "result_announcement_datetime",
    reach: dict[str, int] | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Share of train (val) rows whose label window runs past the split boundary.

    Windows are calendar days (1, 4 and 7). With a trading ``calendar`` they are trading days (1, 3 and 5): a window ends
    that many places after the last trading day at or before the announcement, and crosses when that is beyond the place of
    the last trading day at or before the boundary.
    """
    reach = reach or ({"1d_after": 1, "3d_after": 4, "5d_after": 7} if calendar is None else {"1d_after": 1, "3d_after": 3, "5d_after": 5})
    bounds = {"train": train_end, "val": val_end}
    if calendar is None:
        crosses = {(s, d): f"{on} + INTERVAL {d} DAYS > TIMESTAMP_NTZ '{b} 00:00:00'" for s, b in bounds.items() for d in reach.values()}
    else:
        df = at_day(df.select("split", on), day_lookup(calendar), F.col(on), "__l_")
        # a calendar is bounded by its days; two numbers are read from it
        places = calendar.agg(*[F.expr(f"max(CASE WHEN date <= DATE '{b}' THEN idx END) AS {s}") for s, b in bounds.items()]).first()
        crosses = {(s, d): f"coalesce(__l_idx, -1) + {d} > {-1 if places[s] is None else places[s]}" for s in bounds for d in reach.values()}
    columns = [F.expr(f"count_if(split = '{s}') AS n_{s}") for s in bounds]
    columns += [F.expr(f"count_if(split = '{s}' AND {on} IS NOT NULL AND {crossing}) AS c_{s}_{d}") for (s, d), crossing in crosses.items()]
    entries = ", ".join(
        f"struct('{s}' AS split, '{w}' AS label_window, DATE '{b}' AS boundary, c_{s}_{d} AS crossing_events,"
        f" round(100.0D * c_{s}_{d} / nullif(n_{s}, 0), 2) AS pct)"
        for s, b in bounds.items()
        for w, d in reach.items()
    )
    return df.agg(*columns).selectExpr(f"explode(array({entries})) AS r").selectExpr("r.*")

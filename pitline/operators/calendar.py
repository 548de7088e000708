"""Trading calendars and the dates derived from them.

A calendar has one row per distinct day, so it is bounded by the days covered (366 per year) however many price
rows there are. That bound is what allows the unpartitioned ranking and the broadcasts in this module;
``MAX_DAYS`` is enforced while the calendar is ranked, so a wrong input fails instead of flooding executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitline.functions.dates import minute_of_day
from pitline.session import stage

MAX_DAYS = 200_000  # more than 500 years of days
MARKET_OPEN_MINUTE = 9 * 60 + 15
MARKET_CLOSE_MINUTE = 15 * 60 + 30


def _ranked(days: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.orderBy("date")) - 1
    guarded = F.when(rank >= MAX_DAYS, F.raise_error(F.lit("calendar exceeds MAX_DAYS")).cast("int")).otherwise(rank)
    return days.select("date", guarded.alias("idx"))


def trading_calendar(prices: DataFrame, on: str = "date") -> DataFrame:
    """Distinct trading days with their position: (date, idx), idx from 0.

    Written once, a row per day: whatever looks days up reads that, and the price table is scanned for its dates one time.
    """
    days = prices.select(F.col(on).cast("date").alias("date")).where(F.col("date").isNotNull()).distinct()
    return stage(_ranked(days).coalesce(1))


def weekday_calendar(bounds: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Monday-to-Friday calendar between the ``start`` and ``end`` of the one-row ``bounds``, less holidays."""
    day = F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL 1 DAY")))
    days = bounds.select(day.alias("date")).where(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select(F.col("date").cast("date")), "date", "left_anti")
    return _ranked(days)


def calendar_from_data(df: DataFrame, on: str, buffer_days: int = 30) -> DataFrame:
    """Weekday calendar over the range of ``on``, widened by ``buffer_days`` on both sides."""
    bounds = df.agg(
        F.date_sub(F.min(F.col(on).cast("date")), buffer_days).alias("start"),
        F.date_add(F.max(F.col(on).cast("date")), buffer_days).alias("end"),
    )
    return weekday_calendar(bounds)


def day_lookup(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first trading day to one past the last, with its place in the calendar; that one day
    stands for all later ones, which have the same place (see ``at_day``).

    Columns: day, is_trading_day, idx and trade_date of the last trading day at or before ``day``, and the
    trading days before and after that one; last_idx is the end of the calendar.
    Further calendar columns give ``x``, ``prev_x`` and ``next_x`` for those same three trading days.
    """
    order = Window.orderBy("date")
    facts = [c for c in calendar.columns if c not in ("date", "idx")]
    shifted = {
        f"{side}_{c}": shift(c).over(order) for c in ["date", *facts] for side, shift in (("prev", F.lag), ("next", F.lead))
    }
    placed = calendar.withColumns(shifted | {"last_idx": F.max("idx").over(Window.partitionBy())})
    until = F.coalesce(F.date_sub(F.col("next_date"), 1), F.date_add(F.col("date"), 1))
    days = placed.select(
        F.explode(F.sequence(F.col("date"), until, F.expr("INTERVAL 1 DAY"))).alias("day"),
        "idx",
        "last_idx",
        F.col("date").alias("trade_date"),
        *facts,
        *shifted,
    )
    return days.withColumn("is_trading_day", F.col("day") == F.col("trade_date"))


def at_day(df: DataFrame, lookup: DataFrame, day: Column, prefix: str = "") -> DataFrame:
    """Join the calendar position of ``day`` onto ``df`` (columns get ``prefix``).

    Days before the first trading day find nothing; days past the last one are looked up at the day after it. An equality
    join against a table bounded by calendar days: the
    left side is not shuffled.
    """
    named = lookup.select(*[F.col(c).alias(f"{prefix}{c}") for c in lookup.columns])
    end = lookup.select(F.max("day")).scalar()
    keyed = df.withColumn("__day", F.when(day.isNotNull(), F.least(day.cast("date"), end)))
    return keyed.join(F.broadcast(named), F.col("__day") == F.col(f"{prefix}day"), "left").drop("__day", f"{prefix}day")


def session_type(ts: Column, is_trading_day: Column) -> Column:
    """Announcement session; a missing or exact-midnight time is unknown whatever the day."""
    midnight = (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0)
    minute = minute_of_day(ts)
    return (
        F.when(ts.isNull() | midnight, "unknown")
        .when(~F.coalesce(is_trading_day, F.lit(False)), "non_trading_day")
        .when(minute < MARKET_OPEN_MINUTE, "pre_market")
        .when(minute <= MARKET_CLOSE_MINUTE, "during_market")
        .otherwise("post_market")
    )


def clock_session(ts: Column) -> Column:
    """Session from the clock alone, without looking at the calendar."""
    minute = minute_of_day(ts)
    return (
        F.when(minute < MARKET_OPEN_MINUTE, "pre_market")
        .when(minute > MARKET_CLOSE_MINUTE, "post_market")
        .otherwise("during_market")
    )


def place_events(events: DataFrame, lookup: DataFrame, on: str, non_trading_lag: int = 1) -> DataFrame:
    """Join ``lookup`` at the announcement day and decide which of its trading days apply.

    Adds the lookup columns, announcement_session_type, ``own_close`` (the announcement day's close is already known
    history) and ``same_day`` (the reaction starts on the announcement day).
    """
    placed = at_day(events, lookup, F.col(on))
    kind, trading = F.col("announcement_session_type"), F.coalesce("is_trading_day", F.lit(False))
    own_close = (kind == "post_market") & trading
    if non_trading_lag == 0:
        own_close = own_close | (kind == "non_trading_day")
    session = session_type(F.col(on), F.col("is_trading_day"))
    return placed.withColumn("announcement_session_type", session).withColumns(
        {"own_close": own_close, "same_day": (kind == "pre_market") & trading}
    )


def event_dates(events: DataFrame, calendar: DataFrame, on: str, non_trading_lag: int = 1) -> DataFrame:
    """Add announcement_session_type, feature_cutoff_date and reaction_start_date.

    The cutoff is the announcement day only after the close of a trading day, else the trading day before; the
    reaction starts that day only before the open of a trading day, else on the next trading day. With
    ``non_trading_lag=0`` a weekend announcement may use the close of the last trading day before it.
    """
    placed = place_events(events, day_lookup(calendar), on, non_trading_lag)
    return placed.select(*events.columns, "announcement_session_type", *cutoff_and_reaction())


def cutoff_and_reaction() -> list[Column]:
    return [
        F.when(F.col("own_close"), F.col("trade_date")).otherwise(F.col("prev_date")).alias("feature_cutoff_date"),
        F.when(F.col("same_day"), F.col("trade_date")).otherwise(F.col("next_date")).alias("reaction_start_date"),
    ]


def add_embargo(df: DataFrame, calendar: DataFrame, on: str, days: int, name: str = "embargo_date") -> DataFrame:
    """The ``days``-th trading day strictly after ``on``, or the last trading day if the calendar ends earlier."""
    placed = at_day(df, day_lookup(calendar), F.col(on), "__e_")
    target = F.least(F.coalesce(F.col("__e_idx"), F.lit(-1)) + F.lit(days), F.col("__e_last_idx"))
    placed = placed.withColumn("__target", F.when(F.col(on).isNotNull(), target))
    ends = calendar.select(F.col("date").alias(name), F.col("idx").alias("__target"))
    helpers = [c for c in placed.columns if c.startswith("__e_")]
    return placed.drop(*helpers).join(F.broadcast(ends), "__target", "left").drop("__target")


def count_between(df: DataFrame, calendar: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """Number of trading days strictly between two dates, as a difference of calendar positions."""
    lookup = day_lookup(calendar)
    placed = at_day(at_day(df, lookup, F.col(start), "__s_"), lookup, F.col(end), "__n_")
    from_idx = F.coalesce(F.col("__s_idx"), F.lit(-1))
    # the last position before ``end``: its own position, less one when ``end`` itself trades
    to_idx = F.coalesce(F.col("__n_idx") - F.col("__n_is_trading_day").cast("int"), F.lit(-1))
    gap = F.greatest(to_idx - from_idx, F.lit(0))
    helpers = [c for c in placed.columns if c.startswith(("__s_", "__n_"))]
    return placed.withColumn(name, F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), gap)).drop(*helpers)

"""Calendar, price-feature and reaction-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline import standins
from pitline.catalog.ctes import RETURN_KS, with_ctes
from pitline.catalog.registry import big, query, rounded, sql_round
from pitline.catalog.tables import bench, calendar, events, market, prices
from pitline.operators import calendar as cal_ops
from pitline.operators import prices as px_ops
from pitline.operators.asof import asof_join


@query("trading_calendar", with_ctes("SELECT date, CAST(idx AS BIGINT) AS idx FROM cal", "cal"))
def trading_calendar(spark, d):
    return calendar(spark, d).select("date", big(F.col("idx")).alias("idx"))


@query(
    "event_session_dates",
    with_ctes(
        "SELECT event_key, announcement_session_type, feature_cutoff_date, reaction_start_date FROM evd", "evd"
    ),
)
def event_session_dates(spark, d):
    announced = events(spark, d).where(F.col("result_announcement_datetime").isNotNull())
    dated = cal_ops.event_dates(announced, calendar(spark, d), "result_announcement_datetime")
    return dated.select("event_key", "announcement_session_type", "feature_cutoff_date", "reaction_start_date")


@query(
    "event_session_dates_same_close",
    with_ctes(
        """
SELECT e.event_key, e.announcement_session_type,
       CASE WHEN e.announcement_session_type = 'non_trading_day' THEN b.date ELSE e.feature_cutoff_date END AS feature_cutoff_date
FROM evd e ASOF LEFT JOIN cal b ON b.date <= CAST(e.result_announcement_datetime AS DATE)""",
        "evd",
    ),
)
def event_session_dates_same_close(spark, d):
    announced = events(spark, d).where(F.col("result_announcement_datetime").isNotNull())
    dated = cal_ops.event_dates(announced, calendar(spark, d), "result_announcement_datetime", non_trading_lag=0)
    return dated.select("event_key", "announcement_session_type", "feature_cutoff_date")


@query("session_counts", with_ctes(
    "SELECT announcement_session_type, COUNT(*) AS events FROM evd GROUP BY 1", "evd"))
def session_counts(spark, d):
    announced = events(spark, d).where(F.col("result_announcement_datetime").isNotNull())
    dated = cal_ops.event_dates(announced, calendar(spark, d), "result_announcement_datetime")
    return dated.groupBy("announcement_session_type").agg(F.count(F.lit(1)).alias("events"))


def _family(name: str, columns: list[str], *steps):
    cte = "pf" if "volume" in columns[0] else "pf0"

    @query(name, with_ctes(f"SELECT symbol, date, {sql_round(columns, 12)} FROM {cte}", cte))
    def run(spark, d):
        df = prices(spark, d)
        for step in steps:
            df = step(df)
        return rounded(df.select("symbol", "date", *columns), 12)

    return run


_family("trailing_returns", px_ops.RETURN_COLUMNS, px_ops.with_returns)
_family("volatility", px_ops.VOLATILITY_COLUMNS, px_ops.with_history, px_ops.with_returns, px_ops.with_volatility)
_family("volume_features", px_ops.VOLUME_COLUMNS, px_ops.with_volume_features)
_family("moving_average_distance", px_ops.MA_COLUMNS, px_ops.with_history, px_ops.with_ma_distance)
_family("drawdown", px_ops.DRAWDOWN_COLUMNS, px_ops.with_history, px_ops.with_drawdown)
_family("forward_returns", [f"forward_{k}d" for k in px_ops.LABEL_WINDOWS], px_ops.with_forward_returns)


@query(
    "benchmark_by_day",
    with_ctes(
        "SELECT c.date, COALESCE(b.history_days, 0) AS bench_history_days, "
        + ", ".join(f"ROUND(b.return_{k}d, 10) + 0.0 AS bench_return_{k}d" for k in RETURN_KS)
        + ", "
        + ", ".join(f"ROUND(a.forward_{k}d, 10) + 0.0 AS bench_forward_{k}d" for k in px_ops.LABEL_WINDOWS)
        + " FROM cal c ASOF LEFT JOIN bf b ON b.date <= c.date ASOF LEFT JOIN bf a ON a.date >= c.date",
        "cal",
        "bf",
    ),
)
def benchmark_by_day(spark, d):
    df = px_ops.benchmark_by_day(calendar(spark, d), bench(spark, d)).select(
        "date",
        big(F.coalesce("state.history_days", F.lit(0))).alias("bench_history_days"),
        *[F.col(f"state.return_{k}d").alias(f"bench_return_{k}d") for k in RETURN_KS],
        *[F.col(f"ahead.forward_{k}d").alias(f"bench_forward_{k}d") for k in px_ops.LABEL_WINDOWS],
    )
    return rounded(df)


_ABNORMAL = ["event_key", "symbol", "announcement_session_type", "feature_cutoff_date", "reaction_start_date", "reaction_class"]


@query(
    "event_abnormal_return",
    with_ctes(
        f"SELECT {', '.join(_ABNORMAL)}, {sql_round(sorted(px_ops.LABEL_COLUMNS))} FROM mkt", "mkt"
    ),
)
def event_abnormal_return(spark, d):
    return rounded(market(spark, d).select(*_ABNORMAL, *sorted(px_ops.LABEL_COLUMNS)))


_WIDE = px_ops.PRICE_FEATURES + px_ops.RELATIVE_COLUMNS


@query(
    "event_market_features",
    with_ctes(
        "SELECT event_key, symbol, company_name, period_ended, fiscal_quarter, result_announcement_datetime, "
        f"announcement_session_type, quality_flags, price_history_days, benchmark_history_days, {sql_round(_WIDE)} FROM mkt",
        "mkt",
    ),
)
def event_market_features(spark, d):
    meta = [
        "event_key", "symbol", "company_name", "period_ended", "fiscal_quarter", "result_announcement_datetime",
        "announcement_session_type", "quality_flags",
    ]
    df = market(spark, d).select(
        *meta,
        big(F.col("price_history_days")).alias("price_history_days"),
        big(F.col("benchmark_history_days")).alias("benchmark_history_days"),
        *_WIDE,
    )
    return rounded(df)


@query(
    "relative_returns",
    with_ctes(f"SELECT event_key, {sql_round(px_ops.RELATIVE_COLUMNS)} FROM mkt", "mkt"),
)
def relative_returns(spark, d):
    return rounded(market(spark, d).select("event_key", *px_ops.RELATIVE_COLUMNS))


@query(
    "history_flags",
    with_ctes(
        "SELECT flag, COUNT(*) AS events FROM (SELECT unnest(string_split(quality_flags, '|')) AS flag FROM mkt) GROUP BY 1",
        "mkt",
    ),
)
def history_flags(spark, d):
    flags = market(spark, d).select(F.explode(F.split("quality_flags", "\\|")).alias("flag"))
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("events"))


@query(
    "skip_reasons",
    with_ctes(
        "SELECT COALESCE(skip_reason, 'used') AS reason, COUNT(*) AS events FROM mkta GROUP BY 1", "mkta"
    ),
)
def skip_reasons(spark, d):
    full = px_ops.event_market_features(
        events(spark, d), prices(spark, d), bench(spark, d), calendar(spark, d), keep_skipped=True
    )
    return full.groupBy(F.coalesce("skip_reason", F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "reaction_class_counts",
    with_ctes("SELECT reaction_class, COUNT(*) AS events FROM mkt GROUP BY 1", "mkt"),
)
def reaction_class_counts(spark, d):
    return market(spark, d).groupBy("reaction_class").agg(F.count(F.lit(1)).alias("events"))


@query(
    "price_as_of_announcement",
    with_ctes(
        """
SELECT a.document_id, p.date AS price_date, ROUND(p.close, 10) AS close
FROM ann a ASOF LEFT JOIN px p ON p.symbol = a.symbol AND p.date <= CAST(a.announcement_datetime AS DATE)""",
        "ann",
        "px",
    ),
)
def price_as_of_announcement(spark, d):
    docs = standins.announcements(spark, d).select(
        "document_id", "symbol", F.col("announcement_datetime").cast("date").alias("day")
    )
    px = prices(spark, d).select("symbol", F.col("date").alias("price_date"), "close")
    joined = asof_join(docs, px, ["symbol"], "day", "price_date", ["price_date", "close"], bucket_days=365)
    return rounded(joined.select("document_id", "price_date", "close"))


@query(
    "price_after_announcement",
    with_ctes(
        """
SELECT a.document_id, p.date AS price_date, ROUND(p.close, 10) AS close
FROM ann a ASOF LEFT JOIN px p ON p.symbol = a.symbol AND p.date >= CAST(a.announcement_datetime AS DATE)""",
        "ann",
        "px",
    ),
)
def price_after_announcement(spark, d):
    docs = standins.announcements(spark, d).select(
        "document_id", "symbol", F.col("announcement_datetime").cast("date").alias("day")
    )
    px = prices(spark, d).select("symbol", F.col("date").alias("price_date"), "close")
    joined = asof_join(
        docs, px, ["symbol"], "day", "price_date", ["price_date", "close"], direction="forward", bucket_days=365
    )
    return rounded(joined.select("document_id", "price_date", "close"))


@query(
    "backfill_prev_close",
    with_ctes(
        """
SELECT symbol, date, ROUND(lag(close) OVER (PARTITION BY symbol ORDER BY date), 10) AS prev_close,
       ROUND(close * volume, 10) AS traded_value FROM px""",
        "px",
    ),
)
def backfill_prev_close(spark, d):
    from pitline.sources.history import with_prev_close_and_value

    df = with_prev_close_and_value(prices(spark, d))
    return rounded(df.select("symbol", "date", "prev_close", "traded_value"))


@query(
    "weekday_calendar_gaps",
    with_ctes(
        """
, days AS (
  SELECT CAST(unnest(generate_series((SELECT MIN(date) FROM px) - INTERVAL 30 DAY, (SELECT MAX(date) FROM px) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS date
), wk AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM days WHERE isodow(date) < 6 AND NOT (month(date) = 1 AND day(date) = 26))
SELECT COUNT(*) AS weekdays, MIN(date) AS first_day, MAX(date) AS last_day, COUNT(*) FILTER (WHERE date NOT IN (SELECT date FROM cal)) AS without_prices FROM wk""",
        "cal",
    ).replace("\n,", ",", 1),
)
def weekday_calendar_gaps(spark, d):
    px = prices(spark, d)
    bounds = px.agg(F.date_sub(F.min("date"), 30).alias("start"), F.date_add(F.max("date"), 30).alias("end"))
    every = bounds.select(F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date"))
    holidays = every.where((F.month("date") == 1) & (F.dayofmonth("date") == 26))
    weekdays = cal_ops.weekday_calendar(bounds, holidays)
    seen = calendar(spark, d).select("date", F.lit(True).alias("seen"))
    return weekdays.join(seen, "date", "left").agg(
        F.count(F.lit(1)).alias("weekdays"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.count_if(F.col("seen").isNull()).alias("without_prices"),
    )


@query(
    "embargo_dates",
    with_ctes(
        """
SELECT e.event_key, (SELECT date FROM cal WHERE idx = LEAST(COALESCE(b.idx, -1) + 5, (SELECT MAX(idx) FROM cal))) AS embargo_date,
       (SELECT COUNT(*) FROM cal c WHERE c.date > e.period_ended AND c.date < CAST(e.result_announcement_datetime AS DATE)) AS days_between,
       (SELECT MAX(date) FROM cal) AS far_embargo_date, (SELECT COUNT(*) FROM cal c WHERE c.date > e.period_ended) AS days_to_far,
       (SELECT date FROM cal WHERE idx = LEAST(4, (SELECT MAX(idx) FROM cal))) AS early_embargo_date,
       (SELECT COUNT(*) FROM cal c WHERE c.date < e.period_ended) AS days_from_early
FROM ev e ASOF LEFT JOIN cal b ON b.date <= e.period_ended
WHERE e.period_ended IS NOT NULL AND e.result_announcement_datetime IS NOT NULL""",
        "ev",
        "cal",
    ),
)
def embargo_dates(spark, d):
    ev = events(spark, d).where(F.col("period_ended").isNotNull() & F.col("result_announcement_datetime").isNotNull())
    ev = ev.withColumn("announced_on", F.col("result_announcement_datetime").cast("date"))
    cal = calendar(spark, d)
    placed = cal_ops.count_between(
        cal_ops.add_embargo(ev, cal, "period_ended", 5), cal, "period_ended", "announced_on", "days_between"
    )
    # the same for dates decades past the end of the calendar and before its start
    placed = placed.withColumns({"far": F.date_add("period_ended", 20_000), "early": F.date_sub("period_ended", 20_000)})
    placed = cal_ops.add_embargo(cal_ops.add_embargo(placed, cal, "far", 5, "far_embargo_date"), cal, "early", 5, "early_embargo_date")
    placed = cal_ops.count_between(placed, cal, "period_ended", "far", "days_to_far")
    placed = cal_ops.count_between(placed, cal, "early", "period_ended", "days_from_early")
    counts = ("days_between", "days_to_far", "days_from_early")
    return placed.select("event_key", "embargo_date", "far_embargo_date", "early_embargo_date", *[big(F.col(c)).alias(c) for c in counts])

"""What a company's earlier events say: counts, averages, rates, trend and streak over strictly earlier events.

Rows are one per company and period, so each window covers at most a company's number of reporting periods.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitline.operators.asof import asof_join

ORDER = "PARTITION BY symbol ORDER BY period_ended NULLS LAST, event_key"
MEAN_WINDOWS = (2, 4, 8)
RATE_WINDOWS = (4, 8)
HORIZONS = (1, 3, 5)

HISTORY_COLUMNS = (
    ["prior_earnings_count", "prior_last_reaction_class", "prior_days_since_last"]
    + [f"prior_last_abn_ret_{h}d" for h in HORIZONS]
    + [f"prior_abn_ret_{h}d_mean_{n}" for h in HORIZONS for n in MEAN_WINDOWS]
    + [f"prior_abn_ret_{h}d_{s}_{n}" for h in HORIZONS for s in ("median", "std") for n in RATE_WINDOWS]
    + [f"prior_{c}_rate_{n}" for c in ("positive", "negative", "neutral") for n in RATE_WINDOWS]
    + [f"prior_avg_reaction_magnitude_{n}" for n in MEAN_WINDOWS]
    + [f"prior_reaction_trend_{n}" for n in RATE_WINDOWS]
    + ["prior_reaction_streak"]
)


def with_prior_history(events: DataFrame, known_before: str | None = None, tasks: int | None = None) -> DataFrame:
    """Add the ``prior_`` columns to labelled events (symbol, period_ended, event_key, abnormal returns, class).

    Averages skip missing returns but need N earlier events; rates divide by N, so an unlabelled event counts as
    "no". The magnitude is the mean absolute 5-day return. The trend is the least-squares slope of -1/0/1 over the
    labelled ones among the last N. ``known_before`` names a boolean column (is this event's label known when the
    next one is predicted); labels of events where it is false are treated as missing. ``tasks`` deals the companies over
    that many tasks (see ``tasks_for``).
    """
    source = events if tasks is None else events.repartition(tasks, "symbol")
    if known_before is not None:
        hidden = {f"abnormal_return_{h}d": F.when(F.col(known_before), F.col(f"abnormal_return_{h}d")) for h in HORIZONS}
        source = source.withColumns(hidden | {"reaction_class": F.when(F.col(known_before), F.col("reaction_class"))})
    w = ORDER
    before = lambda n: f"OVER ({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    count = f"row_number() OVER ({w}) - 1"
    gated = lambda n, x: f"CASE WHEN {count} >= {n} THEN {x} END"
    out = [
        f"{count} AS prior_earnings_count",
        f"lag(reaction_class) OVER ({w}) AS prior_last_reaction_class",
        f"datediff(period_ended, lag(period_ended) OVER ({w})) AS prior_days_since_last",
    ]
    for h in HORIZONS:
        out.append(f"lag(abnormal_return_{h}d) OVER ({w}) AS prior_last_abn_ret_{h}d")
        for n in MEAN_WINDOWS:
            out.append(gated(n, f"avg(abnormal_return_{h}d) {before(n)}") + f" AS prior_abn_ret_{h}d_mean_{n}")
        for n in RATE_WINDOWS:
            out.append(gated(n, f"percentile(abnormal_return_{h}d, 0.5) {before(n)}") + f" AS prior_abn_ret_{h}d_median_{n}")
            out.append(gated(n, f"stddev_samp(abnormal_return_{h}d) {before(n)}") + f" AS prior_abn_ret_{h}d_std_{n}")
    for n in RATE_WINDOWS:
        for name in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
            hit = f"CASE WHEN reaction_class = '{name}' THEN 1.0D ELSE 0.0D END"
            out.append(gated(n, f"avg({hit}) {before(n)}") + f" AS prior_{name.lower()}_rate_{n}")
        out.append(gated(n, f"collect_list(__signal) {before(n)}") + f" AS __signals_{n}")
    for n in MEAN_WINDOWS:
        out.append(gated(n, f"avg(abs(abnormal_return_5d)) {before(n)}") + f" AS prior_avg_reaction_magnitude_{n}")
    # length of the run of equal classes ending at this row; a missing class continues no run
    change = f"CASE WHEN reaction_class = lag(reaction_class) OVER ({w}) THEN 0 ELSE 1 END AS __change"
    marked = source.selectExpr(
        "*",
        "CASE reaction_class WHEN 'POSITIVE' THEN 1.0D WHEN 'NEUTRAL' THEN 0.0D WHEN 'NEGATIVE' THEN -1.0D END AS __signal",
        change,
    )
    runs = marked.selectExpr("*", f"sum(__change) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __run")
    # __run never decreases along the order, so the rank inside a run needs no other sort
    lengths = runs.selectExpr("*", f"row_number() OVER ({w}) AS __row").selectExpr(
        "*", "__row - min(__row) OVER (PARTITION BY symbol, __run) + 1 AS __length"
    )
    shifted = lengths.selectExpr(*_kept(events, known_before), *out, f"lag(__length) OVER ({w}) AS prior_reaction_streak")
    trends = [f"{_slope(f'__signals_{n}')} AS prior_reaction_trend_{n}" for n in RATE_WINDOWS]
    done = shifted.selectExpr("*", *trends)
    if known_before is not None:
        return join_dealt(events, done.select("event_key", *HISTORY_COLUMNS), "event_key", tasks)
    return done.select(*events.columns, *HISTORY_COLUMNS)


def join_dealt(events: DataFrame, facts: DataFrame, on: str, tasks: int | None = None) -> DataFrame:
    """Left join of two tables with a row per event, both dealt over ``tasks`` tasks and sorted: a broadcast, decided by the
    compressed size of a few columns, would put every event's facts into each task's memory."""
    if tasks is None:
        return events.join(facts, on, "left")
    return events.repartition(tasks, on).join(facts.repartition(tasks, on).hint("merge"), on, "left")


def _kept(events: DataFrame, known_before: str | None) -> list[str]:
    return ["event_key"] if known_before is not None else events.columns


def _slope(values: str) -> str:
    """Least-squares slope of an array over 0..n-1 (missing values already dropped); NULL below two values."""
    n = f"size({values})"
    indexed = f"zip_with({values}, sequence(0, {n} - 1), (v, i) -> v * (2 * i - ({n} - 1)))"
    weighted = f"aggregate({indexed}, 0.0D, (a, x) -> a + x)"
    # sum((i - mean) * v) / sum((i - mean)^2), with sum((i - mean)^2) = n (n^2 - 1) / 12
    return f"CASE WHEN {n} >= 2 THEN {weighted} * 6 / ({n} * ({n} * {n} - 1)) END"


# ---- labels known at each event's own cutoff ----


def label_known_dates(
    events: DataFrame, prices: DataFrame, bench: DataFrame, calendar: DataFrame, tasks: int | None = None
) -> DataFrame:
    """``events(symbol, reaction_start_date)`` with ``label_known_{h}d``: the day whose close completes the h-day return.

    That is the later of the h-th own and the h-th benchmark observation after the first one at or after the reaction
    start; NULL while one of them is missing. One as-of join by symbol; the benchmark's days are looked up per calendar
    day, whose number bounds the two single-partition windows and the broadcast.
    """
    leads = [f"lead(date, {h}) OVER (PARTITION BY {{}} ORDER BY date) AS {{}}{h}" for h in HORIZONS]
    dealt = prices if tasks is None else prices.repartition(tasks, "symbol")
    own = dealt.selectExpr("symbol", "date", *[x.format("symbol", "__own") for x in leads])
    base = bench.selectExpr("date", "0 AS __k").selectExpr("date", *[x.format("__k", "__base") for x in leads])
    ahead = Window.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = calendar.select("date").join(base.selectExpr("date", f"struct({', '.join(f'__base{h}' for h in HORIZONS)}) AS b"), "date", "left")
    by_day = days.select(F.col("date").alias("reaction_start_date"), F.last("b", ignorenulls=True).over(ahead).alias("b"))
    dated = asof_join(events, own, ["symbol"], "reaction_start_date", "date", [f"__own{h}" for h in HORIZONS], "forward", tasks=tasks)
    joined = dated.join(F.broadcast(by_day), "reaction_start_date", "left")
    known = [f"CASE WHEN __own{h} IS NOT NULL AND b.__base{h} IS NOT NULL THEN greatest(__own{h}, b.__base{h}) END AS label_known_{h}d" for h in HORIZONS]
    return joined.selectExpr(*events.columns, *known)


def with_history_known_at(events: DataFrame, cutoff: str = "feature_cutoff_date", known_on: str = "label_known_{}d") -> DataFrame:
    """The ``prior_`` columns of :func:`with_prior_history`, each row seeing only what was known at its own cutoff.

    An h-day return of an earlier event counts for a row if the day it was known is at or before the row's ``cutoff``; its
    class, if the return it was taken from counts. The same earlier event can so be known to one later event and not to
    another. Hidden and UNKNOWN labels are missing: they drop out of averages and trends, count as "no" in rates, and end a
    streak. Counts and days since the last event don't depend on labels. A NULL cutoff hides all labels.

    Each row carries its last eight events as an array with their dates and filters it, so one window pass serves every
    cutoff. Streaks carry the known dates of the current run, at most a company's number of periods.
    """
    deepest = max(MEAN_WINDOWS)
    returns = {h: f"abnormal_return_{h}d" for h in HORIZONS}
    source = (
        f"CASE WHEN {returns[3]} IS NOT NULL THEN {known_on.format(3)} WHEN {returns[1]} IS NOT NULL THEN {known_on.format(1)} END AS __class_known",
        "nullif(reaction_class, 'UNKNOWN') AS __class",
    )
    entry = ", ".join([*[f"{known_on.format(h)} AS k{h}, {returns[h]} AS r{h}" for h in HORIZONS], "__class_known AS kc, __class AS c"])
    rows = events.selectExpr("*", *source).selectExpr(
        "*",
        f"row_number() OVER ({ORDER}) - 1 AS prior_earnings_count",
        f"datediff(period_ended, lag(period_ended) OVER ({ORDER})) AS prior_days_since_last",
        f"collect_list(struct({entry})) OVER ({ORDER} ROWS BETWEEN {deepest} PRECEDING AND 1 PRECEDING) AS __prior",
        f"CASE WHEN __class = lag(__class) OVER ({ORDER}) THEN 0 ELSE 1 END AS __change",
    )
    runs = rows.selectExpr("*", f"sum(__change) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __run")
    dates = "collect_list(struct(__class_known AS k)) OVER (PARTITION BY symbol, __run ORDER BY prior_earnings_count ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run_before = runs.selectExpr("*", f"{dates} AS __dates").selectExpr("*", f"lag(__dates) OVER ({ORDER}) AS __run_dates")
    sees = lambda day: f"coalesce({day} <= {cutoff}, false)"
    seen = ", ".join([*[f"CASE WHEN {sees(f'p.k{h}')} THEN p.r{h} END AS r{h}" for h in HORIZONS], f"CASE WHEN {sees('p.kc')} THEN p.c END AS c"])
    visible = run_before.selectExpr("*", f"transform(__prior, p -> struct({seen})) AS __seen").selectExpr(
        "*",
        *[f"filter(transform(slice(__seen, greatest(size(__seen) - {n}, 0) + 1, {n}), p -> p.r{h}), v -> v IS NOT NULL) AS __r{h}_{n}" for h in HORIZONS for n in MEAN_WINDOWS],
        *[f"filter(transform(slice(__seen, greatest(size(__seen) - {n}, 0) + 1, {n}), p -> p.c), v -> v IS NOT NULL) AS __c_{n}" for n in RATE_WINDOWS],
    )
    gated = lambda n, x, name: f"CASE WHEN prior_earnings_count >= {n} THEN {x} END AS {name}"
    hidden = f"array_max(transform(__run_dates, (d, i) -> CASE WHEN {sees('d.k')} THEN 0 ELSE i + 1 END))"
    out = [
        "prior_earnings_count",
        "try_element_at(__seen, -1).c AS prior_last_reaction_class",
        "prior_days_since_last",
        *[f"try_element_at(__seen, -1).r{h} AS prior_last_abn_ret_{h}d" for h in HORIZONS],
        f"CASE WHEN __run_dates IS NOT NULL THEN greatest(1, size(__run_dates) - {hidden}) END AS prior_reaction_streak",
    ]
    for h in HORIZONS:
        out += [gated(n, _mean(f"__r{h}_{n}"), f"prior_abn_ret_{h}d_mean_{n}") for n in MEAN_WINDOWS]
        out += [gated(n, _median(f"__r{h}_{n}"), f"prior_abn_ret_{h}d_median_{n}") for n in RATE_WINDOWS]
        out += [gated(n, _deviation(f"__r{h}_{n}"), f"prior_abn_ret_{h}d_std_{n}") for n in RATE_WINDOWS]
    for n in RATE_WINDOWS:
        for name in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
            out.append(gated(n, f"size(filter(__c_{n}, c -> c = '{name}')) / {n}.0D", f"prior_{name.lower()}_rate_{n}"))
        signals = f"transform(__c_{n}, c -> CASE c WHEN 'POSITIVE' THEN 1.0D WHEN 'NEUTRAL' THEN 0.0D ELSE -1.0D END)"
        out.append(gated(n, _slope(signals), f"prior_reaction_trend_{n}"))
    out += [gated(n, _mean(f"transform(__r5_{n}, v -> abs(v))"), f"prior_avg_reaction_magnitude_{n}") for n in MEAN_WINDOWS]
    return visible.selectExpr(*events.columns, *out).select(*events.columns, *HISTORY_COLUMNS)


def _mean(values: str) -> str:
    return f"try_divide(aggregate({values}, 0.0D, (a, v) -> a + v), size({values}))"


def _median(values: str) -> str:
    n, ordered = f"size({values})", f"array_sort({values})"
    low, high = f"get({ordered}, cast(floor(({n} - 1) / 2) AS int))", f"get({ordered}, cast(floor({n} / 2) AS int))"
    return f"({low} + {high}) / 2"


def _deviation(values: str) -> str:
    """Sample standard deviation of an array; NULL below two values."""
    squares = f"aggregate(transform({values}, v -> pow(v - {_mean(values)}, 2)), 0.0D, (a, v) -> a + v)"
    return f"CASE WHEN size({values}) >= 2 THEN sqrt({squares} / (size({values}) - 1)) END"

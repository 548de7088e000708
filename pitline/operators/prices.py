"""Price-series features: trailing returns, volatility, volume, averages, drawdown; forward returns; labels.

All features count a series' own observations (rows), not calendar days. A price table holds one row per symbol and
day, so one symbol never holds more rows than there are days; ``one_row_per_day`` establishes that with a
map-side-combined aggregation, which is what makes the per-symbol windows below safe for a very frequent symbol.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitline.functions.flags import flag_string
from pitline.operators.calendar import cutoff_and_reaction, day_lookup, place_events
from pitline.session import tasks_for

RETURN_WINDOWS = (1, 3, 5, 10, 20, 60)
VOLATILITY_WINDOWS = (5, 20, 60)
VOLUME_WINDOWS = (5, 20)
MA_WINDOWS = (20, 50, 200)
DRAWDOWN_WINDOWS = (20, 60, 252)
LABEL_WINDOWS = (1, 3, 5)
DAYS_PER_YEAR = 252
REACTION_THRESHOLD = 0.02
#: Rows on the common time axis that one task sorts, wide and several times over.
ROWS_PER_TASK = 100_000

RETURN_COLUMNS = [f"return_{k}d" for k in RETURN_WINDOWS]
VOLATILITY_COLUMNS = [f"volatility_{k}d" for k in VOLATILITY_WINDOWS]
VOLUME_COLUMNS = [f"volume_{kind}_{k}d" for k in VOLUME_WINDOWS for kind in ("ratio", "zscore")]
MA_COLUMNS = [f"distance_from_{k}dma" for k in MA_WINDOWS]
DRAWDOWN_COLUMNS = [f"drawdown_from_{k}d_high" for k in DRAWDOWN_WINDOWS]
PRICE_FEATURES = RETURN_COLUMNS + VOLATILITY_COLUMNS + VOLUME_COLUMNS + MA_COLUMNS + DRAWDOWN_COLUMNS
RELATIVE_COLUMNS = [f"relative_return_{k}d" for k in RETURN_WINDOWS]
LABEL_COLUMNS = [
    f"{name}_{k}d{suffix}"
    for name, suffix in (("abnormal_return", ""), ("return", "_after"), ("benchmark_return", "_after"))
    for k in LABEL_WINDOWS
]
# Features that raise INSUFFICIENT_HISTORY_<name> when missing (volume z-scores do not).
HISTORY_FLAGGED = [c for c in PRICE_FEATURES if "zscore" not in c]


def one_row_per_day(prices: DataFrame, order_by: str, values: Sequence[str] = ("close", "volume")) -> DataFrame:
    """Last row, by ``order_by``, of each (symbol, date), without rows that lack symbol, date or close."""
    usable = prices.dropna(subset=["symbol", "date", "close"])
    last = F.max_by(F.struct(*values), F.col(order_by)).alias("v")
    return usable.groupBy("symbol", "date").agg(last).select("symbol", "date", "v.*")


def _window(by: Sequence[str], on: str) -> str:
    return f"PARTITION BY {', '.join(by)} ORDER BY {on}"


def with_history(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    return series.selectExpr("*", f"row_number() OVER ({_window(by, on)}) AS history_days")


def with_returns(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Return over k observations; NULL until k+1 observations exist."""
    w = _window(by, on)
    return series.selectExpr(
        "*", *[f"try_divide(close, lag(close, {k}) OVER ({w})) - 1 AS return_{k}d" for k in RETURN_WINDOWS]
    )


def with_volatility(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Annualised sample deviation of the last k one-observation returns (needs ``return_1d``, ``history_days``)."""
    w = _window(by, on)
    return series.selectExpr(
        "*",
        *[
            f"CASE WHEN history_days > {k} THEN stddev_samp(return_1d) OVER ({w} ROWS BETWEEN {k - 1} PRECEDING AND"
            f" CURRENT ROW) * sqrt({DAYS_PER_YEAR}) END AS volatility_{k}d"
            for k in VOLATILITY_WINDOWS
        ],
    )


def with_volume_features(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Last known volume against the k volume observations before it.

    Volumes skip their own gaps, so the window runs over the rows that have one (same shuffle: the partitioning by
    ``by`` already clusters the finer key) and the result is carried forward onto rows without a volume.
    """
    w = _window([*by, "__gap"], on)
    stats = [
        f"{fn}(volume) OVER ({w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS __{fn}_{k}"
        for k in VOLUME_WINDOWS
        for fn in ("avg", "stddev_samp")
    ]
    fields = ", ".join(
        f"'volume_ratio_{k}d', CASE WHEN __n >= {k} AND __avg_{k} > 0 THEN volume / __avg_{k} END,"
        f" 'volume_zscore_{k}d', CASE WHEN __n >= {k} AND __stddev_samp_{k} > 0"
        f" THEN (volume - __avg_{k}) / __stddev_samp_{k} END"
        for k in VOLUME_WINDOWS
    )
    known = series.selectExpr("*", "volume IS NULL AS __gap").selectExpr(
        "*", f"row_number() OVER ({w}) AS __n", *stats
    )
    carried = known.selectExpr(
        "*",
        f"last(CASE WHEN NOT __gap THEN named_struct({fields}) END, true)"
        f" OVER ({_window(by, on)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __vol",
    )
    return carried.select(*series.columns, "__vol.*")


# A sliding frame is re-evaluated row by row, at a cost of its width. Longer averages and highs are therefore put
# together from adjacent shorter blocks with lag(): exact for highs, and free of cancellation for sums.
def with_ma_distance(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Relative distance from the 20, 50 and 200-observation average, current one included."""
    w = _window(by, on)
    blocks = series.selectExpr(
        "*", f"sum(close) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS __s10"
    )
    blocks = blocks.selectExpr("*", _chain("__s10", "+", [0, 10], w, "__s20"), _chain("__s10", "+", [0, 10, 20, 30, 40], w, "__s50"))
    blocks = blocks.selectExpr("*", _chain("__s50", "+", [0, 50, 100, 150], w, "__s200"))
    return blocks.selectExpr(
        *series.columns,
        *[
            f"CASE WHEN history_days >= {k} AND __s{k} > 0 THEN (close - __s{k} / {k}) / (__s{k} / {k}) END"
            f" AS distance_from_{k}dma"
            for k in MA_WINDOWS
        ],
    )


def with_drawdown(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Relative distance from the 20, 60 and 252-observation high, current one included."""
    w = _window(by, on)
    highs = series.selectExpr(
        "*", f"max(close) OVER ({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS __h20"
    )
    highs = highs.selectExpr("*", _chain("__h20", ",", [0, 20, 40], w, "__h60"))
    highs = highs.selectExpr("*", _chain("__h60", ",", [0, 60, 120, 180, 192], w, "__h252"))
    return highs.selectExpr(
        *series.columns,
        *[
            f"CASE WHEN history_days >= {k} AND __h{k} > 0 THEN (close - __h{k}) / __h{k} END"
            f" AS drawdown_from_{k}d_high"
            for k in DRAWDOWN_WINDOWS
        ],
    )


def _chain(column: str, joiner: str, lags: Sequence[int], w: str, name: str) -> str:
    """Lagged copies of a block value, added (``+``) or compared for the greatest (``,``)."""
    parts = f" {joiner} ".join(column if k == 0 else f"lag({column}, {k}) OVER ({w})" for k in lags)
    return f"greatest({parts}) AS {name}" if joiner == "," else f"{parts} AS {name}"


def price_features(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """All trailing features of every row; every window shares one shuffle."""
    steps = (with_history, with_returns, with_volatility, with_volume_features, with_ma_distance, with_drawdown)
    return reduce(lambda df, step: step(df, by, on), steps, series)


def with_forward_returns(series: DataFrame, by: Sequence[str] = ("symbol",), on: str = "date") -> DataFrame:
    """Return from each row's close to the close k observations later (``forward_kd``)."""
    w = _window(by, on)
    return series.selectExpr(
        "*", *[f"try_divide(lead(close, {k}) OVER ({w}), close) - 1 AS forward_{k}d" for k in LABEL_WINDOWS]
    )


def reaction_class(abnormal_1d: Column, abnormal_3d: Column) -> Column:
    """POSITIVE / NEGATIVE beyond ±2 % on the 3-day abnormal return, the 1-day one when that is missing."""
    signal = F.coalesce(abnormal_3d, abnormal_1d)
    return (
        F.when(signal.isNull(), "UNKNOWN")
        .when(signal > REACTION_THRESHOLD, "POSITIVE")
        .when(signal < -REACTION_THRESHOLD, "NEGATIVE")
        .otherwise("NEUTRAL")
    )


def benchmark_by_day(calendar: DataFrame, bench: DataFrame) -> DataFrame:
    """Calendar with the benchmark's ``state`` at or before each day and its forward returns (``ahead``) from the
    first benchmark day at or after it.

    One row per calendar day, so the single-partition windows are bounded by the calendar, not by the prices.
    """
    one = bench.select(F.lit(0).alias("__k"), "date", "close")
    series = with_forward_returns(with_returns(with_history(one, ["__k"]), ["__k"]), ["__k"])
    state = F.struct(F.col("history_days"), *RETURN_COLUMNS)
    ahead = F.struct(*[f"forward_{k}d" for k in LABEL_WINDOWS])
    days = calendar.join(series.select("date", state.alias("state"), ahead.alias("ahead")), "date", "left")
    span = (Window.unboundedPreceding, Window.currentRow)
    up, down = Window.orderBy("date").rowsBetween(*span), Window.orderBy(F.desc("date")).rowsBetween(*span)
    return days.withColumn("state", F.last("state", ignorenulls=True).over(up)).withColumn(
        "ahead", F.last("ahead", ignorenulls=True).over(down)
    )


#: Powers of two down from the longest series that a search by halves covers: MAX_DAYS are fewer than their sum.
_STEPS = ", ".join(str(1 << b) for b in reversed(range(18)))


def _days_before(days: str, bound: str, last: str) -> str:
    """SQL for how many of the sorted ``days`` are ``<`` or ``<=`` (``last``) the bound, found by halves; 0 without a bound."""
    return f"aggregate(array({_STEPS}), 0, (n, s) -> CASE WHEN get({days}, n + s - 1) {last} {bound} THEN n + s ELSE n END)"


def _added(values: str, first: str, last: str) -> str:
    """SQL for the sum of an array's entries ``first`` to ``last``, counted from 0, in this order."""
    return f"aggregate(sequence({first}, {last}), 0.0D, (s, j) -> s + get({values}, j))"


def _middle(values: str) -> str:
    """SQL for an array's mean, taken about its first entry: equal entries have exactly their value as mean."""
    return f"get({values}, 0) + try_divide(aggregate({values}, 0.0D, (s, v) -> s + (v - get({values}, 0))), size({values}))"


def _deviation(values: str, middle: str) -> str:
    """SQL for the sample deviation of an array about ``middle``, a column, as it is read for every entry."""
    squares = f"aggregate({values}, 0.0D, (s, v) -> s + (v - {middle}) * (v - {middle}))"
    return f"CASE WHEN size({values}) > 1 THEN sqrt({squares} / (size({values}) - 1)) END"


def _series_arrays(prices: DataFrame, tasks: int) -> DataFrame:
    """One row per symbol: its days, closes, one-observation returns and sums of ten closes, and its known volumes with their
    days, as arrays in the order of days. A symbol has a row per day, so an array has MAX_DAYS entries at most."""
    dealt = prices.select("symbol", "date", "close", F.col("volume").cast("double").alias("volume")).where("date IS NOT NULL").repartition(tasks, "symbol")
    whole = dealt.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close", "volume"))).alias("__p"))
    split = whole.selectExpr("symbol", "__p", "__p.date AS __days", "__p.close AS __closes", "filter(__p, x -> x.volume IS NOT NULL) AS __known")
    return split.selectExpr(
        "symbol",
        "__days",
        "__closes",
        "transform(__closes, (c, i) -> try_divide(c, get(__closes, i - 1)) - 1) AS __returns",
        f"transform(__closes, (c, i) -> {_added('__closes', 'greatest(i - 9, 0)', 'i')}) AS __tens",
        "exists(__p, x -> x.close IS NULL OR x.close = 0) AS __gaps",
        "__known.date AS __volume_days",
        "__known.volume AS __volumes",
    )


def _spans(row: str, volume_row: str) -> list[str]:
    """The stretches of a symbol's arrays that deviations are taken of; returns that are missing don't count."""
    out = []
    for k in VOLATILITY_WINDOWS:
        span = f"slice(__returns, greatest({row} - {k}, 0) + 1, {k})"
        out.append(f"CASE WHEN {row} > {k} THEN CASE WHEN __gaps THEN array_compact({span}) ELSE {span} END END AS __returns_{k}")
    for k in VOLUME_WINDOWS:
        first = f"greatest({volume_row} - {k}, 1)"
        out.append(f"CASE WHEN {volume_row} >= {k} THEN slice(__volumes, {first}, {volume_row} - {first}) END AS __volumes_{k}")
    return out


_SPANS = [*[f"__returns_{k}" for k in VOLATILITY_WINDOWS], *[f"__volumes_{k}" for k in VOLUME_WINDOWS]]


def _features_at(row: str, volume_row: str) -> list[str]:
    """The trailing features of ``price_features`` for one row of a symbol's arrays: ``row`` of its days and ``volume_row`` of
    its known volumes, counted from 1; with the spans and their middles as columns."""
    close = f"get(__closes, {row} - 1)"
    out = [f"try_divide({close}, get(__closes, {row} - 1 - {k})) - 1 AS return_{k}d" for k in RETURN_WINDOWS]
    spread = lambda k: _deviation(f"__returns_{k}", f"__middle_returns_{k}")
    out += [f"{spread(k)} * sqrt({DAYS_PER_YEAR}) AS volatility_{k}d" for k in VOLATILITY_WINDOWS]
    volume = f"get(__volumes, {volume_row} - 1)"
    for k in VOLUME_WINDOWS:
        mean, deviation = f"__mean_volumes_{k}", f"__deviation_volumes_{k}"
        out.append(f"CASE WHEN {mean} > 0 THEN {volume} / {mean} END AS volume_ratio_{k}d")
        out.append(f"CASE WHEN {deviation} > 0 THEN ({volume} - {mean}) / {deviation} END AS volume_zscore_{k}d")
    # the same blocks as in with_ma_distance, added in the same order
    sums = lambda lags, block: " + ".join(block(n) for n in lags)
    ten = lambda n: f"get(__tens, {row} - 1 - {n})"
    fifty = lambda n: f"({sums(range(n, n + 50, 10), ten)})"
    totals = {20: sums((0, 10), ten), 50: fifty(0), 200: sums((0, 50, 100, 150), fifty)}
    for k in MA_WINDOWS:
        mean = f"(({totals[k]}) / {k})"
        out.append(f"CASE WHEN {row} >= {k} AND {mean} > 0 THEN ({close} - {mean}) / {mean} END AS distance_from_{k}dma")
    for k in DRAWDOWN_WINDOWS:
        high = f"array_max(slice(__closes, greatest({row} - {k}, 0) + 1, {k}))"
        out.append(f"CASE WHEN {row} >= {k} AND {high} > 0 THEN ({close} - {high}) / {high} END AS drawdown_from_{k}d_high")
    return out


def _price_state(events: DataFrame, prices: DataFrame, tasks: int) -> DataFrame:
    """Attach each event's price features at its cutoff (``back``) and forward returns from its reaction start (``ahead``).

    Most days of a series are no event's cutoff. So a symbol's prices become arrays, one row per symbol, and only its events'
    rows are worked out: both tables are dealt by symbol, joined, and each event finds its places in the days by halves.
    """
    series = _series_arrays(prices, tasks).withColumn("has_prices", F.lit(True))
    joined = events.repartition(tasks, "symbol").join(series.hint("merge"), "symbol", "left")
    ahead = f"CASE WHEN reaction_start_date IS NOT NULL THEN {_days_before('__days', 'reaction_start_date', '<')} END"
    placed = joined.selectExpr(
        "*",
        f"{_days_before('__days', 'feature_cutoff_date', '<=')} AS __row",
        f"{_days_before('__volume_days', 'feature_cutoff_date', '<=')} AS __volume_row",
        f"{ahead} AS __ahead",
    )
    # step by step, as a lambda would work out anew for every entry what stands inside it
    middles = placed.selectExpr("*", *_spans("__row", "__volume_row")).selectExpr(
        "*",
        *[f"{_middle(c)} AS __middle{c[1:]}" for c in _SPANS],
        *[f"try_divide(aggregate(__volumes_{k}, 0.0D, (s, v) -> s + v), size(__volumes_{k})) AS __mean_volumes_{k}" for k in VOLUME_WINDOWS],
    )
    spread = middles.selectExpr("*", *[f"{_deviation(f'__volumes_{k}', f'__middle_volumes_{k}')} AS __deviation_volumes_{k}" for k in VOLUME_WINDOWS])
    back = ", ".join(["get(__closes, __row - 1) AS close", *_features_at("__row", "__volume_row")])
    forward = ", ".join(f"try_divide(get(__closes, __ahead + {k}), get(__closes, __ahead)) - 1 AS forward_{k}d" for k in LABEL_WINDOWS)
    return spread.selectExpr(
        *events.columns, "coalesce(has_prices, false) AS has_prices", "__row AS price_history_days", f"struct({back}) AS back", f"struct({forward}) AS ahead"
    )


def event_market_features(
    events: DataFrame,
    prices: DataFrame,
    bench: DataFrame,
    calendar: DataFrame,
    on: str = "result_announcement_datetime",
    keep_skipped: bool = False,
    universe: DataFrame | None = None,
    price: str | None = None,
) -> DataFrame:
    """Market features and labels for every announced event; with a ``universe``, prices of other symbols don't count.

    Events that cannot be used get a ``skip_reason`` and are dropped unless ``keep_skipped``. Labels need the stock
    and the benchmark return; otherwise all three columns of that horizon are NULL. ``price`` names a last column for the
    close at the cutoff. Events and prices are counted ahead, so they should be tables that are cheap to count.
    """
    tasks = tasks_for(events.sparkSession, prices.count() + 2 * events.count(), ROWS_PER_TASK)
    if universe is not None:
        prices = prices.join(universe.select("symbol"), "symbol", "left_semi")
    lookup = day_lookup(benchmark_by_day(calendar, bench))
    placed = place_events(events.where(F.col(on).isNotNull()), lookup, on)
    dated = placed.select(
        *events.columns,
        "announcement_session_type",
        *cutoff_and_reaction(),
        F.when(F.col("own_close"), F.col("state")).otherwise(F.col("prev_state")).alias("bench_state"),
        F.when(F.col("same_day"), F.col("ahead")).otherwise(F.col("next_ahead")).alias("bench_ahead"),
    )
    relative = [f"back.return_{k}d - bench_state.return_{k}d AS relative_return_{k}d" for k in RETURN_WINDOWS]
    labels = []
    for k in LABEL_WINDOWS:
        stock, base = f"ahead.forward_{k}d", f"bench_ahead.forward_{k}d"
        labels += [
            f"{stock} - {base} AS abnormal_return_{k}d",
            f"CASE WHEN {base} IS NOT NULL THEN {stock} END AS return_{k}d_after",
            f"CASE WHEN {stock} IS NOT NULL THEN {base} END AS benchmark_return_{k}d_after",
        ]
    carried = [*events.columns, "announcement_session_type", "feature_cutoff_date", "reaction_start_date"]
    state = _price_state(dated, prices, tasks)
    if not keep_skipped:
        # the same conditions as skip_reason(), on plain columns, ahead of the wide projection
        state = state.where(
            "feature_cutoff_date IS NOT NULL AND reaction_start_date IS NOT NULL AND has_prices"
            " AND price_history_days >= 2 AND bench_state.history_days >= 2"
        )
    wide = state.selectExpr(
        *carried,
        "has_prices",
        "price_history_days",
        "coalesce(bench_state.history_days, 0) AS benchmark_history_days",
        *[f"back.{c}" for c in PRICE_FEATURES],
        *relative,
        *labels,
        *([f"back.close AS {price}"] if price else []),
    )
    full = wide.withColumns(
        {
            "reaction_class": reaction_class(F.col("abnormal_return_1d"), F.col("abnormal_return_3d")),
            "quality_flags": history_flags(),
        }
    )
    passed_through = [c for c in events.columns if c not in ("symbol", "event_key")]
    ordered = [
        "event_key",
        "symbol",
        *passed_through,
        "announcement_session_type",
        "feature_cutoff_date",
        "reaction_start_date",
        "reaction_class",
        "quality_flags",
        "price_history_days",
        "benchmark_history_days",
        *sorted(PRICE_FEATURES + RELATIVE_COLUMNS + [c for c in LABEL_COLUMNS if not c.endswith("_after")]),
        *sorted(c for c in LABEL_COLUMNS if c.endswith("_after")),
        *([price] if price else []),
    ]
    if keep_skipped:
        return full.select(*ordered, skip_reason().alias("skip_reason"))
    return full.select(*ordered)


def history_flags() -> Column:
    """Missing features by name, then LIMITED (< 60) and VERY_LIMITED (< 252) history."""
    conditions = {f"INSUFFICIENT_HISTORY_{c}": f"{c} IS NULL" for c in HISTORY_FLAGGED}
    conditions["LIMITED_HISTORY"] = "price_history_days < 60"
    conditions["VERY_LIMITED_HISTORY"] = "price_history_days < 252"
    return flag_string(conditions)


def skip_reason() -> Column:
    """Why an event cannot be used, first reason first; NULL for a usable event."""
    return (
        F.when(F.col("feature_cutoff_date").isNull(), "no_cutoff")
        .when(F.col("reaction_start_date").isNull(), "no_reaction_start")
        .when(~F.col("has_prices"), "no_price_history")
        .when(F.col("price_history_days") < 2, "insufficient_history")
        .when(F.col("benchmark_history_days") < 2, "no_benchmark")
    )

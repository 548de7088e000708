"""Audits as tables: each check is one aggregation or one window over the model table.

Wide tables are reduced by one wide aggregation and turned into rows afterwards; only quantile-type checks use the
long (feature, value) form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitline.functions.dates import whole_days
from pitline.operators.calendar import clock_session
from pitline.operators.profiles import count_values_by_slice, deviation_profile, last_decimal, value_profile
from pitline.operators.quantiles import exact_quantiles, ks_p_value, long_form
from pitline.plans.roles import feature_group

SPLITS = ("train", "val", "test")
INFINITY = "double('Infinity')"


def distribution(df: DataFrame, column: str, slices: dict[str, str]) -> DataFrame:
    """(slice, slice_value, class, count, pct): counts of a class overall and along each slice, in one pass.

    ``slices`` maps a slice name to its SQL expression. Every row feeds one grouping-sets aggregation.
    """
    base = df.selectExpr(f"coalesce({column}, 'MISSING') AS class", *[f"cast({e} AS string) AS `{n}`" for n, e in slices.items()])
    names = list(slices)
    sets = [["class"], *[["class", n] for n in names]]
    counted = base.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], F.col("class"), *[F.col(f"`{n}`") for n in names]).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id("class", *[F.col(f"`{n}`") for n in names]).alias("gid")
    )
    slice_name, slice_value = F.lit("overall"), F.lit("all")
    for i, n in enumerate(names):
        grouped = F.col("gid").bitwiseAND(1 << (len(names) - 1 - i)) == 0
        slice_name = F.when(grouped, F.lit(n)).otherwise(slice_name)
        slice_value = F.when(grouped, F.coalesce(F.col(f"`{n}`"), F.lit("MISSING"))).otherwise(slice_value)
    rows = counted.select(slice_name.alias("slice"), slice_value.alias("slice_value"), "class", "count")
    # a slice value has one row per class
    return rows.withColumn("pct", F.expr("round(100.0D * count / sum(count) OVER (PARTITION BY slice, slice_value), 2)"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def numeric_profile(df: DataFrame, columns: Sequence[str], slices: dict[str, str]) -> DataFrame:
    """(feature, slice, n, missing, infinite, mean, std, min, max, q1, median, q3) overall and per slice value, from one scan."""
    profile = value_profile(count_values_by_slice(df, columns, slices), (0.25, 0.5, 0.75), ())
    return profile.selectExpr(
        "feature.feature", "feature.slice", "present AS n", "n - present AS missing", "infinite", "mean", "sqrt(variance) AS std", "min", "max",
        "q0_25 AS q1", "q0_5 AS median", "q0_75 AS q3",
    )


def missingness(df: DataFrame, columns: Sequence[str], period: str = "period_ended") -> DataFrame:
    """Per feature: share missing overall and per split, largest difference, correlation with time, type."""
    isnull = lambda c: f"cast(`{c}` IS NULL AS double)"
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(f"avg({isnull(c)}) AS a{i}")
        aggs += [f"avg(CASE WHEN split = '{s}' THEN {isnull(c)} END) AS a{i}_{s}" for s in SPLITS]
        day = f"cast(unix_date({period}) AS double)"
        aggs.append(f"try_divide(covar_pop({isnull(c)}, {day}), stddev_pop({isnull(c)}) * stddev_pop({day})) AS r{i}")
    entries = ", ".join(
        f"struct('{c}' AS feature, '{feature_group(c)}' AS feature_group, a{i} AS overall, a{i}_train AS train, a{i}_val AS val,"
        f" a{i}_test AS test, CASE WHEN a{i} > 0 AND a{i} < 1 THEN r{i} END AS time_correlation)"
        for i, c in enumerate(columns)
    )
    rows = df.agg(*[F.expr(a) for a in aggs]).selectExpr(f"explode(array({entries})) AS f").selectExpr("f.*")
    kind = (
        F.when(F.col("feature_group").startswith("fundamental") | (F.col("feature_group") == "valuation"), "EXPECTED_UNAVAILABLE")
        .when(F.col("feature_group") == "prior_earnings", "EXPECTED_STRUCTURAL")
        .otherwise("UNEXPECTED")
    )
    shares = "greatest(train, val, test) - least(train, val, test)"
    return rows.select(
        "feature",
        "feature_group",
        *[F.expr(f"round({c} * 100, 2)").alias(f"{c}_missing_pct") for c in ("overall", *SPLITS)],
        F.expr(f"round(({shares}) * 100, 2)").alias("max_difference_pct"),
        F.round("time_correlation", 4).alias("time_correlation"),
        kind.alias("missingness_type"),
        (kind != "UNEXPECTED").alias("informative_missing"),
    )


def missingness_by_group(audit: DataFrame) -> DataFrame:
    return audit.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg("overall_missing_pct").alias("avg_missing"),
        F.max("overall_missing_pct").alias("max_missing"),
        F.min("overall_missing_pct").alias("min_missing"),
        F.bool_or("informative_missing").alias("informative_missing"),
    )


def most_missing(audit: DataFrame, n: int = 20) -> DataFrame:
    return audit.orderBy(F.desc("overall_missing_pct"), "feature").limit(n).select("feature", "overall_missing_pct")


def approximate_distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, distinct_values, constant) from one wide aggregation of sketches; ``profiles`` has the exact counts."""
    wide = df.agg(*[F.expr(f"approx_count_distinct(`{c}`) AS d{i}") for i, c in enumerate(columns)])
    entries = ", ".join(f"struct('{c}' AS feature, d{i} AS distinct_values)" for i, c in enumerate(columns))
    rows = wide.selectExpr(f"explode(array({entries})) AS f").selectExpr("f.*")
    return rows.withColumn("constant", F.col("distinct_values") <= 1)


def distinct_counts(profile: DataFrame) -> DataFrame:
    """(feature, distinct_values, constant) from a value profile, or from ``distinct_values``."""
    return profile.selectExpr("feature", "distinct AS distinct_values", "distinct <= 1 AS constant")


def outlier_shares(counted: DataFrame, profile: DataFrame, reach: float = 10.0, limit: float = 0.05) -> DataFrame:
    """Values outside q1 - reach*iqr .. q3 + reach*iqr per feature, and whether their share exceeds ``limit``."""
    bounds = profile.selectExpr("feature", "q0_25 AS q1", "q0_75 AS q3")
    # one row per feature
    joined = counted.where("value IS NOT NULL").join(F.broadcast(bounds), "feature")
    outside = f"value < q1 - {reach} * (q3 - q1) OR value > q3 + {reach} * (q3 - q1)"
    found = joined.groupBy("feature").agg(F.expr(f"sum(CASE WHEN {outside} THEN n END) AS outliers"))
    rows = profile.where("texts = 0").join(F.broadcast(found), "feature", "left")
    return rows.selectExpr("feature", "present AS n", "coalesce(outliers, 0) AS outliers", f"coalesce(outliers, 0) > present * {limit} AS suspicious")


def extreme_values(counted: DataFrame, profile: DataFrame, threshold: float = 10.0) -> DataFrame:
    """(feature, median, mad, extreme): any modified z-score 0.6745 (x - median) / MAD beyond the threshold."""
    medians = profile.where("q0_5 IS NOT NULL").selectExpr("feature", "q0_5 AS median")
    spread = deviation_profile(counted, medians)
    # one row per feature
    joined = profile.where("q0_5 IS NOT NULL").join(F.broadcast(spread), "feature")
    return joined.selectExpr(
        "feature", "q0_5 AS median", "mad", f"present >= 4 AND coalesce(mad > 0 AND 0.6745D * top / mad > {threshold}, false) AS extreme"
    )


def ks_drift(profile: DataFrame, second: str = "val") -> DataFrame:
    """(feature, n_first, n_second, ks_statistic, p_value) of the training values against another split's."""
    sizes = "present_train AS n_first", f"present_{second} AS n_second", f"ks_{second} AS ks_statistic"
    found = profile.where(f"ks_{second} IS NOT NULL").selectExpr("feature", *sizes)
    return found.withColumn("p_value", F.expr(ks_p_value("ks_statistic", "n_first", "n_second")))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of each key, and all members of repeated keys."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.expr("coalesce(sum(n - 1), 0) AS extra_rows"), F.expr("coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS rows_in_repeated_keys")
    )


def _expected_class(threshold: float) -> str:
    return f"CASE WHEN abnormal_return_3d > {threshold} THEN 'POSITIVE' WHEN abnormal_return_3d < -{threshold} THEN 'NEGATIVE' WHEN abnormal_return_3d IS NOT NULL THEN 'NEUTRAL' END"


def inconsistent_labels(df: DataFrame, threshold: float = 0.02) -> DataFrame:
    """(event_key, actual_class, expected_class, abnormal_return_3d): the rows that ``label_consistency`` counts as inconsistent."""
    rows = df.selectExpr("event_key", "reaction_class AS actual_class", f"{_expected_class(threshold)} AS expected_class", "abnormal_return_3d")
    return rows.where("NOT coalesce(actual_class = expected_class, false)")


def label_consistency(df: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Reaction class against the 3-day return alone; rows labelled from the 1-day fallback are counted apart."""
    expected = _expected_class(threshold)
    return df.agg(
        F.expr("count(*) AS rows"),
        F.expr(f"count_if(reaction_class = {expected}) AS consistent"),
        F.expr(f"count_if(NOT coalesce(reaction_class = {expected}, false)) AS inconsistent"),
        F.expr("count_if(abnormal_return_3d IS NULL AND abnormal_return_1d IS NOT NULL) AS one_day_fallback"),
        F.expr(f"count_if(abs(abnormal_return_3d) > {threshold} * 0.9 AND abs(abnormal_return_3d) < {threshold} * 1.1) AS near_threshold"),
    )


def impossible_returns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(target, impossible_low, impossible_high): at or below -100 %, above +1000 %."""
    aggs = [F.expr(f"count_if({c} <= -1.0) AS l{i}") for i, c in enumerate(columns)] + [
        F.expr(f"count_if({c} > 10.0) AS h{i}") for i, c in enumerate(columns)
    ]
    entries = ", ".join(f"struct('{c}' AS target, l{i} AS impossible_low, h{i} AS impossible_high)" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(f"explode(array({entries})) AS r").selectExpr("r.*")


def announcement_type(ts: str, period: str):
    days = whole_days(F.col(ts), F.col(period).cast("timestamp_ntz"))
    return (
        F.when(days.isNull() | (days > 90), "UNCERTAIN")
        .when(days < -30, "BOARD_EVENT")
        .when(days < 0, "PRE_ANNOUNCEMENT")
        .otherwise("ACTUAL_RESULT")
    )


def announcement_timing(df: DataFrame, ts: str = "result_announcement_datetime", period: str = "period_ended") -> DataFrame:
    """One row: early, late, mean days from period end, cutoff violations and the cutoff-to-announcement histogram."""
    days = whole_days(F.col(ts), F.col(period).cast("timestamp_ntz"))
    gap = whole_days(F.col(ts), F.col("feature_cutoff_date").cast("timestamp_ntz"))
    rows = df.select(days.alias("d"), gap.alias("g"), F.col(ts).alias("ts"))
    median = exact_quantiles(rows.selectExpr("'all' AS k", "d"), ["k"], "d", [0.5]).selectExpr("k", "quantile AS median_days")
    stats = rows.groupBy(F.lit("all").alias("k")).agg(
        F.expr("count_if(d < 0) AS early"),
        F.expr("count_if(d > 90) AS late"),
        F.avg("d").alias("mean_days"),
        F.expr("count_if(g < 0) AS cutoff_violations"),
        F.expr("count_if(g = 0) AS same_day"),
        F.expr("count_if(g = 1) AS one_day"),
        F.expr("count_if(g > 1) AS more_days"),
        F.expr("count_if(hour(ts) = 0 AND minute(ts) = 0) AS midnight"),
    )
    return stats.join(median, "k").drop("k")


def announcement_listing(df: DataFrame, ts: str = "result_announcement_datetime", period: str = "period_ended") -> DataFrame:
    """(audit_item, kind, event_key, events, pct): the announcement audit in long form.

    Every event has a row with its class, and one for each thing found wrong: a cutoff after the announcement, an
    announcement at midnight, a stored session other than the clock's (sessions that don't come from the clock, of unknown
    times and non-trading days, are not compared). Rows without event_key sum up their item and kind; pct is of all events.
    """
    clock, stored = clock_session(F.col(ts)), F.col("announcement_session_type")
    item = lambda name, kind: F.struct(F.lit(name).alias("audit_item"), kind.alias("kind"))
    found = F.array(
        item("event_classification", announcement_type(ts, period)),
        F.when(F.col("feature_cutoff_date").cast("timestamp_ntz") > F.col(ts), item("timing_violation", F.lit("cutoff_after_announcement"))),
        F.when((F.hour(ts) == 0) & (F.minute(ts) == 0), item("timing_violation", F.lit("midnight"))),
        F.when(F.col(ts).isNotNull() & ~stored.isin("unknown", "non_trading_day") & (stored != clock), item("session_inconsistency", F.concat_ws(" ", stored, F.lit("for"), clock))),
    )
    rows = df.select("event_key", F.explode(F.array_compact(found)).alias("i")).select("i.audit_item", "i.kind", "event_key")
    # every event has exactly one class, so the classes' counts add up to all events; a handful of rows
    sums = rows.groupBy("audit_item", "kind").agg(F.count(F.lit(1)).alias("events"))
    total = F.sum(F.when(F.col("audit_item") == "event_classification", F.col("events"))).over(Window.partitionBy())
    pct = F.round(F.lit(100.0) * F.col("events") / total, 2).alias("pct")
    summed = sums.select("audit_item", "kind", F.lit(None).cast("string").alias("event_key"), "events", pct)
    listed = rows.select("*", F.lit(1).cast("long").alias("events"), F.lit(None).cast("double").alias("pct"))
    return listed.unionByName(summed)


#: Families of columns that stand on prices, and how strongly a split or a bonus issue shows in them.
PRICE_FAMILIES = {
    "returns": ("HIGH", "^((relative|benchmark|abnormal)_)?return_"),
    "averages_and_highs": ("HIGH", "^(distance|drawdown)_from_"),
    "volatility": ("MEDIUM", "^volatility_"),
    "volume": ("LOW", "^volume_"),
    "valuation": ("HIGH", "^val_"),
}


def price_integrity(profile: DataFrame) -> DataFrame:
    """(feature, family, sensitivity, missing_pct, mean, std, min, max, low, high) of the columns that stand on prices.

    ``profile`` is a value profile; low and high are its 0.1 % and 99.9 % quantiles. Columns of no family are left out.
    """
    family, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (strength, pattern) in reversed(PRICE_FAMILIES.items()):
        hit = F.col("feature").rlike(pattern)
        family, level = F.when(hit, name).otherwise(family), F.when(hit, strength).otherwise(level)
    return profile.select("*", family.alias("family"), level.alias("sensitivity")).where("family IS NOT NULL").selectExpr(
        "feature", "family", "sensitivity", "round(100.0D * (n - present) / n, 2) AS missing_pct", "mean", "sqrt(variance) AS std",
        "min", "max", "q0_001 AS low", "q0_999 AS high",
    )


def symbol_lifecycle(events: DataFrame, added_after: str = "2020-01-01", quiet_days: int = 365) -> DataFrame:
    """First and last period and announcement per symbol, with POTENTIAL_INDEX_ADDITION / _DELETION concerns."""
    life = events.groupBy("symbol").agg(
        F.min("period_ended").alias("first_period"),
        F.max("period_ended").alias("last_period"),
        F.count("period_ended").alias("n_events"),
        F.min("result_announcement_datetime").alias("first_announcement"),
        F.max("result_announcement_datetime").alias("last_announcement"),
    )
    newest = events.agg(F.max("period_ended")).scalar()
    concern = (
        F.when(F.col("first_period") > F.lit(added_after).cast("date"), "POTENTIAL_INDEX_ADDITION")
        .when(F.col("last_period") < F.date_sub(newest, quiet_days), "POTENTIAL_INDEX_DELETION")
        .otherwise("")
    )
    return life.withColumn("concern", concern)


def universe_overlap(symbols: DataFrame, universe: DataFrame) -> DataFrame:
    """(status, symbols): symbols in both sets, only in the data, only in the universe."""
    a = symbols.select("symbol").distinct().withColumn("a", F.lit(True))
    b = universe.select("symbol").distinct().withColumn("b", F.lit(True))
    status = F.when(F.col("a").isNull(), "universe_only").when(F.col("b").isNull(), "data_only").otherwise("overlap")
    return a.join(b, "symbol", "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("symbols"))


def universe_difference(symbols: DataFrame, universe: DataFrame) -> DataFrame:
    """(status, symbol): the symbols behind ``universe_overlap``, by set operations."""
    a, b = symbols.select("symbol"), universe.select("symbol")
    parts = {"data_only": a.subtract(b), "universe_only": b.subtract(a), "overlap": a.intersect(b)}
    tagged = [df.select(F.lit(name).alias("status"), "symbol") for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def split_key_overlap(df: DataFrame, keys: dict[str, str], splits: Sequence[str] = SPLITS) -> DataFrame:
    """(kind, first, second, value): every value of a key expression that two splits share; none, if the splits are clean.

    ``keys`` names SQL expressions, e.g. event keys and periods; their values are compared as text, NULL with NULL.
    """
    found = None
    for kind, expression in keys.items():
        held = {s: df.where(F.col("split") == s).select(F.expr(f"cast({expression} AS string) AS value")) for s in splits}
        for i, first in enumerate(splits):
            for second in splits[i + 1 :]:
                shared = held[first].intersect(held[second]).select(F.lit(kind).alias("kind"), F.lit(first).alias("first"), F.lit(second).alias("second"), "value")
                found = shared if found is None else found.unionByName(shared)
    return found


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., extra): keys with more than one row, and how many more, as the multiset of rows without its set."""
    rows = df.select(*keys)
    return rows.exceptAll(rows.distinct()).groupBy(*keys).agg(F.count(F.lit(1)).alias("extra"))


def events_per_symbol(events: DataFrame) -> DataFrame:
    """One row: fewest, most, mean and median events per symbol, and which symbols have fewest and most."""
    counts = events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).selectExpr("'all' AS k", "symbol", "n")
    stats = counts.groupBy("k").agg(
        F.min("n").alias("min_events"),
        F.max("n").alias("max_events"),
        F.avg("n").alias("mean_events"),
        F.expr("min(struct(n, symbol)).symbol AS fewest"),
        F.expr("min(struct(-n, symbol)).symbol AS most"),
    )
    return stats.join(exact_quantiles(counts, ["k"], "n", [0.5]).selectExpr("k", "quantile AS median_events"), "k").drop("k")


def history_coverage(df: DataFrame) -> DataFrame:
    rows = df.selectExpr("'all' AS k", "price_history_days AS h", "benchmark_history_days AS b")
    stats = rows.groupBy("k").agg(
        F.avg("h").alias("mean_price_history"),
        F.avg("b").alias("mean_benchmark_history"),
        F.min("h").alias("min_price_history"),
        *[F.expr(f"count_if(h < {n}) AS under_{n}") for n in (20, 60, 252)],
    )
    return stats.join(exact_quantiles(rows, ["k"], "h", [0.5]).selectExpr("k", "quantile AS median_price_history"), "k").drop("k")


def fundamental_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, present_pct) among events with a statement, plus the share of such events."""
    has = "fundamental_pit_status = 'estimated_conservative'"
    aggs = [F.expr(f"avg(cast({has} AS double)) AS share")] + [
        F.expr(f"avg(CASE WHEN {has} THEN cast(`{c}` IS NOT NULL AS double) END) AS c{i}") for i, c in enumerate(columns)
    ]
    entries = ", ".join(
        ["struct('events with fundamentals' AS feature, share AS s)", *[f"struct('{c}' AS feature, c{i} AS s)" for i, c in enumerate(columns)]]
    )
    return df.agg(*aggs).selectExpr(f"explode(array({entries})) AS r").selectExpr("r.feature", "round(100 * r.s, 2) AS present_pct")


def tail_quantiles(profile: DataFrame) -> DataFrame:
    """(feature, low, high): the 0.1 % and 99.9 % quantiles."""
    return profile.where("texts = 0").selectExpr("feature", "q0_001 AS low", "q0_999 AS high")


def jump_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, jumps, large_jumps, max_jump): steps between a symbol's consecutive events above their own 99.9 % quantile."""
    w = "PARTITION BY symbol ORDER BY period_ended NULLS LAST, event_key"
    steps = df.selectExpr(*[f"abs({c} - lag({c}) OVER ({w})) AS {c}" for c in columns])
    long = long_form(steps, columns).where("value IS NOT NULL")
    edge = exact_quantiles(long, ["feature"], "value", [0.999]).selectExpr("feature", "quantile AS edge")
    return long.join(F.broadcast(edge), "feature").groupBy("feature").agg(
        F.count("value").alias("jumps"), F.expr("count_if(value > edge) AS large_jumps"), F.max("value").alias("max_jump")
    )


def prior_count_order(df: DataFrame) -> DataFrame:
    """Symbols whose prior-event count decreases along the periods."""
    w = "PARTITION BY symbol ORDER BY period_ended NULLS LAST, event_key"
    steps = df.selectExpr("symbol", f"prior_earnings_count - lag(prior_earnings_count) OVER ({w}) AS step")
    return steps.groupBy("symbol").agg(F.expr("bool_and(coalesce(step >= 0, true)) AS monotonic"))


def leakage_audit(df: DataFrame) -> DataFrame:
    """(check, violations) for date order, point-in-time rules, keys and infinities, from two aggregations."""
    checks = {
        "cutoff_before_reaction": "NOT coalesce(feature_cutoff_date < reaction_start_date, false)",
        "cutoff_before_announcement": "NOT coalesce(feature_cutoff_date <= result_announcement_datetime, false)",
        "reaction_after_announcement": "NOT coalesce(reaction_start_date >= cast(result_announcement_datetime AS date), false)",
        "fundamentals_available": "fundamental_estimated_available_date > feature_cutoff_date",
        "fundamentals_earlier_period": "fundamental_period_end_date >= period_ended",
    }
    numeric = [c for c, t in df.dtypes if t == "double"]
    infinite = " OR ".join(f"abs(`{c}`) = {INFINITY}" for c in numeric)
    row = df.agg(*[F.expr(f"count_if({e}) AS `{n}`") for n, e in (checks | {"infinite_rows": infinite}).items()])
    names = [*checks, "infinite_rows"]
    table = row.selectExpr(f"explode(array({', '.join(f'struct({chr(39)}{n}{chr(39)} AS check, `{n}` AS violations)' for n in names)})) AS c").selectExpr("c.*")
    for name, keys in (("duplicate_event_keys", ["event_key"]), ("duplicate_symbol_period", ["symbol", "period_ended"])):
        table = table.unionByName(duplicate_counts(df, keys).selectExpr(f"'{name}' AS check", "extra_rows AS violations"))
    return table


def readiness_gate(df: DataFrame, features: Sequence[str], targets: Sequence[str], expected_features: int | None = None) -> DataFrame:
    """(check, status, detail): the pass/fail gate before training, from one wide aggregation and a few small ones."""
    numeric = [c for c in features if dict(df.dtypes)[c] == "double"]
    returns = [t for t in targets if t != "reaction_class"]
    present = " + ".join(f"cast(count(`{c}`) = 0 AS int)" for c in features)
    same = " + ".join(f"cast(coalesce(min(`{c}`) = max(`{c}`), false) AS int)" for c in numeric)
    inf = " + ".join(f"cast(coalesce(max(abs(`{c}`)) = {INFINITY}, false) AS int)" for c in numeric)
    sparse = " + ".join(f"cast(count_if({c} IS NULL) > 0.1 * count(*) AS int)" for c in returns)
    one = df.agg(
        F.expr("count(*) AS rows"),
        F.expr(f"{present} AS all_null"),
        F.expr(f"{same} AS constant"),
        F.expr(f"{inf} AS infinite"),
        F.expr(f"{sparse} AS sparse_targets"),
        F.expr("count_if(NOT coalesce(feature_cutoff_date < reaction_start_date AND feature_cutoff_date <= result_announcement_datetime, false)) AS cutoff"),
        F.expr("count_if(fundamental_estimated_available_date > feature_cutoff_date OR fundamental_period_end_date >= period_ended) AS fundamentals"),
        F.expr("count_if(fundamental_pit_status NOT IN ('estimated_conservative', 'unavailable')) AS status"),
    )
    table = one.selectExpr(
        "explode(array(struct('dataset not empty' AS check, cast(rows = 0 AS bigint) AS bad), struct('no all-null features' AS check, cast(all_null AS bigint) AS bad),"
        " struct('no constant features' AS check, cast(constant AS bigint) AS bad), struct('no infinite features' AS check, cast(infinite AS bigint) AS bad),"
        " struct('targets at most 10% missing' AS check, cast(sparse_targets AS bigint) AS bad), struct('market cutoff' AS check, cutoff AS bad),"
        " struct('fundamental dates' AS check, fundamentals AS bad), struct('fundamental status' AS check, status AS bad))) AS c"
    ).selectExpr("c.*")
    # one row per class
    shares = df.groupBy("reaction_class").agg(F.count(F.lit(1)).alias("n")).selectExpr("n / sum(n) OVER () AS share")
    parts = [
        duplicate_counts(df, ["event_key"]).selectExpr("'unique event keys' AS check", "extra_rows AS bad"),
        duplicate_counts(df, ["symbol", "period_ended"]).selectExpr("'unique symbol and period' AS check", "extra_rows AS bad"),
        prior_count_order(df).agg(F.expr("count_if(NOT monotonic) AS bad")).selectExpr("'prior count order' AS check", "bad"),
        shares.agg(F.expr("count_if(share < 0.05 OR share > 0.9) AS bad")).selectExpr("'class shares' AS check", "bad"),
    ]
    for part in parts:
        table = table.unionByName(part)
    count_bad = 0 if expected_features is None else int(len(features) != expected_features)
    names = len([c for c in features if "_after" in c or c in targets])
    schema = df.sparkSession.createDataFrame(
        [("feature count", count_bad), ("no target or post-event features", names)], "check string, bad bigint"
    )
    return table.unionByName(schema).selectExpr("check", "CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status", "bad AS detail")


#: Decimals to which a number counts in a content hash.
HASHED_DIGITS = 6


def row_text(df: DataFrame) -> str:
    """SQL for a row as text that other engines can rebuild: columns by name, floating numbers as whole numbers of their last
    counted decimal (see ``last_decimal``), dates and times as ISO text, missing values as ``~``."""
    types = dict(df.dtypes)
    floating = lambda c: types[c] in ("float", "double")
    parts = [f"{last_decimal(f"`{c}`", HASHED_DIGITS)}" if floating(c) else f"`{c}`" for c in sorted(df.columns)]
    return f"concat_ws('|', {', '.join(f'coalesce(cast({p} AS string), {chr(39)}~{chr(39)})' for p in parts)})"


def table_fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rows, columns, content_hash): per group the number of rows and a hash of all their columns that doesn't depend on
    the order of rows: the sum of the first 60 bits of each row's md5, which any engine can compute. Repeated rows count."""
    bits = f"cast(conv(substring(md5({row_text(df)}), 1, 15), 16, 10) AS decimal(38,0))"
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.expr(f"cast(coalesce(sum({bits}), 0) AS string) AS content_hash"),
    )


def verify_fingerprint(df: DataFrame, expected: dict) -> dict[str, bool]:
    found = table_fingerprint(df).first().asDict()
    return {name: found[name] == expected[name] for name in found}

"""Audit queries over the model table and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline.catalog.ctes import define, with_ctes
from pitline.catalog.registry import big, query, rounded
from pitline.catalog.features import FEATURES, FUND_FEATURES, GROUP_SQL, NUMERIC_FEATURES, TEXT_FEATURES, WHOLE_FEATURES
from pitline.catalog.tables import counted, documents, events, features, model, model_facts, profile, split_model, tasks
from pitline.operators import audits, profiles, quality
from pitline.operators import events as event_ops
from pitline.operators.calendar import clock_session
from pitline.operators.prices import LABEL_COLUMNS, ROWS_PER_TASK
from pitline.operators.quantiles import EXACT_CELLS, exact_quantiles, ks_distance
from pitline.plans.roles import AUDIT_COLUMNS, META_COLUMNS, TARGET_COLUMNS, classify_columns, feature_group
from pitline.session import read_table

define("lf", " UNION ALL ".join(f"SELECT '{c}' AS feature, split, period_ended, CASE WHEN abs({c}) < 1e5 THEN ROUND(CAST({c} AS DOUBLE), 10) + 0.0 ELSE CAST({c} AS DOUBLE) END AS value FROM mls" for c in NUMERIC_FEATURES), ("mls",))
define("lx", " UNION ALL ".join(f"SELECT '{c}' AS feature, split, period_ended, {c} AS value FROM mls" for c in TEXT_FEATURES), ("mls",))
define("lm", "SELECT feature, split, period_ended, value IS NULL AS gone FROM lf UNION ALL SELECT feature, split, period_ended, value IS NULL FROM lx", ("lf", "lx"))
define("lt", " UNION ALL ".join(f"SELECT '{c}' AS feature, split, period_ended, CAST({c} AS DOUBLE) AS value FROM mls" for c in LABEL_COLUMNS), ("mls",))


@query(
    "target_distribution",
    with_ctes(
        """
, s AS (SELECT reaction_class AS class, 'overall' AS slice, 'all' AS slice_value FROM mls UNION ALL SELECT reaction_class, 'year', CAST(year(period_ended) AS VARCHAR) FROM mls
 UNION ALL SELECT reaction_class, 'quarter', CAST(quarter(period_ended) AS VARCHAR) FROM mls UNION ALL SELECT reaction_class, 'symbol', symbol FROM mls UNION ALL SELECT reaction_class, 'split', split FROM mls)
SELECT slice, slice_value, class, COUNT(*) AS count, ROUND(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY slice, slice_value), 2) AS pct FROM s GROUP BY 1, 2, 3""",
        "mls",
    ).replace("\n,", ",", 1),
)
def target_distribution(spark, d):
    slices = {"year": "year(period_ended)", "quarter": "quarter(period_ended)", "symbol": "symbol", "split": "split"}
    return audits.distribution(split_model(spark, d), "reaction_class", slices)


@query(
    "class_by_year",
    with_ctes("SELECT CAST(year(period_ended) AS INT) AS year, COUNT(*) FILTER (WHERE reaction_class = 'NEGATIVE') AS NEGATIVE, COUNT(*) FILTER (WHERE reaction_class = 'NEUTRAL') AS NEUTRAL, COUNT(*) FILTER (WHERE reaction_class = 'POSITIVE') AS POSITIVE FROM mls GROUP BY 1", "mls"),
)
def class_by_year(spark, d):
    df = model(spark, d).withColumn("year", F.year("period_ended"))
    return audits.crosstab(df, "year", "reaction_class", ["NEGATIVE", "NEUTRAL", "POSITIVE"])


@query(
    "target_profile",
    with_ctes(
        """
, x AS (SELECT feature, 'overall' AS slice, value FROM lt UNION ALL SELECT feature, 'year_' || year(period_ended), value FROM lt UNION ALL SELECT feature, 'split_' || split, value FROM lt)
SELECT feature, slice, COUNT(value) AS n, COUNT(*) - COUNT(value) AS missing, COUNT(*) FILTER (WHERE isinf(value)) AS infinite, ROUND(AVG(value), 8) + 0.0 AS mean, ROUND(stddev_samp(value), 8) + 0.0 AS std,
  ROUND(MIN(value), 8) + 0.0 AS min, ROUND(MAX(value), 8) + 0.0 AS max, ROUND(quantile_cont(value, 0.25), 8) + 0.0 AS q1, ROUND(quantile_cont(value, 0.5), 8) + 0.0 AS median, ROUND(quantile_cont(value, 0.75), 8) + 0.0 AS q3 FROM x GROUP BY 1, 2""",
        "lt",
    ).replace("\n,", ",", 1),
)
def target_profile(spark, d):
    df = split_model(spark, d).withColumn("year", F.year("period_ended"))
    return rounded(audits.numeric_profile(df, LABEL_COLUMNS, {"year": "year", "split": "split"}), 8)


define(
    "miss",
    f"""
SELECT feature, {GROUP_SQL} AS feature_group, AVG(n) AS o, AVG(n) FILTER (WHERE split = 'train') AS tr, AVG(n) FILTER (WHERE split = 'val') AS va, AVG(n) FILTER (WHERE split = 'test') AS te,
   corr(n, CAST(period_ended - DATE '1970-01-01' AS DOUBLE)) AS r FROM (SELECT *, CASE WHEN gone THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n FROM lm) GROUP BY 1""",
    ("lm",),
)
_KIND = "CASE WHEN feature_group LIKE 'fundamental%' OR feature_group = 'valuation' THEN 'EXPECTED_UNAVAILABLE' WHEN feature_group = 'prior_earnings' THEN 'EXPECTED_STRUCTURAL' ELSE 'UNEXPECTED' END"


@query(
    "missingness_by_split",
    with_ctes(
        f"""
SELECT feature, feature_group, ROUND(o * 100, 2) AS overall_missing_pct, ROUND(tr * 100, 2) AS train_missing_pct, ROUND(va * 100, 2) AS val_missing_pct, ROUND(te * 100, 2) AS test_missing_pct,
  ROUND((GREATEST(tr, va, te) - LEAST(tr, va, te)) * 100, 2) AS max_difference_pct, CASE WHEN o > 0 AND o < 1 THEN ROUND(r, 4) END AS time_correlation,
  {_KIND} AS missingness_type, {_KIND} <> 'UNEXPECTED' AS informative_missing FROM miss""",
        "miss",
    ),
)
def missingness_by_split(spark, d):
    return audits.missingness(split_model(spark, d), features(spark, d))


@query(
    "missingness_by_group",
    with_ctes(
        f"SELECT feature_group, COUNT(*) AS n_features, ROUND(AVG(ROUND(o * 100, 2)), 6) AS avg_missing, MAX(ROUND(o * 100, 2)) AS max_missing, MIN(ROUND(o * 100, 2)) AS min_missing, bool_or({_KIND} <> 'UNEXPECTED') AS informative_missing FROM miss GROUP BY 1",
        "miss",
    ),
)
def missingness_by_group(spark, d):
    return rounded(audits.missingness_by_group(audits.missingness(split_model(spark, d), features(spark, d))), 6)


@query("most_missing_features", with_ctes("SELECT feature, ROUND(100 * o, 2) AS overall_missing_pct FROM miss ORDER BY 2 DESC, 1 LIMIT 20", "miss"))
def most_missing_features(spark, d):
    return audits.most_missing(audits.missingness(split_model(spark, d), features(spark, d)), 20)


def _last_decimal_sql(value: str, digits: int) -> str:
    """A whole number of the last decimal: below 1000 from whole numbers of the twelfth, because a mean half-way between two
    decimals lies on either side by chance."""
    unit = 10 ** (12 - digits)
    return (
        f"CASE WHEN abs({value}) < 1000 THEN ((CAST(abs(ROUND({value} * 1e12)) AS BIGINT) + {unit // 2}) // {unit}) * CASE WHEN {value} < 0 THEN -1 ELSE 1 END"
        f" ELSE CAST(ROUND({value} * 1e{digits}) AS BIGINT) END"
    )


define("ld", " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN abs({c}) < 1e5 THEN ({_last_decimal_sql(f'CAST({c} AS DOUBLE)', 10)}) / 1e10::DOUBLE ELSE CAST({c} AS DOUBLE) END AS value FROM mls" for c in NUMERIC_FEATURES), ("mls",))


@query(
    "distinct_counts",
    with_ctes(
        "SELECT feature, COUNT(DISTINCT value) AS distinct_values, COUNT(DISTINCT value) <= 1 AS constant FROM ld GROUP BY 1 UNION ALL SELECT feature, COUNT(DISTINCT value), COUNT(DISTINCT value) <= 1 FROM lx GROUP BY 1",
        "ld", "lx",
    ),
)
def distinct_counts(spark, d):
    return audits.distinct_counts(profiles.distinct_values(split_model(spark, d), features(spark, d), digits=10))


@query(
    "outlier_shares",
    with_ctes(
        """
, q AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM lf GROUP BY 1)
SELECT feature, COUNT(value) AS n, COUNT(*) FILTER (WHERE value < a - 10 * (b - a) OR value > b + 10 * (b - a)) AS outliers,
  COUNT(*) FILTER (WHERE value < a - 10 * (b - a) OR value > b + 10 * (b - a)) > COUNT(value) * 0.05 AS suspicious FROM lf JOIN q USING (feature) GROUP BY 1""",
        "lf",
    ).replace("\n,", ",", 1),
)
def outlier_shares(spark, d):
    return audits.outlier_shares(counted(spark, d), profile(spark, d))


define("md", "SELECT lf.*, m.med FROM lf JOIN (SELECT feature, quantile_cont(value, 0.5) AS med FROM lf GROUP BY 1) m USING (feature) WHERE value IS NOT NULL", ("lf",))
define(
    "xt",
    "SELECT feature, MAX(med) AS median, quantile_cont(abs(value - med), 0.5) AS mad, COUNT(*) >= 4 AND quantile_cont(abs(value - med), 0.5) > 0 AND COALESCE(0.6745 * MAX(abs(value - med)) / NULLIF(quantile_cont(abs(value - med), 0.5), 0) > 10, false) AS extreme FROM md GROUP BY 1",
    ("md",),
)


@query("extreme_values", with_ctes("SELECT feature, ROUND(median, 8) + 0.0 AS median, ROUND(mad, 8) + 0.0 AS mad, extreme FROM xt", "xt"))
def extreme_values(spark, d):
    return rounded(audits.extreme_values(counted(spark, d), profile(spark, d)), 8)


def ks_sql(source: str, feature: str, second: str) -> str:
    """Sizes of both samples, the distance, and the distance as a whole number of 1 / (na * nb)."""
    return f"""SELECT {feature} AS feature, CAST(MAX(na) AS BIGINT) AS na, CAST(MAX(nb) AS BIGINT) AS nb, MAX(abs(ca / NULLIF(na, 0) - cb / NULLIF(nb, 0))) AS ks, CAST(MAX(abs(ca * nb - cb * na)) AS BIGINT) AS h FROM (
  SELECT {feature}, SUM(CASE WHEN split = 'train' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {feature} ORDER BY value) AS ca, SUM(CASE WHEN split = '{second}' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {feature} ORDER BY value) AS cb,
    SUM(CASE WHEN split = 'train' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {feature}) AS na, SUM(CASE WHEN split = '{second}' THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY {feature}) AS nb
  FROM {source} WHERE value IS NOT NULL AND split IN ('train', '{second}')) GROUP BY 1"""


def exact_sql(*sources: str) -> str:
    """(small, large, h, p): the exact tail, one lattice diagonal per step, for the small samples of the named distances."""
    pairs = " UNION ".join(f"SELECT DISTINCT least(na, nb) AS small, greatest(na, nb) AS large, h FROM {s} WHERE na > 0 AND nb > 0 AND na * nb <= {EXACT_CELLS}" for s in sources)
    return f"""
WITH RECURSIVE t AS ({pairs}), r AS (
  SELECT small, large, h, CAST(0 AS BIGINT) AS k, list_transform(range(0, small + 1), lambda i: CASE WHEN i = 0 AND h <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM t
  UNION ALL
  SELECT small, large, h, k + 1, list_transform(q, lambda x, i: CASE WHEN k + 2 - i < 0 OR k + 2 - i > large THEN 0.0::DOUBLE WHEN abs((i - 1) * large - (k + 2 - i) * small) >= h THEN 1.0::DOUBLE
    ELSE (CASE WHEN i > 1 THEN q[i - 1] * (i - 1) / (k + 1) ELSE 0.0::DOUBLE END) + (CASE WHEN k + 2 - i > 0 THEN x * (k + 2 - i) / (k + 1) ELSE 0.0::DOUBLE END) END) FROM r WHERE k < small + large)
SELECT small, large, h, q[small + 1] AS p FROM r WHERE k = small + large"""


_LAM = "(ks * sqrt(CAST(na AS DOUBLE) * nb / (na + nb)))"
_TAIL = f"CASE WHEN {_LAM} < 0.2 THEN 1.0 ELSE GREATEST(0.0, LEAST(1.0, (SELECT SUM(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * {_LAM} * {_LAM})) FROM range(1, 101) r(k)))) END"
define("ksv", ks_sql("lf", "feature", "val"), ("lf",))
define("kst", ks_sql("lf", "feature", "test"), ("lf",))
define("lat", exact_sql("ksv", "kst"), ("ksv", "kst"))
for _name, _from in (("kpv", "ksv"), ("kpt", "kst")):
    define(
        _name,
        f"SELECT s.*, CASE WHEN na = 0 OR nb = 0 THEN NULL WHEN na * nb <= {EXACT_CELLS} THEN p ELSE {_TAIL} END AS pv FROM {_from} s LEFT JOIN lat ON small = least(na, nb) AND large = greatest(na, nb) AND lat.h = s.h",
        (_from, "lat"),
    )


@query("ks_drift", with_ctes("SELECT feature, na AS n_first, nb AS n_second, ROUND(ks, 10) AS ks_statistic, ROUND(pv, 8) AS p_value FROM kpv WHERE ks IS NOT NULL", "kpv"))
def ks_drift(spark, d):
    df = audits.ks_drift(profile(spark, d))
    return df.select(
        "feature", big(F.col("n_first")).alias("n_first"), big(F.col("n_second")).alias("n_second"), F.round("ks_statistic", 10).alias("ks_statistic"), F.round("p_value", 8).alias("p_value")
    )


define("ls", "SELECT symbol AS feature, CASE WHEN period_ended <= DATE '1996-12-31' THEN 'train' ELSE 'val' END AS split, return_5d AS value FROM ml", ("ml",))
define("kss", ks_sql("ls", "feature", "val"), ("ls",))
define("lats", exact_sql("kss"), ("kss",))


@query(
    "ks_small_samples",
    with_ctes(
        f"SELECT feature AS symbol, na AS n_first, nb AS n_second, ROUND(ks, 10) AS ks_statistic, ROUND(CASE WHEN na * nb <= {EXACT_CELLS} THEN p ELSE {_TAIL} END, 10) AS p_value FROM kss s JOIN lats ON small = least(na, nb) AND large = greatest(na, nb) AND lats.h = s.h",
        "kss", "lats",
    ),
)
def ks_small_samples(spark, d):
    """Has a company's 5-day return before its announcements changed since 1996? A handful of events each, so exactly."""
    df = model(spark, d).selectExpr("symbol", "CASE WHEN period_ended <= DATE '1996-12-31' THEN 'early' ELSE 'late' END AS era", "return_5d")
    found = ks_distance(df, "symbol", "return_5d", "era", "early", "late", tasks(ROWS_PER_TASK, df)).where("n_first > 0 AND n_second > 0")
    return rounded(found.select(F.col("feature").alias("symbol"), big(F.col("n_first")).alias("n_first"), big(F.col("n_second")).alias("n_second"), "ks_statistic", "p_value"))


_DIGITS = "CAST(printf('%.7e', {}) AS DOUBLE)"
_FLOATS = "(feature NOT IN ({0}) OR p < n)".format(", ".join(f"'{c}'" for c in WHOLE_FEATURES))


@query(
    "feature_usability",
    with_ctes(
        f"""
, st AS (SELECT feature, COUNT(*) AS n, COUNT(value) AS p, COUNT(DISTINCT value) AS dv, stddev_samp(value) / (abs(AVG(value)) + 1e-10) AS cv,
   {', '.join(f"COUNT(*) FILTER (WHERE split = '{s}') AS n_{s}, COUNT(value) FILTER (WHERE split = '{s}') AS p_{s}, COUNT(DISTINCT value) FILTER (WHERE split = '{s}') AS d_{s}, var_samp(value) FILTER (WHERE split = '{s}') AS v_{s}" for s in ('train', 'val', 'test'))} FROM lf GROUP BY 1),
sx AS (SELECT feature, COUNT(*) AS n, COUNT(value) AS p, COUNT(DISTINCT value) AS dv, NULL::DOUBLE AS cv,
   {', '.join(f"COUNT(*) FILTER (WHERE split = '{s}') AS n_{s}, COUNT(value) FILTER (WHERE split = '{s}') AS p_{s}, COUNT(DISTINCT value) FILTER (WHERE split = '{s}') AS d_{s}, NULL::DOUBLE AS v_{s}" for s in ('train', 'val', 'test'))} FROM lx GROUP BY 1),
al AS (SELECT *, {_FLOATS} AS fl, CASE WHEN feature IN ({', '.join(repr(c) for c in WHOLE_FEATURES)}) THEN 'int' ELSE 'double' END AS dt FROM st UNION ALL SELECT *, false, 'string' FROM sx),
rs AS (SELECT *, CASE WHEN p = 0 THEN 'ALL_MISSING' WHEN dv <= 1 THEN 'CONSTANT' WHEN p / n < 0.5 THEN printf('HIGH_MISSINGNESS (%.1f%%)', ROUND(100.0::DOUBLE * (1 - p / n), 1)) ELSE '' END AS reason FROM al)
SELECT rs.feature AS feature_name, {GROUP_SQL.replace('feature IN', 'rs.feature IN')} AS feature_group, dt AS dtype, ROUND(100.0::DOUBLE * (1 - p / n), 2) AS overall_missing_pct, ROUND(100.0::DOUBLE * (1 - p_train / n_train), 2) AS train_missing_pct,
  ROUND(100.0::DOUBLE * (1 - p_val / n_val), 2) AS validation_missing_pct, ROUND(100.0::DOUBLE * (1 - p_test / n_test), 2) AS test_missing_pct,
  dv AS overall_unique_count, d_train AS train_unique_count, d_val AS validation_unique_count, d_test AS test_unique_count,
  CASE WHEN fl THEN {_DIGITS.format('v_train')} END AS train_variance, CASE WHEN fl THEN {_DIGITS.format('v_val')} END AS validation_variance, CASE WHEN fl THEN {_DIGITS.format('v_test')} END AS test_variance,
  0::BIGINT AS infinite_count, dv <= 1 AS constant_flag, fl AND COALESCE(cv < 0.01, p < 2) AS near_constant_flag, fl AND COALESCE(extreme, false) AS extreme_value_flag,
  COALESCE(GREATEST(1 - p_train / n_train, 1 - p_val / n_val, 1 - p_test / n_test) - LEAST(1 - p_train / n_train, 1 - p_val / n_val, 1 - p_test / n_test) > 0.3, false) AS coverage_shift_flag,
  COALESCE(p_train >= 10 AND p_val >= 10 AND p_test >= 10 AND fl AND (kpv.pv < 0.01 OR kpt.pv < 0.01), false) AS distribution_shift_flag,
  ROUND(kpv.ks, 10) AS ks_val, CASE WHEN fl THEN ROUND(kpv.pv, 8) END AS p_val, ROUND(kpt.ks, 10) AS ks_test, CASE WHEN fl THEN ROUND(kpt.pv, 8) END AS p_test,
  CASE WHEN reason = '' THEN 'CORE' WHEN reason LIKE 'HIGH%' THEN 'SPARSE_BUT_VALID' ELSE 'UNUSABLE' END AS usability_status, reason AS usability_reason
FROM rs LEFT JOIN xt ON xt.feature = rs.feature LEFT JOIN kpv ON kpv.feature = rs.feature LEFT JOIN kpt ON kpt.feature = rs.feature""",
        "lf", "lx", "xt", "kpv", "kpt",
    ).replace("\n,", ",", 1),
)
def feature_usability(spark, d):
    df = profiles.usability(split_model(spark, d), features(spark, d), feature_group, counted=counted(spark, d), profile=profile(spark, d))
    seven = {f"{s}_variance": F.expr(f"cast(format_string('%.7e', {s}_variance) AS double)") for s in ("train", "validation", "test")}
    near = {c: F.round(c, 10 if c.startswith("ks") else 8) for c in ("ks_val", "ks_test", "p_val", "p_test")}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), e) for c, e in seven.items()} | near)


@query("duplicate_targets", with_ctes(f"SELECT CAST(SUM(n - 1) AS BIGINT) AS extra_rows, CAST(SUM(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_repeated_keys FROM (SELECT COUNT(*) AS n FROM ml GROUP BY {', '.join(TARGET_COLUMNS)})", "ml"))
def duplicate_targets(spark, d):
    return audits.duplicate_counts(model(spark, d), TARGET_COLUMNS)


_EXP = "CASE WHEN abnormal_return_3d > 0.02 THEN 'POSITIVE' WHEN abnormal_return_3d < -0.02 THEN 'NEGATIVE' WHEN abnormal_return_3d IS NOT NULL THEN 'NEUTRAL' END"


@query(
    "label_consistency",
    with_ctes(
        f"SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE reaction_class = {_EXP}) AS consistent, COUNT(*) FILTER (WHERE NOT COALESCE(reaction_class = {_EXP}, false)) AS inconsistent, COUNT(*) FILTER (WHERE abnormal_return_3d IS NULL AND abnormal_return_1d IS NOT NULL) AS one_day_fallback, COUNT(*) FILTER (WHERE abs(abnormal_return_3d) > 0.02 * 0.9 AND abs(abnormal_return_3d) < 0.02 * 1.1) AS near_threshold FROM ml",
        "ml",
    ),
)
def label_consistency(spark, d):
    return audits.label_consistency(model(spark, d))


_AT_3 = _EXP.replace("0.02", "0.03")


@query(
    "inconsistent_labels",
    with_ctes(
        f"SELECT event_key, reaction_class AS actual_class, {_AT_3} AS expected_class, ROUND(abnormal_return_3d, 10) + 0.0 AS abnormal_return_3d FROM ml WHERE NOT COALESCE(reaction_class = {_AT_3}, false)",
        "ml",
    ),
)
def inconsistent_labels(spark, d):
    """Labels made with a threshold of 2 % held against one of 3 %."""
    return rounded(audits.inconsistent_labels(model(spark, d), 0.03))


@query("impossible_returns", with_ctes("SELECT feature AS target, COUNT(*) FILTER (WHERE value <= -1) AS impossible_low, COUNT(*) FILTER (WHERE value > 10) AS impossible_high FROM lt GROUP BY 1", "lt"))
def impossible_returns(spark, d):
    return audits.impossible_returns(model(spark, d), LABEL_COLUMNS)


_DAYS = "floor((epoch(result_announcement_datetime) - epoch(CAST(period_ended AS TIMESTAMP))) / 86400)"


@query(
    "announcement_audit",
    with_ctes(
        f"""
SELECT CASE WHEN d IS NULL OR d > 90 THEN 'UNCERTAIN' WHEN d < -30 THEN 'BOARD_EVENT' WHEN d < 0 THEN 'PRE_ANNOUNCEMENT' ELSE 'ACTUAL_RESULT' END AS announcement_classification,
  CASE WHEN hour(t) * 60 + minute(t) < 555 THEN 'pre_market' WHEN hour(t) * 60 + minute(t) > 930 THEN 'post_market' ELSE 'during_market' END AS clock_session, COUNT(*) AS events
FROM (SELECT {_DAYS} AS d, result_announcement_datetime AS t FROM ev WHERE result_announcement_datetime IS NOT NULL) GROUP BY 1, 2""",
        "ev",
    ),
)
def announcement_audit(spark, d):
    ev = events(spark, d).where("result_announcement_datetime IS NOT NULL")
    kind = audits.announcement_type("result_announcement_datetime", "period_ended").alias("announcement_classification")
    return ev.groupBy(kind, clock_session(F.col("result_announcement_datetime")).alias("clock_session")).agg(F.count(F.lit(1)).alias("events"))


_CLOCK = "CASE WHEN hour(t) * 60 + minute(t) < 555 THEN 'pre_market' WHEN hour(t) * 60 + minute(t) > 930 THEN 'post_market' ELSE 'during_market' END"


@query(
    "announcement_listing",
    with_ctes(
        f"""
, a AS (SELECT event_key, {_DAYS} AS d, result_announcement_datetime AS t, CAST(feature_cutoff_date AS TIMESTAMP) AS cut, announcement_session_type AS s FROM ml),
i AS (
  SELECT 'event_classification' AS audit_item, CASE WHEN d IS NULL OR d > 90 THEN 'UNCERTAIN' WHEN d < -30 THEN 'BOARD_EVENT' WHEN d < 0 THEN 'PRE_ANNOUNCEMENT' ELSE 'ACTUAL_RESULT' END AS kind, event_key FROM a
  UNION ALL SELECT 'timing_violation', 'cutoff_after_announcement', event_key FROM a WHERE cut > t
  UNION ALL SELECT 'timing_violation', 'midnight', event_key FROM a WHERE hour(t) = 0 AND minute(t) = 0
  UNION ALL SELECT 'session_inconsistency', s || ' for ' || {_CLOCK}, event_key FROM a WHERE t IS NOT NULL AND s NOT IN ('unknown', 'non_trading_day') AND s <> {_CLOCK})
SELECT audit_item, kind, event_key, 1::BIGINT AS events, NULL::DOUBLE AS pct FROM i
UNION ALL SELECT audit_item, kind, NULL, COUNT(*), ROUND(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM a), 2) FROM i GROUP BY 1, 2""",
        "ml",
    ).replace("\n,", ",", 1),
)
def announcement_listing(spark, d):
    return audits.announcement_listing(model(spark, d))


_FAMILIES = [(name, level, pattern) for name, (level, pattern) in audits.PRICE_FAMILIES.items()]


@query(
    "price_integrity",
    with_ctes(
        f"""
SELECT feature, CASE {' '.join(f"WHEN regexp_matches(feature, '{p}') THEN '{n}'" for n, _, p in _FAMILIES)} END AS family,
  CASE {' '.join(f"WHEN regexp_matches(feature, '{p}') THEN '{s}'" for _, s, p in _FAMILIES)} END AS sensitivity, ROUND(100.0::DOUBLE * (COUNT(*) - COUNT(value)) / COUNT(*), 2) AS missing_pct,
  ROUND(AVG(value), 6) + 0.0 AS mean, ROUND(stddev_samp(value), 6) + 0.0 AS std, ROUND(MIN(value), 6) + 0.0 AS min, ROUND(MAX(value), 6) + 0.0 AS max,
  ROUND(quantile_cont(value, 0.001), 6) + 0.0 AS low, ROUND(quantile_cont(value, 0.999), 6) + 0.0 AS high
FROM (SELECT feature, value FROM lf UNION ALL SELECT feature, value FROM lt) WHERE {' OR '.join(f"regexp_matches(feature, '{p}')" for _, _, p in _FAMILIES)} GROUP BY 1""",
        "lf", "lt",
    ),
)
def price_integrity(spark, d):
    """Market and valuation features, and the labels with the benchmark's returns."""
    labels = profiles.value_profile(profiles.count_values(split_model(spark, d), LABEL_COLUMNS, digits=10))
    return rounded(audits.price_integrity(profile(spark, d).unionByName(labels)), 6)


@query(
    "announcement_timing",
    with_ctes(
        f"""
SELECT COUNT(*) FILTER (WHERE d < 0) AS early, COUNT(*) FILTER (WHERE d > 90) AS late, ROUND(AVG(d), 8) AS mean_days, COUNT(*) FILTER (WHERE g < 0) AS cutoff_violations, COUNT(*) FILTER (WHERE g = 0) AS same_day,
  COUNT(*) FILTER (WHERE g = 1) AS one_day, COUNT(*) FILTER (WHERE g > 1) AS more_days, COUNT(*) FILTER (WHERE hour(t) = 0 AND minute(t) = 0) AS midnight, ROUND(quantile_cont(d, 0.5), 8) AS median_days
FROM (SELECT {_DAYS} AS d, floor((epoch(result_announcement_datetime) - epoch(CAST(feature_cutoff_date AS TIMESTAMP))) / 86400) AS g, result_announcement_datetime AS t FROM ml)""",
        "ml",
    ),
)
def announcement_timing(spark, d):
    return rounded(audits.announcement_timing(model(spark, d)), 8)


@query(
    "symbol_lifecycle",
    with_ctes(
        """
SELECT symbol, MIN(period_ended) AS first_period, MAX(period_ended) AS last_period, COUNT(period_ended) AS n_events, MIN(result_announcement_datetime) AS first_announcement, MAX(result_announcement_datetime) AS last_announcement,
  CASE WHEN MIN(period_ended) > DATE '1994-12-31' THEN 'POTENTIAL_INDEX_ADDITION' WHEN MAX(period_ended) < (SELECT MAX(period_ended) FROM ev) - 60 THEN 'POTENTIAL_INDEX_DELETION' ELSE '' END AS concern FROM ev GROUP BY 1""",
        "ev",
    ),
)
def symbol_lifecycle(spark, d):
    return audits.symbol_lifecycle(events(spark, d), added_after="1994-12-31", quiet_days=60)


@query(
    "universe_overlap",
    with_ctes(
        "SELECT CASE WHEN a.symbol IS NULL THEN 'universe_only' WHEN b.symbol IS NULL THEN 'data_only' ELSE 'overlap' END AS status, COUNT(*) AS symbols FROM (SELECT DISTINCT symbol FROM ev) a FULL JOIN (SELECT 'S' || (s_suppkey + 5) AS symbol FROM supplier) b ON a.symbol = b.symbol GROUP BY 1",
        "ev",
    ),
)
def universe_overlap(spark, d):
    universe = read_table(spark, d, "supplier").selectExpr("concat('S', s_suppkey + 5) AS symbol")
    return audits.universe_overlap(events(spark, d), universe)


@query(
    "universe_difference",
    with_ctes(
        "SELECT CASE WHEN a.symbol IS NULL THEN 'universe_only' WHEN b.symbol IS NULL THEN 'data_only' ELSE 'overlap' END AS status, COALESCE(a.symbol, b.symbol) AS symbol FROM (SELECT DISTINCT symbol FROM ev) a FULL JOIN (SELECT 'S' || (s_suppkey + 5) AS symbol FROM supplier) b ON a.symbol = b.symbol",
        "ev",
    ),
)
def universe_difference(spark, d):
    universe = read_table(spark, d, "supplier").selectExpr("concat('S', s_suppkey + 5) AS symbol")
    return audits.universe_difference(events(spark, d), universe)


_SHARED = "SELECT '{k}' AS kind, '{a}' AS first, '{b}' AS second, value FROM (SELECT CAST({e} AS VARCHAR) AS value FROM mls WHERE split = '{a}' INTERSECT SELECT CAST({e} AS VARCHAR) FROM mls WHERE split = '{b}')"


@query(
    "split_key_overlap",
    with_ctes(
        " UNION ALL ".join(
            _SHARED.format(k=k, e=e, a=a, b=b)
            for k, e in (("event_key", "event_key"), ("period", "period_ended"), ("symbol", "symbol"), ("fiscal_quarter", "fiscal_quarter"), ("month", "month(period_ended)"))
            for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
        ),
        "mls",
    ),
)
def split_key_overlap(spark, d):
    """Event keys and periods share nothing; companies, months and fiscal quarters may."""
    keys = {"event_key": "event_key", "period": "period_ended", "symbol": "symbol", "fiscal_quarter": "fiscal_quarter", "month": "month(period_ended)"}
    return audits.split_key_overlap(split_model(spark, d), keys)


@query(
    "events_per_symbol",
    with_ctes(
        "SELECT MIN(n) AS min_events, MAX(n) AS max_events, ROUND(AVG(n), 8) AS mean_events, arg_min(symbol, struct_pack(a := n, b := symbol)) AS fewest, arg_min(symbol, struct_pack(a := -n, b := symbol)) AS most, ROUND(quantile_cont(n, 0.5), 8) AS median_events FROM (SELECT symbol, COUNT(*) AS n FROM ev GROUP BY 1)",
        "ev",
    ),
)
def events_per_symbol(spark, d):
    return rounded(audits.events_per_symbol(events(spark, d)), 8)


@query(
    "history_coverage",
    with_ctes(
        "SELECT ROUND(AVG(price_history_days), 8) AS mean_price_history, ROUND(AVG(benchmark_history_days), 8) AS mean_benchmark_history, MIN(price_history_days) AS min_price_history, COUNT(*) FILTER (WHERE price_history_days < 20) AS under_20, COUNT(*) FILTER (WHERE price_history_days < 60) AS under_60, COUNT(*) FILTER (WHERE price_history_days < 252) AS under_252, ROUND(quantile_cont(price_history_days, 0.5), 8) AS median_price_history FROM ml",
        "ml",
    ),
)
def history_coverage(spark, d):
    df = rounded(audits.history_coverage(model(spark, d)), 8)
    return df.withColumn("min_price_history", big(F.col("min_price_history")))


@query(
    "fundamental_coverage",
    with_ctes(
        "SELECT 'events with fundamentals' AS feature, ROUND(100 * AVG(CASE WHEN fundamental_pit_status = 'estimated_conservative' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS present_pct FROM ml "
        + " ".join(f"UNION ALL SELECT '{c}', ROUND(100 * AVG(CASE WHEN {c} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE fundamental_pit_status = 'estimated_conservative'), 2) FROM ml" for c in FUND_FEATURES),
        "ml",
    ),
)
def fundamental_coverage(spark, d):
    return audits.fundamental_coverage(model(spark, d), FUND_FEATURES)


@query("tail_quantiles", with_ctes("SELECT feature, ROUND(quantile_cont(value, 0.001), 8) + 0.0 AS low, ROUND(quantile_cont(value, 0.999), 8) + 0.0 AS high FROM lf GROUP BY 1", "lf"))
def tail_quantiles(spark, d):
    return rounded(audits.tail_quantiles(profile(spark, d)), 8)


@query(
    "line_price_quantiles",
    """
SELECT l_returnflag, p, CASE p WHEN 0.001 THEN ROUND(quantile_cont(l_extendedprice, 0.001), 6) WHEN 0.25 THEN ROUND(quantile_cont(l_extendedprice, 0.25), 6) WHEN 0.5 THEN ROUND(quantile_cont(l_extendedprice, 0.5), 6) ELSE ROUND(quantile_cont(l_extendedprice, 0.999), 6) END AS quantile
FROM lineitem, (VALUES (0.001::DOUBLE), (0.25), (0.5), (0.999)) t(p) GROUP BY 1, 2""",
)
def line_price_quantiles(spark, d):
    df = exact_quantiles(read_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.001, 0.25, 0.5, 0.999])
    return df.withColumn("quantile", F.round("quantile", 6))


_DISTANCES = ["distance_from_20dma", "distance_from_50dma", "distance_from_200dma"]


@query(
    "price_jumps",
    with_ctes(
        "\n, s AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs({c} - lag({c}) OVER w) AS j FROM ml WINDOW w AS (PARTITION BY symbol ORDER BY period_ended, event_key)" for c in _DISTANCES)
        + """),
e AS (SELECT feature, quantile_cont(j, 0.999) AS edge FROM s GROUP BY 1)
SELECT feature, COUNT(j) AS jumps, COUNT(*) FILTER (WHERE j > edge) AS large_jumps, ROUND(MAX(j), 8) AS max_jump FROM s JOIN e USING (feature) GROUP BY 1""",
        "ml",
    ).replace("\n,", ",", 1),
)
def price_jumps(spark, d):
    return rounded(audits.jump_counts(model(spark, d), _DISTANCES), 8)


@query("prior_count_order", with_ctes("SELECT symbol, bool_and(COALESCE(s >= 0, true)) AS monotonic FROM (SELECT symbol, prior_earnings_count - lag(prior_earnings_count) OVER (PARTITION BY symbol ORDER BY period_ended, event_key) AS s FROM ml) GROUP BY 1", "ml"))
def prior_count_order(spark, d):
    return audits.prior_count_order(model(spark, d))


@query(
    "leakage_audit",
    with_ctes(
        """
SELECT 'cutoff_before_reaction' AS check, COUNT(*) FILTER (WHERE NOT COALESCE(feature_cutoff_date < reaction_start_date, false)) AS violations FROM ml
UNION ALL SELECT 'cutoff_before_announcement', COUNT(*) FILTER (WHERE NOT COALESCE(feature_cutoff_date <= result_announcement_datetime, false)) FROM ml
UNION ALL SELECT 'reaction_after_announcement', COUNT(*) FILTER (WHERE NOT COALESCE(reaction_start_date >= CAST(result_announcement_datetime AS DATE), false)) FROM ml
UNION ALL SELECT 'fundamentals_available', COUNT(*) FILTER (WHERE fundamental_estimated_available_date > feature_cutoff_date) FROM ml
UNION ALL SELECT 'fundamentals_earlier_period', COUNT(*) FILTER (WHERE fundamental_period_end_date >= period_ended) FROM ml
UNION ALL SELECT 'infinite_rows', 0 UNION ALL SELECT 'duplicate_event_keys', COUNT(*) - COUNT(DISTINCT event_key) FROM ml
UNION ALL SELECT 'duplicate_symbol_period', (SELECT COUNT(*) FROM ml) - (SELECT COUNT(*) FROM (SELECT DISTINCT symbol, period_ended FROM ml))""",
        "ml",
    ).replace("AS check", 'AS "check"'),
)
def leakage_audit(spark, d):
    return audits.leakage_audit(model(spark, d))


def _row(no, check, subject, number="NULL", passed="NULL", text="NULL", source="ml") -> str:
    return f"SELECT {no} AS check_no, '{check}' AS \"check\", {subject} AS subject, CAST({number} AS DOUBLE) AS number, CAST({text} AS VARCHAR) AS text, CAST({passed} AS BOOLEAN) AS passed FROM {source}"


def _quality_sql() -> str:
    columns = [*META_COLUMNS, *FEATURES, *TARGET_COLUMNS, *AUDIT_COLUMNS]
    kinds = {"string": ["event_key", "symbol", "company_name", "fiscal_quarter", "announcement_session_type", "quality_flags", "fundamental_pit_status", "reaction_class", *TEXT_FEATURES],
             "date": ["period_ended", "feature_cutoff_date", "reaction_start_date", "fundamental_period_end_date", "fundamental_estimated_available_date"],
             "timestamp_ntz": ["result_announcement_datetime"], "int": ["price_history_days", "benchmark_history_days", "fundamental_lag_days", *WHOLE_FEATURES]}
    kinds["double"] = [c for c in columns if not any(c in k for k in kinds.values())]
    bad = {
        "cutoff before reaction": "NOT COALESCE(feature_cutoff_date < reaction_start_date, false)",
        "cutoff before announcement": "NOT COALESCE(feature_cutoff_date <= result_announcement_datetime, false)",
        "reaction after announcement": "NOT COALESCE(reaction_start_date >= CAST(result_announcement_datetime AS DATE), false)",
        "statement available": "fundamental_estimated_available_date > feature_cutoff_date",
        "statement earlier": "fundamental_period_end_date >= period_ended",
    }
    share = "ROUND(100.0::DOUBLE * AVG(CASE WHEN gone THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"
    present = "CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END"
    has = "fundamental_pit_status = 'estimated_conservative'"
    rows = [
        _row(1, "shape", "'rows'", "COUNT(*)", "COUNT(*) > 0"),
        _row(1, "shape", "'columns'", len(columns), source="(SELECT 1)"),
        *[_row(2, "event range", f"'{f} {c}'", text=f"CAST({f}({c}) AS VARCHAR)") for c in ("period_ended", "feature_cutoff_date", "reaction_start_date") for f in ("min", "max")],
        _row(3, "events per symbol", "symbol", "COUNT(*)", source="ml GROUP BY symbol"),
        _row(4, "repeated event keys", "'extra rows'", "COUNT(*) - COUNT(DISTINCT event_key)", "COUNT(*) = COUNT(DISTINCT event_key)"),
        _row(5, "repeated symbol and period", "'extra rows'", "SUM(n) - COUNT(*)", "SUM(n) = COUNT(*)", source="(SELECT COUNT(*) AS n FROM ml GROUP BY symbol, period_ended)"),
        *[_row(6, "missing target", f"'{t}'", f"COUNT(*) - COUNT({t})") for t in ("reaction_class", "abnormal_return_1d", "abnormal_return_3d", "abnormal_return_5d")],
        _row(7, "target distribution", "COALESCE(reaction_class, 'MISSING')", "COUNT(*)", source="ml GROUP BY reaction_class"),
        _row(8, "missing values", "feature", share, source="lm GROUP BY feature"),
        _row(9, "mostly missing", "feature", share, "false", source="lm GROUP BY feature HAVING AVG(CASE WHEN gone THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.5"),
        _row(10, "statements", "'events with one'", f"COUNT(*) FILTER (WHERE {has})"),
        *[_row(10, "statements", f"'{c}'", f"ROUND(100.0::DOUBLE * COUNT({c}) / COUNT(*), 6)", source=f"ml WHERE {has}") for c in FUND_FEATURES],
        _row(11, "price history", "'mean days'", "AVG(price_history_days)"),
        _row(11, "price history", "'mean benchmark days'", "AVG(benchmark_history_days)"),
        _row(12, "classes by year", "year || ' ' || reaction_class", "ROUND(n / s, 6)", source="(SELECT year(period_ended) AS year, COALESCE(reaction_class, 'MISSING') AS reaction_class, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY year(period_ended)) AS s FROM ml GROUP BY 1, 2)"),
        *[_row(13, "column types", f"'{k}'", len(v), source="(SELECT 1)") for k, v in kinds.items()],
        _row(14, "infinite values", "feature", "COUNT(*) FILTER (WHERE isinf(value))", "false", source="lf GROUP BY feature HAVING COUNT(*) FILTER (WHERE isinf(value)) > 0"),
        _row(15, "constant features", "feature", "COUNT(DISTINCT value)", "false", source="lf GROUP BY feature HAVING COUNT(DISTINCT value) <= 1"),
        _row(15, "constant features", "feature", "COUNT(DISTINCT value)", "false", source="lx GROUP BY feature HAVING COUNT(DISTINCT value) <= 1"),
        _row(16, "suspicious features", "feature", "o", "false", source=f"(SELECT feature, COUNT(*) FILTER (WHERE value < a - 10 * (b - a) OR value > b + 10 * (b - a)) AS o, SUM({present}) AS p FROM lf JOIN (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM lf GROUP BY 1) q USING (feature) GROUP BY 1) WHERE o > p * 0.05"),
        *[_row(18, "point in time", f"'{k}'", f"COUNT(*) FILTER (WHERE {e})", f"COUNT(*) FILTER (WHERE {e}) = 0") for k, e in bad.items()],
        _row(19, "own history", "'prior features'", sum(c.startswith("prior_") for c in FEATURES), source="(SELECT 1)"),
        _row(19, "own history", "'same class as the last event'", "COUNT(*) FILTER (WHERE prior_last_reaction_class = reaction_class)"),
        _row(20, "chronological split", "split", "COUNT(*)", text="MIN(period_ended) || ' to ' || MAX(period_ended)", source="fs GROUP BY split"),
        _row(20, "chronological split", "'no overlap'", passed="MAX(period_ended) FILTER (WHERE split = 'train') < MIN(period_ended) FILTER (WHERE split = 'val') AND MAX(period_ended) FILTER (WHERE split = 'val') < MIN(period_ended) FILTER (WHERE split = 'test')", source="fs"),
        _row(20, "chronological split", "split || ' ' || COALESCE(reaction_class, 'MISSING')", "COUNT(*)", source="fs GROUP BY split, reaction_class"),
    ]
    leaking = [(c, w) for c in FEATURES for w in [next((w for w in ("after", "future", "forward", "next", "target", "label") if w in c), None)] if w]
    rows += [_row(17, "leaking names", f"'{c}'", passed="false", text=f"'{w}'", source="(SELECT 1)") for c, w in leaking]
    table = " UNION ALL ".join(rows)
    return f"""
, fs AS (SELECT period_ended, reaction_class, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM ml JOIN (SELECT period_ended, row_number() OVER (ORDER BY period_ended) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT period_ended FROM ml)) USING (period_ended))
SELECT check_no, "check", subject, ROUND(number, 6) + 0.0 AS number, text, passed FROM ({table})"""


@query("quality_audit", with_ctes(_quality_sql(), "ml", "lf", "lx", "lm").replace("\n,", ",", 1))
def quality_audit(spark, d):
    df = model(spark, d)
    return rounded(quality.quality_audit(df, model_facts(spark, d), counted(spark, d), profile(spark, d), features(spark, d)), 6)


_COUNT_BAD = {
    "dataset not empty": "SELECT CASE WHEN COUNT(*) = 0 THEN 1 ELSE 0 END FROM ml",
    "no all-null features": "SELECT COUNT(*) FILTER (WHERE p = 0) FROM fc",
    "no constant features": f"SELECT COUNT(*) FILTER (WHERE lo = hi AND feature NOT IN ({', '.join(repr(c) for c in WHOLE_FEATURES)})) FROM fc",
    "no infinite features": "SELECT COUNT(*) FILTER (WHERE isinf(hi) OR isinf(lo)) FROM fc",
    "targets at most 10% missing": "SELECT COUNT(*) FILTER (WHERE m > 0.1) FROM (SELECT feature, AVG(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m FROM lt GROUP BY 1)",
    "market cutoff": "SELECT COUNT(*) FILTER (WHERE NOT COALESCE(feature_cutoff_date < reaction_start_date AND feature_cutoff_date <= result_announcement_datetime, false)) FROM ml",
    "fundamental dates": "SELECT COUNT(*) FILTER (WHERE fundamental_estimated_available_date > feature_cutoff_date OR fundamental_period_end_date >= period_ended) FROM ml",
    "fundamental status": "SELECT COUNT(*) FILTER (WHERE fundamental_pit_status NOT IN ('estimated_conservative', 'unavailable')) FROM ml",
    "unique event keys": "SELECT COUNT(*) - COUNT(DISTINCT event_key) FROM ml",
    "unique symbol and period": "SELECT SUM(n) - COUNT(*) FROM (SELECT COUNT(*) AS n FROM ml GROUP BY symbol, period_ended)",
    "prior count order": "SELECT COUNT(*) FILTER (WHERE s < 0) FROM (SELECT MIN(s) AS s FROM (SELECT symbol, prior_earnings_count - lag(prior_earnings_count) OVER (PARTITION BY symbol ORDER BY period_ended, event_key) AS s FROM ml) GROUP BY symbol)",
    "class shares": "SELECT COUNT(*) FILTER (WHERE s < 0.05 OR s > 0.9) FROM (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS s FROM ml GROUP BY reaction_class)",
    "feature count": f"SELECT CASE WHEN COUNT(DISTINCT feature) = {len(FEATURES)} THEN 0 ELSE 1 END FROM lm",
    "no target or post-event features": "SELECT COUNT(DISTINCT feature) FILTER (WHERE feature LIKE '%\\_after%' ESCAPE '\\') FROM lm",
}


@query(
    "readiness_gate",
    with_ctes(
        "\n, fc AS (SELECT feature, COUNT(value) AS p, MIN(value) AS lo, MAX(value) AS hi FROM lf GROUP BY 1 UNION ALL SELECT feature, COUNT(value), NULL, NULL FROM lx GROUP BY 1) "
        + 'SELECT "check", CASE WHEN bad = 0 THEN \'PASS\' ELSE \'FAIL\' END AS status, CAST(bad AS BIGINT) AS detail FROM ('
        + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v}) AS bad" for k, v in _COUNT_BAD.items())
        + ")",
        "ml", "lf", "lx", "lt", "lm",
    ).replace("\n,", ",", 1),
)
def readiness_gate(spark, d):
    df = rounded(model(spark, d))
    roles = classify_columns(df.columns)
    return audits.readiness_gate(df, roles["features"], roles["targets"], len(FEATURES))


_HASHED = {**dict.fromkeys([*NUMERIC_FEATURES, *[c for c in TARGET_COLUMNS if c != "reaction_class"]], _last_decimal_sql("{0}", 6)), **dict.fromkeys(WHOLE_FEATURES, "{}")}
_ROW_TEXT = "concat_ws('|', " + ", ".join(
    f"COALESCE(CAST({_HASHED.get(c, '{}').format(c)} AS VARCHAR), '~')" for c in sorted([*META_COLUMNS, *FEATURES, *TARGET_COLUMNS, *AUDIT_COLUMNS, "split"])
) + ")"


@query(
    "table_fingerprint",
    with_ctes(
        f"SELECT split, reaction_class, COUNT(*) AS rows, CAST({len(META_COLUMNS) + len(FEATURES) + len(TARGET_COLUMNS) + len(AUDIT_COLUMNS) + 1} AS BIGINT) AS columns, CAST(SUM(CAST('0x' || substr(md5({_ROW_TEXT}), 1, 15) AS BIGINT)) AS VARCHAR) AS content_hash FROM mls GROUP BY 1, 2",
        "mls",
    ),
)
def table_fingerprint(spark, d):
    return audits.table_fingerprint(split_model(spark, d), ["split", "reaction_class"])


@query("late_announcements", with_ctes("SELECT event_key, days_from_period_end FROM (SELECT event_key, CAST(datediff('day', period_ended, CAST(result_announcement_datetime AS DATE)) AS INT) AS days_from_period_end FROM ev) WHERE days_from_period_end > 90 OR days_from_period_end < 0", "ev"))
def late_announcements(spark, d):
    rolled = event_ops.roll_up(documents(spark, d))
    return rolled.where("days_from_period_end > 90 OR days_from_period_end < 0").select("event_key", "days_from_period_end")

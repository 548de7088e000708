"""Splits, preprocessing, leakage checks and prediction guardrails."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from pitline.catalog.ctes import define, with_ctes
from pitline.catalog.registry import big, query, rounded
from pitline.catalog.features import FEATURES, NUMERIC_FEATURES, TEXT_FEATURES, WHOLE_FEATURES, by_group
from pitline.catalog.tables import calendar, model, split_model
from pitline.operators import firewall, guardrails, preprocess, splits
from pitline.plans.loader import load_training_data, with_roles
from pitline.plans.roles import ALL_GROUPS, STRICT_GROUPS, TARGET_COLUMNS, classify_columns, columns_in_groups, feature_group, feature_manifest
from pitline.session import read_table, shared_folder, stage
from pitline.standins import TRAIN_END, VAL_END


@query(
    "temporal_split",
    with_ctes("SELECT split, COUNT(*) AS rows, COUNT(DISTINCT period_ended) AS periods, MIN(period_ended) AS first_period, MAX(period_ended) AS last_period FROM mls GROUP BY 1", "mls"),
)
def temporal_split(spark, d):
    return splits.split_summary(split_model(spark, d))


_WK = """
wk AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT CAST(unnest(generate_series((SELECT MIN(feature_cutoff_date) FROM mls) - INTERVAL 30 DAY, (SELECT MAX(feature_cutoff_date) FROM mls) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS date) WHERE isodow(date) < 6)"""
_EMB = f"""
, {_WK},
vs AS (SELECT COALESCE((SELECT date FROM wk WHERE i = (SELECT MIN(i) FROM wk WHERE date > (SELECT MAX(feature_cutoff_date) FROM mls WHERE split = 'train')) + 4), (SELECT MAX(date) FROM wk)) AS d),
ts AS (SELECT COALESCE((SELECT date FROM wk WHERE i = (SELECT MIN(i) FROM wk WHERE date > (SELECT MAX(feature_cutoff_date) FROM mls, vs WHERE split = 'val' AND feature_cutoff_date >= vs.d)) + 4), (SELECT MAX(date) FROM wk)) AS d),
emb AS (SELECT mls.* EXCLUDE (split), CASE WHEN split = 'val' AND feature_cutoff_date < vs.d THEN 'embargoed' WHEN split = 'test' AND feature_cutoff_date < ts.d THEN 'embargoed' ELSE split END AS split FROM mls, vs, ts)"""


@query("embargo_split", with_ctes(f"{_EMB} SELECT split, COUNT(*) AS rows, MIN(feature_cutoff_date) AS first_cutoff, MAX(feature_cutoff_date) AS last_cutoff FROM emb GROUP BY 1", "mls").replace("\n,", ",", 1))
def embargo_split(spark, d):
    placed = splits.embargo_split(model(spark, d), TRAIN_END, VAL_END)
    return placed.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("feature_cutoff_date").alias("first_cutoff"), F.max("feature_cutoff_date").alias("last_cutoff")
    )


@query(
    "embargo_verify",
    with_ctes(
        f"""{_EMB}, e AS (SELECT MAX(feature_cutoff_date) FILTER (WHERE split = 'train') AS a, MIN(feature_cutoff_date) FILTER (WHERE split = 'val') AS b,
  MAX(feature_cutoff_date) FILTER (WHERE split = 'val') AS c, MIN(feature_cutoff_date) FILTER (WHERE split = 'test') AS t FROM emb)
SELECT a AS train_max_cutoff, b AS val_min_cutoff, c AS val_max_cutoff, t AS test_min_cutoff,
  (SELECT COUNT(*) FROM wk WHERE date > a AND date < b) AS train_val_days_between, (SELECT COUNT(*) FROM wk WHERE date > c AND date < t) AS val_test_days_between,
  (SELECT COUNT(*) FROM wk WHERE date > a AND date < b) >= 5 AS train_val_ok, (SELECT COUNT(*) FROM wk WHERE date > c AND date < t) >= 5 AS val_test_ok FROM e""",
        "mls",
    ).replace("\n,", ",", 1),
)
def embargo_verify(spark, d):
    checked = splits.verify_embargo(splits.embargo_split(model(spark, d), TRAIN_END, VAL_END))
    days = {c: big(F.col(c)) for c in ("train_val_days_between", "val_test_days_between")}
    return checked.withColumns(days)


@query(
    "walk_forward",
    with_ctes(
        f"""
, {_WK},
cand AS (SELECT CASE WHEN k <= 3 THEN last_day(CAST(DATE '1996-12-31' + to_months(CAST(3 * k AS INTEGER)) AS DATE)) ELSE CAST(DATE '1997-09-30' + to_months(CAST(3 * (k - 3) AS INTEGER)) AS DATE) END AS t FROM range(0, 14) r(k)),
edge AS (SELECT t, LEAST(CAST(t + INTERVAL 1 MONTH + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), DATE '{VAL_END}') AS v, (SELECT MAX(feature_cutoff_date) FROM mls WHERE period_ended <= t) AS m FROM cand WHERE t + INTERVAL 1 MONTH <= DATE '{VAL_END}'),
st AS (SELECT *, (SELECT date FROM wk WHERE i = (SELECT MIN(i) FROM wk WHERE date > m) + 4) AS s FROM edge),
f AS (SELECT t, s, v, m, (SELECT COUNT(*) FROM mls WHERE period_ended <= t) AS tr, (SELECT COUNT(*) FROM mls WHERE period_ended > t AND period_ended <= v AND feature_cutoff_date >= s) AS vr,
  (SELECT MIN(feature_cutoff_date) FROM mls WHERE period_ended > t AND period_ended <= v AND feature_cutoff_date >= s) AS vm FROM st)
SELECT t AS train_end, s AS val_start, v AS val_end, tr AS train_rows, vr AS val_rows, m AS train_max_cutoff, vm AS val_min_cutoff FROM f
WHERE vr > 0 AND (SELECT COUNT(*) FROM wk WHERE date > m AND date < vm) >= 4""",
        "mls",
    ).replace("\n,", ",", 1),
)
def walk_forward(spark, d):
    # gap of 4: the embargo starts on the fifth weekday, so four lie strictly in between
    folds = splits.walk_forward(
        model(spark, d), dt.date(1996, 12, 31), dt.date.fromisoformat(VAL_END), strict_gap=4
    )
    return folds.select("train_end", "val_start", "val_end", "train_rows", "val_rows", "train_max_cutoff", "val_min_cutoff")


@query(
    "walk_forward_by_period",
    with_ctes(
        f"""
, {_WK},
cand AS (SELECT CASE WHEN k <= 3 THEN last_day(CAST(DATE '1996-12-31' + to_months(CAST(3 * k AS INTEGER)) AS DATE)) ELSE CAST(DATE '1997-09-30' + to_months(CAST(3 * (k - 3) AS INTEGER)) AS DATE) END AS t FROM range(0, 14) r(k)),
edge AS (SELECT t, LEAST(CAST(t + INTERVAL 1 MONTH + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), DATE '{VAL_END}') AS v, (SELECT MAX(feature_cutoff_date) FROM mls WHERE period_ended <= t) AS m FROM cand WHERE t + INTERVAL 1 MONTH <= DATE '{VAL_END}'),
st AS (SELECT *, (SELECT date FROM wk WHERE i = (SELECT MIN(i) FROM wk WHERE date > m) + 4) AS s FROM edge),
f AS (SELECT t, s, v, m, (SELECT COUNT(*) FROM mls WHERE period_ended <= t) AS tr, (SELECT COUNT(*) FROM mls WHERE period_ended > t AND period_ended <= v AND period_ended >= s) AS vr,
  (SELECT MIN(feature_cutoff_date) FROM mls WHERE period_ended > t AND period_ended <= v AND period_ended >= s) AS vm FROM st)
SELECT t AS train_end, s AS val_start, v AS val_end, tr AS train_rows, vr AS val_rows, m AS train_max_cutoff, vm AS val_min_cutoff FROM f
WHERE vr > 0 AND (SELECT COUNT(*) FROM wk WHERE date > m AND date < vm) >= 4""",
        "mls",
    ).replace("\n,", ",", 1),
)
def walk_forward_by_period(spark, d):
    # gap of 4: the embargo starts on the fifth weekday, so four lie strictly in between
    folds = splits.walk_forward(
        model(spark, d), dt.date(1996, 12, 31), dt.date.fromisoformat(VAL_END), strict_gap=4, val_axis="period_ended"
    )
    return folds.select("train_end", "val_start", "val_end", "train_rows", "val_rows", "train_max_cutoff", "val_min_cutoff")


@query(
    "fraction_split",
    with_ctes(
        """
, p AS (SELECT period_ended, row_number() OVER (ORDER BY period_ended) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT period_ended FROM ml))
SELECT CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split, COUNT(*) AS rows, COUNT(DISTINCT period_ended) AS periods, MIN(period_ended) AS first_period, MAX(period_ended) AS last_period
FROM ml JOIN p USING (period_ended) GROUP BY 1""",
        "ml",
    ).replace("\n,", ",", 1),
)
def fraction_split(spark, d):
    return splits.split_summary(splits.fraction_split(model(spark, d)))


@query(
    "announcement_folds",
    with_ctes(
        """
, u AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT result_announcement_datetime AS ts FROM ml)),
b AS (SELECT k + 1 AS fold, CAST(floor(0.5 * n) + k * floor(n / 5.0) AS BIGINT) AS a, CAST(floor(0.5 * n) + (k + 1) * floor(n / 5.0) AS BIGINT) AS z, n FROM (SELECT DISTINCT n FROM u), range(0, 3) t(k)),
g AS (SELECT fold, MIN(ts) FILTER (WHERE r < a) AS train_start, MAX(ts) FILTER (WHERE r < a) AS train_end, MIN(ts) FILTER (WHERE r >= a AND r < z) AS val_start, MAX(ts) FILTER (WHERE r >= a AND r < z) AS val_end
  FROM b, u WHERE z < b.n GROUP BY fold)
SELECT fold, train_start, train_end, val_start, val_end,
  (SELECT COUNT(*) FROM ml WHERE result_announcement_datetime <= train_end) AS train_events,
  (SELECT COUNT(*) FROM ml WHERE result_announcement_datetime BETWEEN val_start AND val_end) AS val_events,
  (SELECT COUNT(*) FROM ml WHERE result_announcement_datetime <= train_end AND result_announcement_datetime > val_start - INTERVAL 7 DAY) AS embargo_events FROM g""",
        "ml",
    ).replace("\n,", ",", 1),
)
def announcement_folds(spark, d):
    folds = splits.announcement_folds(model(spark, d))
    return folds.withColumn("fold", big(F.col("fold")))


@query(
    "label_contamination",
    with_ctes(
        f"""
SELECT split, w AS label_window, CASE split WHEN 'train' THEN DATE '{TRAIN_END}' ELSE DATE '{VAL_END}' END AS boundary,
  COUNT(*) FILTER (WHERE result_announcement_datetime + to_days(k) > CAST(CASE split WHEN 'train' THEN DATE '{TRAIN_END}' ELSE DATE '{VAL_END}' END AS TIMESTAMP)) AS crossing_events,
  ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE result_announcement_datetime + to_days(k) > CAST(CASE split WHEN 'train' THEN DATE '{TRAIN_END}' ELSE DATE '{VAL_END}' END AS TIMESTAMP)) / COUNT(*), 2) AS pct
FROM mls, (VALUES ('1d_after', 1), ('3d_after', 4), ('5d_after', 7)) t(w, k) WHERE split IN ('train', 'val') GROUP BY 1, 2, 3""",
        "mls",
    ),
)
def label_contamination(spark, d):
    return splits.label_contamination(split_model(spark, d), TRAIN_END, VAL_END)


@query(
    "label_contamination_trading_days",
    with_ctes(
        f"""
, b AS (SELECT * FROM (VALUES ('train', DATE '{TRAIN_END}'), ('val', DATE '{VAL_END}')) v(split, boundary)),
e AS (SELECT m.split, m.result_announcement_datetime AS ts, COALESCE(c.idx, -1) AS idx FROM mls m ASOF LEFT JOIN cal c ON c.date <= CAST(m.result_announcement_datetime AS DATE)),
k AS (SELECT b.split, b.boundary, MAX(idx) AS edge FROM b JOIN cal ON cal.date <= b.boundary GROUP BY 1, 2)
SELECT e.split, w AS label_window, boundary, COUNT(*) FILTER (WHERE ts IS NOT NULL AND idx + days > edge) AS crossing_events,
  ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE ts IS NOT NULL AND idx + days > edge) / COUNT(*), 2) AS pct
FROM e JOIN k USING (split), (VALUES ('1d_after', 1), ('3d_after', 3), ('5d_after', 5)) t(w, days) GROUP BY 1, 2, 3""",
        "mls", "cal",
    ).replace("\n,", ",", 1),
)
def label_contamination_trading_days(spark, d):
    return splits.label_contamination(split_model(spark, d), TRAIN_END, VAL_END, calendar=calendar(spark, d))


_FEATURES = NUMERIC_FEATURES


@query(
    "missing_indicators",
    with_ctes(
        "SELECT split, "
        + ", ".join(f"CASE WHEN (SELECT AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM mls WHERE split = 'train') >= 0.05 THEN SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) END::BIGINT AS {c}_was_missing" for c in _FEATURES)
        + " FROM mls GROUP BY 1",
        "mls",
    ),
)
def missing_indicators(spark, d):
    df = split_model(spark, d)
    fitted = preprocess.create_preprocessor("tree").fit(df.where("split = 'train'"), _FEATURES)
    out = fitted.transform(df, keep=["split"])
    total = [
        F.sum(f"{c}_was_missing").alias(f"{c}_was_missing") if c in fitted.flagged else F.lit(None).cast("bigint").alias(f"{c}_was_missing")
        for c in _FEATURES
    ]
    return out.groupBy("split").agg(*total)


def _scaled(kind: str) -> str:
    train = "FROM {} WHERE split = 'train'"
    medians = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in _FEATURES)
    filled = ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in _FEATURES)
    if kind == "robust":
        fitted = [f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in _FEATURES]
    else:
        fitted = [f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in _FEATURES]
    out = [f"ROUND(({c} - c_{c}) / CASE WHEN s_{c} > 1e-12 * GREATEST(1, abs(c_{c})) THEN s_{c} ELSE 1 END, 6) + 0.0 AS {c}" for c in _FEATURES]
    return f""", md AS (SELECT {medians} {train.format("mls")}), filled AS MATERIALIZED (SELECT event_key, split, {filled} FROM mls, md),
ft AS (SELECT {', '.join(fitted)} {train.format("filled")}) SELECT event_key, split, {', '.join(out)} FROM filled, ft"""


def _linear(name: str, scaler: str) -> None:
    @query(name, with_ctes("\n" + _scaled(scaler), "mls").replace("\n,", ",", 1))
    def run(spark, d):
        df = split_model(spark, d)
        fitted = preprocess.create_preprocessor("linear", scaler=scaler).fit(df.where("split = 'train'"), _FEATURES)
        path = f"{shared_folder(spark)}/preprocessor-{scaler}-{uuid.uuid4().hex}"
        preprocess.save_preprocessor(spark, fitted, path)
        fitted = preprocess.load_preprocessor(spark, path)
        out = fitted.transform(df, keep=["event_key", "split"])
        # a feature without any training value has no median and is dropped by the fit
        dropped = {c: F.lit(None).cast("double") for c in _FEATURES if c not in fitted.features}
        return rounded((out.withColumns(dropped) if dropped else out).select("event_key", "split", *_FEATURES), 6)


_linear("median_impute_robust_scale", "robust")
_linear("median_impute_standard_scale", "standard")


@query(
    "leakage_row_checks",
    with_ctes(
        "SELECT check_name AS check, split, violations FROM (SELECT split, "
        "COUNT(*) FILTER (WHERE feature_cutoff_date >= reaction_start_date) AS \"cutoff before reaction\", "
        "COUNT(*) FILTER (WHERE feature_cutoff_date > result_announcement_datetime) AS \"cutoff not after announcement\", "
        "COUNT(*) FILTER (WHERE reaction_start_date < CAST(result_announcement_datetime AS DATE)) AS \"reaction not before announcement\", "
        "COUNT(*) FILTER (WHERE prior_earnings_count < 0 OR prior_earnings_count > 100) AS \"prior count plausible\", "
        "COUNT(*) FILTER (WHERE fundamental_estimated_available_date > feature_cutoff_date) AS \"fundamentals available at cutoff\", "
        "COUNT(*) FILTER (WHERE fundamental_period_end_date >= period_ended) AS \"fundamentals from earlier period\" FROM mls GROUP BY 1) "
        "UNPIVOT (violations FOR check_name IN (\"cutoff before reaction\", \"cutoff not after announcement\", \"reaction not before announcement\", \"prior count plausible\", \"fundamentals available at cutoff\", \"fundamentals from earlier period\"))",
        "mls",
    ),
)
def leakage_row_checks(spark, d):
    return firewall.row_checks(split_model(spark, d))


def _firewall_sql(source: str, names: dict[str, list[str]]) -> str:
    """A row per check: names, each row check in each split, and keys."""
    said = "CASE WHEN v = 0 THEN 'OK' ELSE v || ' violations' END AS details"
    named = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", {'false' if bad else 'true'} AS passed, '{', '.join(bad) or 'OK'}' AS details" for n, bad in names.items())
    rows = " UNION ALL ".join(f"SELECT '{n} (' || split || ')' AS \"check\", COUNT(*) FILTER (WHERE {e}) AS v FROM {source} GROUP BY split" for n, e in _ROW_SQL.items())
    keys = f"""SELECT 'disjoint event keys' AS "check", COUNT(*) FILTER (WHERE s > 1) AS v FROM (SELECT COUNT(DISTINCT split) AS s FROM {source} GROUP BY event_key)
 UNION ALL SELECT 'no duplicate event keys', COUNT(*) - COUNT(DISTINCT event_key) FROM {source}
 UNION ALL SELECT 'chronological order', CASE WHEN MAX(period_ended) FILTER (WHERE split = 'train') < MIN(period_ended) FILTER (WHERE split = 'val') THEN 0 ELSE 1 END
   + CASE WHEN MAX(period_ended) FILTER (WHERE split = 'val') < MIN(period_ended) FILTER (WHERE split = 'test') THEN 0 ELSE 1 END FROM {source}"""
    return f'{named} UNION ALL SELECT "check", v = 0, {said} FROM ({rows} UNION ALL {keys})'


_ROW_SQL = {
    "cutoff before reaction": "feature_cutoff_date >= reaction_start_date",
    "cutoff not after announcement": "feature_cutoff_date > result_announcement_datetime",
    "reaction not before announcement": "reaction_start_date < CAST(result_announcement_datetime AS DATE)",
    "prior count plausible": "prior_earnings_count < 0 OR prior_earnings_count > 100",
    "fundamentals available at cutoff": "fundamental_estimated_available_date > feature_cutoff_date",
    "fundamentals from earlier period": "fundamental_period_end_date >= period_ended",
}
_NAME_CHECKS = ("no target leakage", "no post-event columns", "no future-looking names")


@query("leakage_firewall", with_ctes(_firewall_sql("mls", dict.fromkeys(_NAME_CHECKS, [])), "mls"))
def leakage_firewall(spark, d):
    df = split_model(spark, d)
    return firewall.run_firewall(df, [c for c in classify_columns(df.columns)["features"] if c != "split"], strict=False)


_SPOILED = {
    "event_key": "CASE WHEN prior_earnings_count IN (4, 40) THEN symbol ELSE event_key END",
    "feature_cutoff_date": "CASE WHEN prior_earnings_count % 7 = 3 THEN reaction_start_date ELSE feature_cutoff_date END",
    "fundamental_period_end_date": "CASE WHEN prior_earnings_count % 13 = 2 THEN period_ended ELSE fundamental_period_end_date END",
    "prior_earnings_count": "CASE WHEN prior_earnings_count % 11 = 5 THEN -1 ELSE prior_earnings_count END",
    "split": "CASE WHEN prior_earnings_count = 1 THEN 'test' ELSE split END",
}
define("spoiled", f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _SPOILED.items())}) FROM mls", ("mls",))


@query(
    "leakage_firewall_spoiled",
    with_ctes(
        _firewall_sql("spoiled", {"no target leakage": ["return_1d_after", "symbol"], "no post-event columns": ["return_1d_after"], "no future-looking names": ["forward_5d"]}),
        "spoiled",
    ),
)
def leakage_firewall_spoiled(spark, d):
    """The same on rows with planted violations and with features that aren't: every check but those of unspoiled dates fails."""
    df = split_model(spark, d)
    wrong = df.selectExpr(*[f"{_SPOILED[c]} AS {c}" if c in _SPOILED else c for c in df.columns])
    return firewall.run_firewall(wrong, ["return_5d", "return_1d_after", "symbol", "forward_5d"], strict=False)


def _digits(c: str) -> int:
    return 6 if c.startswith("val_") else 10


def _comparable(df):
    """Doubles rounded, as the SQL does, whole numbers as bigint."""
    exact = {c: big(F.col(c)) for c, t in df.dtypes if t == "int"}
    return df.withColumns(exact).select(*[(F.round(c, _digits(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.withColumns(exact).dtypes])


def _comparable_sql(columns) -> str:
    kinds = {**dict.fromkeys(WHOLE_FEATURES, "CAST({0} AS BIGINT) AS {0}"), **dict.fromkeys(TEXT_FEATURES, "{0}"), "reaction_class": "{0}"}
    return ", ".join(kinds.get(c, f"ROUND({{0}}, {_digits(c)}) + 0.0 AS {{0}}").format(c) for c in columns)


@query(
    "feature_selection_by_group",
    with_ctes(f"SELECT event_key, split, {_comparable_sql([c for c in FEATURES if feature_group(c) in STRICT_GROUPS])} FROM mls", "mls"),
)
def feature_selection_by_group(spark, d):
    df = split_model(spark, d)
    strict = columns_in_groups(df.columns, STRICT_GROUPS)
    return _comparable(df.select("event_key", "split", *strict))


def _xy(name: str, track: str, groups) -> None:
    chosen = [c for c in FEATURES if feature_group(c) in groups]

    @query(name, with_ctes(f"SELECT event_key, split, {_comparable_sql([*chosen, *TARGET_COLUMNS])} FROM mls", "mls"))
    def run(spark, d):
        # the roles survive a round through files: the loader only sees what is read back
        typed = stage(with_roles(model(spark, d)))
        data = load_training_data(typed, TRAIN_END, VAL_END, track)
        return _comparable(data.joined())


_xy("training_xy_strict", "strict", STRICT_GROUPS)
_xy("training_xy_all", "all", ALL_GROUPS)


@query(
    "training_xy_embargoed",
    with_ctes(f"{_EMB} SELECT split, COUNT(*) AS rows, COUNT(return_5d) AS present, COUNT(reaction_class) AS labelled FROM emb WHERE split <> 'embargoed' GROUP BY 1", "mls").replace("\n,", ",", 1),
)
def training_xy_embargoed(spark, d):
    data = load_training_data(model(spark, d), TRAIN_END, VAL_END, "strict", embargo_days=5)
    sizes = [F.count(F.lit(1)).alias("rows"), F.count("return_5d").alias("present")]
    parts = []
    for s in ("train", "val", "test"):
        x, y = data.xy(s)
        both = x.agg(*sizes).crossJoin(y.agg(F.count("reaction_class").alias("labelled")))
        parts.append(both.select(F.lit(s).alias("split"), "rows", "present", "labelled"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- predictions: the next event type of a user guessed from the one before; toxicity as a guess of quality
define("pc", "SELECT event_id, event_type AS y_true, COALESCE(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'view') AS y_pred, value FROM events")
define("pr", "SELECT value AS y_true, AVG(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 100 AS y_pred FROM events QUALIFY y_pred IS NOT NULL")


def _predicted_types(spark, d):
    # the window covers one user and day
    ev = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return ev.selectExpr(
        "event_id", "event_type AS y_true", "value",
        "lag(event_type) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS in_day", "user_id", "day", "ts",
    )


define("pcd", "SELECT event_type AS y_true, COALESCE(lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id), 'view') AS y_pred, value FROM events")


def _types(spark, d):
    return _predicted_types(spark, d).selectExpr("y_true", "coalesce(in_day, 'view') AS y_pred", "value")


@query("class_confusion", with_ctes("SELECT y_true, y_pred, COUNT(*) AS n FROM pcd GROUP BY 1, 2", "pcd"))
def class_confusion(spark, d):
    return guardrails.class_counts(_types(spark, d))


@query(
    "class_metrics",
    with_ctes(
        """
, c AS (SELECT y_true AS k, COUNT(*) AS t FROM pcd GROUP BY 1), p AS (SELECT y_pred AS k, COUNT(*) AS p, COUNT(*) FILTER (WHERE y_true = y_pred) AS tp FROM pcd GROUP BY 1),
j AS (SELECT c.k, t, COALESCE(p, 0) AS p, COALESCE(tp, 0) AS tp, SUM(t) OVER () AS total, row_number() OVER (ORDER BY t DESC, c.k) = 1 AS top FROM c LEFT JOIN p USING (k))
SELECT MAX(CASE WHEN top THEN k END) AS majority_class, ROUND(AVG(2.0::DOUBLE * tp / (t + p)), 10) AS macro_f1, ROUND(AVG(tp / t), 10) AS balanced_accuracy, ROUND(SUM(tp) / MAX(total), 10) AS accuracy,
  ROUND(AVG(CASE WHEN top THEN 2.0::DOUBLE * t / (t + total) ELSE 0 END), 10) AS baseline_macro_f1, ROUND(AVG(CASE WHEN top THEN 1.0::DOUBLE ELSE 0 END), 10) AS baseline_balanced_accuracy, ROUND(MAX(CASE WHEN top THEN t END) / MAX(total), 10) AS baseline_accuracy FROM j""",
        "pcd",
    ).replace("\n,", ",", 1),
)
def class_metrics(spark, d):
    return rounded(guardrails.class_metrics(_types(spark, d)))


@query(
    "label_quality_metrics",
    """
WITH l AS (SELECT CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels), c AS (SELECT y_true AS k, COUNT(*) AS t FROM l GROUP BY 1),
p AS (SELECT y_pred AS k, COUNT(*) AS p, COUNT(*) FILTER (WHERE y_true = y_pred) AS tp FROM l GROUP BY 1), j AS (SELECT c.k, t, COALESCE(p, 0) AS p, COALESCE(tp, 0) AS tp, SUM(t) OVER () AS total FROM c LEFT JOIN p USING (k))
SELECT ROUND(AVG(2.0::DOUBLE * tp / (t + p)), 10) AS macro_f1, ROUND(AVG(tp / t), 10) AS balanced_accuracy, ROUND(SUM(tp) / MAX(total), 10) AS accuracy FROM j""",
)
def label_quality_metrics(spark, d):
    df = read_table(spark, d, "labels").selectExpr("cast(quality AS string) AS y_true", "cast(toxic AS string) AS y_pred")
    return rounded(guardrails.class_metrics(df).select("macro_f1", "balanced_accuracy", "accuracy"))


_PROBA = "[(k + 1) / (k + 6.0::DOUBLE), 3 / (k + 6.0::DOUBLE), 2 / (k + 6.0::DOUBLE)]"
define("pp", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) * CASE WHEN event_id % 10 = 0 THEN 100 ELSE 1 END AS k FROM events")


def _proba(spark, d):
    ev = read_table(spark, d, "events")
    k = "get_json_object(props, '$.k') * CASE WHEN event_id % 10 = 0 THEN 100 ELSE 1 END"
    rows = ev.selectExpr("event_type", f"cast({k} AS bigint) AS k")
    return rows.selectExpr("CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' ELSE 'c' END AS y_true", "array((k + 1) / (k + 6.0D), 3 / (k + 6.0D), 2 / (k + 6.0D)) AS y_proba")


@query(
    "probability_stats",
    with_ctes(
        f"""
SELECT COUNT(*) AS n_samples, 0::BIGINT AS wrong_width, 0::BIGINT AS nan_values, 0::BIGINT AS infinite_values, COUNT(*) FILTER (WHERE list_sum(y) < 0.99 OR list_sum(y) > 1 / 0.99) AS bad_row_sums,
  COUNT(*) FILTER (WHERE list_max(y) > 0.99) AS collapsed_samples, ROUND(AVG(list_max(y)), 10) AS max_prob_mean, ROUND(MAX(list_max(y)), 10) AS max_prob_max, ROUND(MIN(list_max(y)), 10) AS max_prob_min,
  ROUND(AVG(list_sum(y)), 10) AS row_sum_mean, ROUND(stddev_pop(list_sum(y)), 10) AS row_sum_std FROM (SELECT {_PROBA} AS y FROM pp)""",
        "pp",
    ),
)
def probability_stats(spark, d):
    return rounded(guardrails.probability_stats(_proba(spark, d), 3))


@query(
    "log_loss",
    with_ctes(
        f"SELECT ROUND(AVG(-ln(y[CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END] / list_sum(y))), 10) AS log_loss FROM (SELECT event_type, {_PROBA} AS y FROM pp)",
        "pp",
    ),
)
def log_loss(spark, d):
    return rounded(guardrails.log_loss(_proba(spark, d), ["a", "b", "c"]))


@query(
    "regression_baseline",
    with_ctes(
        """
SELECT COUNT(*) AS n, 0::BIGINT AS nan_values, 0::BIGINT AS infinite_values, ROUND(stddev_pop(y_pred), 6) AS pred_std, ROUND(AVG(abs(y_true - y_pred)), 6) AS mae, ROUND(sqrt(AVG((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
  ROUND(MAX(m), 6) AS baseline_mean, ROUND(AVG(abs(y_true - m)), 6) AS baseline_mae, ROUND(sqrt(AVG((y_true - m) * (y_true - m))), 6) AS baseline_rmse,
  ROUND(AVG(abs(y_true - y_pred)) / AVG(abs(y_true - m)), 6) AS mae_ratio, ROUND(sqrt(AVG((y_true - y_pred) * (y_true - y_pred))) / sqrt(AVG((y_true - m) * (y_true - m))), 6) AS rmse_ratio
FROM pr, (SELECT AVG(y_true) AS m FROM pr)""",
        "pr",
    ),
)
def regression_baseline(spark, d):
    ev = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    rows = ev.selectExpr(
        "value AS y_true",
        "avg(cast(round(value * 100) AS bigint)) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / 100 AS y_pred",
    ).where("y_pred IS NOT NULL")
    return rounded(guardrails.regression_metrics(rows), 6)


@query("class_weights", with_ctes("SELECT reaction_class, COUNT(*) AS n, ROUND(SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)::DOUBLE), 10) AS weight FROM ml GROUP BY 1", "ml"))
def class_weights(spark, d):
    return rounded(guardrails.balanced_weights(model(spark, d), "reaction_class"))


_GROUPS = by_group("feature_name")
_TARGETS_IN = ", ".join(f"'{c}'" for c in TARGET_COLUMNS)
_RULES = f"""CASE WHEN feature_name IN ({_TARGETS_IN}) THEN 'After the event, never a feature' WHEN feature_name LIKE 'fund\\_%' ESCAPE '\\' THEN 'Latest report whose period ends before the event period and 45 days before the cutoff'
  WHEN feature_name LIKE 'val\\_%' ESCAPE '\\' THEN 'Price at the cutoff and the latest usable report' WHEN feature_name LIKE 'prior\\_%' ESCAPE '\\' THEN 'Strictly earlier events of the same company' ELSE 'Prices up to the cutoff' END"""


@query(
    "feature_manifest",
    with_ctes(
        f"""SELECT feature_name, CASE WHEN feature_name IN ({_TARGETS_IN}) THEN 'target' ELSE {_GROUPS} END AS feature_group, {_RULES} AS point_in_time_rule,
  CASE WHEN feature_name IN ({', '.join(f"'{c}'" for c in [*TEXT_FEATURES, 'reaction_class'])}) THEN 'string' WHEN feature_name IN ({', '.join(f"'{c}'" for c in WHOLE_FEATURES)}) THEN 'int' ELSE 'double' END AS expected_dtype,
  feature_name IN ({_TARGETS_IN}) AS is_target, ROUND(100 * m, 2) AS missing_pct FROM (SELECT """
        + ", ".join(f"AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}" for c in [*FEATURES, *TARGET_COLUMNS])
        + f" FROM ml) UNPIVOT (m FOR feature_name IN ({', '.join([*FEATURES, *TARGET_COLUMNS])}))",
        "ml",
    ),
)
def manifest_query(spark, d):
    return feature_manifest(model(spark, d)).drop("description")

"""Audits on a small model table: what they report on clean rows, and that each spoiled value shows."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.operators import audits, preprocess, profiles, quality
from pitline.operators.calendar import trading_calendar
from pitline.operators.splits import label_contamination, temporal_split

FEATURES = ["return_5d", "fund_roe", "val_pe", "prior_earnings_count", "prior_last_reaction_class"]
SCHEMA = (
    "event_key string, symbol string, period_ended date, result_announcement_datetime timestamp_ntz, feature_cutoff_date date, reaction_start_date date,"
    " price_history_days int, benchmark_history_days int, return_5d double, fund_roe double, val_pe double, prior_earnings_count int,"
    " prior_last_reaction_class string, reaction_class string, abnormal_return_1d double, abnormal_return_3d double, abnormal_return_5d double,"
    " fundamental_pit_status string, fundamental_period_end_date date, fundamental_estimated_available_date date"
)


def _rows():
    rng = random.Random(7)
    rows = []
    for k in range(60):
        company, n = k % 3, k // 3
        period = dt.date(2018, 3, 31) + dt.timedelta(days=91 * n)
        at = dt.datetime.combine(period + dt.timedelta(days=30), dt.time(9))
        kind = ("POSITIVE", "NEUTRAL", "NEGATIVE")[k % 3]
        value = rng.gauss(0, 0.03)
        rows.append((f"c{company}_{n}", f"c{company}", period, at, at.date() - dt.timedelta(days=1), at.date(), 300, 400, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(9, 1), n,
                     kind if n else None, kind, value, value, value, "estimated_conservative", period - dt.timedelta(days=91), period - dt.timedelta(days=46)))
    return rows


@pytest.fixture(scope="module")
def clean(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


def _audit(df):
    staged, facts = quality.stage_observed(df)
    counted = profiles.count_values(temporal_split(staged, "2020-06-30", "2021-12-31"), FEATURES)
    profile = profiles.value_profile(counted)
    return {(r.check_no, r.subject): (r.number, r.text, r.passed) for r in quality.quality_audit(staged, facts, counted, profile, FEATURES).collect()}


def test_quality_audit_of_clean_rows(clean):
    got = _audit(clean)
    assert {k for k, _ in got} == set(range(1, 21)) - {9, 14, 15, 16, 17}
    assert [v for v in got.values() if v[2] is False] == []
    assert got[1, "rows"] == (60.0, None, True) and got[3, "c1"][0] == 20.0 and got[4, "extra rows"] == (0.0, None, True)
    assert got[2, "min period_ended"][1] == "2018-03-31" and got[10, "fund_roe"][0] == 100.0
    assert got[8, "prior_last_reaction_class"][0] == 5.0 and got[20, "no overlap"][2] is True
    assert got[20, "train"][0] == 36.0 and got[20, "val"][0] == 12.0 and got[19, "prior features"][0] == 2.0


@pytest.mark.parametrize(
    "column, value, check",
    [
        ("event_key", "'c1_0'", (4, "extra rows")),
        ("period_ended", "date'2018-03-31'", (5, "extra rows")),
        ("feature_cutoff_date", "date'2030-01-01'", (18, "cutoff before reaction")),
        ("reaction_start_date", "date'2010-01-01'", (18, "reaction after announcement")),
        ("fundamental_estimated_available_date", "date'2030-01-01'", (18, "statement available")),
        ("fundamental_period_end_date", "date'2030-01-01'", (18, "statement earlier")),
        ("return_5d", "double('Infinity')", (14, "return_5d")),
    ],
)
def test_one_spoiled_value_fails_the_quality_audit(clean, column, value, check):
    spoiled = clean.withColumn(column, F.when(F.col("event_key") == "c1_1", F.expr(value)).otherwise(F.col(column)))
    assert _audit(spoiled)[check][2] is False


def test_features_that_are_constant_missing_or_wild_show(clean):
    wild = F.when(F.col("prior_earnings_count") < 2, 1e9).otherwise(F.col("return_5d"))
    got = _audit(clean.withColumns({"val_pe": F.lit(4.0), "fund_roe": F.when(F.col("prior_earnings_count") < 6, F.col("fund_roe")), "return_5d": wild}))
    assert got[15, "val_pe"][2] is False and got[9, "fund_roe"] == (70.0, None, False) and got[16, "return_5d"][0] == 6.0


def _gate(df):
    targets = ["reaction_class", "abnormal_return_1d", "abnormal_return_3d", "abnormal_return_5d"]
    return {r.check: r.status for r in audits.readiness_gate(df, FEATURES, targets, len(FEATURES)).collect()}


def test_readiness_gate_passes_and_fails(clean):
    assert set(_gate(clean).values()) == {"PASS"}
    spoil = lambda c, v: clean.withColumn(c, F.when(F.col("event_key") == "c1_1", F.expr(v)).otherwise(F.col(c)))
    for df, check in (
        (spoil("event_key", "'c1_0'"), "unique event keys"),
        (spoil("fundamental_pit_status", "'guessed'"), "fundamental status"),
        (spoil("reaction_start_date", "date'2010-01-01'"), "market cutoff"),
        (spoil("prior_earnings_count", "9"), "prior count order"),
        (clean.withColumn("abnormal_return_3d", F.when(F.col("symbol") != "c1", F.col("abnormal_return_3d"))), "targets at most 10% missing"),
        (clean.withColumn("val_pe", F.lit(None).cast("double")), "no all-null features"),
        (clean.withColumn("reaction_class", F.lit("NEUTRAL")), "class shares"),
    ):
        assert _gate(df)[check] == "FAIL", check


def test_fingerprints_by_group(clean):
    split = temporal_split(clean, "2020-06-30", "2021-12-31")
    known = {r.split: (r.rows, r.content_hash) for r in audits.table_fingerprint(split, ["split"]).collect()}
    assert sum(n for n, _ in known.values()) == 60
    changed = split.withColumn("fund_roe", F.when(F.col("event_key") == "c2_19", F.lit(None)).otherwise(F.col("fund_roe")))
    now = {r.split: (r.rows, r.content_hash) for r in audits.table_fingerprint(changed.orderBy(F.rand(1)), ["split"]).collect()}
    assert {s for s in known if known[s] != now[s]} == {"test"}
    swapped = split.withColumns({"fund_roe": F.col("val_pe"), "val_pe": F.col("fund_roe")})
    assert audits.table_fingerprint(swapped).first().content_hash != audits.table_fingerprint(split).first().content_hash


def test_keys_that_splits_share(spark):
    rows = [("train", "a", 1), ("train", "b", 2), ("train", "a", 1), ("val", "b", 3), ("val", None, 2), ("test", None, 1), ("test", "c", 4), ("embargoed", "a", 4)]
    df = spark.createDataFrame(rows, "split string, event_key string, period int")
    got = {tuple(r) for r in audits.split_key_overlap(df, {"key": "event_key", "period": "period"}).collect()}
    assert got == {("key", "train", "val", "b"), ("key", "val", "test", None), ("period", "train", "val", "2"), ("period", "train", "test", "1")}
    assert {tuple(r) for r in audits.repeated_keys(df, ["event_key"]).collect()} == {("a", 2), ("b", 1), (None, 1)}
    universe = spark.createDataFrame([("b",), ("d",)], "symbol string")
    symbols = spark.createDataFrame([("a",), ("b",), ("a",)], "symbol string")
    assert {tuple(r) for r in audits.universe_difference(symbols, universe).collect()} == {("data_only", "a"), ("overlap", "b"), ("universe_only", "d")}


def test_profiles_by_slice(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if k % 9 else None, None if k % 11 == 0 else rng.gauss(5, 2), float(k % 4)) for k in range(300)]
    df = spark.createDataFrame(rows, "kind string, x double, y double")
    got = {(r.feature, r.slice): r for r in audits.numeric_profile(df, ["x", "y"], {"kind": "kind"}).collect()}
    assert set(got) == {(f, s) for f in "xy" for s in ("overall", "kind_a", "kind_b")}
    for (feature, tag), r in got.items():
        part = [row[1 if feature == "x" else 2] for row in rows if tag == "overall" or row[0] == tag[-1]]
        values = [v for v in part if v is not None]
        assert (r.n, r.missing, r.infinite, r.min, r.max) == (len(values), len(part) - len(values), 0, min(values), max(values))
        assert r.mean == pytest.approx(statistics.fmean(values)) and r.std == pytest.approx(statistics.stdev(values))
        assert [r.q1, r.median, r.q3] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())


@pytest.mark.parametrize("kind, options", [("tree", {}), ("linear", {"scaler": "robust"}), ("linear", {"scaler": "standard"}), ("linear", {"scaler": "none"})])
def test_saved_preprocessors_transform_alike(spark, clean, tmp_path, kind, options):
    names = ["return_5d", "fund_roe", "val_pe", "prior_earnings_count"]
    gappy = clean.withColumn("fund_roe", F.when(F.col("symbol") != "c1", F.col("fund_roe")))
    fitted = preprocess.create_preprocessor(kind, **options).fit(gappy, names)
    preprocess.save_preprocessor(spark, fitted, f"{tmp_path}/state")
    loaded = preprocess.load_preprocessor(spark.newSession(), f"{tmp_path}/state")
    assert loaded == fitted
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(loaded.transform(gappy, ["event_key"])) == key(fitted.transform(gappy, ["event_key"]))
    preprocess.require_same_features(loaded, names)
    for other, message in ((names[:-1], "missing \\['prior_earnings_count'\\]"), ([*names, "size"], "new \\['size'\\]"), (names[::-1], "another order")):
        with pytest.raises(ValueError, match=message):
            preprocess.require_same_features(loaded, other)
    with pytest.raises(ValueError, match="missing columns"):
        loaded.transform(gappy.drop("val_pe"))


def test_a_feature_without_spread_is_not_scaled(spark):
    df = spark.createDataFrame([(0.1 + 0.2,), (0.3,), (0.3,)], "x double")
    for scaler in ("robust", "standard"):
        out = preprocess.create_preprocessor("linear", scaler=scaler).fit(df, ["x"]).transform(df)
        assert all(abs(r.x) < 1e-9 for r in out.collect())
    with pytest.raises(ValueError, match="not fitted"):
        preprocess.save_preprocessor(spark, preprocess.create_preprocessor("tree"), "/tmp/never-written")


def test_announcement_listing_names_each_fault(spark):
    at = lambda hour, minute=0: dt.datetime(2020, 5, 4, hour, minute)
    day, period = dt.date(2020, 5, 1), dt.date(2020, 3, 31)
    rows = [
        ("fine", period, at(9), day, "pre_market"),
        ("closed", period, at(11), day, "non_trading_day"),
        ("midnight", period, at(0), day, "unknown"),
        ("late cutoff", period, at(16), dt.date(2020, 5, 5), "post_market"),
        ("wrong session", dt.date(2020, 5, 31), at(10), day, "pre_market"),
        ("no time", period, None, None, "pre_market"),
    ]
    schema = "event_key string, period_ended date, result_announcement_datetime timestamp_ntz, feature_cutoff_date date, announcement_session_type string"
    found = audits.announcement_listing(spark.createDataFrame(rows, schema)).collect()
    listed = {(r.audit_item, r.kind, r.event_key) for r in found if r.event_key and r.audit_item != "event_classification"}
    assert listed == {
        ("timing_violation", "midnight", "midnight"),
        ("timing_violation", "cutoff_after_announcement", "late cutoff"),
        ("session_inconsistency", "pre_market for during_market", "wrong session"),
    }
    sums = {(r.audit_item, r.kind): (r.events, r.pct) for r in found if r.event_key is None}
    assert sums["event_classification", "ACTUAL_RESULT"] == (4, 66.67) and sums["event_classification", "PRE_ANNOUNCEMENT"] == (1, 16.67)
    assert sums["event_classification", "UNCERTAIN"] == (1, 16.67) and sums["timing_violation", "midnight"] == (1, 16.67)
    assert audits.announcement_listing(spark.createDataFrame([], schema)).count() == 0


def test_inconsistent_labels_are_listed(spark):
    rows = [("a", "POSITIVE", 0.05), ("b", "NEUTRAL", 0.05), ("c", "NEGATIVE", -0.01), ("d", None, 0.0), ("e", "NEUTRAL", None)]
    df = spark.createDataFrame(rows, "event_key string, reaction_class string, abnormal_return_3d double")
    got = {(r.event_key, r.actual_class, r.expected_class) for r in audits.inconsistent_labels(df).collect()}
    assert got == {("b", "NEUTRAL", "POSITIVE"), ("c", "NEGATIVE", "NEUTRAL"), ("d", None, "NEUTRAL"), ("e", "NEUTRAL", None)}


def test_price_integrity_takes_price_columns_alone(spark):
    df = spark.createDataFrame([("train", 0.1, 5.0, 1.0), ("train", 0.3, None, 2.0)], "split string, return_5d double, val_pe double, fund_roe double")
    profile = profiles.value_profile(profiles.count_values(df, ["return_5d", "val_pe", "fund_roe"]))
    got = {r.feature: r for r in audits.price_integrity(profile).collect()}
    assert set(got) == {"return_5d", "val_pe"} and got["val_pe"].missing_pct == 50.0 and got["val_pe"].family == "valuation"
    assert got["return_5d"].sensitivity == "HIGH" and got["return_5d"].mean == pytest.approx(0.2) and got["return_5d"].max == 0.3

def test_label_contamination_in_trading_days(spark):
    days = [dt.date(2020, 6, d) for d in (24, 25, 26, 29, 30)] + [dt.date(2020, 7, d) for d in (1, 2, 3)]
    calendar = trading_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    rows = [("train", dt.datetime(2020, 6, 24, 9)), ("train", dt.datetime(2020, 6, 27, 9)), ("train", dt.datetime(2020, 6, 30, 18)), ("train", None), ("val", dt.datetime(2020, 7, 9))]
    df = spark.createDataFrame(rows, "split string, result_announcement_datetime timestamp_ntz")
    got = {(r.split, r.label_window): r.crossing_events for r in label_contamination(df, "2020-06-30", "2020-07-31", calendar=calendar).collect()}
    # on the 27th, a Saturday, the last trading day is the 26th: two more fit in before July
    assert [got["train", w] for w in ("1d_after", "3d_after", "5d_after")] == [1, 2, 3]
    assert got["val", "1d_after"] == 1


def _near_ties(spark):
    """Means half-way between two last decimals, a little below, at and above it."""
    tenth, sixth = -0.04589843745, -0.0234375
    rows = [("train", tenth + e, sixth + e, 12345.678) for e in (-7e-18, 0.0, 7e-18)]
    assert len({r[1] for r in rows}) > 1 and len({r[2] for r in rows}) > 1
    return spark.createDataFrame(rows, "split string, x double, y double, z double")


def test_noise_makes_no_distinct_values(spark):
    df = _near_ties(spark)
    found = {r.feature: r.distinct_values for r in audits.distinct_counts(profiles.distinct_values(df, ["x", "y", "z"], digits=10)).collect()}
    assert found == {"x": 1, "y": 1, "z": 1}


def test_noise_does_not_change_a_fingerprint(spark):
    df = _near_ties(spark).select("y", "z")
    assert len({audits.table_fingerprint(df.limit(0).union(spark.createDataFrame([tuple(r)], df.schema))).first().content_hash for r in df.collect()}) == 1

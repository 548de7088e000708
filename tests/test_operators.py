"""As-of joins, calendar, prices, quantiles and preprocessing against brute force on small inputs."""

import datetime as dt
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.functions.nullsafe import finite, safe_divide
from pitline.operators import calendar as cal
from pitline.operators import guardrails as gr
from pitline.operators import history, prices, profiles, splits
from pitline.operators.asof import asof_join
from pitline.operators.audits import table_fingerprint, verify_fingerprint
from pitline.operators.firewall import LeakageError, name_checks, run_firewall
from pitline.operators.preprocess import create_preprocessor
from pitline.operators.quantiles import exact_quantiles, ks_distance, ks_exact_tail, ks_p_value


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("bucket", [None, 3])
def test_asof_equals_brute_force(spark, direction, bucket):
    rng = random.Random(1)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    left = [(i, rng.choice("ab"), None if i % 17 == 0 else day(rng.randrange(60))) for i in range(200)]
    right = sorted({(rng.choice("abc"), day(rng.randrange(60))) for _ in range(40)})
    ldf = spark.createDataFrame(left, "i int, k string, t date")
    rdf = spark.createDataFrame([(k, d, j) for j, (k, d) in enumerate(right)], "k string, u date, v int")
    out = {r.i: r.v for r in asof_join(ldf, rdf, ["k"], "t", "u", ["v"], direction, bucket).collect()}
    for i, k, t in left:
        fits = [(d, j) for j, (kk, d) in enumerate(right) if t and kk == k and (d <= t if direction == "backward" else d >= t)]
        expected = (max(fits) if direction == "backward" else min(fits))[1] if fits else None
        assert out[i] == expected


def test_sessions_cutoff_and_reaction(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 8, 9)]
    calendar = cal.trading_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    rows = {
        "pre": (at(3, 9, 14), "pre_market", 2, 3),
        "open": (at(3, 9, 15), "during_market", 2, 4),
        "close": (at(3, 15, 30), "during_market", 2, 4),
        "post": (at(3, 15, 31), "post_market", 3, 4),
        "weekend": (at(6, 12, 0), "non_trading_day", 4, 8),
        "midnight": (at(3, 0, 0), "unknown", 2, 4),
        "first": (at(1, 8, 0), "pre_market", None, 1),
        "last": (at(9, 16, 0), "post_market", 9, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "k string, ts timestamp_ntz")
    for r in cal.event_dates(df, calendar, "ts").collect():
        _, session, cutoff, reaction = rows[r.k]
        assert r.announcement_session_type == session, r.k
        assert (r.feature_cutoff_date and r.feature_cutoff_date.day) == cutoff, r.k
        assert (r.reaction_start_date and r.reaction_start_date.day) == reaction, r.k


def test_drawdown_and_averages_match_direct_frames(spark):
    rng = random.Random(2)
    closes = [100 + rng.random() * 20 for _ in range(300)]
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    rows = prices.with_drawdown(prices.with_ma_distance(prices.with_history(df))).orderBy("date").collect()
    for i in (19, 58, 59, 199, 251, 299):
        for k in (20, 50, 200):
            mean = statistics.fmean(closes[i - k + 1 : i + 1]) if i + 1 >= k else None
            assert (rows[i][f"distance_from_{k}dma"] is None) if mean is None else abs(rows[i][f"distance_from_{k}dma"] - (closes[i] - mean) / mean) < 1e-12
        for k in (20, 60, 252):
            high = max(closes[i - k + 1 : i + 1]) if i + 1 >= k else None
            assert (rows[i][f"drawdown_from_{k}d_high"] is None) if high is None else rows[i][f"drawdown_from_{k}d_high"] == (closes[i] - high) / high


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1 if n > 100 else 6)  # many ties in the large case
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    out = {r.p: r.quantile for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for p in probs:
        assert abs(out[p] - np.quantile(values, p)) < 1e-12


def test_ks_distance_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(size=300), 2), np.round(rng.normal(0.3, 1.2, size=200), 2)
    rows = [("f", float(x), "train") for x in a] + [("f", float(x), "val") for x in b]
    df = spark.createDataFrame(rows, "feature string, value double, split string")
    grid = np.unique(np.concatenate([a, b]))
    expected = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    row = ks_distance(df, "feature", "value", "split", "train", "val").first()
    assert abs(row.ks_statistic - expected) < 1e-12 and (row.n_first, row.n_second) == (300, 200)


def test_trend_skips_missing_labels_and_streak(spark):
    classes = ["POSITIVE", "UNKNOWN", "NEGATIVE", "NEGATIVE", "NEUTRAL", "POSITIVE"]
    rows = [("A", f"e{i}", dt.date(2020 + i, 3, 31), 0.01 * i, 0.01, 0.01, c) for i, c in enumerate(classes)]
    df = spark.createDataFrame(rows, "symbol string, event_key string, period_ended date, abnormal_return_1d double, abnormal_return_3d double, abnormal_return_5d double, reaction_class string")
    out = {r.event_key: r for r in history.with_prior_history(df).collect()}
    assert out["e0"].prior_earnings_count == 0 and out["e0"].prior_reaction_streak is None
    assert abs(out["e4"].prior_reaction_trend_4 - np.polyfit([0, 1, 2], [1, -1, -1], 1)[0]) < 1e-12
    assert out["e4"].prior_reaction_streak == 2 and out["e5"].prior_reaction_streak == 1
    assert out["e4"].prior_negative_rate_4 == 0.5 and out["e3"].prior_negative_rate_4 is None


def test_safe_math(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0), (3.0, 2.0), (1.0, float("inf"))], "a double, b double")
    assert [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"))).collect()] == [None, None, None, 1.5, None]
    assert [r[0] for r in df.select(finite(F.col("a"))).collect()] == [1.0, None, None, 3.0, 1.0]


def test_embargo_weekday_arithmetic(spark):
    friday = dt.date(2024, 1, 5)
    assert splits.nth_weekday_after(friday, 5, dt.date(2024, 2, 1)) == dt.date(2024, 1, 12)
    assert splits.nth_weekday_after(friday, 5, dt.date(2024, 1, 9)) == dt.date(2024, 1, 9)


def test_guardrails(spark):
    truth = ["NEUTRAL"] * 120 + ["POSITIVE"] * 40 + ["NEGATIVE"] * 40
    collapsed = spark.createDataFrame([(t, "NEUTRAL", [0.0025, 0.995, 0.0025]) for t in truth], "y_true string, y_pred string, y_proba array<double>")
    with pytest.raises(gr.GuardrailViolation, match="degenerate"):
        gr.check_classes(collapsed)
    with pytest.raises(gr.GuardrailViolation, match="collapse"):
        gr.check_probabilities(collapsed, 3)
    with pytest.raises(gr.GuardrailViolation, match="majority"):
        gr.require_better_than_majority(collapsed)
    assert gr.class_metrics(collapsed).first().baseline_accuracy == 0.6
    good = spark.createDataFrame([(t, t) for t in truth], "y_true string, y_pred string")
    assert gr.check_classes(good) == {"NEGATIVE": 40, "NEUTRAL": 120, "POSITIVE": 40}
    assert gr.require_better_than_majority(good)["macro_f1"] == 1.0
    reg = spark.createDataFrame([(float(v), 3.0) for v in range(1, 6)], "y_true double, y_pred double")
    assert abs(gr.regression_metrics(reg).first().baseline_mae - 1.2) < 1e-12
    with pytest.raises(gr.GuardrailViolation, match="constant"):
        gr.check_regression(reg)


def test_preprocessing_uses_training_rows_only(spark):
    rows = [("train", float(i), None if i % 2 else 1.0, "s") for i in range(10)] + [("test", 1000.0, None, "s")]
    df = spark.createDataFrame(rows, "split string, x double, y double, z string")
    train = df.where("split = 'train'")
    linear = create_preprocessor("linear").fit(train, ["x", "y", "z"])
    assert linear.medians == {"x": 4.5, "y": 1.0} and linear.flagged == ["y"]
    out = linear.transform(df.where("split = 'test'")).first()
    assert abs(out.x - (1000 - 4.5) / 4.5) < 1e-9 and out.y == 0.0
    tree = create_preprocessor("tree").fit(train, ["x", "y"])
    assert tree.transform(df.where("split = 'test'")).first().asDict() == {"x": 1000.0, "y": None, "y_was_missing": 1}
    with pytest.raises(ValueError, match="missing columns"):
        tree.transform(df.drop("y"))


def _firewall_data(spark, bad_cutoff=False):
    rows = []
    for i in range(30):
        split = "train" if i < 20 else "val" if i < 25 else "test"
        cutoff = dt.date(2024, 1, 1) + dt.timedelta(days=7 * i + (14 if i >= 20 else 0) + (14 if i >= 25 else 0))
        reaction = cutoff if bad_cutoff and i == 3 else cutoff + dt.timedelta(days=10)
        rows.append((f"k{i}", split, cutoff, cutoff, dt.datetime.combine(cutoff + dt.timedelta(days=5), dt.time()), reaction, i))
    schema = "event_key string, split string, period_ended date, feature_cutoff_date date, result_announcement_datetime timestamp_ntz, reaction_start_date date, prior_earnings_count int"
    return spark.createDataFrame(rows, schema)


def test_firewall(spark):
    ok = run_firewall(_firewall_data(spark), ["feature_1", "prior_earnings_count"])
    assert ok.where("NOT passed").count() == 0
    with pytest.raises(LeakageError, match="cutoff before reaction"):
        run_firewall(_firewall_data(spark, bad_cutoff=True), ["feature_1"])
    with pytest.raises(LeakageError, match="post-event"):
        run_firewall(_firewall_data(spark), ["return_7d_after"])
    assert dict(name_checks(["reaction_class", "next_return"]))["no target leakage"] == ["reaction_class"]


def test_events_without_period_are_no_earlier_events(spark):
    rows = [("A", dt.date(2024, 3, 31), "k1", "POSITIVE"), ("A", dt.date(2024, 6, 30), "k2", "NEGATIVE"), ("A", None, "k0", "NEUTRAL")]
    df = spark.createDataFrame([(*r, 0.1, 0.2, 0.3) for r in rows], "symbol string, period_ended date, event_key string, reaction_class string, abnormal_return_1d double, abnormal_return_3d double, abnormal_return_5d double")
    got = {r.event_key: (r.prior_earnings_count, r.prior_last_reaction_class) for r in history.with_prior_history(df).collect()}
    assert got == {"k1": (0, None), "k2": (1, "POSITIVE"), "k0": (2, "NEGATIVE")}


def test_dates_far_past_and_before_the_calendar(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 4, 5, 8, 9)], "date date")
    calendar = cal.trading_calendar(days)
    df = spark.createDataFrame([(dt.date(2040, 1, 1), dt.date(2024, 1, 3), dt.date(2041, 1, 1)), (dt.date(1990, 1, 1), dt.date(1980, 1, 1), dt.date(2024, 1, 3)), (None, None, None)], "day date, a date, b date")
    placed = cal.count_between(cal.add_embargo(df, calendar, "day", 5), calendar, "a", "b", "n")
    assert {(r.embargo_date, r.n) for r in placed.collect()} == {(dt.date(2024, 1, 9), 4), (dt.date(2024, 1, 5), 2), (None, None)}


def test_embargo_without_rows_to_keep(spark):
    schema = "period_ended date, feature_cutoff_date date"
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 2)), (dt.date(2020, 2, 1), dt.date(2020, 1, 2)), (dt.date(2020, 6, 1), dt.date(2020, 6, 2))], schema)
    got = [r.split for r in splits.embargo_split(df, "2020-01-15", "2020-03-01").orderBy("period_ended").collect()]
    assert got == ["train", "embargoed", "test"]
    with pytest.raises(ValueError):
        splits.embargo_split(df, "2010-01-01", "2020-03-01")


def test_fingerprint_sees_any_change_but_order(spark):
    rows = [(k, f"v{k}", None if k == 3 else k / 2) for k in range(20)]
    make = lambda r: spark.createDataFrame(r, "a long, b string, c double")
    known = table_fingerprint(make(rows)).first().asDict()
    assert verify_fingerprint(make(rows[::-1]).select("c", "a", "b"), known) == {"rows": True, "columns": True, "content_hash": True}
    changed = rows[:5] + [(5, "other", 2.5)] + rows[6:]
    assert verify_fingerprint(make(changed), known) == {"rows": True, "columns": True, "content_hash": False}
    assert not verify_fingerprint(make(rows[1:]), known)["rows"]


def _history_rows(seed, companies=6, periods=14):
    """Events whose announcements overlap, so that labels become known in another order than the periods'."""
    rng = random.Random(seed)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    rows = []
    for c in range(companies):
        for p in range(periods):
            cutoff = None if rng.random() < 0.1 else day(90 * p + rng.randint(10, 250))
            known = {h: None if cutoff is None or rng.random() < 0.1 else cutoff + dt.timedelta(days=h + rng.randint(1, 60)) for h in (1, 3, 5)}
            returns = {h: rng.choice([-0.05, -0.01, 0.0, 0.03, 0.04]) if known[h] else None for h in (1, 3, 5)}
            lead = returns[3] if returns[3] is not None else returns[1]
            kind = "UNKNOWN" if lead is None else "POSITIVE" if lead > 0.02 else "NEGATIVE" if lead < -0.02 else "NEUTRAL"
            rows.append((f"c{c}_{p}", f"c{c}", day(90 * p), cutoff, *(returns[h] for h in (1, 3, 5)), kind, *(known[h] for h in (1, 3, 5))))
    return rows


HISTORY_SCHEMA = "event_key string, symbol string, period_ended date, feature_cutoff_date date, abnormal_return_1d double, abnormal_return_3d double, abnormal_return_5d double, reaction_class string, label_known_1d date, label_known_3d date, label_known_5d date"


def _seen_history(rows):
    out = {}
    for key, symbol, period, cutoff, *_ in rows:
        prior = sorted((r for r in rows if r[1] == symbol and (r[2], r[0]) < (period, key)), key=lambda r: (r[2], r[0]))
        sees = lambda known: known is not None and cutoff is not None and known <= cutoff
        returns = [{h: r[4 + k] if sees(r[8 + k]) else None for k, h in enumerate((1, 3, 5))} for r in prior]
        classes = [r[7] if r[7] != "UNKNOWN" and sees(r[9] if r[5] is not None else r[8]) else None for r in prior]
        row = {"prior_earnings_count": len(prior), "prior_last_reaction_class": classes[-1] if prior else None}
        row["prior_days_since_last"] = (period - prior[-1][2]).days if prior else None
        for h in (1, 3, 5):
            row[f"prior_last_abn_ret_{h}d"] = returns[-1][h] if prior else None
            for n in (2, 4, 8):
                values = [r[h] for r in returns[-n:] if r[h] is not None] if len(prior) >= n else []
                row[f"prior_abn_ret_{h}d_mean_{n}"] = statistics.fmean(values) if values else None
                if n > 2:
                    row[f"prior_abn_ret_{h}d_median_{n}"] = statistics.median(values) if values else None
                    row[f"prior_abn_ret_{h}d_std_{n}"] = statistics.stdev(values) if len(values) > 1 else None
                if h == 5:
                    row[f"prior_avg_reaction_magnitude_{n}"] = statistics.fmean(map(abs, values)) if values else None
        for n in (4, 8):
            recent = classes[-n:]
            for c in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
                row[f"prior_{c.lower()}_rate_{n}"] = recent.count(c) / n if len(prior) >= n else None
            signs = [{"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}[c] for c in recent if c]
            row[f"prior_reaction_trend_{n}"] = float(np.polyfit(range(len(signs)), signs, 1)[0]) if len(prior) >= n and len(signs) > 1 else None
        streak = 0
        while streak < len(prior) and classes[-1 - streak] is not None and classes[-1 - streak] == classes[-1]:
            streak += 1
        row["prior_reaction_streak"] = max(streak, 1) if prior else None
        out[key] = row
    return out


def test_history_sees_what_each_cutoff_knew(spark):
    rows = _history_rows(1)
    df = history.with_history_known_at(spark.createDataFrame(rows, HISTORY_SCHEMA))
    assert df.columns == [*[c.split(" ")[0] for c in HISTORY_SCHEMA.split(", ")], *history.HISTORY_COLUMNS]
    expected = _seen_history(rows)
    for r in df.collect():
        got = {c: r[c] for c in history.HISTORY_COLUMNS}
        assert got == pytest.approx(expected[r.event_key], abs=1e-9), r.event_key


def test_an_event_known_to_one_later_event_only(spark):
    day = dt.date
    rows = [
        ("a", "s", day(2000, 3, 31), day(2000, 5, 1), 0.1, 0.1, 0.1, "POSITIVE", *[day(2000, 6, 1)] * 3),
        ("b", "s", day(2000, 6, 30), day(2000, 5, 20), 0.2, 0.2, 0.2, "POSITIVE", *[day(2000, 5, 25)] * 3),
        ("c", "s", day(2000, 9, 30), day(2000, 6, 1), None, None, None, None, None, None, None),
    ]
    got = {r.event_key: (r.prior_last_abn_ret_5d, r.prior_abn_ret_1d_mean_2) for r in history.with_history_known_at(spark.createDataFrame(rows, HISTORY_SCHEMA)).collect()}
    assert got["b"] == (None, None) and got["c"] == (0.2, pytest.approx(0.15))


def test_history_with_everything_known_is_the_plain_one(spark):
    rows = [(*r[:3], dt.date(2030, 1, 1), *[0.01 * k if v is None else v for k, v in enumerate(r[4:7])], "NEUTRAL" if r[7] == "UNKNOWN" else r[7], *[dt.date(2001, 1, 1)] * 3) for r in _history_rows(2)]
    df = spark.createDataFrame(rows, HISTORY_SCHEMA)
    plain = {r.event_key: r for r in history.with_prior_history(df).select("event_key", *history.HISTORY_COLUMNS).collect()}
    for r in history.with_history_known_at(df).select("event_key", *history.HISTORY_COLUMNS).collect():
        assert r.asDict() == pytest.approx(plain[r.event_key].asDict(), abs=1e-9)


def test_label_dates_are_the_later_of_both_series(spark):
    day = lambda d: dt.date(2024, 1, d)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    prices_ = frame([("a", day(d), 1.0) for d in (2, 4, 8, 9, 10, 11, 12)], "symbol string, date date, close double")
    bench = frame([(day(d), 1.0) for d in (1, 2, 5, 9, 10)], "date date, close double")
    calendar = cal.trading_calendar(frame([(day(d),) for d in range(1, 13)], "date date"))
    events = frame([("x", "a", day(3)), ("y", "a", day(9)), ("z", "b", day(3)), ("w", "a", None)], "event_key string, symbol string, reaction_start_date date")
    got = {r.event_key: (r.label_known_1d, r.label_known_3d, r.label_known_5d) for r in history.label_known_dates(events, prices_, bench, calendar).collect()}
    # from the 3rd: own observations 4, 8, 9, 10; benchmark 5, 9, 10
    assert got == {"x": (day(9), None, None), "y": (day(10), None, None), "z": (None,) * 3, "w": (None,) * 3}


# ---- counted values and exact p-values ----


def test_profile_matches_numpy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(700):
        split = ["train", "val", "test", "embargoed"][k % 4]
        heavy = float(rng.standard_t(1) * 1e6)
        rows.append((split, None if k % 7 == 0 else float(rng.normal(1e7 if k % 2 else 1e7 + 3)), heavy, float(k % 3), 2.5, None, k % 5, "ab"[k % 2] if k % 3 else None))
    names = ["near", "heavy", "few", "same", "none", "whole", "word"]
    df = spark.createDataFrame(rows, "split string, near double, heavy double, few double, same double, none double, whole int, word string")
    counted = profiles.count_values(df, names)
    got = {r.feature: r for r in profiles.value_profile(counted).collect()}
    assert set(got) == set(names)
    medians = spark.createDataFrame([(f, r.q0_5) for f, r in got.items() if r.q0_5 is not None], "feature string, median double")
    spread = {r.feature: r for r in profiles.deviation_profile(counted, medians).collect()}
    for k, name in enumerate(names[:-1], 1):
        part = {s: np.array([r[k] for r in rows if r[k] is not None and s in (None, r[0])], float) for s in (None, "train", "val", "test")}
        r, values = got[name], part[None]
        assert (r.n, r.present, r.distinct) == (700, len(values), len(set(values)))
        assert r.distinct_val == len(set(part["val"])) and r.present_test == len(part["test"])
        if not len(values):
            assert r.q0_5 is None and r.mean is None and r.ks_val is None
            continue
        assert r.mean == pytest.approx(values.mean()) and r.variance == pytest.approx(values.var(ddof=1), rel=1e-7, abs=1e-12)
        assert r.variance_train == pytest.approx(part["train"].var(ddof=1), rel=1e-7, abs=1e-12)
        for p in profiles.PROBS:
            assert r[profiles.quantile_name(p)] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert spread[name].mad == pytest.approx(np.median(abs(values - np.median(values))), rel=1e-9, abs=1e-15)
        for s in ("val", "test"):
            at = np.unique(values)
            share = lambda x: np.searchsorted(np.sort(x), at, side="right") / len(x)  # noqa: E731, B023
            assert r[f"ks_{s}"] == pytest.approx(abs(share(part["train"]) - share(part[s])).max())
    assert (got["word"].present, got["word"].distinct, got["word"].texts, got["word"].q0_5) == (466, 2, 466, None)


def test_profile_with_infinities_and_nan(spark):
    inf = float("inf")
    df = spark.createDataFrame([("train", v) for v in (1.0, inf, -inf, inf, float("nan"), None)], "split string, x double")
    r = profiles.value_profile(profiles.count_values(df, ["x"])).first()
    assert (r.n, r.present, r.distinct, r.infinite) == (6, 5, 4, 3) and r.q0_25 == 1.0 and r.q0_5 == inf
    assert profiles.value_profile(profiles.count_values(df.limit(0), ["x"])).count() == 0


def test_usability_flags(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        split = "train" if k < 200 else "val" if k < 300 else "test"
        rows.append((split, rng.gauss(0, 1), rng.gauss(0, 1) + (3 if split == "val" else 0), None if rng.random() < 0.7 else 1.0 + k, 5.0, 1e9 if k == 3 else rng.random(), 3, None, float("inf") if k == 0 else 1.0 * k, 0.5 * k))
    columns = ["plain", "moved", "sparse", "constant", "spiked", "count", "empty", "infinite", "return_1d_after"]
    df = spark.createDataFrame(rows, "split string, plain double, moved double, sparse double, constant double, spiked double, count int, empty double, infinite double, return_1d_after double")
    got = {r.feature_name: r for r in profiles.usability(df, columns, lambda c: "g").collect()}
    reasons = {c: r.usability_reason.split(" ")[0] for c, r in got.items()}
    assert reasons == {"plain": "", "moved": "", "sparse": "HIGH_MISSINGNESS", "constant": "CONSTANT", "spiked": "", "count": "CONSTANT", "empty": "ALL_MISSING", "infinite": "INFINITE_VALUES", "return_1d_after": "POST_EVENT"}
    assert got["moved"].distribution_shift_flag and not got["plain"].distribution_shift_flag
    assert got["spiked"].extreme_value_flag and not got["plain"].extreme_value_flag
    assert got["constant"].near_constant_flag and not got["count"].near_constant_flag and got["count"].train_variance is None


def _enumerated_tail(n, m, h):
    """Share of all orders of two samples in which some |i m - j n| reaches h."""
    hits = total = 0
    for first in itertools.combinations(range(n + m), n):
        i = j = far = 0
        mine = set(first)
        for k in range(n + m):
            i, j = (i + 1, j) if k in mine else (i, j + 1)
            far = max(far, abs(i * m - j * n))
        hits += far >= h
        total += 1
    return hits / total


@pytest.mark.parametrize("n, m", [(1, 1), (1, 5), (2, 2), (3, 4), (4, 4), (5, 3), (6, 6), (7, 5)])
def test_exact_ks_tail_equals_enumeration(spark, n, m):
    df = spark.createDataFrame([(h / (n * m), n, m) for h in range(0, n * m + 1)], "d double, n int, m int")
    for r in df.withColumn("p", F.expr(ks_exact_tail("d", "n", "m"))).collect():
        assert r.p == pytest.approx(_enumerated_tail(n, m, round(r.d * n * m)), abs=1e-12)


def test_exact_ks_tail_up_to_twelve_by_counting_paths(spark):
    """Enumeration of all n, m up to 12 by the number of paths that stay inside, in whole numbers."""

    def tail(n, m, h):
        paths = {}
        for i in range(n + 1):
            for j in range(m + 1):
                inside = abs(i * m - j * n) < h
                paths[i, j] = (1 if i == j == 0 else paths.get((i - 1, j), 0) + paths.get((i, j - 1), 0)) if inside else 0
        return 1 - paths[n, m] / math.comb(n + m, n)

    rows = [(h / (n * m), n, m) for n in range(1, 13) for m in range(1, 13) for h in {1, n * m, max(n, m), n * m // 2, n * m // 3} if h]
    df = spark.createDataFrame(rows, "d double, n int, m int").repartition(4)
    for r in df.withColumn("p", F.expr(ks_exact_tail("d", "n", "m"))).collect():
        assert r.p == pytest.approx(tail(r.n, r.m, round(r.d * r.n * r.m)), abs=1e-12), r
    sizes = spark.createDataFrame([(0.2, 300, 300), (0.5, 0, 4), (0.3, 10, 10)], "d double, n int, m int")
    far, none, near = [r.p for r in sizes.withColumn("p", F.expr(ks_p_value("d", "n", "m"))).collect()]
    assert none is None and far == pytest.approx(1.19e-5, rel=0.05) and near == pytest.approx(tail(10, 10, 30))


def test_free_text_predictions_are_refused(spark):
    df = spark.range(200).selectExpr("'a' AS y_true", "concat('b', id) AS y_pred")
    assert gr.check_classes(df.limit(20).selectExpr("'a' AS y_true", "CASE WHEN y_pred < 'b2' THEN 'a' ELSE 'c' END AS y_pred"), ["a", "c"]).keys() == {"a", "c"}
    many = spark.range(11_000).selectExpr("concat('a', id) AS y_true", "concat('b', id) AS y_pred")
    with pytest.raises(gr.GuardrailViolation, match="more than 100 classes"):
        gr.check_classes(many)

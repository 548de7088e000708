"""Wide sorts are dealt over tasks by row counts, whatever the session would join up."""

import contextlib
import datetime as dt
import io

from pitline import standins
from pitline.operators import preprocess, prices, profiles
from pitline.operators.asof import asof_join
from pitline.operators.calendar import trading_calendar
from pitline.operators.history import join_dealt, label_known_dates, with_prior_history
from pitline.operators.quantiles import ks_distance


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _series(spark, symbols=6, days=30):
    start = dt.date(2020, 1, 1)
    rows = [(f"s{i}", start + dt.timedelta(k), 100.0 + (i * 7 + k * 3) % 11, 10.0 + k % 4) for i in range(symbols) for k in range(days)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, volume double")


def test_market_features_are_dealt_by_rows(spark, monkeypatch):
    px = _series(spark)
    bench = px.where("symbol = 's0'").select("date", "close")
    ev = spark.createDataFrame([(f"s{i}_a", f"s{i}", dt.datetime(2020, 1, 20, 12)) for i in range(6)], "event_key string, symbol string, result_announcement_datetime timestamp_ntz")
    whole = prices.event_market_features(ev, px, bench, trading_calendar(px), price="price")
    monkeypatch.setattr(prices, "ROWS_PER_TASK", 8)
    dealt = prices.event_market_features(ev, px, bench, trading_calendar(px), price="price")
    assert "hashpartitioning(symbol" in _plan(dealt) and f", {-(-(180 + 12) // 8)}), REPARTITION_BY_NUM" in _plan(dealt)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    close = {(r.symbol, r.date): r.close for r in px.collect()}
    assert {r.event_key: r.price for r in dealt.collect()} == {f"s{i}_a": close[f"s{i}", dt.date(2020, 1, 19)] for i in range(6)}


def test_history_is_dealt_by_company(spark):
    rows = [(f"c{i}", dt.date(2020, 1, 1), f"c{i}_a", 0.1, 0.1, 0.1, "POSITIVE") for i in range(5)]
    ev = spark.createDataFrame(rows, "symbol string, period_ended date, event_key string, abnormal_return_1d double, abnormal_return_3d double, abnormal_return_5d double, reaction_class string")
    assert ", 23), REPARTITION_BY_NUM" in _plan(with_prior_history(ev, tasks=23))


def test_values_are_counted_in_bounded_tasks(spark, monkeypatch):
    staged = []
    real = profiles.stage
    monkeypatch.setattr(profiles, "stage", lambda df: staged.append(_plan(df)) or real(df))
    monkeypatch.setattr(profiles, "VALUES_PER_TASK", 10)
    df = spark.range(100).selectExpr("'train' AS split", "id * 0.5D AS x", "id % 3 AS y")
    counted = profiles.count_values(df, ["x", "y"])
    assert "RoundRobinPartitioning(20)" in staged[0]
    assert {(r.feature, r.n) for r in counted.groupBy("feature").sum("n").toDF("feature", "n").collect()} == {("x", 100), ("y", 100)}


def test_ks_distances_of_many_features_are_not_broadcast(spark):
    rows = [(f"c{i % 7}", float(i * 37 % 101), "a" if i % 2 else "b") for i in range(140)]
    df = spark.createDataFrame(rows, "feature string, value double, split string")
    dealt = ks_distance(df, "feature", "value", "split", "a", "b", tasks=19)
    assert ", 19), REPARTITION_BY_NUM" in _plan(dealt)
    plain = ks_distance(df, "feature", "value", "split", "a", "b")
    assert sorted(dealt.collect()) == sorted(plain.collect())


def _dated_events(spark, n=5):
    rows = [(f"c{i}", dt.date(2020, 1, 1), f"c{i}_a", dt.date(2020, 1, 6)) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, period_ended date, event_key string, reaction_start_date date")


def test_labels_are_joined_to_events_without_broadcast(spark):
    labels = spark.createDataFrame([("c1_a", 0.5), ("c3_a", 0.7)], "event_key string, abnormal_return_1d double")
    joined = join_dealt(_dated_events(spark), labels, "event_key", 19)
    assert "BroadcastHashJoin" not in _plan(joined) and _plan(joined).count("19), REPARTITION_BY_NUM") == 2
    assert {r.event_key: r.abnormal_return_1d for r in joined.collect()} == {"c0_a": None, "c1_a": 0.5, "c2_a": None, "c3_a": 0.7, "c4_a": None}


def test_price_leads_of_label_dates_are_dealt_by_rows(spark):
    px = _series(spark).selectExpr("replace(symbol, 's', 'c') AS symbol", "date", "close", "volume")
    bench = px.where("symbol = 'c0'").select("date", "close")
    whole = label_known_dates(_dated_events(spark), px, bench, trading_calendar(px))
    dealt = label_known_dates(_dated_events(spark), px, bench, trading_calendar(px), tasks=21)
    assert _plan(dealt).count("21), REPARTITION_BY_NUM") == 2
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
    assert {r.label_known_3d for r in dealt.collect()} == {dt.date(2020, 1, 9)}


def test_robust_scale_sketches_few_features_at_a_time(spark, monkeypatch):
    groups = []
    real = preprocess.exact_quantiles
    monkeypatch.setattr(preprocess, "exact_quantiles", lambda df, by, *rest: groups.append(df.select(*by).distinct().count()) or real(df, by, *rest))
    names = [f"x{i}" for i in range(135)]
    df = spark.range(20).selectExpr(*[f"id * {i + 1}.0D AS {c}" for i, c in enumerate(names)])
    fitted = preprocess.LinearPreprocessor("robust").fit(df, names)
    assert max(groups) <= 128 and len(fitted.centre) == 135
    assert [(fitted.medians[c], fitted.centre[c], fitted.scale[c]) for c in ("x0", "x134")] == [(9.5, 9.5, 9.5), (9.5 * 135, 9.5 * 135, 9.5 * 135)]


def test_running_counts_are_dealt_by_rows(spark, monkeypatch):
    rows = spark.range(100).selectExpr("'x' AS feature", "id div 10 AS bin", "cast(id AS double) AS value", "1L AS n")
    monkeypatch.setattr(profiles, "RANKED_PER_TASK", 5)
    ranked = profiles.running_counts(rows, ["n"])
    assert ", 20), REPARTITION_BY_NUM" in _plan(ranked)
    assert sorted((r.value, r.upto_n, r.total_n) for r in ranked.collect()) == [(float(i), i + 1, 100) for i in range(100)]


def test_prices_and_events_are_added_up_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(standins, "LINES_PER_TASK", 250)
    monkeypatch.setattr(standins, "ORDERS_PER_TASK", 100)
    sf = "/root/testdata/sf0.001"
    lines, orders = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders"))
    assert f", {-(-lines // 250)}), REPARTITION_BY_NUM" in _plan(standins.prices(spark, sf)) and "partial_count" in _plan(standins.prices(spark, sf))
    assert _plan(standins.prices(spark, sf)).count("Exchange ") == 1
    assert f", {-(-orders // 100)}), REPARTITION_BY_NUM" in _plan(standins.announcements(spark, sf, dealt=True))
    assert "REPARTITION" not in _plan(standins.announcements(spark, sf))


def test_market_features_are_worked_out_at_events_alone(spark):
    """Only events' rows of a series are needed: no window may run over all prices, and the features are those of the windows."""
    start = dt.date(2020, 1, 1)
    # a year with gaps in days and volumes, a series of constant closes and volumes, a short one, and one without volumes
    rows = [("a", start + dt.timedelta(k), 100.0 + (k * 37 % 23) / 7, None if k % 5 == 0 else 10.0 + k % 9) for k in range(400) if k % 11]
    rows += [("b", start + dt.timedelta(k), 0.1, 0.1) for k in range(300)] + [("c", start + dt.timedelta(k), 5.0 + k, 3.0 + k) for k in range(6)]
    rows += [("d", start + dt.timedelta(k), float(k % 3), None) for k in range(70)]
    px = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    bench = px.where("symbol = 'a'").select("date", "close")
    events = [(f"{s}_{k}", s, dt.datetime(2020, 1, 1, 12) + dt.timedelta(k)) for s in "abcde" for k in range(0, 401, 3)]
    ev = spark.createDataFrame(events, "event_key string, symbol string, result_announcement_datetime timestamp_ntz")
    found = prices.event_market_features(ev, px, bench, trading_calendar(px), keep_skipped=True, price="price")
    assert "stddev_samp" not in _plan(found)
    series = prices.with_forward_returns(prices.price_features(px)).selectExpr("*", "date AS day")
    columns = ["history_days", "close", *prices.PRICE_FEATURES]
    back = asof_join(found.select("event_key", "symbol", "feature_cutoff_date"), series, ["symbol"], "feature_cutoff_date", "day", columns)
    expected = {r.event_key: r for r in back.collect()}
    got = found.collect()
    assert len(got) == len(events) and any(r.volatility_60d for r in got) and any(r.drawdown_from_252d_high for r in got)
    for r in got:
        e = expected[r.event_key]
        assert r.price_history_days == (e.history_days or 0) and r.price == e.close
        for c in prices.PRICE_FEATURES:
            assert (r[c] is None) == (e[c] is None), (r.event_key, c, r[c], e[c])
            assert r[c] is None or abs(r[c] - e[c]) < 1e-11, (r.event_key, c, r[c], e[c])
    ahead = asof_join(found.select("event_key", "symbol", "reaction_start_date"), series, ["symbol"], "reaction_start_date", "day", ["forward_1d", "forward_5d"], "forward")
    later = {r.event_key: r for r in ahead.collect()}
    for r in got:
        if r.return_5d_after is not None:
            assert r.return_5d_after == later[r.event_key].forward_5d and r.return_1d_after == later[r.event_key].forward_1d


def test_values_are_ranked_in_bins_that_can_matter(spark, monkeypatch):
    opened = []
    real = profiles.opened_counts
    monkeypatch.setattr(profiles, "opened_counts", lambda *given: opened.append(real(*given)) or opened[-1])
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'val' ELSE 'train' END AS split", "sin(id) + (id % 3) / 3.0D AS x")
    counted = profiles.count_values(df, ["x"], splits=("train", "val"), digits=10)
    r = profiles.value_profile(counted, (0.25, 0.5), ("train", "val")).first()
    assert opened[0].count() < 12_000 < counted.count()
    values = sorted(v.x for v in df.select(profiles._near(df.x, 10).alias("x")).collect())
    low, high = values[9_999], values[10_000]
    assert r.q0_5 == low + 0.5 * (high - low)
    ranked = profiles.running_counts(counted, ["n_train", "n_val"]).selectExpr("max(abs(upto_n_train / total_n_train - upto_n_val / total_n_val)) AS ks")
    assert r.ks_val == ranked.first().ks


def test_values_are_rounded_half_away_from_zero(spark):
    given = [0.25, -0.25, 0.35, -0.04, 1e5 + 0.25, float("inf"), None, 0.0, -0.0]
    df = spark.createDataFrame([("train", v) for v in given], "split string, x double")
    counted = profiles.count_values(df, ["x"], digits=1)
    assert {(str(r.value), r.n, r.n_train) for r in counted.collect()} == {
        ("0.3", 1, 1), ("-0.3", 1, 1), ("0.4", 1, 1), ("0.0", 3, 3), ("100000.25", 1, 1), ("inf", 1, 1), ("None", 1, 1)
    }


def test_deviations_are_ranked_in_the_bin_of_their_median(spark, monkeypatch):
    opened = []
    real = profiles.opened_counts
    monkeypatch.setattr(profiles, "opened_counts", lambda *given: opened.append(real(*given)) or opened[-1])
    df = spark.range(30_001).selectExpr("'train' AS split", "sin(id) AS x", "cast(id % 7 AS double) AS y")
    counted = profiles.count_values(df, ["x", "y"])
    medians = spark.createDataFrame([("x", 0.125), ("y", 3.0)], "feature string, median double")
    found = {r.feature: r for r in profiles.deviation_profile(counted, medians).collect()}
    away = sorted(abs(v.x - 0.125) for v in df.select("x").collect())
    assert (found["x"].mad, found["x"].top) == (away[15_000], away[-1])
    assert (found["y"].mad, found["y"].top) == (2.0, 3.0)
    bins = profiles.FINENESS * 5
    assert opened[0].count() < bins + 200 < counted.count()

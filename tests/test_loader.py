"""Roles in the schema, X and y of both tracks, and splits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitline.plans.loader import columns_with_role, load_training_data, prepare_xy, with_roles
from pitline.session import stage

SCHEMA = (
    "event_key string, period_ended date, result_announcement_datetime timestamp_ntz, feature_cutoff_date date, reaction_start_date date,"
    " return_5d double, volatility_20d double, prior_earnings_count int, fund_roe double, val_pe double, reaction_class string,"
    " abnormal_return_3d double, fundamental_lag_days int"
)


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for k in range(12):
        day = dt.date(2020, 1, 31) + dt.timedelta(days=60 * k)
        at = dt.datetime.combine(day, dt.time(9)) + dt.timedelta(days=20)
        rows.append((f"e{k}", day, at, at.date() - dt.timedelta(days=1), at.date(), 0.1 * k, 0.2, k, None, 5.0, "NEUTRAL", 0.01, 3))
    return spark.createDataFrame(rows, SCHEMA)


def test_roles_survive_files_and_projections(table):
    read = stage(with_roles(table))
    back = read.sparkSession.read.parquet(read.inputFiles()[0].rsplit("/", 1)[0])
    for df in (with_roles(table), back, back.where("prior_earnings_count > 3").select("*")):
        assert set(columns_with_role(df.schema, "feature")) == {"return_5d", "volatility_20d", "prior_earnings_count", "fund_roe", "val_pe"}
        assert columns_with_role(df.schema, "target") == ["reaction_class", "abnormal_return_3d"]
        assert columns_with_role(df.schema, "feature", ["valuation"]) == ["val_pe"]
    assert back.schema["fund_roe"].metadata["point_in_time_rule"].startswith("Latest report")
    assert with_roles(table).collect() == table.collect()
    with pytest.raises(ValueError, match="no feature in groups"):
        columns_with_role(back.schema, "feature", ["weather"])


def test_tracks_and_splits(table):
    targets = ["reaction_class", "abnormal_return_3d"]
    strict = load_training_data(table, "2020-10-31", "2021-04-30", "strict", targets)
    full = load_training_data(table, "2020-10-31", "2021-04-30", "all", targets)
    assert strict.features == ["return_5d", "volatility_20d", "prior_earnings_count"]
    assert set(full.features) - set(strict.features) == {"fund_roe", "val_pe"}
    assert full.groups["prior_earnings"] == ["prior_earnings_count"] and set(strict.groups) == {"market_returns", "market_volatility", "prior_earnings"}
    sizes = {}
    for s in ("train", "val", "test"):
        x, y = strict.xy(s)
        assert x.columns == strict.features and y.columns == targets and x.count() == y.count() == strict.keys(s).count()
        sizes[s] = x.count()
    assert sizes == {"train": 5, "val": 3, "test": 4}
    assert strict.joined().columns == ["event_key", "split", *strict.features, *targets]
    with pytest.raises(ValueError, match="unknown split"):
        strict.rows("dev")


def test_embargoed_rows_are_in_no_split(table):
    near = table.withColumn("feature_cutoff_date", F.when(F.col("event_key") == "e5", F.lit("2020-10-20").cast("date")).otherwise(F.col("feature_cutoff_date")))
    data = load_training_data(near, "2020-10-31", "2021-04-30", "strict", ["reaction_class"], embargo_days=5)
    assert {r.event_key for r in data.keys("val").collect()} == {"e6", "e7"}
    assert data.joined().count() == 11


def test_missing_and_forbidden_columns(table, spark):
    typed = with_roles(table)
    with pytest.raises(ValueError, match="missing feature columns: \\['return_1d'\\]"):
        prepare_xy(typed, ["return_1d"], ["reaction_class"])
    with pytest.raises(ValueError, match="missing target columns"):
        prepare_xy(typed, ["return_5d"], ["return_5d_after"])
    for bad in ("abnormal_return_3d", "reaction_start_date", "event_key", "fundamental_lag_days"):
        with pytest.raises(ValueError, match=f"forbidden columns in X: \\['{bad}'\\]"):
            prepare_xy(typed, ["return_5d", bad], ["reaction_class"])
    with pytest.raises(ValueError, match="unknown track"):
        load_training_data(table, "2020-10-31", "2021-04-30", "some", ["reaction_class"])
    with pytest.raises(ValueError, match="no features"):
        load_training_data(table.select("event_key", "period_ended", "reaction_class"), "2020-10-31", "2021-04-30", "strict", ["reaction_class"], check=False)


def test_splits_are_checked(table):
    with pytest.raises(ValueError, match="splits without a period_ended: \\['test'\\]"):
        load_training_data(table, "2020-10-31", "2030-01-01", "all", ["reaction_class"])
    with pytest.raises(ValueError, match="duplicate event keys"):
        load_training_data(table.withColumn("event_key", F.lit("e")), "2020-10-31", "2021-04-30", "all", ["reaction_class"])


def test_manifest_drives_the_columns(table, spark):
    schema = "feature_name string, feature_group string, point_in_time_rule string, is_target boolean"
    manifest = spark.createDataFrame([("return_5d", "market_returns", "r", False), ("val_pe", "valuation", "v", False), ("abnormal_return_3d", "target", "t", True)], schema)
    typed = with_roles(table, manifest)
    assert columns_with_role(typed.schema, "feature") == ["return_5d", "val_pe"] and columns_with_role(typed.schema, "target") == ["abnormal_return_3d"]
    data = load_training_data(table, "2020-10-31", "2021-04-30", "all", ["abnormal_return_3d"], manifest=manifest)
    assert data.features == ["return_5d", "val_pe"] and data.groups == {"market_returns": ["return_5d"], "valuation": ["val_pe"]}
    with pytest.raises(ValueError, match="manifest are missing: \\['return_7d'\\]"):
        with_roles(table, spark.createDataFrame([("return_7d", "market_returns", "r", False)], schema))
    with pytest.raises(ValueError, match="forbidden column named as a feature"):
        with_roles(table, spark.createDataFrame([("abnormal_return_3d", "market_returns", "r", False)], schema))

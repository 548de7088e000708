"""Shared inputs of the catalogue queries, built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitline import standins
from pitline.operators import events as event_ops
from pitline.operators import prices as px_ops
from pitline.operators import profiles
from pitline.operators.calendar import trading_calendar
from pitline.operators.quality import stage_observed
from pitline.operators.splits import temporal_split
from pitline.plans.dataset import model_table
from pitline.plans.roles import classify_columns
from pitline.session import stage, tasks_for


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _staged(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A table several queries read: written once per session to the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build())
    return _STAGED[key]


def tasks(rows_per_task: int, *tables: DataFrame) -> int:
    """Tasks for a join or window over staged tables, whose rows are counted from file footers."""
    return tasks_for(tables[0].sparkSession, sum(t.count() for t in tables), rows_per_task)


def prices(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d, "prices", lambda: standins.prices(spark, d))


def bench(spark: SparkSession, d: str) -> DataFrame:
    return standins.benchmark_prices(spark, d)


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return trading_calendar(prices(spark, d))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return event_ops.mark_canonical(standins.announcements(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Symbol × period events with the announcement time of their canonical result."""
    return _staged(spark, d, "events", lambda: event_ops.event_headers(standins.announcements(spark, d, dealt=True)))


def market(spark: SparkSession, d: str) -> DataFrame:
    return px_ops.event_market_features(events(spark, d), prices(spark, d), bench(spark, d), calendar(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Staged market features and labels."""
    return _staged(spark, d, "market", lambda: market(spark, d))


def build_model(spark: SparkSession, d: str) -> DataFrame:
    """The model-ready table over all events with a period before mid-2001."""
    return model_table(
        events(spark, d),
        prices(spark, d),
        bench(spark, d),
        calendar(spark, d),
        standins.fundamentals(spark, d),
        period_cutoff="2001-06-30",
    )


def model(spark: SparkSession, d: str) -> DataFrame:
    """Staged model table, the input of splits, preprocessing and audits."""
    return _observed_model(spark, d)[0]


def model_facts(spark: SparkSession, d: str) -> dict:
    """What was observed while the model table was staged."""
    return _observed_model(spark, d)[1]


_MODELS: dict[tuple[str, str], tuple[DataFrame, dict]] = {}


def _observed_model(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = stage_observed(build_model(spark, d))
    return _MODELS[key]


def split_model(spark: SparkSession, d: str) -> DataFrame:
    return temporal_split(model(spark, d), standins.TRAIN_END, standins.VAL_END)


_COUNTED: dict[tuple[str, str], DataFrame] = {}


def features(spark: SparkSession, d: str) -> list[str]:
    return classify_columns(model(spark, d).columns)["features"]


def counted(spark: SparkSession, d: str) -> DataFrame:
    """The model table's feature values to ten digits, each counted once per session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _COUNTED:
        _COUNTED[key] = profiles.count_values(split_model(spark, d), features(spark, d), digits=10)
    return _COUNTED[key]


def profile(spark: SparkSession, d: str) -> DataFrame:
    return _staged(spark, d, "profile", lambda: profiles.value_profile(counted(spark, d)))

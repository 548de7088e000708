"""The two chains of the library: filings to events, which writes the typed filings once on the way, and events to the model
table, one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.operators import events as event_ops
from pitline.operators.fundamentals import attach_point_in_time, with_metrics, with_valuation
from pitline.operators.history import HORIZONS, with_prior_history
from pitline.operators.prices import event_market_features
from pitline.plans.roles import ordered_columns
from pitline.session import stage, tasks_for

#: Events, a hundred columns wide, that one task sorts.
EVENTS_PER_TASK = 20_000


def filings_to_documents(filings: DataFrame, source: str = "exchange_announcements") -> DataFrame:
    """Parsed raw filings to the documents table: classify, re-date, remove copies, mark the canonical result."""
    # re-dating reads the typed filings three times; the text work must not be repeated
    typed = event_ops.reassign_periods(stage(event_ops.classify_filings(filings)))
    once = event_ops.drop_duplicate_documents(typed, ["period_ended", "announcement_text", "announcement_details"])
    return event_ops.documents_table(once, source)


def filings_to_events(filings: DataFrame) -> DataFrame:
    return event_ops.roll_up(filings_to_documents(filings))


def model_table(
    events: DataFrame,
    prices: DataFrame,
    bench: DataFrame,
    calendar: DataFrame,
    statements: DataFrame,
    period_cutoff: str | None = None,
) -> DataFrame:
    """Events with market, fundamental, valuation and own-history features and labels, in role order.

    History is computed over all events, including those without prices; periods at or after ``period_cutoff`` are
    left out at the end. Unusable events stay in the table, without labels, until history is done, so the market
    features are computed once.
    """
    announced = "result_announcement_datetime"
    tasks = tasks_for(events.sparkSession, events.count(), EVENTS_PER_TASK)
    market = event_market_features(events, prices, bench, calendar, keep_skipped=True, price="price")
    silent = events.where(F.col(announced).isNull()).withColumn("skip_reason", F.lit("no_announcement"))
    everyone = market.unionByName(silent, allowMissingColumns=True)
    usable = F.col("skip_reason").isNull()
    labels = [*[f"abnormal_return_{h}d" for h in HORIZONS], "reaction_class"]
    labelled = everyone.withColumns({c: F.when(usable, F.col(c)) for c in labels})
    with_history = with_prior_history(labelled, tasks=tasks).where(usable).drop("skip_reason")
    funded = attach_point_in_time(with_history, with_metrics(statements), tasks=tasks)
    full = with_valuation(funded).drop("price")
    if period_cutoff is not None:
        full = full.where(F.col("period_ended") < F.lit(period_cutoff).cast("date"))
    return full.select(*ordered_columns(full.columns))

"""From filings to canonical events: identifiers, period re-dating, canonical choice, roll-up and quality flags.

Group work is done with mergeable aggregates (min_by, count_if, count distinct), which combine map-side, so one
event or company holding a large share of all filings is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.functions.dates import clock_time, fiscal_quarter, quarter_end, whole_days
from pitline.functions.flags import flag_string, truthy_text
from pitline.functions.patterns import CATEGORY_DESCRIPTIONS, FOLLOWUP_TYPES, HUMAN_PRIMARY_TYPES, PRIMARY_TYPES
from pitline.functions.period import with_period
from pitline.functions.text import (
    classify_documents,
    is_candidate,
    legacy_document_type,
    legacy_earnings_type,
    reporting_scope,
    search_text,
    trimmed,
)
from pitline.operators.asof import nearest_within


def document_id(symbol: Column, announced: Column, url: Column) -> Column:
    """First 16 hex digits of sha256('symbol|ISO time|url')."""
    iso = F.coalesce(F.date_format(announced, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("NaT"))
    key = F.concat_ws("|", symbol, iso, F.coalesce(url, F.lit("")))
    return F.substring(F.sha2(key, 256), 1, 16)


def event_key(symbol: Column, period: Column) -> Column:
    return F.concat_ws("_", symbol, F.coalesce(F.date_format(period, "yyyy-MM-dd"), F.lit("UNKNOWN")))


def classify_filings(filings: DataFrame) -> DataFrame:
    """Typed candidate filings from raw ones (symbol, desc, attchmntText, attchmntFile, an_dt, exchdisstime, hasXbrl).

    The datetime columns must already be parsed; see :mod:`pitline.sources.announcements`.
    """
    texts = filings.withColumns(
        {
            "announcement_text": trimmed(F.col("desc")),
            "announcement_details": trimmed(F.col("attchmntText")),
            "search_text": search_text(F.col("desc"), F.col("attchmntText")),
            "filing_url": trimmed(F.col("attchmntFile")),
            "has_xbrl": truthy_text(F.col("hasXbrl")),
        }
    ).where(is_candidate(F.col("search_text")))
    dated = with_period(texts, "search_text", "period_extracted").withColumns(
        {
            "earnings_type": legacy_earnings_type(F.col("search_text")),
            "document_type_legacy": legacy_document_type(F.col("search_text")),
            "reporting_scope": reporting_scope(F.col("search_text")),
        }
    )
    dated = dated.withColumns(
        {
            "period_ended": F.coalesce(
                "period_extracted", quarter_end(F.col("announcement_datetime").cast("date"))
            ),
            "period_from_fallback": F.col("period_extracted").isNull(),
            "document_id": document_id(F.col("symbol"), F.col("announcement_datetime"), F.col("filing_url")),
        }
    )
    return classify_documents(
        dated, "announcement_text", "announcement_details", "filing_url", "document_type_legacy"
    )


def reassign_periods(docs: DataFrame, tolerance_days: int = 14, suspicious_days: int = 90) -> DataFrame:
    """Give undated (or implausibly dated) filings the period of the nearest explicitly dated primary result.

    Applies to follow-ups whose period is a fallback or ends more than ``suspicious_days`` after the filing, and to
    primary results with a fallback period. Only anchors of the same symbol within ``tolerance_days`` count; the
    earlier anchor wins a tie, then the smaller document id. Adds the result as ``period_ended`` /
    ``period_from_fallback`` and refreshes the fiscal label and event key. ``docs`` is read three times: stage it
    first when it is costly.
    """
    primary = F.col("document_type").isin(*PRIMARY_TYPES)
    fallback = F.col("period_from_fallback")
    ahead = whole_days(F.col("period_ended").cast("timestamp_ntz"), F.col("announcement_datetime"))
    stray_followup = F.col("document_type").isin(*FOLLOWUP_TYPES) & (fallback | (ahead > suspicious_days))
    needs = F.coalesce(stray_followup | (primary & fallback), F.lit(False))
    keys = ["symbol", "announcement_datetime"]
    anchors = (
        docs.where(primary & ~fallback)
        .groupBy(*keys)
        .agg(F.min_by("period_ended", "document_id").alias("anchor_period"))
    )
    found = nearest_within(docs.where(needs), anchors, ["symbol"], "announcement_datetime", "anchor_period", tolerance_days)
    joined = docs.withColumn("__needs", needs).join(found.select(*keys, "anchor_period"), keys, "left")
    adopt = F.col("__needs") & F.col("anchor_period").isNotNull()
    return (
        joined.withColumn("period_ended", F.when(adopt, F.col("anchor_period")).otherwise(F.col("period_ended")))
        .withColumn("period_from_fallback", fallback & ~adopt)
        .withColumn("period_reassigned", adopt)
        .withColumn("fiscal_quarter", fiscal_quarter(F.col("period_ended")))
        .withColumn("event_key", event_key(F.col("symbol"), F.col("period_ended")))
        .drop("__needs", "anchor_period")
    )


def drop_duplicate_documents(docs: DataFrame, order_by: list[str]) -> DataFrame:
    """One row per document_id: the first by ``order_by``. Copies collapse before the shuffle."""
    rest = [c for c in docs.columns if c != "document_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("doc")
    return docs.groupBy("document_id").agg(first).select("document_id", "doc.*")


def canonical_score() -> Column:
    """Preference score of a result filing; whole numbers, higher is better."""
    text = F.lower(F.coalesce(F.col("announcement_text"), F.lit("")))
    quarter, year = text.contains("quarter ended"), text.contains("year ended")
    specific, generic = quarter | year, F.trim(text) == "financial result updates"
    kind = F.when(F.col("document_type") == "financial_result_update", 100).when(
        F.col("document_type") == "financial_results", 50
    ).otherwise(0)

    def grade(with_period: int, update: int, other) -> Column:
        return F.when(specific, with_period).when(generic, update).otherwise(other)

    scope = (
        F.when(F.col("reporting_scope") == "consolidated", grade(1000, 500, 300))
        .when(F.col("reporting_scope") == "standalone", grade(900, 400, 200))
        .when(F.col("reporting_scope") == "both", grade(800, 300, 100))
        .otherwise(grade(200, 100, F.when(text.contains("outcome of board meeting"), 50).otherwise(10)))
    )
    annual = F.when(F.month("period_ended") == 3, F.when(year, 200).when(quarter, 100).otherwise(0)).otherwise(0)
    period_start = F.col("period_ended").cast("timestamp_ntz")
    early = F.when(
        F.col("announcement_datetime") < period_start,
        10000 + 10 * whole_days(period_start, F.col("announcement_datetime")),
    ).otherwise(0)
    return kind + scope + annual - early


def _canonical_rank() -> Column:
    """Sort key of human-readable results (smaller is better); NULL for every other filing."""
    human = F.col("document_type").isin(*HUMAN_PRIMARY_TYPES)
    order = F.struct((-canonical_score()).alias("s"), F.col("announcement_datetime"), F.col("document_id"))
    return F.when(human, order)


def canonical_documents(docs: DataFrame) -> DataFrame:
    """(event_key, document_id, announcement_datetime, score) of each event's canonical result."""
    best = F.min(_canonical_rank()).alias("best")
    picked = docs.groupBy("event_key").agg(best).where(F.col("best").isNotNull())
    return picked.select(
        "event_key", "best.document_id", "best.announcement_datetime", (-F.col("best.s")).alias("score")
    )


def mark_canonical(docs: DataFrame) -> DataFrame:
    """Add is_canonical_primary. The join back runs on the unique document id, so no event is hot."""
    chosen = canonical_documents(docs).select("document_id", F.lit(True).alias("is_canonical_primary"))
    joined = docs.join(chosen, "document_id", "left")
    return joined.withColumn("is_canonical_primary", F.coalesce("is_canonical_primary", F.lit(False)))


def event_headers(docs: DataFrame) -> DataFrame:
    """Identity and canonical result time of every event, straight from filings in one aggregation."""
    order = F.struct("announcement_datetime", "document_id")
    attributes = ["symbol", "company_name", "period_ended", "fiscal_quarter"]
    grouped = docs.groupBy("event_key").agg(
        *[F.min_by(a, F.when(F.col(a).isNotNull(), order)).alias(a) for a in attributes],
        F.min(_canonical_rank()).alias("best"),
    )
    return grouped.select(
        "event_key", *attributes, F.col("best.announcement_datetime").alias("result_announcement_datetime")
    )


def document_type_counts(docs: DataFrame) -> DataFrame:
    """(event_key, doc_types): map from document type to count, keys sorted."""
    counts = docs.groupBy("event_key", "document_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("document_type", "n")))  # at most one entry per type
    return counts.groupBy("event_key").agg(F.map_from_entries(pairs).alias("doc_types"))


def type_string(doc_types: Column) -> Column:
    """'type:count|type:count', sorted by type."""
    entries = F.array_sort(F.map_entries(doc_types))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|")


def _type_list() -> Column:
    """'type:count|type:count', sorted by type, from the counts of :func:`roll_up`; a type it doesn't know is an error."""
    types = sorted(CATEGORY_DESCRIPTIONS)
    known = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(f"__{t}") > 0, F.concat(F.lit(f"{t}:"), F.col(f"__{t}").cast("string"))) for t in types])), "|"
    )
    counted = sum((F.col(f"__{t}") for t in types), F.lit(0))
    return F.when(counted == F.col("document_count"), known).otherwise(F.raise_error(F.lit("a filing has an unknown document type")).cast("string"))


def roll_up(docs: DataFrame) -> DataFrame:
    """The events table: one row per event_key with dates, counts, has_* flags, quality flags and type string.

    Without an ``is_canonical_primary`` column the first human-readable result counts as canonical.
    """
    ts, kind, period = F.col("announcement_datetime"), F.col("document_type"), F.col("period_ended")
    human, primary = kind.isin(*HUMAN_PRIMARY_TYPES), F.col("is_primary_result")
    canonical = F.col("is_canonical_primary") if "is_canonical_primary" in docs.columns else human
    early = ts < period.cast("timestamp_ntz")
    order = F.struct("announcement_datetime", "document_id")
    attributes = ["symbol", "company_name", "period_ended", "fiscal_quarter"]
    grouped = docs.groupBy("event_key").agg(
        *[F.min_by(a, F.when(F.col(a).isNotNull(), order)).alias(a) for a in attributes],
        F.min(ts).alias("announcement_datetime"),
        F.max(ts).alias("last_document_datetime"),
        F.min(F.when(canonical, ts)).alias("result_announcement_datetime"),
        F.min(F.when(primary, ts)).alias("all_primary_first_datetime"),
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(primary).alias("primary_result_count"),
        F.count_if(human).alias("human_primary_result_count"),
        F.count_if(canonical).alias("canonical_primary_count"),
        F.bool_or(kind.isin(*PRIMARY_TYPES)).alias("has_financial_results"),
        F.bool_or(kind == "media_release").alias("has_media_release"),
        F.bool_or(kind == "investor_presentation").alias("has_investor_presentation"),
        F.bool_or(kind.isin("earnings_call_recording", "earnings_call_schedule")).alias("has_earnings_call"),
        F.bool_or(kind == "earnings_call_transcript").alias("has_transcript"),
        F.count_if(kind == "unclassified").alias("unclassified"),
        F.count_if(early).alias("all_suspicious_dates"),
        F.count_if(early & primary).alias("primary_suspicious_dates"),
        F.count_if(early & human).alias("human_primary_suspicious_dates"),
        (F.count(F.lit(1)) - F.count_distinct(F.coalesce("filing_url", F.lit("\u0000")))).alias("dup_urls"),
        *[F.count_if(kind == t).alias(f"__{t}") for t in CATEGORY_DESCRIPTIONS],
    )
    result = F.col("result_announcement_datetime")
    joined = grouped.withColumn("days_from_period_end", F.datediff(result.cast("date"), F.col("period_ended")))
    return joined.select(
        "event_key",
        *attributes,
        "announcement_datetime",
        F.col("announcement_datetime").cast("date").alias("announcement_date"),
        clock_time(F.col("announcement_datetime")).alias("announcement_time"),
        "result_announcement_datetime",
        result.cast("date").alias("result_announcement_date"),
        clock_time(result).alias("result_announcement_time"),
        F.when(F.col("human_primary_result_count") > 0, "confirmed").otherwise("no_primary_result").alias("event_status"),
        "document_count",
        "has_financial_results",
        "has_media_release",
        "has_investor_presentation",
        "has_earnings_call",
        "has_transcript",
        F.col("announcement_datetime").alias("first_document_datetime"),
        "last_document_datetime",
        "days_from_period_end",
        "primary_result_count",
        "human_primary_result_count",
        "canonical_primary_count",
        "all_primary_first_datetime",
        event_quality_flags().alias("quality_flag"),
        _type_list().alias("document_types"),
    )


def event_quality_flags() -> Column:
    return flag_string(
        {
            "MISSING_PERIOD_END": "period_ended IS NULL",
            "MISSING_RESULT": "human_primary_result_count = 0",
            "MULTIPLE_HUMAN_PRIMARY_RESULTS": "human_primary_result_count > 1",
            "ANNOUNCEMENT_BEFORE_PERIOD_END": "days_from_period_end < 0",
            "VERY_LATE_FILING": "days_from_period_end > 90",
            "DUPLICATE_DOCUMENT": "dup_urls > 0",
            "UNCLASSIFIED_DOCUMENT": "unclassified > 0",
            "HUMAN_PRIMARY_RESULT_BEFORE_PERIOD_END": "human_primary_suspicious_dates > 0",
            "MANY_PRE_ANNOUNCEMENTS": "all_suspicious_dates > 5",
        }
    )


QUALITY_REPORT_COLUMNS = [
    "event_key",
    "symbol",
    "period_ended",
    "document_count",
    "first_document_datetime",
    "result_announcement_datetime",
    "last_document_datetime",
    "days_from_period_end",
    "human_primary_result_count",
    "quality_flag",
]


def quality_report(events: DataFrame) -> DataFrame:
    return events.select(*QUALITY_REPORT_COLUMNS)


def quality_flag_counts(events: DataFrame) -> DataFrame:
    flags = events.select(F.explode(F.split("quality_flag", "\\|")).alias("flag"))
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("events"))


def documents_table(docs: DataFrame, source: str) -> DataFrame:
    """The documents table: canonical mark, date and time parts, follow-up mark and source label."""
    marked = mark_canonical(docs)
    ts = F.col("announcement_datetime")
    return marked.withColumns(
        {
            "announcement_date": ts.cast("date"),
            "announcement_time": clock_time(ts),
            "is_followup_document": ~F.col("is_primary_result"),
            "source": F.lit(source),
        }
    )

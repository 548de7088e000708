"""Queries over filings: classification, periods, scope, canonical choice, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline import standins
from pitline.catalog.ctes import FISCAL, QUARTER_END, define, with_ctes
from pitline.catalog.registry import big, query
from pitline.catalog.tables import documents
from pitline.functions import dates, patterns as P
from pitline.functions.flags import truthy_text
from pitline.functions import text as text_fn
from pitline.functions.period import repair_glued_words, with_period
from pitline.operators import events as event_ops
from pitline.session import read_table, stage
from pitline.sources.announcements import prepare_announcements
from pitline.sources.exchange import with_company_names


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _re(column: str, patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '{joined}')"


def _results(t: str) -> str:
    """The phrase with its exclusion, without lookahead: excluded phrases are blanked first."""
    blanked = f"regexp_replace({t}, '{P.RESULTS_PHRASE}{P.RESULTS_PHRASE_NOT_BEFORE}', ' # ', 'g')"
    return f"(NOT {_re(t, P.RESULTS_EXCLUDED)} AND ({_re(blanked, [P.RESULTS_PHRASE])} OR {_re(t, P.RESULTS_OTHER)}))"


def _update(t: str) -> str:
    return f"(NOT ({_re(t, [P.BOARD_OUTCOME_PHRASE])} AND NOT {_re(t, [P.MENTIONS_RESULT])}) AND {_re(t, P.RESULT_UPDATE)})"


_spell = "replace({t}, '{{{m}}}', {v})"


def _templated(position: int) -> str:
    sql = f"{_list(t[position] for t in standins.FILING_TEMPLATES)}[k % 24 + 1]"
    for mark, value in {
        "dash": "strftime(p, '%d-%b-%Y')",
        "long": "strftime(p, '%B %-d, %Y')",
        "ordinal": "CAST(day(p) AS VARCHAR) || CASE WHEN day(p) = 31 THEN 'st ' ELSE 'th ' END || strftime(p, '%B %Y')",
        "abbr": "strftime(p, '%b %-d, %Y')",
        "dots": "strftime(p, '%d.%m.%Y')",
        "month": "strftime(p, '%B %Y')",
        "token": "'Q' || CAST(quarter(p) AS VARCHAR) || ' FY' || strftime(p, '%y')",
    }.items():
        sql = f"replace({sql}, '{{{mark}}}', {value})"
    return sql


define(
    "raw",
    f"""
SELECT symbol, k, {_templated(0)} AS announcement_text, {_templated(1)} AS announcement_details,
       'https://filings.example/' || CASE WHEN k % 24 = 11 THEN 'Transcript_Q4' ELSE 'document' END || '_' || CAST(k % 5 AS VARCHAR) || '.pdf' AS filing_url,
       CASE WHEN k % 97 = 0 THEN NULL ELSE a END AS announcement_datetime, a AS dissemination_datetime, k % 3 < 2 AS has_xbrl
FROM (
  SELECT o_orderkey AS k, 'S' || CAST(o_custkey % (SELECT COUNT(*) + 2 FROM supplier) AS VARCHAR) AS symbol,
         o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS a, CAST(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS DATE) AS p,
         unnest(generate_series(1, CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END)) AS copy
  FROM orders)""",
)
define("cand0", f"SELECT *, lower(announcement_text || ' ' || announcement_details) AS st FROM raw WHERE {_re('lower(announcement_text || chr(32) || announcement_details)', P.CANDIDATE)}", ("raw",))


def _glue(t: str) -> str:
    for pattern in P.GLUED_WORDS:
        t = f"regexp_replace({t}, '{pattern}', '\\1 \\2', 'g')"
    return t


def _phrase(t: str) -> str:
    return "COALESCE(" + ", ".join(f"NULLIF(regexp_extract({t}, '{p}', 1), '')" for p in P.PERIOD_PATTERNS) + ")"


define("glued", f"SELECT *, {_glue('st')} AS g FROM cand0", ("cand0",))
define("phrased", f"SELECT *, {_phrase('g')} AS ph, regexp_extract(g, '{P.FISCAL_TOKEN}', 1) AS fq, regexp_extract(g, '{P.FISCAL_TOKEN}', 2) AS fy FROM glued", ("glued",))
_TRY = lambda s, f: f"CAST(try_strptime({s}, '{f}') AS DATE)"
define(
    "dated",
    f"""
SELECT * EXCLUDE (x), CASE WHEN ph IS NULL THEN
    CASE WHEN fq = '' THEN NULL WHEN fq = '4' THEN make_date(2000 + CAST(fy AS INT), 3, 31)
         WHEN fq = '1' THEN make_date(1999 + CAST(fy AS INT), 6, 30) WHEN fq = '2' THEN make_date(1999 + CAST(fy AS INT), 9, 30)
         ELSE make_date(1999 + CAST(fy AS INT), 12, 31) END
  WHEN regexp_matches(ph, '^[a-z]+\\s+\\d{{4}}$') THEN last_day({_TRY('ph', '%B %Y')})
  ELSE COALESCE({_TRY('x', '%d-%b-%Y')}, {_TRY('x', '%d %B %Y')}, {_TRY('x', '%B %d, %Y')}, {_TRY('x', '%b %d, %Y')}, {_TRY('x', '%d.%m.%Y')}, {_TRY('x', '%d %b %Y')}) END AS period_extracted
FROM (SELECT *, regexp_replace(ph, '(\\d+)(st|nd|rd|th)', '\\1', 'g') AS x FROM phrased)""",
    ("phrased",),
)
_LEGACY = "CASE WHEN st LIKE '%integrated filing%' THEN 'integrated_financial_filing' WHEN st LIKE '%financial result updates%' THEN 'financial_result_update' WHEN st LIKE '%financial results%' THEN 'financial_results' WHEN st LIKE '%results update%' THEN 'results_update' WHEN st LIKE '%limited review%' THEN 'limited_review' ELSE 'other' END"
_EARNINGS = "CASE WHEN st LIKE '%integrated filing%' AND st LIKE '%financial%' THEN 'integrated_financial' WHEN st LIKE '%financial result%' THEN 'financial_results' WHEN st LIKE '%quarterly result%' THEN 'quarterly_results' WHEN st LIKE '%results update%' THEN 'results_update' WHEN st LIKE '%limited review%' THEN 'limited_review' WHEN st LIKE '%annual%' THEN 'annual_results' ELSE 'other_earnings' END"
_SCOPE_C = f"({_re('st', [P.CONSOLIDATED])} AND NOT {_re('st', [P.NON_CONSOLIDATED])})"
_SCOPE = f"CASE WHEN {_SCOPE_C} AND {_re('st', [P.STANDALONE])} THEN 'both' WHEN {_SCOPE_C} THEN 'consolidated' WHEN {_re('st', [P.STANDALONE])} THEN 'standalone' ELSE 'unknown' END"
_SIGNALS = {
    "financial_results": _results("o"),
    "financial_result_update": _update("o"),
    "integrated_financial": _re("o", P.INTEGRATED),
    "media_release": _re("c", P.MEDIA_RELEASE),
    "investor_presentation": _re("c", P.INVESTOR_PRESENTATION),
    "earnings_call_transcript": _re("c", P.CALL_TRANSCRIPT),
    "earnings_call_recording": _re("c", P.CALL_RECORDING),
    "earnings_call_schedule": _re("c", P.CALL_SCHEDULE),
    "board_meeting_outcome": f"({_re('c', P.BOARD_OUTCOME)} AND NOT {_results('c')} AND NOT {_update('c')})",
    "board_meeting_notice": _re("c", P.BOARD_NOTICE),
    "limited_review": _re("c", P.LIMITED_REVIEW),
}
define(
    "sig",
    "SELECT *, "
    + ", ".join(f"{sql} AS s_{name}" for name, sql in _SIGNALS.items())
    + f", {_re('c', P.TRADING_WINDOW)} AS s_window, {_re('c', P.OPTION_TO_SUBMIT)} AS s_option, ({_re('c', [P.MENTIONS_RESULT])} AND {_re('c', P.FOLLOWUP)}) AS s_followup"
    + f", {_LEGACY} AS legacy, {_EARNINGS} AS earnings_type, {_SCOPE} AS reporting_scope"
    + " FROM (SELECT *, lower(announcement_text) AS o, lower(announcement_text || ' ' || announcement_details || ' ' || filing_url) AS c FROM dated)",
    ("dated",),
)
define(
    "typed",
    """
SELECT *, CASE WHEN s_integrated_financial THEN 'integrated_financial_filing' WHEN s_financial_result_update THEN 'financial_result_update'
  WHEN s_financial_results THEN 'financial_results' WHEN s_window THEN 'other_filing' WHEN s_earnings_call_transcript THEN 'earnings_call_transcript'
  WHEN s_earnings_call_recording THEN 'earnings_call_recording' WHEN s_investor_presentation THEN 'investor_presentation' WHEN s_media_release THEN 'media_release'
  WHEN s_earnings_call_schedule THEN 'earnings_call_schedule' WHEN s_board_meeting_outcome THEN 'board_meeting_outcome' WHEN s_board_meeting_notice THEN 'board_meeting_notice'
  WHEN s_limited_review THEN 'limited_review' WHEN s_option THEN 'board_meeting_notice' WHEN s_followup THEN 'other_filing'
  WHEN legacy IN ('financial_results', 'financial_result_update', 'integrated_financial_filing', 'limited_review') THEN legacy
  WHEN legacy = 'results_update' THEN 'financial_result_update' ELSE 'unclassified' END AS document_type,
  concat_ws('|', """
    + ", ".join(f"CASE WHEN s_{n} THEN '{n}' END" for n in _SIGNALS)
    + f""") AS signals,
  COALESCE(period_extracted, {QUARTER_END.format(d='announcement_datetime')}) AS period0, period_extracted IS NULL AS fallback0,
  substr(sha256(symbol || '|' || COALESCE(strftime(announcement_datetime, '%Y-%m-%dT%H:%M:%S'), 'NaT') || '|' || filing_url), 1, 16) AS document_id
FROM sig""",
    ("sig",),
)
_PRIMARY = "('financial_results', 'financial_result_update', 'integrated_financial_filing')"
define(
    "moved",
    f"""
WITH need AS (
  SELECT DISTINCT symbol, announcement_datetime AS t FROM typed WHERE announcement_datetime IS NOT NULL AND (
    (document_type IN {_PRIMARY} AND fallback0) OR (document_type IN {tuple(P.FOLLOWUP_TYPES)} AND
     (fallback0 OR floor((epoch(CAST(period0 AS TIMESTAMP)) - epoch(announcement_datetime)) / 86400) > 90)))
), anchor AS (SELECT symbol, announcement_datetime AS t, arg_min(period0, document_id) AS p FROM typed WHERE document_type IN {_PRIMARY} AND NOT fallback0 GROUP BY 1, 2),
near AS (
  SELECT n.symbol, n.t, arg_min(a.p, struct_pack(g := abs(epoch(a.t) - epoch(n.t)), t := a.t)) AS p
  FROM need n JOIN anchor a ON a.symbol = n.symbol AND a.t BETWEEN n.t - INTERVAL 14 DAY AND n.t + INTERVAL 14 DAY GROUP BY 1, 2)
SELECT d.*, CASE WHEN m THEN p ELSE period0 END AS period_ended, fallback0 AND NOT m AS period_from_fallback, m AS period_reassigned
FROM (
  SELECT typed.*, near.p, near.p IS NOT NULL AND ((document_type IN {_PRIMARY} AND fallback0) OR (document_type IN {tuple(P.FOLLOWUP_TYPES)} AND
     (fallback0 OR floor((epoch(CAST(period0 AS TIMESTAMP)) - epoch(announcement_datetime)) / 86400) > 90))) AS m
  FROM typed LEFT JOIN near ON near.symbol = typed.symbol AND near.t = typed.announcement_datetime) d""",
    ("typed",),
)
define(
    "deduped",
    """
SELECT DISTINCT ON (document_id) * FROM moved ORDER BY document_id, period_ended NULLS FIRST, announcement_text, announcement_details""",
    ("moved",),
)


def _typed(spark, d):
    return event_ops.classify_filings(prepare_announcements(standins.filings(spark, d)))


@query(
    "candidate_filter",
    with_ctes("SELECT symbol, COUNT(*) AS filings, COUNT(*) FILTER (WHERE k IN (SELECT k FROM cand0)) AS candidates FROM raw GROUP BY 1", "cand0"),
)
def candidate_filter(spark, d):
    raw = standins.filings(spark, d)
    hit = text_fn.is_candidate(text_fn.search_text(F.col("desc"), F.col("attchmntText")))
    return raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("filings"), F.count_if(hit).alias("candidates"))


@query(
    "parse_announcement_times",
    with_ctes(
        "SELECT symbol, COUNT(*) AS filings, COUNT(announcement_datetime) AS parsed, MIN(announcement_datetime) AS first_at, MAX(dissemination_datetime) AS last_at, COUNT(*) FILTER (WHERE has_xbrl) AS with_xbrl FROM raw GROUP BY 1",
        "raw",
    ),
)
def parse_announcement_times(spark, d):
    rows = prepare_announcements(standins.filings(spark, d))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("filings"),
        F.count("announcement_datetime").alias("parsed"),
        F.min("announcement_datetime").alias("first_at"),
        F.max("dissemination_datetime").alias("last_at"),
        F.count_if(truthy_text(F.col("hasXbrl"))).alias("with_xbrl"),
    )


@query("legacy_types", with_ctes("SELECT earnings_type, legacy AS document_type_legacy, COUNT(*) AS filings FROM sig GROUP BY 1, 2", "sig"))
def legacy_types(spark, d):
    rows = standins.filings(spark, d).select(text_fn.search_text(F.col("desc"), F.col("attchmntText")).alias("t"))
    rows = rows.where(text_fn.is_candidate(F.col("t")))
    return rows.groupBy(
        text_fn.legacy_earnings_type(F.col("t")).alias("earnings_type"),
        text_fn.legacy_document_type(F.col("t")).alias("document_type_legacy"),
    ).agg(F.count(F.lit(1)).alias("filings"))


@query("reporting_scope", with_ctes("SELECT announcement_text, announcement_details, reporting_scope, COUNT(*) AS filings FROM sig GROUP BY 1, 2, 3", "sig"))
def reporting_scope(spark, d):
    rows = standins.filings(spark, d).select(
        F.col("desc").alias("announcement_text"),
        F.col("attchmntText").alias("announcement_details"),
        text_fn.search_text(F.col("desc"), F.col("attchmntText")).alias("t"),
    ).where(text_fn.is_candidate(F.col("t")))
    scoped = rows.withColumn("reporting_scope", text_fn.reporting_scope(F.col("t")))
    return scoped.groupBy("announcement_text", "announcement_details", "reporting_scope").agg(F.count(F.lit(1)).alias("filings"))


@query(
    "extract_period",
    with_ctes("SELECT st AS search_text, g AS repaired_text, ph AS period_phrase, period_extracted, COUNT(*) AS filings FROM dated GROUP BY ALL", "dated"),
)
def extract_period_query(spark, d):
    rows = standins.filings(spark, d).select(text_fn.search_text(F.col("desc"), F.col("attchmntText")).alias("search_text"))
    rows = rows.where(text_fn.is_candidate(F.col("search_text"))).groupBy("search_text").agg(F.count(F.lit(1)).alias("filings"))
    dated = with_period(rows, "search_text", "period_extracted")
    return dated.select(
        "search_text",
        repair_glued_words(F.col("search_text")).alias("repaired_text"),
        F.col("period_extracted_phrase").alias("period_phrase"),
        "period_extracted",
        "filings",
    )


@query(
    "classify_documents",
    with_ctes(
        f"SELECT document_id, document_type, document_type IN {_PRIMARY} AS is_primary_result, reporting_scope, earnings_type, period0 AS period_ended, fallback0 AS period_from_fallback, has_xbrl FROM typed",
        "typed",
    ),
)
def classify_documents(spark, d):
    return _typed(spark, d).select(
        "document_id", "document_type", "is_primary_result", "reporting_scope", "earnings_type", "period_ended",
        "period_from_fallback", "has_xbrl",
    )


@query(
    "classification_signals",
    with_ctes("SELECT document_type, signals, COUNT(*) AS filings FROM typed GROUP BY 1, 2", "typed"),
)
def classification_signals(spark, d):
    rows = _typed(spark, d).withColumn("signals", F.array_join("classification_signals", "|"))
    return rows.groupBy("document_type", "signals").agg(F.count(F.lit(1)).alias("filings"))


@query(
    "document_type_descriptions",
    with_ctes(
        "SELECT document_type, CASE document_type "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CATEGORY_DESCRIPTIONS.items())
        + " END AS category_description, COUNT(*) AS filings FROM typed GROUP BY 1, 2",
        "typed",
    ),
)
def document_type_descriptions(spark, d):
    return _typed(spark, d).groupBy("document_type", "category_description").agg(F.count(F.lit(1)).alias("filings"))


@query(
    "reassign_followup_periods",
    with_ctes(
        f"SELECT document_id, document_type, period_ended, {FISCAL.format(d='period_ended')} AS fiscal_quarter, symbol || '_' || COALESCE(strftime(period_ended, '%Y-%m-%d'), 'UNKNOWN') AS event_key, period_from_fallback, period_reassigned FROM moved",
        "moved",
    ),
)
def reassign_followup_periods(spark, d):
    moved = event_ops.reassign_periods(stage(_typed(spark, d)))
    return moved.select(
        "document_id", "document_type", "period_ended", "fiscal_quarter", "event_key", "period_from_fallback", "period_reassigned"
    )


@query(
    "documents_dedup",
    with_ctes("SELECT document_id, symbol, period_ended, document_type, announcement_text, announcement_datetime FROM deduped", "deduped"),
)
def documents_dedup(spark, d):
    moved = event_ops.reassign_periods(stage(_typed(spark, d)))
    once = event_ops.drop_duplicate_documents(moved, ["period_ended", "announcement_text", "announcement_details"])
    return once.select("document_id", "symbol", "period_ended", "document_type", "announcement_text", "announcement_datetime")


@query(
    "canonical_document",
    with_ctes("SELECT event_key, document_id, announcement_datetime, CAST(score AS BIGINT) AS score FROM canon", "canon"),
)
def canonical_document(spark, d):
    picked = event_ops.canonical_documents(standins.announcements(spark, d))
    return picked.withColumn("score", big(F.col("score")))


@query(
    "documents_table",
    with_ctes(
        """
SELECT a.document_id, a.event_key, CAST(a.announcement_datetime AS DATE) AS announcement_date, strftime(a.announcement_datetime, '%H:%M:%S') AS announcement_time,
       c.document_id IS NOT NULL AS is_canonical_primary, NOT a.is_primary_result AS is_followup_document, 'exchange_announcements' AS source
FROM ann a LEFT JOIN canon c USING (document_id)""",
        "ann",
        "canon",
    ),
)
def documents_table(spark, d):
    docs = event_ops.documents_table(standins.announcements(spark, d), "exchange_announcements")
    return docs.select(
        "document_id", "event_key", "announcement_date", "announcement_time", "is_canonical_primary", "is_followup_document", "source"
    )


def _events_sql(docs: str, canon: str) -> str:
    return f"""
SELECT event_key, any_value(symbol) AS symbol, any_value(company_name) AS company_name, any_value(period_ended) AS period_ended, any_value(fiscal_quarter) AS fiscal_quarter,
  MIN(announcement_datetime) AS announcement_datetime, MAX(announcement_datetime) AS last_document_datetime,
  MIN(CASE WHEN is_canon THEN announcement_datetime END) AS result_announcement_datetime,
  MIN(CASE WHEN is_primary_result THEN announcement_datetime END) AS all_primary_first_datetime, COUNT(*) AS document_count,
  COUNT(*) FILTER (WHERE is_primary_result) AS primary_result_count,
  COUNT(*) FILTER (WHERE document_type IN ('financial_results', 'financial_result_update')) AS human_primary_result_count,
  COUNT(*) FILTER (WHERE is_canon) AS canonical_primary_count,
  bool_or(is_primary_result) AS has_financial_results, bool_or(document_type = 'media_release') AS has_media_release,
  bool_or(document_type = 'investor_presentation') AS has_investor_presentation,
  bool_or(document_type IN ('earnings_call_recording', 'earnings_call_schedule')) AS has_earnings_call,
  bool_or(document_type = 'earnings_call_transcript') AS has_transcript,
  COUNT(*) FILTER (WHERE document_type = 'unclassified') AS unclassified,
  COUNT(*) FILTER (WHERE announcement_datetime < period_ended) AS all_early,
  COUNT(*) FILTER (WHERE announcement_datetime < period_ended AND document_type IN ('financial_results', 'financial_result_update')) AS human_early,
  COUNT(*) - COUNT(DISTINCT filing_url) AS dup_urls
FROM (SELECT a.*, c.document_id IS NOT NULL AS is_canon FROM {docs} a LEFT JOIN {canon} c USING (document_id)) GROUP BY event_key"""


define("rolled", _events_sql("ann", "canon"), ("ann", "canon"))
define(
    "evt",
    """
SELECT r.*, t.document_types, datediff('day', period_ended, CAST(result_announcement_datetime AS DATE)) AS days_from_period_end
FROM rolled r JOIN (SELECT event_key, string_agg(document_type || ':' || n, '|' ORDER BY document_type) AS document_types
  FROM (SELECT event_key, document_type, COUNT(*) AS n FROM ann GROUP BY 1, 2) GROUP BY 1) t USING (event_key)""",
    ("rolled",),
)
define(
    "evq",
    """
SELECT *, COALESCE(NULLIF(concat_ws('|', CASE WHEN period_ended IS NULL THEN 'MISSING_PERIOD_END' END, CASE WHEN human_primary_result_count = 0 THEN 'MISSING_RESULT' END,
  CASE WHEN human_primary_result_count > 1 THEN 'MULTIPLE_HUMAN_PRIMARY_RESULTS' END, CASE WHEN days_from_period_end < 0 THEN 'ANNOUNCEMENT_BEFORE_PERIOD_END' END,
  CASE WHEN days_from_period_end > 90 THEN 'VERY_LATE_FILING' END, CASE WHEN dup_urls > 0 THEN 'DUPLICATE_DOCUMENT' END, CASE WHEN unclassified > 0 THEN 'UNCLASSIFIED_DOCUMENT' END,
  CASE WHEN human_early > 0 THEN 'HUMAN_PRIMARY_RESULT_BEFORE_PERIOD_END' END, CASE WHEN all_early > 5 THEN 'MANY_PRE_ANNOUNCEMENTS' END), ''), 'OK') AS quality_flag FROM evt""",
    ("evt",),
)


@query(
    "event_rollup",
    with_ctes(
        """
SELECT event_key, symbol, company_name, period_ended, fiscal_quarter, announcement_datetime, CAST(announcement_datetime AS DATE) AS announcement_date,
  strftime(announcement_datetime, '%H:%M:%S') AS announcement_time, result_announcement_datetime, CAST(result_announcement_datetime AS DATE) AS result_announcement_date,
  strftime(result_announcement_datetime, '%H:%M:%S') AS result_announcement_time,
  CASE WHEN human_primary_result_count > 0 THEN 'confirmed' ELSE 'no_primary_result' END AS event_status, document_count, has_financial_results, has_media_release,
  has_investor_presentation, has_earnings_call, has_transcript, announcement_datetime AS first_document_datetime, last_document_datetime,
  CAST(days_from_period_end AS INT) AS days_from_period_end, primary_result_count, human_primary_result_count, canonical_primary_count, all_primary_first_datetime, quality_flag, document_types
FROM evq""",
        "evq",
    ),
)
def event_rollup(spark, d):
    return event_ops.roll_up(documents(spark, d))


@query(
    "event_quality_report",
    with_ctes(
        "SELECT event_key, symbol, period_ended, document_count, announcement_datetime AS first_document_datetime, result_announcement_datetime, last_document_datetime, CAST(days_from_period_end AS INT) AS days_from_period_end, human_primary_result_count, quality_flag FROM evq",
        "evq",
    ),
)
def event_quality_report(spark, d):
    return event_ops.quality_report(event_ops.roll_up(documents(spark, d)))


@query(
    "event_quality_flags",
    with_ctes("SELECT flag, COUNT(*) AS events FROM (SELECT unnest(string_split(quality_flag, '|')) AS flag FROM evq) GROUP BY 1", "evq"),
)
def event_quality_flags(spark, d):
    return event_ops.quality_flag_counts(event_ops.roll_up(documents(spark, d)))


@query(
    "document_type_counts",
    with_ctes("SELECT event_key, document_types FROM evt", "evt"),
)
def document_type_counts(spark, d):
    counts = event_ops.document_type_counts(standins.announcements(spark, d))
    return counts.select("event_key", event_ops.type_string(F.col("doc_types")).alias("document_types"))


@query(
    "filings_to_events",
    with_ctes(
        f"""
, sc AS (
  SELECT *, lower(announcement_text) AS t, symbol || '_' || COALESCE(strftime(period_ended, '%Y-%m-%d'), 'UNKNOWN') AS event_key FROM deduped
), cn AS (
  SELECT event_key, announcement_datetime FROM (
  SELECT *, CASE document_type WHEN 'financial_result_update' THEN 100 ELSE 50 END
    + CASE reporting_scope
      WHEN 'consolidated' THEN CASE WHEN t LIKE '%quarter ended%' OR t LIKE '%year ended%' THEN 1000 WHEN trim(t) = 'financial result updates' THEN 500 ELSE 300 END
      WHEN 'standalone' THEN CASE WHEN t LIKE '%quarter ended%' OR t LIKE '%year ended%' THEN 900 WHEN trim(t) = 'financial result updates' THEN 400 ELSE 200 END
      WHEN 'both' THEN CASE WHEN t LIKE '%quarter ended%' OR t LIKE '%year ended%' THEN 800 WHEN trim(t) = 'financial result updates' THEN 300 ELSE 100 END
      ELSE CASE WHEN t LIKE '%quarter ended%' OR t LIKE '%year ended%' THEN 200 WHEN trim(t) = 'financial result updates' THEN 100
                WHEN t LIKE '%outcome of board meeting%' THEN 50 ELSE 10 END END
    + CASE WHEN month(period_ended) = 3 THEN CASE WHEN t LIKE '%year ended%' THEN 200 WHEN t LIKE '%quarter ended%' THEN 100 ELSE 0 END ELSE 0 END
    - CASE WHEN announcement_datetime < period_ended
           THEN 10000 + 10 * CAST(floor((epoch(CAST(period_ended AS TIMESTAMP)) - epoch(announcement_datetime)) / 86400) AS BIGINT) ELSE 0 END AS score
  FROM sc WHERE document_type IN ('financial_results', 'financial_result_update'))
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY score DESC, announcement_datetime NULLS FIRST, document_id) = 1)
SELECT s.event_key, any_value(s.symbol) AS symbol, any_value((SELECT s_name FROM supplier WHERE 'S' || s_suppkey = s.symbol)) AS company_name, COUNT(*) AS document_count, COUNT(DISTINCT s.document_type) AS document_types, MIN(s.announcement_datetime) AS first_document_datetime, any_value(cn.announcement_datetime) AS result_announcement_datetime,
  any_value({FISCAL.format(d='s.period_ended')}) AS fiscal_quarter, COUNT(*) FILTER (WHERE document_type IN {_PRIMARY}) AS primary_result_count
FROM sc s LEFT JOIN cn USING (event_key) GROUP BY 1""",
        "deduped",
    ).replace("\n,", ",", 1),
)
def filings_to_events(spark, d):
    from pitline.plans.dataset import filings_to_documents

    universe = read_table(spark, d, "supplier").selectExpr("concat('S', s_suppkey) AS symbol", "s_name AS company_name")
    docs = filings_to_documents(with_company_names(prepare_announcements(standins.filings(spark, d)), universe))
    return event_ops.roll_up(docs).select(
        "event_key", "symbol", "company_name", F.size(F.split("document_types", r"\|")).cast("long").alias("document_types"), "document_count", "first_document_datetime", "result_announcement_datetime", "fiscal_quarter", "primary_result_count"
    )

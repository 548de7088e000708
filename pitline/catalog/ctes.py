"""Named common table expressions from which the SQL oracles are composed."""

from __future__ import annotations

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    _PARTS[name] = (needs, sql.strip())


def with_ctes(body: str, *names: str) -> str:
    """``body`` preceded by the named expressions and everything they need, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _PARTS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


_CLOSE = "100.0::DOUBLE * (1.0::DOUBLE + CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / (CAST(COUNT(*) AS DOUBLE) * 200.0::DOUBLE))"

define(
    "px",
    f"""
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, {_CLOSE} AS close,
       CASE WHEN CAST(SUM(l_quantity) AS BIGINT) % 29 <> 0 THEN SUM(l_quantity) END AS volume
FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY ALL""",
)
define(
    "bench",
    f"""
SELECT CAST(l_shipdate AS DATE) AS date, {_CLOSE} AS close
FROM lineitem WHERE isodow(l_shipdate) < 6 AND day(l_shipdate) <> 13 GROUP BY ALL""",
)
define("cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM px)", ("px",))

QUARTER_END = "CAST(date_trunc('quarter', {d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
PREV_QUARTER_END = "CAST(date_trunc('quarter', {d}) - INTERVAL 1 DAY AS DATE)"
FISCAL = (
    "CASE month({d}) WHEN 3 THEN year({d}) || '-Q4' WHEN 6 THEN year({d}) || '-Q1'"
    " WHEN 9 THEN year({d}) || '-Q2' WHEN 12 THEN year({d}) || '-Q3' END"
)

define(
    "ann0",
    f"""
SELECT o_orderkey AS k, 'S' || CAST(o_custkey % (SELECT COUNT(*) + 2 FROM supplier) AS VARCHAR) AS symbol,
       o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS announcement_datetime,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 11 = 0 THEN {QUARTER_END.format(d='o_orderdate')}
            ELSE {PREV_QUARTER_END.format(d='o_orderdate')} END AS period_ended,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'financial_results'
            WHEN o_orderpriority = '2-HIGH' THEN 'financial_result_update'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'media_release'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'earnings_call_transcript'
            WHEN o_orderkey % 4 = 0 THEN 'investor_presentation'
            WHEN o_orderkey % 4 = 1 THEN 'earnings_call_recording'
            WHEN o_orderkey % 4 = 2 THEN 'integrated_financial_filing' ELSE 'unclassified' END AS document_type,
       CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'standalone' ELSE 'unknown' END AS reporting_scope,
       CASE o_orderkey % 4 WHEN 0 THEN 'Results for the quarter ended' WHEN 1 THEN 'Financial Result Updates'
            WHEN 2 THEN 'Outcome of Board Meeting' ELSE 'Audited results for the year ended' END AS announcement_text
FROM orders""",
)
define(
    "ann",
    f"""
SELECT 'D' || CAST(k AS VARCHAR) AS document_id,
       symbol || '_' || COALESCE(strftime(period_ended, '%Y-%m-%d'), 'UNKNOWN') AS event_key,
       symbol, 'Company ' || symbol AS company_name, period_ended, {FISCAL.format(d='period_ended')} AS fiscal_quarter,
       announcement_datetime, document_type,
       document_type IN ('financial_results', 'financial_result_update', 'integrated_financial_filing') AS is_primary_result,
       reporting_scope, announcement_text, 'https://filings.example/' || symbol || '/' || CAST(k % 7 AS VARCHAR) AS filing_url
FROM ann0""",
    ("ann0",),
)
define(
    "scored",
    """
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
FROM (SELECT *, lower(announcement_text) AS t FROM ann WHERE document_type IN ('financial_results', 'financial_result_update'))""",
    ("ann",),
)
define(
    "canon",
    """
SELECT event_key, document_id, announcement_datetime, score FROM scored
QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY score DESC, announcement_datetime, document_id) = 1""",
    ("scored",),
)
define(
    "ev",
    """
SELECT a.event_key, any_value(a.symbol) AS symbol, any_value(a.company_name) AS company_name,
       any_value(a.period_ended) AS period_ended, any_value(a.fiscal_quarter) AS fiscal_quarter,
       any_value(c.announcement_datetime) AS result_announcement_datetime
FROM ann a LEFT JOIN canon c USING (event_key) GROUP BY a.event_key""",
    ("ann", "canon"),
)
define(
    "evd",
    """
WITH s AS (
  SELECT e.*, CAST(result_announcement_datetime AS DATE) AS day, c.idx AS own_idx, b.idx AS at_idx,
         hour(result_announcement_datetime) * 60 + minute(result_announcement_datetime) AS m
  FROM ev e
  LEFT JOIN cal c ON c.date = CAST(result_announcement_datetime AS DATE)
  ASOF LEFT JOIN cal b ON b.date <= CAST(result_announcement_datetime AS DATE)
  WHERE result_announcement_datetime IS NOT NULL
), k AS (
  SELECT *, CASE WHEN m = 0 AND second(result_announcement_datetime) = 0 THEN 'unknown'
                 WHEN own_idx IS NULL THEN 'non_trading_day' WHEN m < 555 THEN 'pre_market'
                 WHEN m <= 930 THEN 'during_market' ELSE 'post_market' END AS announcement_session_type FROM s
)
SELECT event_key, symbol, company_name, period_ended, fiscal_quarter, result_announcement_datetime, announcement_session_type,
       (SELECT date FROM cal WHERE idx = CASE WHEN announcement_session_type = 'post_market' AND own_idx IS NOT NULL THEN at_idx ELSE at_idx - 1 END) AS feature_cutoff_date,
       (SELECT date FROM cal WHERE idx = CASE WHEN announcement_session_type = 'pre_market' AND own_idx IS NOT NULL THEN at_idx ELSE at_idx + 1 END) AS reaction_start_date
FROM k""",
    ("ev", "cal"),
)

RETURN_KS, VOL_KS, VOLUME_KS, MA_KS, DD_KS, LABEL_KS = (1, 3, 5, 10, 20, 60), (5, 20, 60), (5, 20), (20, 50, 200), (20, 60, 252), (1, 3, 5)


def _feature_sql(source: str, by: str) -> str:
    """Trailing features of every price row, written with explicit frames."""
    part = f"PARTITION BY {by} " if by else ""
    ret = ",\n".join(f"close / lag(close, {k}) OVER w - 1 AS return_{k}d" for k in RETURN_KS)
    vol = ",\n".join(
        f"CASE WHEN history_days > {k} THEN stddev_samp(return_1d) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) * sqrt(252.0) END AS volatility_{k}d"
        for k in VOL_KS
    )
    ma = ",\n".join(
        f"CASE WHEN history_days >= {k} THEN (close - avg(close) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) / avg(close) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS distance_from_{k}dma"
        for k in MA_KS
    )
    dd = ",\n".join(
        f"CASE WHEN history_days >= {k} THEN (close - max(close) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)) / max(close) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS drawdown_from_{k}d_high"
        for k in DD_KS
    )
    fwd = ",\n".join(f"lead(close, {k}) OVER w / close - 1 AS forward_{k}d" for k in LABEL_KS)
    return f"""
WITH r AS (SELECT *, row_number() OVER w AS history_days, {ret}, {fwd} FROM {source} WINDOW w AS ({part}ORDER BY date))
SELECT *, {vol}, {ma}, {dd} FROM r"""


define("pf0", _feature_sql("px", "symbol"), ("px",))
define(
    "vf",
    """
WITH v AS (SELECT symbol, date, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, """
    + ", ".join(
        f"avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS m{k}, "
        f"stddev_samp(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS s{k}"
        for k in VOLUME_KS
    )
    + " FROM px WHERE volume IS NOT NULL) SELECT symbol, date, "
    + ", ".join(
        f"CASE WHEN n >= {k} AND m{k} > 0 THEN volume / m{k} END AS volume_ratio_{k}d, "
        f"CASE WHEN n >= {k} AND s{k} > 0 THEN (volume - m{k}) / s{k} END AS volume_zscore_{k}d"
        for k in VOLUME_KS
    )
    + " FROM v",
    ("px",),
)
VOLUME_COLS = [f"volume_{n}_{k}d" for k in VOLUME_KS for n in ("ratio", "zscore")]
define(
    "pf",
    "SELECT p.*, " + ", ".join(f"v.{c}" for c in VOLUME_COLS) + " FROM pf0 p ASOF LEFT JOIN vf v ON p.symbol = v.symbol AND p.date >= v.date",
    ("pf0", "vf"),
)
define("bf", _feature_sql("bench", ""), ("bench",))
_PF = [f"return_{k}d" for k in RETURN_KS] + [f"volatility_{k}d" for k in VOL_KS] + VOLUME_COLS + [f"distance_from_{k}dma" for k in MA_KS] + [f"drawdown_from_{k}d_high" for k in DD_KS]
_FLAGGED = [c for c in _PF if "zscore" not in c]
define(
    "mkt0",
    "SELECT e.*, p.symbol AS p_symbol, COALESCE(p.history_days, 0) AS price_history_days, COALESCE(b.history_days, 0) AS benchmark_history_days, "
    + ", ".join(f"p.{c}" for c in _PF)
    + ", "
    + ", ".join(f"p.return_{k}d - b.return_{k}d AS relative_return_{k}d" for k in RETURN_KS)
    + ", "
    + ", ".join(
        f"CASE WHEN pa.forward_{k}d IS NOT NULL AND ba.forward_{k}d IS NOT NULL THEN pa.forward_{k}d - ba.forward_{k}d END AS abnormal_return_{k}d, "
        f"CASE WHEN ba.forward_{k}d IS NOT NULL THEN pa.forward_{k}d END AS return_{k}d_after, "
        f"CASE WHEN pa.forward_{k}d IS NOT NULL THEN ba.forward_{k}d END AS benchmark_return_{k}d_after"
        for k in LABEL_KS
    )
    + """ FROM evd e
ASOF LEFT JOIN pf p ON p.symbol = e.symbol AND p.date <= e.feature_cutoff_date
ASOF LEFT JOIN bf b ON b.date <= e.feature_cutoff_date
ASOF LEFT JOIN pf pa ON pa.symbol = e.symbol AND pa.date >= e.reaction_start_date
ASOF LEFT JOIN bf ba ON ba.date >= e.reaction_start_date""",
    ("evd", "pf", "bf"),
)
define(
    "mkta",
    "SELECT *, CASE WHEN COALESCE(abnormal_return_3d, abnormal_return_1d) IS NULL THEN 'UNKNOWN' "
    "WHEN COALESCE(abnormal_return_3d, abnormal_return_1d) > 0.02 THEN 'POSITIVE' "
    "WHEN COALESCE(abnormal_return_3d, abnormal_return_1d) < -0.02 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS reaction_class, "
    "CASE WHEN feature_cutoff_date IS NULL THEN 'no_cutoff' WHEN reaction_start_date IS NULL THEN 'no_reaction_start' "
    "WHEN symbol NOT IN (SELECT DISTINCT symbol FROM px) THEN 'no_price_history' WHEN price_history_days < 2 THEN 'insufficient_history' "
    "WHEN benchmark_history_days < 2 THEN 'no_benchmark' END AS skip_reason, "
    "COALESCE(NULLIF(concat_ws('|', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN 'INSUFFICIENT_HISTORY_{c}' END" for c in _FLAGGED)
    + ", CASE WHEN price_history_days < 60 THEN 'LIMITED_HISTORY' END, CASE WHEN price_history_days < 252 THEN 'VERY_LIMITED_HISTORY' END), ''), 'OK') AS quality_flags FROM mkt0",
    ("mkt0",),
)
define("mkt", "SELECT * EXCLUDE (skip_reason, p_symbol) FROM mkta WHERE skip_reason IS NULL", ("mkta",))
define("cm", "SELECT * FROM mkt", ("mkt",))

"""Statement metrics, point-in-time attachment, valuation, own history, model table and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitline import standins
from pitline.catalog.ctes import QUARTER_END, define, with_ctes
from pitline.catalog.registry import big, query, rounded, sql_round
from pitline.catalog.tables import bench, build_model, calendar, events, labelled, prices, tasks
from pitline.operators import fundamentals as fund_ops
from pitline.operators import history as hist_ops
from pitline.operators.prices import ROWS_PER_TASK
from pitline.plans.dataset import EVENTS_PER_TASK
from pitline.plans.roles import feature_manifest
from pitline.session import read_table

_M = "CAST({} AS DOUBLE) / 10000.0::DOUBLE"
_S = {
    "revenue": _M.format("(g * 100 - o)"),
    "gross_profit": f"CASE WHEN n % 5 <> 0 THEN {_M.format('o')} END",
    "operating_income": _M.format("(o - t)"),
    "net_income": _M.format("((o - t) * 2)"),
    "ebit": f"CASE WHEN n % 3 <> 0 THEN {_M.format('(o - t)')} END",
    "ebitda": f"CASE WHEN n % 3 <> 1 THEN {_M.format('o')} END",
    "normalized_ebitda": _M.format("(o + t)"),
    "eps_diluted": f"CASE WHEN n % 4 <> 0 THEN {_M.format('(o - t)')} / NULLIF(CAST(q AS DOUBLE), 0) END",
    "eps_basic": f"{_M.format('(o - t)')} / CAST(q + 10 AS DOUBLE)",
    "shares_outstanding": "CASE WHEN n % 7 <> 0 THEN CAST(q AS DOUBLE) END",
    "shares_diluted": "CAST(q AS DOUBLE)",
    "total_assets": _M.format("(g * 200)"),
    "total_liabilities": _M.format("(g * 100)"),
    "equity": f"CASE WHEN n % 6 <> 0 THEN {_M.format('(g * 100 - t)')} END",
    "total_equity": _M.format("(g * 100 + t)"),
    "total_debt": f"CASE WHEN n % 8 <> 0 THEN {_M.format('(t * 3)')} END",
    "cash": _M.format("t"),
    "current_assets": _M.format("(g * 100 - t)"),
    "current_liabilities": _M.format("(t * 2)"),
    "operating_cash_flow": _M.format("o"),
    "free_cash_flow": _M.format("(o - t * 2)"),
}
define(
    "fund",
    f"""
SELECT symbol, period_end_date, {', '.join(f'{v} AS {k}' for k, v in _S.items())} FROM (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, {QUARTER_END.format(d='l_shipdate')} AS period_end_date,
    SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS g, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CAST(ROUND(l_discount * 100) AS BIGINT)) AS o,
    SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CAST(ROUND(l_tax * 100) AS BIGINT)) AS t, SUM(CAST(l_quantity AS BIGINT)) AS q, COUNT(*) AS n
  FROM lineitem GROUP BY 1, 2)""",
)
_GROWTH = [
    f"(({c} - lag({c}, {k}) OVER w) / NULLIF(abs(lag({c}, {k}) OVER w), 0)) AS {name}_{s}"
    for name, c in (("revenue_growth", "revenue"), ("eps_growth", "eps_diluted"), ("net_income_growth", "net_income"))
    for s, k in (("qoq", 1), ("yoy", 4))
]
_RATIO = {
    "operating_margin": ("operating_income", "revenue"), "net_margin": ("net_income", "revenue"), "ebitda_margin": ("ebitda", "revenue"),
    "debt_to_equity": ("total_debt", "equity"), "current_ratio": ("current_assets", "current_liabilities"), "roe": ("net_income", "equity"),
    "roa": ("net_income", "total_assets"), "roce": ("ebit", "(total_assets - current_liabilities)"), "fcf_margin": ("free_cash_flow", "revenue"),
    "fcf_to_debt": ("free_cash_flow", "total_debt"), "asset_turnover": ("revenue", "total_assets"), "cash_to_debt": ("cash", "total_debt"),
}
METRICS = [g.split(" AS ")[-1] for g in _GROWTH] + list(_RATIO)
define(
    "fm",
    f"SELECT *, {', '.join(_GROWTH)}, {', '.join(f'{n} / NULLIF({d}, 0) AS {k}' for k, (n, d) in _RATIO.items())} FROM fund WINDOW w AS (PARTITION BY symbol ORDER BY period_end_date)",
    ("fund",),
)
FUND_COLUMNS = [*_S, *METRICS]
define(
    "pit",
    "SELECT e.*, f.period_end_date AS fundamental_period_end_date, f.period_end_date + 45 AS fundamental_estimated_available_date, "
    "CASE WHEN f.symbol IS NULL THEN 'unavailable' ELSE 'estimated_conservative' END AS fundamental_pit_status, "
    "datediff('day', f.period_end_date + 45, e.feature_cutoff_date) AS fundamental_lag_days, "
    + ", ".join(f"f.{c} AS fund_{c}" for c in FUND_COLUMNS)
    + """ FROM mkt e LEFT JOIN fm f ON f.symbol = e.symbol AND f.period_end_date = (
  SELECT MAX(x.period_end_date) FROM fm x WHERE x.symbol = e.symbol AND x.period_end_date < e.period_ended AND x.period_end_date + 45 <= e.feature_cutoff_date)""",
    ("mkt", "fm"),
)
define(
    "val",
    """
WITH p AS (SELECT t.*, x.close AS price, COALESCE(fund_shares_outstanding, fund_shares_diluted) AS sh, COALESCE(fund_equity, fund_total_equity) AS eq,
    COALESCE(fund_eps_diluted, fund_eps_basic) AS eps, COALESCE(fund_ebitda, fund_normalized_ebitda) AS eb
  FROM pit t ASOF LEFT JOIN px x ON x.symbol = t.symbol AND x.date <= t.feature_cutoff_date),
c AS (SELECT *, CASE WHEN sh > 0 THEN price * sh END AS val_market_cap, price / NULLIF(eps, 0) AS val_pe,
    price / NULLIF(CASE WHEN sh > 0 THEN eq / sh END, 0) AS val_pb FROM p)
SELECT * EXCLUDE (price, sh, eq, eps, eb), 1 / NULLIF(val_pe, 0) AS val_earnings_yield, CASE WHEN fund_revenue > 0 THEN val_market_cap / fund_revenue END AS val_ps,
  CASE WHEN fund_operating_cash_flow > 0 THEN val_market_cap / fund_operating_cash_flow END AS val_pcf,
  val_market_cap + fund_total_debt - fund_cash AS val_ev, (val_market_cap + fund_total_debt - fund_cash) / NULLIF(eb, 0) AS val_ev_ebitda FROM c""",
    ("pit", "px"),
)
_W = "PARTITION BY symbol ORDER BY period_ended, event_key"


def _hist() -> str:
    def frame(n):
        return f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def gate(n, x, name):
        return f"CASE WHEN row_number() OVER w - 1 >= {n} THEN {x} END AS {name}"

    cols = ["row_number() OVER w - 1 AS prior_earnings_count", "lag(reaction_class) OVER w AS prior_last_reaction_class",
            "datediff('day', lag(period_ended) OVER w, period_ended) AS prior_days_since_last"]
    for h in (1, 3, 5):
        a = f"abnormal_return_{h}d"
        cols.append(f"lag({a}) OVER w AS prior_last_abn_ret_{h}d")
        cols += [gate(n, f"avg({a}) {frame(n)}", f"prior_abn_ret_{h}d_mean_{n}") for n in (2, 4, 8)]
        cols += [gate(n, f"quantile_cont({a}, 0.5) {frame(n)}", f"prior_abn_ret_{h}d_median_{n}") for n in (4, 8)]
        cols += [gate(n, f"stddev_samp({a}) {frame(n)}", f"prior_abn_ret_{h}d_std_{n}") for n in (4, 8)]
    for n in (4, 8):
        cols += [gate(n, f"avg(CASE WHEN reaction_class = '{c}' THEN 1.0 ELSE 0.0 END) {frame(n)}", f"prior_{c.lower()}_rate_{n}") for c in ("POSITIVE", "NEGATIVE", "NEUTRAL")]
        cols.append(gate(n, f"count(sgn) {frame(n)}", f"cnt_{n}"))
        # rank among labelled rows gives the re-indexed x; a slope does not depend on where x starts
        cols.append(gate(n, f"CASE WHEN count(sgn) {frame(n)} >= 2 THEN regr_slope(sgn, xi) {frame(n)} END", f"prior_reaction_trend_{n}"))
    cols += [gate(n, f"avg(abs(abnormal_return_5d)) {frame(n)}", f"prior_avg_reaction_magnitude_{n}") for n in (2, 4, 8)]
    return (
        f"WITH l AS (SELECT e.*, m.abnormal_return_1d, m.abnormal_return_3d, m.abnormal_return_5d, m.reaction_class, "
        "CASE m.reaction_class WHEN 'POSITIVE' THEN 1 WHEN 'NEUTRAL' THEN 0 WHEN 'NEGATIVE' THEN -1 END AS sgn FROM ev e LEFT JOIN mkt m USING (event_key)), "
        f"x AS (SELECT *, count(sgn) OVER ({_W}) AS xi, row_number() OVER ({_W}) AS rn, "
        f"CASE WHEN reaction_class = lag(reaction_class) OVER ({_W}) THEN 0 ELSE 1 END AS chg FROM l), "
        f"y AS (SELECT *, rn - max(CASE WHEN chg = 1 THEN rn END) OVER ({_W}) + 1 AS len FROM x) "
        f"SELECT event_key, symbol, period_ended, {', '.join(cols)}, lag(len) OVER w AS prior_reaction_streak FROM y WINDOW w AS ({_W})"
    )


define("hist", _hist(), ("ev", "mkt"))
define("ml", "SELECT v.*, h.* EXCLUDE (event_key, symbol, period_ended, cnt_4, cnt_8) FROM val v JOIN hist h USING (event_key) WHERE v.period_ended < DATE '2001-06-30'", ("val", "hist"))


@query("fundamental_metrics", with_ctes(f"SELECT symbol, period_end_date, {sql_round(METRICS)} FROM fm", "fm"))
def fundamental_metrics(spark, d):
    df = fund_ops.with_metrics(standins.fundamentals(spark, d))
    return rounded(df.select("symbol", "period_end_date", *METRICS))


_QUARTERLY = """
WITH q AS (SELECT 'S' || l_suppkey AS symbol, last_day(l_shipdate) AS p, COUNT(*) % 3 > 0 AS quarterly, CAST(SUM(l_quantity) AS BIGINT)::DOUBLE AS x FROM lineitem GROUP BY 1, 2),
r AS (SELECT symbol, p, CASE WHEN quarterly THEN x END AS revenue, lag(x, 1) OVER w AS one, lag(x, 4) OVER w AS four FROM q WINDOW w AS (PARTITION BY symbol, quarterly ORDER BY p))
SELECT symbol, CAST(p AS DATE) AS period_end_date, revenue, ROUND((revenue - one) / NULLIF(abs(one), 0), 10) AS revenue_growth_qoq, ROUND((revenue - four) / NULLIF(abs(four), 0), 10) AS revenue_growth_yoy FROM r"""


@query("quarterly_row_growth", _QUARTERLY)
def quarterly_row_growth(spark, d):
    """Growth over statements of which a third hold annual values alone."""
    sums = read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.last_day("l_shipdate").alias("period_end_date"))
    rows = sums.agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("x"), F.count(F.lit(1)).alias("n"))
    statements = rows.selectExpr("symbol", "period_end_date", "CASE WHEN n % 3 > 0 THEN x END AS revenue", "CASE WHEN n % 3 = 0 THEN x END AS a_revenue")
    grown = fund_ops.with_metrics(statements, quarterly_rows=True)
    return rounded(grown.select("symbol", "period_end_date", "revenue", "revenue_growth_qoq", "revenue_growth_yoy"))


@query(
    "pit_fundamentals",
    with_ctes(
        f"SELECT event_key, fundamental_period_end_date, fundamental_estimated_available_date, fundamental_pit_status, fundamental_lag_days, {', '.join(f'ROUND(fund_{c}, 10) + 0.0 AS fund_{c}' for c in FUND_COLUMNS)} FROM pit",
        "pit",
    ),
)
def pit_fundamentals(spark, d):
    df = fund_ops.attach_point_in_time(labelled(spark, d), fund_ops.with_metrics(standins.fundamentals(spark, d)), tasks=tasks(EVENTS_PER_TASK, labelled(spark, d)))
    return rounded(
        df.select(
            "event_key", "fundamental_period_end_date", "fundamental_estimated_available_date", "fundamental_pit_status",
            big(F.col("fundamental_lag_days")).alias("fundamental_lag_days"), *[f"fund_{c}" for c in FUND_COLUMNS],
        )
    )


@query("valuation", with_ctes(f"SELECT event_key, {sql_round(fund_ops.VALUATION_COLUMNS, 6)} FROM val", "val"))
def valuation(spark, d):
    funded = fund_ops.attach_point_in_time(labelled(spark, d), fund_ops.with_metrics(standins.fundamentals(spark, d)), tasks=tasks(EVENTS_PER_TASK, labelled(spark, d)))
    valued = fund_ops.with_valuation(fund_ops.attach_price(funded, prices(spark, d), tasks=tasks(ROWS_PER_TASK, prices(spark, d), labelled(spark, d))))
    return rounded(valued.select("event_key", *fund_ops.VALUATION_COLUMNS), 6)


_DOUBLE_HISTORY = [c for c in hist_ops.HISTORY_COLUMNS if not c.endswith(("count", "streak", "class", "since_last"))]


def _history(spark, d, columns):
    ev = events(spark, d)
    labels = labelled(spark, d).select("event_key", *[f"abnormal_return_{h}d" for h in (1, 3, 5)], "reaction_class")
    n = tasks(EVENTS_PER_TASK, ev)
    df = hist_ops.with_prior_history(hist_ops.join_dealt(ev, labels, "event_key", n), tasks=n)
    ints = {c: big(F.col(c)) for c in ("prior_earnings_count", "prior_days_since_last", "prior_reaction_streak")}
    return rounded(df.withColumns(ints).select("event_key", *columns))


_STATS = [c for c in hist_ops.HISTORY_COLUMNS if "trend" not in c and "streak" not in c]


@query(
    "prior_event_stats",
    with_ctes("SELECT event_key, " + ", ".join(f"ROUND({c}, 10) + 0.0 AS {c}" if c in _DOUBLE_HISTORY else c for c in _STATS) + " FROM hist", "hist"),
)
def prior_event_stats(spark, d):
    return _history(spark, d, _STATS)


@query("prior_reaction_trend", with_ctes("SELECT event_key, ROUND(prior_reaction_trend_4, 10) + 0.0 AS prior_reaction_trend_4, ROUND(prior_reaction_trend_8, 10) + 0.0 AS prior_reaction_trend_8 FROM hist", "hist"))
def prior_reaction_trend(spark, d):
    return _history(spark, d, ["prior_reaction_trend_4", "prior_reaction_trend_8"])


@query("reaction_streak", with_ctes("SELECT event_key, CAST(prior_reaction_streak AS BIGINT) AS prior_reaction_streak FROM hist", "hist"))
def reaction_streak(spark, d):
    return _history(spark, d, ["prior_reaction_streak"])


@query(
    "prior_history_known_labels",
    with_ctes(
        """
, k AS (SELECT e.event_key, e.symbol, e.period_ended, CASE WHEN m.reaction_start_date + 14 <= make_date(2001, 1, 1) THEN m.abnormal_return_5d END AS a FROM ev e LEFT JOIN mkt m USING (event_key))
SELECT event_key, CASE WHEN row_number() OVER w - 1 >= 4 THEN ROUND(avg(a) OVER (PARTITION BY symbol ORDER BY period_ended, event_key ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 10) + 0.0 END AS prior_abn_ret_5d_mean_4
FROM k WINDOW w AS (PARTITION BY symbol ORDER BY period_ended, event_key)""",
        "ev", "mkt",
    ).replace("\n,", ",", 1),
)
def prior_history_known_labels(spark, d):
    ev = events(spark, d)
    labels = labelled(spark, d).select("event_key", "reaction_start_date", *[f"abnormal_return_{h}d" for h in (1, 3, 5)], "reaction_class")
    known = F.coalesce(F.date_add("reaction_start_date", 14) <= F.lit("2001-01-01").cast("date"), F.lit(False))
    n = tasks(EVENTS_PER_TASK, ev)
    df = hist_ops.with_prior_history(hist_ops.join_dealt(ev, labels, "event_key", n).withColumn("known", known), known_before="known", tasks=n)
    return rounded(df.select("event_key", "prior_abn_ret_5d_mean_4"))


define(
    "lkd",
    """
WITH o AS (SELECT symbol, date, lead(date, 1) OVER w AS o1, lead(date, 3) OVER w AS o3, lead(date, 5) OVER w AS o5 FROM px WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT date, lead(date, 1) OVER w AS b1, lead(date, 3) OVER w AS b3, lead(date, 5) OVER w AS b5 FROM bench WINDOW w AS (ORDER BY date))
SELECT m.event_key, m.reaction_start_date, m.feature_cutoff_date, m.abnormal_return_1d, m.abnormal_return_3d, m.abnormal_return_5d, NULLIF(m.reaction_class, 'UNKNOWN') AS c,
  CASE WHEN o1 IS NOT NULL AND b1 IS NOT NULL THEN greatest(o1, b1) END AS label_known_1d, CASE WHEN o3 IS NOT NULL AND b3 IS NOT NULL THEN greatest(o3, b3) END AS label_known_3d,
  CASE WHEN o5 IS NOT NULL AND b5 IS NOT NULL THEN greatest(o5, b5) END AS label_known_5d
FROM mkt m ASOF LEFT JOIN o ON o.symbol = m.symbol AND o.date >= m.reaction_start_date ASOF LEFT JOIN b ON b.date >= m.reaction_start_date""",
    ("mkt", "px", "bench"),
)


@query("label_known_dates", with_ctes("SELECT event_key, label_known_1d, label_known_3d, label_known_5d FROM lkd", "lkd"))
def label_known_dates(spark, d):
    df = hist_ops.label_known_dates(
        labelled(spark, d), prices(spark, d), bench(spark, d), calendar(spark, d), tasks(ROWS_PER_TASK, prices(spark, d), labelled(spark, d))
    )
    return df.select("event_key", "label_known_1d", "label_known_3d", "label_known_5d")


def _known_at_sql() -> str:
    gate = lambda n, x, name: f"CASE WHEN rn - 1 >= {n} THEN {x} END AS {name}"
    cols = []
    for h in (1, 3, 5):
        cols.append(f"max(r{h}) FILTER (WHERE back = 1) AS prior_last_abn_ret_{h}d")
        cols += [gate(n, f"avg(r{h}) FILTER (WHERE back <= {n})", f"prior_abn_ret_{h}d_mean_{n}") for n in (2, 4, 8)]
        cols += [gate(n, f"quantile_cont(r{h}, 0.5) FILTER (WHERE back <= {n})", f"prior_abn_ret_{h}d_median_{n}") for n in (4, 8)]
        cols += [gate(n, f"stddev_samp(r{h}) FILTER (WHERE back <= {n})", f"prior_abn_ret_{h}d_std_{n}") for n in (4, 8)]
    for n in (4, 8):
        cols += [gate(n, f"count(*) FILTER (WHERE back <= {n} AND c = '{k}') / {n}.0::DOUBLE", f"prior_{k.lower()}_rate_{n}") for k in ("POSITIVE", "NEGATIVE", "NEUTRAL")]
        slope = f"CASE WHEN count(sgn) FILTER (WHERE back <= {n}) >= 2 THEN regr_slope(sgn, xi) FILTER (WHERE back <= {n} AND sgn IS NOT NULL) END"
        cols.append(gate(n, slope, f"prior_reaction_trend_{n}"))
    cols += [gate(n, f"avg(abs(r5)) FILTER (WHERE back <= {n})", f"prior_avg_reaction_magnitude_{n}") for n in (2, 4, 8)]
    seen = ", ".join(f"CASE WHEN p.label_known_{h}d <= q.feature_cutoff_date THEN p.abnormal_return_{h}d END AS r{h}" for h in (1, 3, 5))
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    return f"""
, l AS (SELECT e.event_key, e.symbol, e.period_ended, k.* EXCLUDE (event_key), CASE WHEN k.abnormal_return_3d IS NOT NULL THEN k.label_known_3d WHEN k.abnormal_return_1d IS NOT NULL THEN k.label_known_1d END AS kc,
   row_number() OVER (PARTITION BY e.symbol ORDER BY e.period_ended, e.event_key) AS rn FROM ev e LEFT JOIN lkd k ON k.event_key = e.event_key),
pairs AS (SELECT q.event_key, q.rn, q.rn - p.rn AS back, {seen}, CASE WHEN p.kc <= q.feature_cutoff_date THEN p.c END AS c, datediff('day', p.period_ended, q.period_ended) AS days FROM l q LEFT JOIN l p ON p.symbol = q.symbol AND p.rn < q.rn),
sg AS (SELECT *, CASE c WHEN 'POSITIVE' THEN 1 WHEN 'NEUTRAL' THEN 0 WHEN 'NEGATIVE' THEN -1 END AS sgn FROM pairs),
x AS (SELECT *, row_number() OVER (PARTITION BY event_key, sgn IS NULL ORDER BY back DESC) AS xi, max(CASE WHEN back = 1 THEN c END) OVER (PARTITION BY event_key) AS lastc FROM sg),
g AS (SELECT event_key, rn - 1 AS prior_earnings_count, max(c) FILTER (WHERE back = 1) AS prior_last_reaction_class, max(days) FILTER (WHERE back = 1) AS prior_days_since_last, {', '.join(cols)},
   CASE WHEN rn > 1 THEN greatest(1, coalesce(min(back) FILTER (WHERE NOT coalesce(c = lastc, false)), rn) - 1) END AS prior_reaction_streak FROM x GROUP BY event_key, rn)
SELECT event_key, prior_earnings_count, prior_last_reaction_class, prior_days_since_last, {', '.join(f'ROUND({n}, 10) + 0.0 AS {n}' for n in names)}, prior_reaction_streak FROM g"""


@query("prior_history_at_cutoff", with_ctes(_known_at_sql(), "ev", "lkd").replace("\n,", ",", 1))
def prior_history_at_cutoff(spark, d):
    """Every event's history from what was known at its own cutoff; events without a cutoff see no labels."""
    dated = hist_ops.label_known_dates(
        labelled(spark, d), prices(spark, d), bench(spark, d), calendar(spark, d), tasks(ROWS_PER_TASK, prices(spark, d), labelled(spark, d))
    )
    columns = ["event_key", "feature_cutoff_date", *[f"abnormal_return_{h}d" for h in (1, 3, 5)], "reaction_class", *[f"label_known_{h}d" for h in (1, 3, 5)]]
    n = tasks(EVENTS_PER_TASK, events(spark, d))
    df = hist_ops.with_history_known_at(hist_ops.join_dealt(events(spark, d), dated.select(*columns), "event_key", n).repartition(n, "symbol"))
    ints = {c: big(F.col(c)) for c in ("prior_earnings_count", "prior_days_since_last", "prior_reaction_streak")}
    return rounded(df.withColumns(ints).select("event_key", *hist_ops.HISTORY_COLUMNS))


@query(
    "model_table",
    with_ctes(
        "SELECT event_key, reaction_class, CAST(prior_earnings_count AS BIGINT) AS prior_earnings_count, ROUND(return_5d, 10) + 0.0 AS return_5d, ROUND(fund_roe, 10) + 0.0 AS fund_roe, ROUND(val_pe, 8) + 0.0 AS val_pe, ROUND(abnormal_return_3d, 10) + 0.0 AS abnormal_return_3d, fundamental_pit_status FROM ml",
        "ml",
    ),
)
def model_table(spark, d):
    df = build_model(spark, d)
    return df.select(
        "event_key", "reaction_class", big(F.col("prior_earnings_count")).alias("prior_earnings_count"),
        *[(F.round(c, 10) + F.lit(0.0)).alias(c) for c in ("return_5d", "fund_roe", "abnormal_return_3d")],
        (F.round("val_pe", 8) + F.lit(0.0)).alias("val_pe"), "fundamental_pit_status",
    )

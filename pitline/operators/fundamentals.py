"""Statement metrics, their point-in-time attachment to events, and valuation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.functions.nullsafe import first_present, safe_divide
from pitline.operators.asof import asof_join

FILING_LAG_DAYS = 45

# Statement columns as delivered and their short names. Fixed values.
COLUMN_NAMES = {
    "q_is_Total Revenue": "revenue",
    "q_is_Gross Profit": "gross_profit",
    "q_is_Operating Income": "operating_income",
    "q_is_Operating Expense": "operating_expense",
    "q_is_Net Income": "net_income",
    "q_is_Net Income Common Stockholders": "net_income_common",
    "q_is_EBIT": "ebit",
    "q_is_EBITDA": "ebitda",
    "q_is_Diluted EPS": "eps_diluted",
    "q_is_Basic EPS": "eps_basic",
    "q_is_Diluted Average Shares": "shares_diluted",
    "q_is_Basic Average Shares": "shares_basic",
    "q_is_Interest Expense": "interest_expense",
    "q_is_Tax Provision": "tax_provision",
    "q_is_Pretax Income": "pretax_income",
    "q_is_Cost Of Revenue": "cost_of_revenue",
    "q_is_Operating Revenue": "operating_revenue",
    "q_is_Selling General And Administration": "sga",
    "q_is_Interest Income": "interest_income",
    "q_is_Normalized Income": "normalized_income",
    "q_is_Normalized EBITDA": "normalized_ebitda",
    "q_bs_Total Assets": "total_assets",
    "q_bs_Total Debt": "total_debt",
    "q_bs_Cash And Cash Equivalents": "cash",
    "q_bs_Cash Cash Equivalents And Short Term Investments": "cash_and_sti",
    "q_bs_Stockholders Equity": "equity",
    "q_bs_Current Assets": "current_assets",
    "q_bs_Current Liabilities": "current_liabilities",
    "q_bs_Total Liabilities Net Minority Interest": "total_liabilities",
    "q_bs_Long Term Debt": "long_term_debt",
    "q_bs_Current Debt": "current_debt",
    "q_bs_Ordinary Shares Number": "shares_outstanding",
    "q_bs_Working Capital": "working_capital",
    "q_bs_Net Debt": "net_debt",
    "q_bs_Retained Earnings": "retained_earnings",
    "q_bs_Total Equity Gross Minority Interest": "total_equity",
    "q_cf_Operating Cash Flow": "operating_cash_flow",
    "q_cf_Capital Expenditure": "capex",
    "q_cf_Free Cash Flow": "free_cash_flow",
    "q_cf_Investing Cash Flow": "investing_cash_flow",
    "q_cf_Financing Cash Flow": "financing_cash_flow",
    "q_cf_Change In Working Capital": "change_in_working_capital",
    "q_cf_Depreciation And Amortization": "depreciation_amortization",
    "q_cf_Net Income From Continuing Operations": "cf_net_income",
    "a_is_Total Revenue": "a_revenue",
    "a_is_Gross Profit": "a_gross_profit",
    "a_is_Operating Income": "a_operating_income",
    "a_is_Net Income": "a_net_income",
    "a_is_Diluted EPS": "a_eps_diluted",
    "a_bs_Total Assets": "a_total_assets",
    "a_bs_Total Debt": "a_total_debt",
    "a_bs_Cash And Cash Equivalents": "a_cash",
    "a_bs_Stockholders Equity": "a_equity",
    "a_bs_Current Assets": "a_current_assets",
    "a_bs_Current Liabilities": "a_current_liabilities",
    "a_bs_Long Term Debt": "a_long_term_debt",
    "a_bs_Ordinary Shares Number": "a_shares_outstanding",
    "a_cf_Operating Cash Flow": "a_operating_cash_flow",
    "a_cf_Capital Expenditure": "a_capex",
    "a_cf_Free Cash Flow": "a_free_cash_flow",
}

# name -> numerator and denominator (SQL text over statement columns)
_RATIOS = {
    "operating_margin": ("operating_income", "revenue"),
    "net_margin": ("net_income", "revenue"),
    "ebitda_margin": ("ebitda", "revenue"),
    "debt_to_equity": ("total_debt", "equity"),
    "current_ratio": ("current_assets", "current_liabilities"),
    "roe": ("net_income", "equity"),
    "roa": ("net_income", "total_assets"),
    "roce": ("ebit", "total_assets - current_liabilities"),
    "fcf_margin": ("free_cash_flow", "revenue"),
    "fcf_to_debt": ("free_cash_flow", "total_debt"),
    "asset_turnover": ("revenue", "total_assets"),
}
_GROWTH = {"revenue_growth": "revenue", "eps_growth": "eps_diluted", "net_income_growth": "net_income"}
DERIVED_METRICS = [*(f"{name}_{suffix}" for name in _GROWTH for suffix in ("qoq", "yoy")), *_RATIOS, "cash_to_debt"]
VALUATION_COLUMNS = [f"val_{c}" for c in ("market_cap", "pe", "earnings_yield", "pb", "ps", "ev", "ev_ebitda", "pcf")]


def standardize_columns(statements: DataFrame) -> DataFrame:
    return statements.withColumnsRenamed(COLUMN_NAMES)


def available_columns(columns: Sequence[str]) -> dict[str, str]:
    """Short name to delivered name, for the delivered columns that are present."""
    return {short: raw for raw, short in COLUMN_NAMES.items() if raw in columns}


def with_metrics(statements: DataFrame, quarterly_rows: bool = False) -> DataFrame:
    """Growth, margins, leverage, returns and turnover, each only where its inputs exist as columns.

    Growth looks one and four rows back within the symbol (rows, whatever their spacing); with ``quarterly_rows`` it passes
    over rows that hold annual values alone. A symbol has one row per
    reporting period, so its window is small however many raw rows fed it.
    """
    have = set(statements.columns)
    w = "PARTITION BY symbol ORDER BY period_end_date"
    if quarterly_rows:
        quarterly = [c for c in statements.columns if c not in ("symbol", "period_end_date") and not c.startswith("a_")]
        w = f"PARTITION BY symbol, {' OR '.join(f'`{c}` IS NOT NULL' for c in quarterly) or 'true'} ORDER BY period_end_date"
    lags, metrics = [], {}
    for name, source in _GROWTH.items():
        if source in have:
            for suffix, k in (("qoq", 1), ("yoy", 4)):
                lags.append(f"lag({source}, {k}) OVER ({w}) AS __{name}_{suffix}")
                previous = F.col(f"__{name}_{suffix}")
                metrics[f"{name}_{suffix}"] = safe_divide(F.col(source) - previous, F.abs(previous))
    for name, (num, den) in _RATIOS.items():
        if {num, *den.split(" - ")} <= have:
            metrics[name] = safe_divide(F.expr(num), F.expr(den))
    cash = "cash" if "cash" in have else "cash_and_sti"
    if {cash, "total_debt"} <= have:
        metrics["cash_to_debt"] = safe_divide(F.col(cash), F.col("total_debt"))
    return statements.selectExpr("*", *lags).withColumns(metrics).select(*statements.columns, *metrics)


def attach_point_in_time(events: DataFrame, statements: DataFrame, lag_days: int = FILING_LAG_DAYS, tasks: int | None = None) -> DataFrame:
    """The latest statement usable at each event's cutoff, as ``fund_`` columns.

    Usable means: the reporting period ends before the event's own period, and ends at least ``lag_days`` before the
    cutoff. Both are bounds on the same date, so this is one backward as-of join. The latest usable statement is taken
    even when many of its values are missing. Without event period there is no match.
    """
    metrics = [c for c in statements.columns if c not in ("symbol", "period_end_date")]
    bound = F.when(
        F.col("period_ended").isNotNull() & F.col("feature_cutoff_date").isNotNull(),
        F.least(F.date_sub("period_ended", 1), F.date_sub("feature_cutoff_date", lag_days)),
    )
    right = statements.select(
        "symbol", F.col("period_end_date").alias("fundamental_period_end_date"), *[F.col(c).alias(f"fund_{c}") for c in metrics]
    )
    joined = asof_join(
        events.withColumn("__bound", bound),
        right,
        ["symbol"],
        "__bound",
        "fundamental_period_end_date",
        ["fundamental_period_end_date", *[f"fund_{c}" for c in metrics]],
        tasks=tasks,
    )
    period = F.col("fundamental_period_end_date")
    available = F.date_add(period, lag_days)
    return joined.withColumns(
        {
            "fundamental_estimated_available_date": available,
            "fundamental_pit_status": F.when(period.isNull(), "unavailable").otherwise("estimated_conservative"),
            "fundamental_lag_days": F.datediff(F.col("feature_cutoff_date"), available),
        }
    ).drop("__bound")


def _pick(columns: Sequence[str], *preferred: str) -> Column:
    present = [F.col(c) for c in preferred if c in columns]
    return first_present(*present) if present else F.lit(None).cast("double")


def with_valuation(events: DataFrame, price: str = "price") -> DataFrame:
    """Valuation ratios from the price at the cutoff and the attached statement; all NULL without a price."""
    names = events.columns
    inputs = events.withColumns(
        {
            "__shares": _pick(names, "fund_shares_outstanding", "fund_shares_diluted", "fund_shares_basic", "fund_a_shares_outstanding"),
            "__equity": _pick(names, "fund_equity", "fund_total_equity", "fund_a_equity"),
            "__eps": _pick(names, "fund_eps_diluted", "fund_eps_basic", "fund_a_eps_diluted"),
            "__ebitda": _pick(names, "fund_ebitda", "fund_normalized_ebitda"),
            "__debt": _pick(names, "fund_total_debt", "fund_a_total_debt"),
            "__cash": _pick(names, "fund_cash_and_sti", "fund_cash", "fund_a_cash"),
            "__revenue": _pick(names, "fund_revenue"),
            "__ocf": _pick(names, "fund_operating_cash_flow"),
        }
    )
    p, shares = F.col(price), F.col("__shares")
    cap = F.when(shares > 0, p * shares)
    first = inputs.withColumns(
        {
            "val_market_cap": cap,
            "val_pe": safe_divide(p, F.col("__eps")),
            "val_pb": safe_divide(p, F.when(shares > 0, F.try_divide(F.col("__equity"), shares))),
            "val_ps": F.when(F.col("__revenue") > 0, F.try_divide(cap, F.col("__revenue"))),
            "val_pcf": F.when(F.col("__ocf") > 0, F.try_divide(cap, F.col("__ocf"))),
            "val_ev": cap + F.col("__debt") - F.col("__cash"),
        }
    )
    return first.withColumns(
        {
            "val_earnings_yield": safe_divide(F.lit(1.0), F.col("val_pe")),
            "val_ev_ebitda": safe_divide(F.col("val_ev"), F.col("__ebitda")),
        }
    ).select(*names, *VALUATION_COLUMNS)


def attach_price(
    events: DataFrame, prices: DataFrame, on: str = "feature_cutoff_date", name: str = "price", tasks: int | None = None
) -> DataFrame:
    """Last close at or before ``on``."""
    px = prices.select("symbol", F.col("date").alias("__price_date"), F.col("close").alias(name))
    return asof_join(events, px, ["symbol"], on, "__price_date", [name], tasks=tasks)

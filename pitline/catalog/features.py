"""The model table's features by name, as the SQL partners need them, and the split model table."""

from __future__ import annotations

from pitline.catalog.ctes import define
from pitline.catalog.fundamentals import FUND_COLUMNS
from pitline.operators.fundamentals import VALUATION_COLUMNS
from pitline.operators.history import HISTORY_COLUMNS
from pitline.operators.prices import PRICE_FEATURES, RELATIVE_COLUMNS
from pitline.plans.roles import feature_group
from pitline.standins import TRAIN_END, VAL_END

TEXT_FEATURES = ["prior_last_reaction_class"]
WHOLE_FEATURES = ["prior_earnings_count", "prior_days_since_last", "prior_reaction_streak"]
FUND_FEATURES = [f"fund_{c}" for c in FUND_COLUMNS]
NUMERIC_FEATURES = sorted([*PRICE_FEATURES, *RELATIVE_COLUMNS, *FUND_FEATURES, *VALUATION_COLUMNS, *[c for c in HISTORY_COLUMNS if c not in TEXT_FEATURES]])
FEATURES = sorted([*NUMERIC_FEATURES, *TEXT_FEATURES])


def by_group(column: str) -> str:
    """SQL for the group of the feature named by a column."""
    groups = sorted({feature_group(c) for c in FEATURES})
    cases = " ".join(f"WHEN {column} IN ({', '.join(repr(c) for c in FEATURES if feature_group(c) == g)}) THEN '{g}'" for g in groups)
    return f"CASE {cases} END"


GROUP_SQL = by_group("feature")

define(
    "mls",
    f"SELECT *, CASE WHEN period_ended <= DATE '{TRAIN_END}' THEN 'train' WHEN period_ended <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END AS split FROM ml",
    ("ml",),
)

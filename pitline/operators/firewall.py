"""Leakage checks before training: schema checks on names, row checks in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.plans.roles import AUDIT_COLUMNS, META_COLUMNS, TARGET_COLUMNS

FORBIDDEN = {*TARGET_COLUMNS, *META_COLUMNS, *AUDIT_COLUMNS, "reaction_start_datetime"}
# Name fragments that point to the future.
FUTURE_WORDS = ["future", "forward", "next_", "t+1", "t+2", "t+3", "t_plus", "lead_", "lag_-", "predicted_", "forecast_"]
LEAK_WORDS = ["after", "future", "forward", "next", "target", "label"]
MAX_PRIOR_COUNT = 100


class LeakageError(Exception):
    """A leakage check failed."""


def name_checks(features: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(check, offending names) for a list of feature names."""
    return [
        ("no target leakage", [c for c in features if c in FORBIDDEN]),
        ("no post-event columns", [c for c in features if "_after" in c.lower()]),
        ("no future-looking names", [c for c in features if any(w in c.lower() for w in FUTURE_WORDS)]),
    ]


def suspicious_names(features: Sequence[str]) -> list[tuple[str, str]]:
    """(name, first matching word) of features whose names suggest leakage."""
    hits = ((c, next((w for w in LEAK_WORDS if w in c.lower()), None)) for c in features)
    return [(c, w) for c, w in hits if w]


_ROW_CHECKS = {
    "cutoff before reaction": "feature_cutoff_date >= reaction_start_date",
    "cutoff not after announcement": "feature_cutoff_date > result_announcement_datetime",
    "reaction not before announcement": "reaction_start_date < cast(result_announcement_datetime AS date)",
    "prior count plausible": f"prior_earnings_count < 0 OR prior_earnings_count > {MAX_PRIOR_COUNT}",
    "fundamentals available at cutoff": "fundamental_estimated_available_date > feature_cutoff_date",
    "fundamentals from earlier period": "fundamental_period_end_date >= period_ended",
}


def row_checks(df: DataFrame) -> DataFrame:
    """(check, split, violations): every row check for every split, from one pass over the labelled table."""
    checks = {n: c for n, c in _ROW_CHECKS.items() if all(w in df.columns for w in _columns_of(c))}
    counts = df.groupBy("split").agg(*[F.expr(f"count_if({c})").alias(f"v{i}") for i, c in enumerate(checks.values())])
    entries = ", ".join(f"struct('{n}' AS check, v{i} AS violations)" for i, n in enumerate(checks))
    return counts.selectExpr("split", f"explode(array({entries})) AS c").selectExpr("c.check", "split", "c.violations")


def _columns_of(condition: str) -> list[str]:
    known = (*META_COLUMNS, *AUDIT_COLUMNS, "prior_earnings_count")
    return [c for c in known if c in condition]


def key_checks(df: DataFrame, on: str = "period_ended") -> DataFrame:
    """(check, violations): keys shared between splits, duplicate keys, and order of the splits."""
    keys = df.groupBy("event_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    per_key = keys.agg(F.expr("count_if(splits > 1)").alias("shared"), F.expr("coalesce(sum(n - 1), 0)").alias("extra"))
    edge = df.agg(
        *[F.expr(f"{f}(CASE WHEN split = '{s}' THEN {on} END)").alias(f"{s}_{f}") for s, f in (("train", "max"), ("val", "min"), ("val", "max"), ("test", "min"))]
    )
    order = "cast(NOT coalesce(train_max < val_min, false) AS bigint) + cast(NOT coalesce(val_max < test_min, false) AS bigint)"
    return per_key.selectExpr(
        "explode(array(struct('disjoint event keys' AS check, cast(shared AS bigint) AS violations),"
        " struct('no duplicate event keys' AS check, cast(extra AS bigint) AS violations))) AS c"
    ).selectExpr("c.*").unionByName(edge.selectExpr("'chronological order' AS check", f"{order} AS violations"))


def run_firewall(df: DataFrame, features: Sequence[str], strict: bool = True) -> DataFrame:
    """All checks as (check, passed, details). ``strict`` raises on the first failure instead of reporting it."""
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(n, not bad, "OK" if not bad else ", ".join(bad)) for n, bad in name_checks(features)], "check string, passed boolean, details string"
    )
    rows = row_checks(df).selectExpr(
        "concat(check, ' (', split, ')') AS check", "violations = 0 AS passed", "CASE WHEN violations = 0 THEN 'OK' ELSE concat(violations, ' violations') END AS details"
    )
    keys = key_checks(df).selectExpr(
        "check", "violations = 0 AS passed", "CASE WHEN violations = 0 THEN 'OK' ELSE concat(violations, ' violations') END AS details"
    )
    result = names.unionByName(rows).unionByName(keys)
    if strict:
        failed = result.where("NOT passed").orderBy("check").first()
        if failed is not None:
            raise LeakageError(f"{failed['check']}: {failed['details']}")
    return result

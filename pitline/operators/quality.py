"""The quality audit of a model table: twenty checks in one table.

What one pass can count is observed while the table is written down, so it costs no pass of its own; what needs values of each
feature comes from the counted table; only a few checks group the table again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pitline.operators.audits import duplicate_counts, outlier_shares
from pitline.operators.splits import fraction_split
from pitline.session import stage

LEAKING_WORDS = ("after", "future", "forward", "next", "target", "label")
DATES = ("period_ended", "feature_cutoff_date", "reaction_start_date")
CHECKED_TARGETS = ("reaction_class", "abnormal_return_1d", "abnormal_return_3d", "abnormal_return_5d")
HAS_STATEMENT = "fundamental_pit_status = 'estimated_conservative'"

#: Aggregates without grouping, by name; each counts violations where its name says so.
OBSERVED = {
    "rows": "count(*)",
    **{f"{f}_{c}": f"cast({f}({c}) AS string)" for c in DATES for f in ("min", "max")},
    **{f"missing_{t}": f"count_if({t} IS NULL)" for t in CHECKED_TARGETS},
    "with_statement": f"count_if({HAS_STATEMENT})",
    "mean_price_history": "avg(price_history_days)",
    "mean_benchmark_history": "avg(benchmark_history_days)",
    "bad_cutoff_before_reaction": "count_if(NOT coalesce(feature_cutoff_date < reaction_start_date, false))",
    "bad_cutoff_before_announcement": "count_if(NOT coalesce(feature_cutoff_date <= result_announcement_datetime, false))",
    "bad_reaction_after_announcement": "count_if(NOT coalesce(reaction_start_date >= cast(result_announcement_datetime AS date), false))",
    "bad_statement_available": "count_if(fundamental_estimated_available_date > feature_cutoff_date)",
    "bad_statement_earlier": "count_if(fundamental_period_end_date >= period_ended)",
    "same_class_as_last": "count_if(prior_last_reaction_class = reaction_class)",
}


def stage_observed(df: DataFrame) -> tuple[DataFrame, dict]:
    """``df`` written to the shared folder, and the OBSERVED metrics of its rows, gathered by the tasks that write it."""
    seen = Observation()
    staged = stage(df.observe(seen, *[F.expr(e).alias(n) for n, e in OBSERVED.items()]))
    return staged, seen.get


def quality_audit(df: DataFrame, facts: dict, counted: DataFrame, profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """(check_no, check, subject, number, text, passed): what each check found; ``passed`` is NULL where it only reports.

    ``facts`` comes from ``stage_observed``, ``counted`` and ``profile`` from the counted values of ``features``. The scalars are
    a handful of rows; each grouped check is bounded by companies, years, classes or features.
    """
    rows = facts["rows"]
    types = dict(df.dtypes)
    one: list[tuple] = [
        (1, "shape", "rows", float(rows), None, rows > 0),
        (1, "shape", "columns", float(len(df.columns)), None, None),
        *[(2, "event range", f"{f} {c}", None, facts[f"{f}_{c}"], None) for c in DATES for f in ("min", "max")],
        *[(6, "missing target", t, float(facts[f"missing_{t}"]), None, None) for t in CHECKED_TARGETS],
        (10, "statements", "events with one", float(facts["with_statement"]), None, None),
        (11, "price history", "mean days", facts["mean_price_history"], None, None),
        (11, "price history", "mean benchmark days", facts["mean_benchmark_history"], None, None),
        *[(13, "column types", t, float(sum(v == t for v in types.values())), None, None) for t in sorted(set(types.values()))],
        *[(17, "leaking names", c, None, next(w for w in LEAKING_WORDS if w in c.lower()), False) for c in features if any(w in c.lower() for w in LEAKING_WORDS)],
        *[(18, "point in time", n.removeprefix("bad_").replace("_", " "), float(v), None, v == 0) for n, v in facts.items() if n.startswith("bad_")],
        (19, "own history", "prior features", float(sum(c.startswith("prior_") for c in features)), None, None),
        (19, "own history", "same class as the last event", float(facts["same_class_as_last"]), None, None),
    ]
    table = df.sparkSession.createDataFrame(one, "check_no int, check string, subject string, number double, text string, passed boolean")

    def part(no: int, name: str, source: DataFrame, subject: str, number: str, passed: str = "cast(NULL AS boolean)", text: str = "cast(NULL AS string)"):
        return source.selectExpr(f"{no} AS check_no", f"'{name}' AS check", f"{subject} AS subject", f"cast({number} AS double) AS number", f"{text} AS text", f"{passed} AS passed")

    classes = df.groupBy("reaction_class").agg(F.count(F.lit(1)).alias("n"))
    by_year = df.groupBy(F.year("period_ended").alias("year"), "reaction_class").agg(F.count(F.lit(1)).alias("n"))
    shares = by_year.selectExpr("year", "reaction_class", "n / sum(n) OVER (PARTITION BY year) AS share")
    placed = fraction_split(df.select("period_ended", "reaction_class")).where("split IS NOT NULL")
    spans = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("period_ended").alias("low"), F.max("period_ended").alias("high"))
    edges = spans.agg(*[F.expr(f"max(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{c}") for s in ("train", "val", "test") for c in ("low", "high")])
    dense = "round(100.0D * (1 - present / n), 6)"
    statement = df.where(HAS_STATEMENT)
    fund = [c for c in features if c.startswith("fund_")]
    cover = statement.agg(*[F.expr(f"round(100.0D * count(`{c}`) / count(*), 6) AS c{i}") for i, c in enumerate(fund)]) if fund else None
    parts = [
        part(3, "events per symbol", df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol", "n"),
        part(4, "repeated event keys", duplicate_counts(df, ["event_key"]), "'extra rows'", "extra_rows", "extra_rows = 0"),
        part(5, "repeated symbol and period", duplicate_counts(df, ["symbol", "period_ended"]), "'extra rows'", "extra_rows", "extra_rows = 0"),
        part(7, "target distribution", classes, "coalesce(reaction_class, 'MISSING')", "n"),
        part(8, "missing values", profile, "feature", dense),
        part(9, "mostly missing", profile.where("present < 0.5 * n"), "feature", dense, "false"),
        part(12, "classes by year", shares, "concat(year, ' ', coalesce(reaction_class, 'MISSING'))", "round(share, 6)"),
        part(14, "infinite values", profile.where("infinite > 0"), "feature", "infinite", "false"),
        part(15, "constant features", profile.where("distinct <= 1"), "feature", "distinct", "false"),
        part(16, "suspicious features", outlier_shares(counted, profile).where("suspicious"), "feature", "outliers", "false"),
        part(20, "chronological split", spans, "split", "n", text="concat(low, ' to ', high)"),
        part(20, "chronological split", edges, "'no overlap'", "CAST(NULL AS double)", "coalesce(train_high < val_low AND val_high < test_low, false)"),
        part(20, "chronological split", placed.groupBy("split", "reaction_class").agg(F.count(F.lit(1)).alias("n")), "concat(split, ' ', coalesce(reaction_class, 'MISSING'))", "n"),
    ]
    if cover is not None:
        entries = ", ".join(f"struct('{c}' AS feature, c{i} AS pct)" for i, c in enumerate(fund))
        parts.append(part(10, "statements", cover.selectExpr(f"explode(array({entries})) AS e").selectExpr("e.*"), "feature", "pct"))
    for p in parts:
        table = table.unionByName(p)
    return table

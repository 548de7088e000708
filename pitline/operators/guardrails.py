"""Prediction checks and metrics from aggregates over a predictions table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLLAPSE_PROBABILITY = 0.99
MIN_ROW_SUM = 0.99
COLLAPSE_SHARE = 0.95
MIN_IMPROVEMENT = 0.01
LOG_FLOOR = 2.220446049250313e-16


class GuardrailViolation(Exception):
    """Predictions are degenerate or no better than a baseline."""


#: Classes that labels and predictions may have; their counts are gathered on the driver.
MAX_CLASSES = 100


def class_counts(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n): the confusion counts every class metric is computed from."""
    return df.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def check_classes(df: DataFrame, valid: Sequence[str] | None = None, min_classes: int = 2) -> dict[str, int]:
    """Raise on empty, NULL, too uniform or invalid predictions; otherwise the predicted counts per class."""
    # one row per pair of classes; labels that are free text are refused before they reach the driver
    rows = class_counts(df).limit(MAX_CLASSES**2 + 1).collect()
    if len(rows) > MAX_CLASSES**2:
        raise GuardrailViolation(f"more than {MAX_CLASSES} classes among labels and predictions")
    if not rows:
        raise GuardrailViolation("empty predictions")
    missing = sum(r["n"] for r in rows if r["y_pred"] is None)
    if missing:
        raise GuardrailViolation(f"NaN predictions: {missing}")
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["y_pred"]] = counts.get(r["y_pred"], 0) + r["n"]
    allowed = list(valid) if valid is not None else sorted({r["y_true"] for r in rows if r["y_true"] is not None})
    if len(counts) < min_classes:
        raise GuardrailViolation(f"degenerate predictions: only {len(counts)} class(es) predicted: {counts}")
    invalid = sorted(set(counts) - set(allowed))
    if invalid:
        raise GuardrailViolation(f"invalid prediction labels: {invalid}")
    return {c: counts.get(c, 0) for c in allowed}


def class_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro-F1, balanced accuracy and accuracy of the predictions and of the majority-class baseline.

    Everything follows from the confusion counts; equal class sizes resolve to the smaller label.
    """
    by = list(by)
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.selectExpr(
        *by, "explode(array(struct(y_true AS c, n AS t, 0L AS p, CASE WHEN y_true = y_pred THEN n ELSE 0L END AS tp),"
        " struct(y_pred AS c, 0L AS t, n AS p, 0L AS tp))) AS s"
    ).selectExpr(*by, "s.*")
    per_class = sides.groupBy(*by, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    known = per_class.where("t > 0")  # the label set is that of the truth
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    total = known.selectExpr(
        "*", f"sum(t) OVER ({part}) AS total", f"row_number() OVER ({part} ORDER BY t DESC, c) = 1 AS majority"
    )
    measures = [
        F.expr("max(CASE WHEN majority THEN c END) AS majority_class"),
        F.expr("avg(coalesce(try_divide(2.0D * tp, t + p), 0.0D)) AS macro_f1"),
        F.expr("avg(tp / t) AS balanced_accuracy"),
        F.expr("sum(tp) / max(total) AS accuracy"),
        F.expr("avg(CASE WHEN majority THEN 2.0D * t / (t + total) ELSE 0.0D END) AS baseline_macro_f1"),
        F.expr("avg(CASE WHEN majority THEN 1.0D ELSE 0.0D END) AS baseline_balanced_accuracy"),
        F.expr("max(CASE WHEN majority THEN t END) / max(total) AS baseline_accuracy"),
    ]
    return (total.groupBy(*by) if by else total.groupBy()).agg(*measures)


def require_better_than_majority(df: DataFrame, margin: float = MIN_IMPROVEMENT) -> dict:
    row = class_metrics(df).first().asDict()
    for name in ("macro_f1", "balanced_accuracy"):
        gain = row[name] - row[f"baseline_{name}"]
        if gain < margin:
            raise GuardrailViolation(f"does not beat the majority class: {name} improves by {gain:.4f}, needs {margin}")
    return row


def log_loss(df: DataFrame, classes: Sequence[str], truth: str = "y_true", proba: str = "y_proba") -> DataFrame:
    """Mean negative log of the (row-normalised) probability given to the true class."""
    names = ", ".join(f"'{c}'" for c in classes)
    share = f"element_at({proba}, cast(array_position(array({names}), {truth}) AS int)) / aggregate({proba}, 0.0D, (a, x) -> a + x)"
    return df.agg(F.expr(f"avg(-ln(least(greatest({share}, {LOG_FLOOR}D), 1.0D))) AS log_loss"))


def probability_stats(df: DataFrame, n_classes: int, proba: str = "y_proba") -> DataFrame:
    """One row: sizes, missing, infinite, row sums out of range, collapsed rows, and spreads."""
    rows = df.selectExpr(
        f"size({proba}) AS width",
        f"size(filter({proba}, x -> x IS NULL OR isnan(x))) AS nans",
        f"size(filter({proba}, x -> abs(x) = double('Infinity'))) AS infs",
        f"aggregate({proba}, 0.0D, (a, x) -> a + x) AS total",
        f"array_max({proba}) AS top",
    )
    return rows.agg(
        F.expr("count(*) AS n_samples"),
        F.expr(f"count_if(width <> {n_classes}) AS wrong_width"),
        F.expr("coalesce(sum(nans), 0) AS nan_values"),
        F.expr("coalesce(sum(infs), 0) AS infinite_values"),
        F.expr(f"count_if(total < {MIN_ROW_SUM} OR total > 1 / {MIN_ROW_SUM}) AS bad_row_sums"),
        F.expr(f"count_if(top > {COLLAPSE_PROBABILITY}) AS collapsed_samples"),
        F.expr("avg(top) AS max_prob_mean"),
        F.expr("max(top) AS max_prob_max"),
        F.expr("min(top) AS max_prob_min"),
        F.expr("avg(total) AS row_sum_mean"),
        F.expr("stddev_pop(total) AS row_sum_std"),
    )


def check_probabilities(df: DataFrame, n_classes: int, proba: str = "y_proba") -> dict:
    row = probability_stats(df, n_classes, proba).first().asDict()
    for key, text in (
        ("wrong_width", "probability shape mismatch"),
        ("nan_values", "NaN probabilities"),
        ("infinite_values", "infinite probabilities"),
        ("bad_row_sums", "probability mass violation"),
    ):
        if row[key]:
            raise GuardrailViolation(f"{text}: {row[key]}")
    if row["n_samples"] and row["collapsed_samples"] > COLLAPSE_SHARE * row["n_samples"]:
        raise GuardrailViolation(f"probability collapse: {row['collapsed_samples']} of {row['n_samples']} rows")
    return row


def regression_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """MAE and RMSE of the predictions and of the mean of the truth, their ratios, and defects, in two passes."""
    usable = df.selectExpr(f"cast({truth} AS double) AS t", f"cast({pred} AS double) AS p")
    errors = usable.withColumn("m", usable.agg(F.avg("t")).scalar())
    stats = errors.agg(
        F.expr("count(*) AS n"),
        F.expr("count_if(p IS NULL OR isnan(p)) AS nan_values"),
        F.expr("count_if(abs(p) = double('Infinity')) AS infinite_values"),
        F.expr("stddev_pop(p) AS pred_std"),
        F.expr("avg(abs(t - p)) AS mae"),
        F.expr("sqrt(avg((t - p) * (t - p))) AS rmse"),
        F.expr("max(m) AS baseline_mean"),
        F.expr("avg(abs(t - m)) AS baseline_mae"),
        F.expr("sqrt(avg((t - m) * (t - m))) AS baseline_rmse"),
    )
    return stats.selectExpr("*", "try_divide(mae, baseline_mae) AS mae_ratio", "try_divide(rmse, baseline_rmse) AS rmse_ratio")


def check_regression(df: DataFrame, max_ratio: float = 1.0) -> dict:
    row = regression_metrics(df).first().asDict()
    if not row["n"]:
        raise GuardrailViolation("empty predictions")
    if row["nan_values"]:
        raise GuardrailViolation(f"NaN predictions: {row['nan_values']}")
    if row["infinite_values"]:
        raise GuardrailViolation(f"infinite predictions: {row['infinite_values']}")
    if row["pred_std"] < 1e-10:
        raise GuardrailViolation("constant predictions")
    for name in ("mae", "rmse"):
        ratio = row[f"{name}_ratio"]
        if ratio is None or ratio > max_ratio:
            raise GuardrailViolation(f"regression does not beat baseline: {name} ratio {ratio}")
    return row


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (k * n_c)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    return counts.selectExpr(label, "n", "sum(n) OVER () / (count(*) OVER () * n) AS weight")

"""Exact quantiles, tail shares and the two-sample Kolmogorov-Smirnov distance without unbounded groups.

The exact ``percentile`` aggregate keeps every distinct value of a group in one task. Here a mergeable sketch first
brackets each wanted quantile; one more pass counts the values below the bracket and keeps, already counted per
value, only the few inside it. The answer is exact: a bracket that misses its rank raises an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature") -> DataFrame:
    """(keep..., feature, value): the numeric ``columns`` as rows, missing values included."""
    entries = ", ".join(f"struct('{c}' AS {name}, cast(`{c}` AS double) AS value)" for c in columns)
    return df.selectExpr(*keep, f"explode(array({entries})) AS e").selectExpr(*keep, "e.*")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by..., p, quantile) with linear interpolation, over the non-missing values of each group.

    ``by`` must be a classification of bounded size (features, splits, years): its groups are broadcast.
    """
    by = list(by)
    margin = 2.0 / ACCURACY
    values = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    lows = ", ".join(f"{max(p - margin, 0.0)}D" for p in probs)
    highs = ", ".join(f"{min(p + margin, 1.0)}D" for p in probs)
    sketch = values.groupBy(*by).agg(
        F.count("v").alias("n"),
        F.expr(f"percentile_approx(v, array({lows}), {ACCURACY})").alias("lo"),
        F.expr(f"percentile_approx(v, array({highs}), {ACCURACY})").alias("hi"),
    )
    entries = ", ".join(f"struct({p}D AS p, lo[{i}] AS lo, hi[{i}] AS hi)" for i, p in enumerate(probs))
    brackets = sketch.selectExpr(*by, "n", f"explode(array({entries})) AS b").selectExpr(*by, "n", "b.*")
    side = "CASE WHEN v < lo THEN -1 WHEN v > hi THEN 1 ELSE 0 END"
    counted = (
        values.join(F.broadcast(brackets), by)
        .selectExpr(*by, "p", "n", "v", f"{side} AS side", f"CASE WHEN ({side}) = 0 THEN v END AS inside")
        .groupBy(*by, "p", "n", "side", "inside")
        .agg(F.count("v").alias("c"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))
    )
    keys = ", ".join([*by, "p"])
    ranked = counted.selectExpr(
        "*",
        f"sum(c) OVER (PARTITION BY {keys} ORDER BY side, inside ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto",
        "p * (n - 1) AS pos",
    )

    def at(rank: str) -> str:
        """Value at a rank, if this row knows it: an outer side only knows its value next to the bracket."""
        known = f"CASE WHEN side = 0 THEN v_min WHEN side = -1 AND {rank} = upto - 1 THEN v_max WHEN side = 1 AND {rank} = upto - c THEN v_min END"
        return f"max(CASE WHEN {rank} >= upto - c AND {rank} < upto THEN {known} END)"

    picked = ranked.groupBy(*by, "p").agg(
        F.expr(at("floor(pos)")).alias("v0"), F.expr(at("ceil(pos)")).alias("v1"), F.expr("max(pos - floor(pos))").alias("w")
    )
    # written as numpy and DuckDB interpolate, so that equal inputs give equal bits
    result = "CASE WHEN v0 IS NULL OR v1 IS NULL THEN raise_error('quantile bracket missed its rank') ELSE v0 + w * (v1 - v0) END"
    return picked.selectExpr(*by, "p", f"cast({result} AS double) AS quantile")


def ks_distance(
    df: DataFrame, feature: str, value: str, sample: str, first: str, second: str, tasks: int | None = None
) -> DataFrame:
    """Per feature: sizes of both samples, the exact KS distance and its asymptotic p-value.

    Values are counted per distinct value, then cumulated in two levels: within order-preserving bins, and over the
    bins. Bins are logarithmic around the sketch median in units of the spread, so no bin collects a feature's bulk.
    There may be many features, such as companies; ``tasks`` deals their bins over that many tasks (see ``tasks_for``).
    """
    both = df.where(F.col(value).isNotNull() & F.col(sample).isin(first, second)).selectExpr(
        f"{feature} AS feature", f"cast({value} AS double) AS v", f"CASE WHEN {sample} = '{first}' THEN 1 ELSE 0 END AS a"
    )
    counts = both.groupBy("feature", "v").agg(F.sum("a").alias("na"), F.count("v").alias("n")).selectExpr(
        "feature", "v", "na", "n - na AS nb"
    )
    centre = both.groupBy("feature").agg(F.expr("percentile_approx(v, array(0.25D, 0.5D, 0.75D), 1000)").alias("q"))
    scaled = counts.join(centre, "feature").selectExpr(
        "feature", "v", "na", "nb", "(v - q[1]) / greatest(q[2] - q[0], 1e-12D) AS z"
    )
    binned = scaled.selectExpr("feature", "v", "na", "nb", "cast(sign(z) * floor(256 * ln(1 + 8 * least(abs(z), 1e300D))) AS bigint) AS bin")
    if tasks is not None:
        binned = binned.repartition(tasks, "feature", "bin")
    per_bin = binned.groupBy("feature", "bin").agg(F.sum("na").alias("ba"), F.sum("nb").alias("bb"))
    order = "PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = per_bin.selectExpr(
        "feature",
        "bin",
        f"coalesce(sum(ba) OVER ({order}), 0) AS oa",
        f"coalesce(sum(bb) OVER ({order}), 0) AS ob",
        "sum(ba) OVER (PARTITION BY feature) AS ta",
        "sum(bb) OVER (PARTITION BY feature) AS tb",
    )
    inner = "PARTITION BY feature, bin ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    gaps = binned.join(offsets.hint("merge"), ["feature", "bin"]).selectExpr(
        "feature",
        "ta",
        "tb",
        f"abs((oa + sum(na) OVER ({inner})) / nullif(ta, 0) - (ob + sum(nb) OVER ({inner})) / nullif(tb, 0)) AS gap",
    )
    found = gaps.groupBy("feature").agg(
        F.max("ta").alias("n_first"), F.max("tb").alias("n_second"), F.max("gap").alias("ks_statistic")
    )
    return found.withColumn("p_value", F.expr(ks_p_value("ks_statistic", "n_first", "n_second")))


#: Cells of the lattice, n * m, up to which a p-value is exact.
EXACT_CELLS = 40_000


def ks_p_value(distance: str, n: str, m: str, exact_cells: int = EXACT_CELLS) -> str:
    """SQL for the two-sided p-value of a two-sample KS distance: exact up to ``exact_cells`` = n * m, asymptotic beyond."""
    asymptotic = _kolmogorov_tail(f"({distance}) * sqrt({n} * {m} / ({n} + {m}))")
    exact = ks_exact_tail(distance, n, m)
    return f"CASE WHEN {n} = 0 OR {m} = 0 OR ({distance}) IS NULL THEN NULL WHEN {n} * {m} <= {exact_cells} THEN {exact} ELSE {asymptotic} END"


def ks_exact_tail(distance: str, n: str, m: str) -> str:
    """SQL for the chance that two samples of one distribution, without ties, are at least this far apart.

    The order of both samples is a lattice path from (0, 0) to (n, m), all paths equally likely; the distance is reached where
    |i / n - j / m| is, in whole numbers |i m - j n| >= h. ``touched(i, j)``, the share of paths to (i, j) that reached it, is 1
    at such points and else the mean of its two predecessors, weighted i : j. Only positive terms are added, so small
    p-values keep their digits. Points with the same i + j = k depend only on those with k - 1: the fold carries one
    diagonal, an array over the smaller sample's i.
    """
    small, large = f"cast(least({n}, {m}) AS int)", f"cast(greatest({n}, {m}) AS int)"
    reach = f"cast(round(({distance}) * {n} * {m}) AS bigint)"
    near = f"abs(i * cast({large} AS bigint) - (k - i) * cast({small} AS bigint)) >= {reach}"
    step = (
        f"transform(q, (x, i) -> CASE WHEN k - i < 0 OR k - i > {large} THEN 0.0D WHEN {near} THEN 1.0D"
        f" ELSE (CASE WHEN i > 0 THEN q[i - 1] * i / k ELSE 0.0D END) + (CASE WHEN k - i > 0 THEN x * (k - i) / k ELSE 0.0D END) END)"
    )
    start = f"transform(sequence(0, {small}), i -> CASE WHEN i = 0 AND {reach} <= 0 THEN 1.0D ELSE 0.0D END)"
    return f"element_at(aggregate(sequence(1, {small} + {large}), {start}, (q, k) -> {step}), -1)"


def _kolmogorov_tail(lam: str) -> str:
    """2 * sum (-1)^(k-1) exp(-2 k^2 lam^2), within [0, 1]."""
    terms = f"aggregate(sequence(1, 100), 0.0D, (s, k) -> s + (CASE WHEN k % 2 = 1 THEN 2.0D ELSE -2.0D END) * exp(-2.0D * k * k * ({lam}) * ({lam})))"
    return f"CASE WHEN ({lam}) < 0.2 THEN 1.0D ELSE greatest(0.0D, least(1.0D, {terms})) END"

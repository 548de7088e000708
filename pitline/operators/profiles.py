"""Value audits of many features from one counted table.

Every (feature, value) is counted once, per split, and the counts are written down. Each value also has a bin that keeps the
order of values: logarithmic around the feature's approximate median, in units of its spread, so that no bin holds a feature's
bulk. Running counts are put together in two levels, over the bins of a feature and over the values of a bin, so that no
task sorts a feature's values as a whole. The lower level is only worked out for bins that can hold what is asked for: a
quantile's rank, or a KS distance beyond those at the bins' ends. The distances from the median give the MAD in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.operators.quantiles import ks_p_value
from pitline.session import stage, tasks_for

SPLITS = ("train", "val", "test")
PROBS = (0.001, 0.25, 0.5, 0.75, 0.999)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Bins per unit of the logarithm: a bin in the bulk is about an 8,000th of the spread wide.
FINENESS = 1024
EDGE = 1 << 40
#: Values, near all of them different, that one task counts ahead of the shuffle.
VALUES_PER_TASK = 2_000_000
#: Counted values that one task sorts for running counts.
RANKED_PER_TASK = 500_000
#: Larger numbers have no digits to spare, so they are never rounded.
ROUNDED_BELOW = "1e5D"


def _is_number(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def _near(value: Column, digits: int | None) -> Column:
    """The value to so many decimals, half away from zero, in floating point as other engines round; zero has no sign."""
    if digits is None:
        return value
    whole = F.floor(F.abs(value) * F.lit(10.0**digits) + F.lit(0.5)).cast("double")
    return F.when(F.abs(value) < F.expr(ROUNDED_BELOW), F.sign(value) * whole / F.lit(10.0**digits) + F.lit(0.0)).otherwise(value)


def _long(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., feature, value, text): numbers as values, anything else as text."""
    types = dict(df.dtypes)

    def entry(c: str) -> str:
        number = _is_number(types[c])
        value, text = (f"cast(`{c}` AS double)", "cast(NULL AS string)") if number else ("cast(NULL AS double)", f"cast(`{c}` AS string)")
        return f"struct('{c}' AS feature, {value} AS value, {text} AS text)"

    entries = ", ".join(map(entry, columns))
    return df.selectExpr(*keep, f"explode(array({entries})) AS e").select("*", "e.*").drop("e")


#: Numbers below this are first taken to SNAP_DIGITS decimals where a last decimal must not depend on the order of sums: a mean
#: that lies half-way between two decimals is a little below or above it in floating point, by chance.
SNAPPED_BELOW = "1000D"
SNAP_DIGITS = 12


def last_decimal(value: str, digits: int) -> str:
    """SQL for a floating number as a whole number of its ``digits``-th decimal: first of its SNAP_DIGITS-th, from there half up
    in whole numbers, away from zero; large numbers at once."""
    unit = 10 ** (SNAP_DIGITS - digits)
    fine = f"(cast(abs(round({value} * 1e{SNAP_DIGITS}D)) AS bigint) + {unit // 2}) div {unit}"
    return (
        f"CASE WHEN abs({value}) < {SNAPPED_BELOW} THEN ({fine}) * CASE WHEN {value} < 0 THEN -1 ELSE 1 END"
        f" ELSE cast(round({value} * 1e{digits}D) AS bigint) END"
    )


def distinct_values(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """(feature, distinct): how many values each feature has to ``digits`` decimals, snapped first. Read twice, see ``count_values``."""
    tasks = tasks_for(df.sparkSession, df.count() * len(columns), VALUES_PER_TASK)
    rows = _long(df.select(*[f"`{c}`" for c in columns]).repartition(tasks), columns, [])
    near = f"CASE WHEN abs(value) < {ROUNDED_BELOW} THEN ({last_decimal('value', digits)}) / 1e{digits}D ELSE value END"
    once = rows.selectExpr("feature", f"{near} AS value", "text").distinct()
    return once.groupBy("feature").agg(F.expr("count_if(value IS NOT NULL OR text IS NOT NULL) AS distinct"))


def _bin(value: str, centre: str, spread: str) -> str:
    """A number that never falls as the value grows; infinities and NaN have places of their own."""
    z = f"(({value} - {centre}) / {spread})"
    inside = f"cast(sign({z}) * floor({FINENESS} * ln(1 + 8 * least(abs({z}), 1e300D))) AS bigint)"
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN isnan({value}) THEN {EDGE + 1} WHEN {value} = double('Infinity') THEN {EDGE}"
        f" WHEN {value} = double('-Infinity') THEN -{EDGE} ELSE {inside} END"
    )


def count_values(
    df: DataFrame, columns: Sequence[str], split: str = "split", splits: Sequence[str] = SPLITS, digits: int | None = None
) -> DataFrame:
    """(feature, value, text, n, n_<split>..., centre, spread, bin): how often each value occurs, missing ones included.

    Text features have no value and no bin. With ``digits``, values are rounded first, so that sums taken in another order
    don't count as other values. The counts and the centres, one row per feature, are written to the shared
    folder; the centres are broadcast. Rows are counted first and dealt out, so ``df`` should be cheap to read twice.
    """
    types = dict(df.dtypes)
    numbers = [c for c in columns if _is_number(types[c])]
    texts = [c for c in columns if c not in numbers]
    tasks = tasks_for(df.sparkSession, df.count() * len(columns), VALUES_PER_TASK)
    marks = [f"cast(coalesce(`{split}` = '{s}', false) AS bigint) AS n_{s}" for s in splits]
    counts = [F.count(F.lit(1)).alias("n"), *[F.sum(f"n_{s}").alias(f"n_{s}") for s in splits]]
    parts = []
    # a row is dealt out as one array and taken apart behind the shuffle; a value's feature is its place, a number, until it is counted
    if numbers:
        entries = ", ".join(f"cast(`{c}` AS double)" for c in numbers)
        dealt = df.selectExpr(f"array({entries}) AS e", *marks).repartition(tasks).selectExpr("*", "posexplode(e) AS (place, value)")
        parts.append(dealt.select("place", _near(F.col("value"), digits).alias("value"), F.lit(None).cast("string").alias("text"), *[f"n_{s}" for s in splits]))
    if texts:
        entries = ", ".join(f"cast(`{c}` AS string)" for c in texts)
        dealt = df.selectExpr(f"array({entries}) AS e", *marks).repartition(tasks).selectExpr("*", "posexplode(e) AS (place, text)")
        parts.append(dealt.selectExpr(f"place + {len(numbers)} AS place", "cast(NULL AS double) AS value", "text", *[f"n_{s}" for s in splits]))
    counted = reduce(DataFrame.unionByName, parts).groupBy("place", "value", "text").agg(*counts)
    names = ", ".join(f"'{c}'" for c in [*numbers, *texts])
    return _binned(counted.selectExpr(f"get(array({names}), place) AS feature", "value", "text", "n", *[f"n_{s}" for s in splits]))


def count_values_by_slice(df: DataFrame, columns: Sequence[str], slices: dict[str, str]) -> DataFrame:
    """The same with ``struct(feature, slice)`` as feature: 'overall', and ``<name>_<value>`` for each named SQL expression.

    One scan; every row feeds one aggregation by grouping sets. Rows without a value of a slice are only in the others.
    """
    names = list(slices)
    rows = _long(df, columns, [f"cast({e} AS string) AS `{n}`" for n, e in slices.items()])
    base = ["feature", "value", "text"]
    sets = [base, *[[*base, n] for n in names]]
    by = [F.col(f"`{c}`") for c in [*base, *names]]
    counted = rows.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    tag, kept = F.lit("overall"), F.lit(True)
    for i, n in enumerate(names):
        grouped = F.col("gid").bitwiseAND(1 << (len(names) - 1 - i)) == 0
        tag = F.when(grouped, F.concat(F.lit(f"{n}_"), F.col(f"`{n}`"))).otherwise(tag)
        kept = kept & ~(grouped & F.col(f"`{n}`").isNull())
    return _binned(counted.where(kept).select(F.struct("feature", tag.alias("slice")).alias("feature"), "value", "text", "n"))


def _binned(counts: DataFrame) -> DataFrame:
    counted = stage(counts)
    finite = counted.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    quartiles = finite.groupBy("feature").agg(F.expr("percentile_approx(value, array(0.25D, 0.5D, 0.75D), 1000) AS q"))
    centres = stage(quartiles.selectExpr("feature", "q[1] AS centre", "greatest(q[2] - q[0], 1e-12D) AS spread"))
    joined = counted.join(F.broadcast(centres), "feature", "left")
    return joined.selectExpr("*", f"{_bin('value', 'coalesce(centre, 0.0D)', 'coalesce(spread, 1.0D)')} AS bin")


def running_counts(rows: DataFrame, counts: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """``rows(feature, bin, value, <counts>, <carry>)`` with ``upto_<count>``, the counts of all values of the feature up to
    this one, and ``total_<count>``.

    Each bin's start is a row of its own that runs ahead of the bin's values, so one shuffle by feature and bin is enough
    for the lower level; the upper level sees bins only. Rows are counted ahead and dealt out, so they should be cheap to count.
    """
    tasks = tasks_for(rows.sparkSession, rows.count(), RANKED_PER_TASK)
    per_bin = rows.groupBy("feature", "bin").agg(*[F.sum(c).alias(c) for c in counts])
    before = "PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    starts = per_bin.selectExpr(
        "feature", "bin", "0 AS __kind",
        *[f"coalesce(sum({c}) OVER ({before}), 0) AS {c}" for c in counts],
        *[f"sum({c}) OVER (PARTITION BY feature) AS total_{c}" for c in counts],
    )
    both = rows.select("feature", "bin", F.lit(1).alias("__kind"), "value", *counts, *carry).unionByName(starts, allowMissingColumns=True)
    both = both.repartition(tasks, "feature", "bin")
    running = "PARTITION BY feature, bin ORDER BY __kind, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    summed = both.selectExpr(
        "*", *[f"sum({c}) OVER ({running}) AS upto_{c}" for c in counts], *[f"max(total_{c}) OVER ({running}) AS __t_{c}" for c in counts]
    )
    return summed.where("__kind = 1").selectExpr(
        "feature", "value", *carry, *counts, *[f"upto_{c}" for c in counts], *[f"__t_{c} AS total_{c}" for c in counts]
    )


def opened_counts(rows: DataFrame, counts: Sequence[str], opened: str) -> DataFrame:
    """``running_counts`` of the values in ``opened`` bins alone; any other bin is one row, with its largest value and the counts
    up to its end. ``opened`` is SQL over a bin's ``<count>``, ``upto_<count>`` and ``total_<count>``; bins of one value stay closed.

    The bins are written down, some thousands per feature at most; those opened are broadcast, and their values dealt by count.
    """
    bins = rows.groupBy("feature", "bin").agg(
        *[F.sum(c).alias(c) for c in counts], F.min("value").alias("low"), F.max("value").alias("value"), F.count(F.lit(1)).alias("__rows")
    )
    running = "PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ends = bins.selectExpr(
        "*", *[f"sum({c}) OVER ({running}) AS upto_{c}" for c in counts], *[f"sum({c}) OVER (PARTITION BY feature) AS total_{c}" for c in counts]
    )
    marked = stage(ends.selectExpr("*", f"low < value AND coalesce({opened}, false) AS __open"))
    found = ["feature", "value", *counts, *[f"upto_{c}" for c in counts], *[f"total_{c}" for c in counts]]
    held = marked.where("__open").agg(F.expr("coalesce(sum(__rows), 0)")).first()[0]
    starts = marked.where("__open").selectExpr("feature", "bin", *[f"upto_{c} - {c} AS __before_{c}" for c in counts], *[f"total_{c}" for c in counts])
    inside = rows.select("feature", "bin", "value", *counts).join(F.broadcast(starts), ["feature", "bin"])
    inside = inside.repartition(tasks_for(rows.sparkSession, held, RANKED_PER_TASK), "feature", "bin")
    within = "PARTITION BY feature, bin ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    summed = inside.selectExpr("*", *[f"__before_{c} + sum({c}) OVER ({within}) AS upto_{c}" for c in counts])
    return summed.select(*found).unionByName(marked.where("NOT __open").select(*found))


def _rank_inside(p: float, count: str = "n") -> str:
    """SQL for whether a bin holds one of the ranks that enclose p * (n - 1)."""
    pos = f"({p}D * (total_{count} - 1))"
    return f"(upto_{count} - {count} <= ceil({pos}) AND floor({pos}) < upto_{count})"


def _quantile(p: float, count: str = "n") -> str:
    """Linear interpolation between the two values whose ranks enclose p * (n - 1), written as other engines do; between equal
    values, infinite ones too, it is that value."""
    at = lambda rank: f"max(CASE WHEN upto_{count} - {count} <= {rank} AND {rank} < upto_{count} THEN value END)"
    pos = f"({p}D * (total_{count} - 1))"
    low, high, part = at(f"floor({pos})"), at(f"ceil({pos})"), f"max({pos} - floor({pos}))"
    return f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + {part} * ({high} - {low}) END"


def quantile_name(p: float) -> str:
    return f"q{p}".replace(".", "_")


def value_profile(counted: DataFrame, probs: Sequence[float] = PROBS, splits: Sequence[str] = SPLITS) -> DataFrame:
    """One row per feature of ``count_values``: rows, present and distinct values, mean and variances, quantiles, and the KS
    distance of the first split from each other one.

    ``n``, ``present``, ``distinct`` and per split ``n_<s>``, ``present_<s>``, ``distinct_<s>``; ``infinite`` and ``texts``; ``min``, ``max``, ``mean``, ``variance``
    and ``variance_<s>`` (sums of squares about the approximate median, which cancel little); ``q0_5`` and so on; ``ks_<s>``.
    """
    names = ["n", *[f"n_{s}" for s in splits]]
    whole = counted.groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in names],
        *[F.expr(f"coalesce(sum(CASE WHEN value IS NOT NULL OR text IS NOT NULL THEN {c} END), 0) AS {c.replace('n', 'present', 1)}") for c in names],
        *[F.expr(f"count_if({c} > 0 AND (value IS NOT NULL OR text IS NOT NULL)) AS {c.replace('n', 'distinct', 1)}") for c in names],
        F.expr("coalesce(sum(CASE WHEN abs(value) = double('Infinity') THEN n END), 0) AS infinite"),
        F.expr("coalesce(sum(CASE WHEN text IS NOT NULL THEN n END), 0) AS texts"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max("centre").alias("__centre"),
        *[F.expr(f"sum({c} * (value - centre)) AS __s1_{c}") for c in names],
        *[F.expr(f"sum({c} * (value - centre) * (value - centre)) AS __s2_{c}") for c in names],
    )
    spread = []
    for c in names:
        have = f"present{c[1:]}"
        squares = f"greatest(0.0D, __s2_{c} - __s1_{c} * __s1_{c} / {have})"
        spread.append(f"CASE WHEN {have} > 1 THEN {squares} / ({have} - 1) END AS variance{c[1:]}")
    kept = [c for c in whole.columns if not c.startswith("__")]
    stats = whole.selectExpr(*kept, "__centre + try_divide(__s1_n, present) AS mean", *spread)
    share = lambda s: f"upto_n_{s} / nullif(total_n_{s}, 0)"
    start = lambda s: f"(upto_n_{s} - n_{s}) / nullif(total_n_{s}, 0)"
    opened = [_rank_inside(p) for p in probs]
    for s in splits[1:]:
        # nowhere in a bin are two splits further apart than one at the bin's end and the other at its start
        reach = f"greatest({share(splits[0])} - {start(s)}, {share(s)} - {start(splits[0])})"
        opened.append(f"coalesce({reach} > max(abs({share(splits[0])} - {share(s)})) OVER (PARTITION BY feature), false)")
    ranked = opened_counts(counted.where("value IS NOT NULL"), names, " OR ".join(opened))
    gaps = [f"max(abs({share(splits[0])} - {share(s)})) AS ks_{s}" for s in splits[1:]]
    read = ranked.groupBy("feature").agg(*[F.expr(f"{_quantile(p)} AS {quantile_name(p)}") for p in probs], *[F.expr(g) for g in gaps])
    return stats.join(read, "feature", "left")


def deviation_profile(counted: DataFrame, medians: DataFrame) -> DataFrame:
    """(feature, mad, top): median and largest absolute distance from the exact ``medians(feature, median)``, one row per
    feature, which are broadcast. Infinite values count; a feature of which most values are infinite has no MAD."""
    far = counted.where("value IS NOT NULL").join(F.broadcast(medians), "feature").selectExpr("feature", "n", "abs(value - median) AS value", "spread")
    binned = far.selectExpr("*", f"{_bin('value', '0.0D', 'coalesce(spread, 1.0D)')} AS bin")
    return opened_counts(binned, ["n"], _rank_inside(0.5)).groupBy("feature").agg(F.expr(f"{_quantile(0.5)} AS mad"), F.max("value").alias("top"))


def usability(
    df: DataFrame,
    columns: Sequence[str],
    group_of,
    split: str = "split",
    alpha: float = 0.01,
    shift: float = 0.3,
    extreme: float = 10.0,
    targets: Sequence[str] = (),
    counted: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """One row per feature: missing shares, distinct counts and variances overall and per split, flags, KS distances with
    p-values, and CORE / SPARSE_BUT_VALID / UNUSABLE with the reason.

    Variances and the flags drawn from them hold for floating numbers only; a whole-number column with missing values counts
    as one. ``group_of`` names a feature's group. The counted table and the profile are written once, unless they are given.
    """
    types = dict(df.dtypes)
    counted = count_values(df, columns, split) if counted is None else counted
    profile = stage(value_profile(counted)) if profile is None else profile
    medians = profile.where("q0_5 IS NOT NULL").select("feature", F.col("q0_5").alias("median"))
    spread = deviation_profile(counted, medians)
    flags = lambda c: (types[c] in ("float", "double"), types[c] in NUMERIC, c in targets)
    # spelled as SQL: rows from the driver's Python would start a Python worker on every core
    entries = [
        f"struct('{c}' AS feature, '{group_of(c)}' AS feature_group, '{types[c]}' AS dtype, {f} AS floating, {n} AS numeric, {t} AS is_target)"
        for c in columns
        for f, n, t in [flags(c)]
    ]
    known = df.sparkSession.range(1).selectExpr(f"inline(array({', '.join(entries)}))")
    # one row per feature on every side
    rows = profile.join(F.broadcast(known), "feature").join(F.broadcast(spread), "feature", "left")
    missing = lambda s: f"(1 - present{s} / n{s})"
    miss = [missing(f"_{s}") for s in SPLITS]
    flagged = rows.selectExpr("*", "floating OR (numeric AND present < n) AS floats").selectExpr(
        "*",
        *[f"CASE WHEN floats THEN {ks_p_value(f'ks_{s}', 'present_train', f'present_{s}')} END AS p_{s}" for s in SPLITS[1:]],
    )
    enough = " AND ".join(f"present_{s} >= 10" for s in SPLITS)
    reason = (
        "CASE WHEN present = 0 THEN 'ALL_MISSING' WHEN distinct <= 1 THEN 'CONSTANT' WHEN infinite > 0 THEN 'INFINITE_VALUES' WHEN is_target THEN 'TARGET_LEAKAGE'"
        " WHEN instr(feature, '_after') > 0 THEN 'POST_EVENT' WHEN present / n < 0.5 THEN format_string('HIGH_MISSINGNESS (%.1f%%)', round(100.0D * (1 - present / n), 1))"
        " WHEN startswith(feature, 'abnormal_return_') OR startswith(feature, 'reaction_class_') THEN 'TARGET_LEAKAGE_PATTERN' ELSE '' END"
    )
    named = zip(("train", "validation", "test"), SPLITS, strict=True)
    named = [("overall", ""), *[(long, f"_{s}") for long, s in named]]
    return flagged.selectExpr("*", f"{reason} AS usability_reason").selectExpr(
        "feature AS feature_name",
        "feature_group",
        "dtype",
        *[f"round(100.0D * {missing(s)}, 2) AS {long}_missing_pct" for long, s in named],
        *[f"distinct{s} AS {long}_unique_count" for long, s in named],
        *[f"CASE WHEN floats THEN variance{s} END AS {long}_variance" for long, s in named[1:]],
        "infinite AS infinite_count",
        "distinct <= 1 AS constant_flag",
        "floats AND coalesce(sqrt(variance) / (abs(mean) + 1e-10D) < 0.01, present < 2) AS near_constant_flag",
        f"floats AND present >= 4 AND coalesce(mad > 0 AND 0.6745D * top / mad > {extreme}, false) AS extreme_value_flag",
        f"coalesce(greatest({', '.join(miss)}) - least({', '.join(miss)}) > {shift}, false) AS coverage_shift_flag",
        f"coalesce({enough} AND (p_val < {alpha} OR p_test < {alpha}), false) AS distribution_shift_flag",
        "ks_val",
        "p_val",
        "ks_test",
        "p_test",
        "CASE WHEN usability_reason = '' THEN 'CORE' WHEN startswith(usability_reason, 'HIGH_MISSINGNESS') THEN 'SPARSE_BUT_VALID' ELSE 'UNUSABLE' END AS usability_status",
        "usability_reason",
    )

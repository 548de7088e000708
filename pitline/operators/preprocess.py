"""Preprocessing whose parameters come from training rows only.

Fitting is aggregation; what reaches the driver is a handful of numbers per feature. Transforming is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.operators.quantiles import exact_quantiles, long_form

THRESHOLD = 0.05
#: Features whose quantiles are sketched together. Spark's sketches live in a hash table of 128 groups at most; with more, every
#: row of a task is sorted in memory instead.
SKETCHED = 100
NOISE = 1e-12
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def missing_shares(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = train.agg(*[F.expr(f"avg(CASE WHEN `{c}` IS NULL THEN 1.0D ELSE 0.0D END) AS `{c}`") for c in features]).first()
    return {c: row[c] or 0.0 for c in features}


def add_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in features}) if features else df


def _require(df: DataFrame, features: Sequence[str]) -> None:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns at transform time: {missing}")


def _quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """(feature, p) to the exact quantile: at most one number per feature and p reaches the driver."""
    found = {}
    for k in range(0, len(names), SKETCHED):
        block = list(names[k : k + SKETCHED])
        rows = exact_quantiles(long_form(df.select(*[f"`{c}`" for c in block]), block), ["feature"], "value", probs).collect()
        found |= {(r["feature"], r["p"]): r["quantile"] for r in rows}
    return found


def _scale(spread: float, centre: float) -> float:
    """A spread that is only rounding noise beside the values counts as none, and a feature without spread isn't scaled."""
    return spread if spread > NOISE * max(1.0, abs(centre)) else 1.0


@dataclass
class TreePreprocessor:
    """Keeps NULLs and adds ``_was_missing`` for features often missing in training."""

    threshold: float = THRESHOLD
    features: list[str] = field(default_factory=list)
    flagged: list[str] | None = None

    def fit(self, train: DataFrame, features: Sequence[str]) -> TreePreprocessor:
        self.features = list(features)
        shares = missing_shares(train, features)
        self.flagged = [c for c in features if shares[c] >= self.threshold]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.flagged is None:
            raise ValueError("not fitted")
        _require(df, self.features)
        return add_indicators(df.select(*keep, *self.features), self.flagged)


@dataclass
class LinearPreprocessor:
    """Numeric features only: indicators, training-median imputation, then robust, standard or no scaling."""

    scaler: str = "robust"
    threshold: float = THRESHOLD
    features: list[str] = field(default_factory=list)
    flagged: list[str] | None = None
    medians: dict[str, float] = field(default_factory=dict)
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def fit(self, train: DataFrame, features: Sequence[str]) -> LinearPreprocessor:
        if self.scaler not in ("robust", "standard", "none"):
            raise ValueError(f"unknown scaler: {self.scaler}")
        types = dict(train.dtypes)
        self.features = [c for c in features if types[c] in _NUMERIC or types[c].startswith("decimal")]
        shares = missing_shares(train, self.features)
        self.flagged = [c for c in self.features if shares[c] >= self.threshold]
        self.medians = {c: median for (c, _), median in _quantiles(train, self.features, [0.5]).items()}
        self.features = [c for c in self.features if c in self.medians]
        if self.scaler != "none":
            self._fit_scaler(self._impute(train, ()))
        return self

    def _fit_scaler(self, imputed: DataFrame) -> None:
        names = imputed.columns
        if self.scaler == "robust":
            q = _quantiles(imputed, names, [0.25, 0.5, 0.75])
            self.centre = {c: q[c, 0.5] for c in names}
            self.scale = {c: _scale(q[c, 0.75] - q[c, 0.25], q[c, 0.5]) for c in names}
        else:
            row = imputed.agg(*[F.expr(f"{f}(`{c}`) AS `{f}_{c}`") for c in names for f in ("avg", "stddev_pop")]).first()
            self.centre = {c: row[f"avg_{c}"] for c in names}
            self.scale = {c: _scale(row[f"stddev_pop_{c}"], row[f"avg_{c}"]) for c in names}

    def _impute(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        flags = [f"cast(`{c}` IS NULL AS double) AS `{c}_was_missing`" for c in self.flagged or []]
        filled = [f"coalesce(cast(`{c}` AS double), {self.medians[c]!r}D) AS `{c}`" for c in self.features]
        return df.selectExpr(*keep, *filled, *flags)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        if self.flagged is None:
            raise ValueError("not fitted")
        _require(df, self.features)
        imputed = self._impute(df, keep)
        names = [c for c in imputed.columns if c not in keep]
        if self.scaler == "none":
            return imputed
        return imputed.selectExpr(*keep, *[f"(`{c}` - ({self.centre[c]!r}D)) / ({self.scale[c]!r}D) AS `{c}`" for c in names])


STATE = "position int, feature string, flagged boolean, median double, centre double, scale double, kind string, scaler string, threshold double"


def save_preprocessor(spark: SparkSession, fitted: TreePreprocessor | LinearPreprocessor, path: str) -> None:
    """Writes what was fitted as a table: a row per feature, and per indicator that is scaled, in column order."""
    if fitted.flagged is None:
        raise ValueError("not fitted")
    linear = isinstance(fitted, LinearPreprocessor)
    kind, scaler = ("linear", fitted.scaler) if linear else ("tree", None)
    scaled = [*fitted.features, *[f"{c}_was_missing" for c in fitted.flagged]] if linear else fitted.features
    rows = []
    for position, c in enumerate(scaled):
        median, centre, scale = (fitted.medians.get(c), fitted.centre.get(c), fitted.scale.get(c)) if linear else (None, None, None)
        rows.append((position, c, c in fitted.flagged if c in fitted.features else None, median, centre, scale, kind, scaler, fitted.threshold))
    spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(path)


def load_preprocessor(spark: SparkSession, path: str) -> TreePreprocessor | LinearPreprocessor:
    """What ``save_preprocessor`` wrote, in any session. The table has one row per feature and indicator."""
    rows = sorted(spark.read.schema(STATE).parquet(path).collect(), key=lambda r: r["position"])
    if not rows:
        raise ValueError(f"no features in {path}")
    own = [r for r in rows if r["flagged"] is not None]
    features, flagged = [r["feature"] for r in own], [r["feature"] for r in own if r["flagged"]]
    if rows[0]["kind"] == "tree":
        return TreePreprocessor(rows[0]["threshold"], features, flagged)
    of = lambda name: {r["feature"]: r[name] for r in rows if r[name] is not None}
    return LinearPreprocessor(rows[0]["scaler"], rows[0]["threshold"], features, flagged, of("median"), of("centre"), of("scale"))


def require_same_features(fitted: TreePreprocessor | LinearPreprocessor, features: Sequence[str]) -> None:
    """Raises unless ``features`` are the fitted ones in their order."""
    if list(features) != fitted.features:
        lost, new = sorted(set(fitted.features) - set(features)), sorted(set(features) - set(fitted.features))
        raise ValueError(f"features differ from the fitted ones: missing {lost}, new {new}" + ("" if lost or new else ", in another order"))


def create_preprocessor(model_type: str = "tree", **options) -> TreePreprocessor | LinearPreprocessor:
    kinds = {"tree": TreePreprocessor, "linear": LinearPreprocessor}
    if model_type not in kinds:
        raise ValueError(f"unknown model type: {model_type}")
    return kinds[model_type](**options)

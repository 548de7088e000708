"""From the model table to X and y: roles travel in the schema, and projections read them from there.

A column's role, feature group and point-in-time rule are metadata of its field. Spark writes them into Parquet files and
reads them back, so a table describes itself wherever it is loaded, and a projection of features can't pick up a target by
its name. Nothing is collected: X and y are column projections of the table, one per split by a filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitline.operators.splits import embargo_split, require_chronology, temporal_split
from pitline.plans.roles import (
    ALL_GROUPS,
    STRICT_GROUPS,
    TARGET_COLUMNS,
    classify_columns,
    feature_group,
    point_in_time_rule,
)

ROLE, GROUP, RULE = "role", "feature_group", "point_in_time_rule"
TRACKS = {"strict": STRICT_GROUPS, "all": ALL_GROUPS}
SPLITS = ("train", "val", "test")
KEYS = ("event_key", "result_announcement_datetime", "feature_cutoff_date", "reaction_start_date")


def with_roles(df: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """``df`` with role, group and rule of every column as metadata of its field; rows and columns stay as they are.

    Roles come from the fixed lists of names, or from ``manifest(feature_name, feature_group, point_in_time_rule, is_target)``,
    one row per column, whose features and targets must all be there; columns it doesn't name are metadata then.
    """
    described: dict[str, dict[str, str]] = {}
    if manifest is None:
        roles = classify_columns(df.columns)
        for c in roles["features"]:
            described[c] = {ROLE: "feature", GROUP: feature_group(c), RULE: point_in_time_rule(c)}
        for role, name in (("audit", "audit"), ("metadata", "metadata"), ("forbidden", "forbidden"), ("targets", "target")):
            described |= {c: {ROLE: name} for c in roles[role]}
    else:
        rows = manifest.select("feature_name", "feature_group", "point_in_time_rule", "is_target").collect()
        missing = sorted(r["feature_name"] for r in rows if r["feature_name"] not in df.columns)
        if missing:
            raise ValueError(f"columns of the manifest are missing: {missing}")
        banned = set(classify_columns(df.columns)["forbidden"])
        for r in rows:
            if r["is_target"]:
                described[r["feature_name"]] = {ROLE: "target"}
            elif r["feature_name"] in banned:
                raise ValueError(f"forbidden column named as a feature: {r['feature_name']}")
            else:
                described[r["feature_name"]] = {ROLE: "feature", GROUP: r["feature_group"], RULE: r["point_in_time_rule"]}
        described = {c: {ROLE: "forbidden"} for c in banned} | described
    plain = {ROLE: "metadata"}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=described.get(c, plain)) for c in df.columns])


def columns_with_role(schema: StructType, role: str, groups: Sequence[str] | None = None) -> list[str]:
    """Names with that role, in the schema's order; ``groups`` narrows features, and each must have one."""
    found = [f for f in schema.fields if f.metadata.get(ROLE) == role]
    if groups is not None:
        unknown = sorted(set(groups) - {f.metadata.get(GROUP) for f in found})
        if unknown:
            raise ValueError(f"no {role} in groups: {unknown}")
        found = [f for f in found if f.metadata.get(GROUP) in groups]
    return [f.name for f in found]


def prepare_xy(df: DataFrame, features: Sequence[str], targets: Sequence[str] = tuple(TARGET_COLUMNS)) -> tuple[DataFrame, DataFrame]:
    """X and y of a table with roles. Missing columns, and columns in X that aren't features by their role, are errors."""
    for kind, names in (("feature", features), ("target", targets)):
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"missing {kind} columns: {missing}")
    roles = {f.name: f.metadata.get(ROLE) for f in df.schema.fields}
    forbidden = [c for c in features if roles[c] != "feature"]
    if forbidden:
        raise ValueError(f"forbidden columns in X: {forbidden}")
    return df.select(*features), df.select(*targets)


@dataclass(frozen=True)
class TrainingData:
    """X, y and the key columns (event key, announcement, cutoff, reaction start) of each split, and where features belong.

    The frames of a split are projections of the same rows; to bring X and y together row by row use ``joined``.
    """

    table: DataFrame
    features: list[str]
    targets: list[str]
    groups: dict[str, list[str]]

    def rows(self, split: str) -> DataFrame:
        if split not in SPLITS:
            raise ValueError(f"unknown split: {split}")
        return self.table.where(F.col("split") == split)

    def xy(self, split: str) -> tuple[DataFrame, DataFrame]:
        return prepare_xy(self.rows(split), self.features, self.targets)

    def keys(self, split: str) -> DataFrame:
        return self.rows(split).select(*KEYS)

    def joined(self) -> DataFrame:
        """event_key, split, features, targets of all splits; embargoed rows are left out."""
        chosen = [*self.features, *self.targets]
        return self.table.where(F.col("split").isin(*SPLITS)).select("event_key", "split", *chosen)


def load_training_data(
    df: DataFrame,
    train_end: str,
    val_end: str,
    track: str = "all",
    targets: Sequence[str] = tuple(TARGET_COLUMNS),
    embargo_days: int | None = None,
    manifest: DataFrame | None = None,
    check: bool = True,
) -> TrainingData:
    """Splits the model table by period and projects X and y of a track: ``strict`` (market and own history) or ``all``.

    Groups the table has no feature of are left out of the track; a table without any is an error. With ``embargo_days``,
    rows too close to the split before them are ``embargoed``. ``check`` verifies in one pass that splits are chronological
    and that no event is in two of them. Roles are taken from the schema; a table without them gets them first.
    """
    if track not in TRACKS:
        raise ValueError(f"unknown track: {track}")
    if manifest is not None or not any(ROLE in f.metadata for f in df.schema.fields):
        df = with_roles(df, manifest)
    present = {f.metadata.get(GROUP) for f in df.schema.fields if f.metadata.get(ROLE) == "feature"}
    features = columns_with_role(df.schema, "feature", [g for g in TRACKS[track] if g in present])
    if not features:
        raise ValueError(f"no features for track {track}")
    placed = temporal_split(df, train_end, val_end) if embargo_days is None else embargo_split(df, train_end, val_end, embargo_days)
    if check:
        require_chronology(placed.where(F.col("split").isin(*SPLITS)))
    prepare_xy(placed, features, targets)
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in features:
            groups.setdefault(f.metadata[GROUP], []).append(f.name)
    return TrainingData(placed, features, list(targets), groups)

"""Flag lists: conditions joined into one 'A|B' string."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_string(conditions: Mapping[str, str], empty: str = "OK") -> Column:
    """Names of the conditions (SQL text) that hold, in mapping order, joined by ``|``; ``empty`` when none does."""
    names = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in conditions.items())
    return F.expr(f"coalesce(nullif(concat_ws('|', {names}), ''), '{empty}')")


def truthy_text(value: Column) -> Column:
    """Boolean from text: true, 1 and yes (any case) are true, everything else is false."""
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))

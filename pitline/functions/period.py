"""Reporting period from filing text.

The work is laid out as successive projections, so that each regular expression is evaluated once per row; nested
into one expression, every later reference would repeat all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.functions import patterns as P


def repair_glued_words(text: Column) -> Column:
    """Separate words run together by text extraction, rule by rule in order."""
    for pattern in P.GLUED_WORDS:
        text = F.regexp_replace(text, pattern, "$1 $2")
    return text


def period_phrase(text: Column) -> Column:
    """The date text of the first period pattern that matches; NULL when none does.

    Every pattern needs the word "ended" with the start of a date after it; texts without that skip all of them.
    """
    found = F.lit("")
    for pattern in reversed(P.PERIOD_PATTERNS):
        # regexp_extract gives '' without a match; rlike first keeps a single evaluation per reference
        found = F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(found)
    dated = F.contains(text, F.lit("ended")) & F.rlike(text, F.lit(P.ENDED_BEFORE_DATE))
    return F.when(dated, F.nullif(found, F.lit("")))


def with_period(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``, the reporting period end stated in column ``text`` or NULL, and the phrase it was read from.

    Phrases are dotted numbers, a day and a month name in either order, or month and year (the month's last day).
    Two-digit years pivot at 69. An impossible date gives NULL; the fiscal token is only consulted without a phrase.
    """
    kept = df.columns
    phrase = f"{name}_phrase"
    repaired = df.withColumn("__text", repair_glued_words(F.lower(F.col(text))))
    found = repaired.withColumn(phrase, period_phrase(F.col("__text")))
    parts = found.selectExpr("*", *_phrase_parts(phrase))
    numbers = parts.selectExpr(
        *kept,
        phrase,
        "__dotted",
        "__month_only",
        "try_cast(__y AS int) + CASE WHEN length(__y) = 4 THEN 0 WHEN length(__y) <> 2 THEN NULL"
        " WHEN try_cast(__y AS int) >= 69 THEN 1900 ELSE 2000 END AS __year",
        f"CASE WHEN __dotted THEN try_cast(__m AS int) ELSE nullif((instr('{"".join(P.MONTH_ABBREVIATIONS)}', __m) + 2) div 3, 0) END"
        " AS __month",
        "CASE WHEN __month_only THEN 1 ELSE try_cast(__d AS int) END AS __day",
        "try_cast(__q AS int) AS __quarter",
        "try_cast(__fy AS int) + 2000 AS __fy",
    )
    stated = "try_to_date(concat_ws('-', __year, __month, __day), 'y-M-d')"
    fiscal = (
        "CASE __quarter WHEN 1 THEN make_date(__fy - 1, 6, 30) WHEN 2 THEN make_date(__fy - 1, 9, 30)"
        " WHEN 3 THEN make_date(__fy - 1, 12, 31) WHEN 4 THEN make_date(__fy, 3, 31) END"
    )
    return numbers.selectExpr(
        *kept,
        phrase,
        f"CASE WHEN {phrase} IS NULL THEN {fiscal} WHEN __year IS NULL OR __month IS NULL OR __day IS NULL THEN NULL"
        f" WHEN __month_only THEN last_day({stated}) ELSE {stated} END AS {name}",
    )



def _phrase_parts(phrase: str) -> list[str]:
    """Day, month and year text of a phrase, and the parts of a fiscal token for texts without one."""
    token = P.FISCAL_TOKEN.replace("\\", "\\\\")
    return [
        rf"{phrase} rlike '^\\d+\\.' AS __dotted",
        rf"{phrase} rlike '^[a-z]+\\s+\\d{{4}}$' AS __month_only",
        rf"regexp_extract({phrase}, '(\\d+)$', 1) AS __y",
        rf"CASE WHEN {phrase} rlike '^\\d+\\.' THEN regexp_extract({phrase}, '\\.(\\d+)\\.', 1)"
        rf" ELSE regexp_extract({phrase}, '(?:^|[^a-z\\d]|\\d(?:st|nd|rd|th)?)\\s*(?!st|nd|rd|th)([a-z]{{3}})', 1) END AS __m",
        rf"CASE WHEN {phrase} rlike '^\\d' THEN regexp_extract({phrase}, '^(\\d+)', 1)"
        rf" ELSE regexp_extract({phrase}, '^[a-z]+\\s+(\\d{{1,2}}?)(?:,|\\s|(?=\\d{{4}}$))', 1) END AS __d",
        f"regexp_extract(__text, '{token}', 1) AS __q",
        f"regexp_extract(__text, '{token}', 2) AS __fy",
    ]

"""Date functions: day-first parsing, quarter ends, fiscal labels and whole-day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted day-first layouts, most specific first. Fixed values.
DAY_FIRST_FORMATS = (
    "d-MMM-yyyy H:mm:ss",
    "d-MMM-yyyy H:mm",
    "d-MMM-yyyy",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy H:mm",
    "d/M/yyyy",
    "d-M-yyyy H:mm:ss",
    "d-M-yyyy",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d",
)


def parse_day_first(text: Column) -> Column:
    """Timestamp from day-first text; NULL for anything that is not a real date."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in DAY_FIRST_FORMATS]).cast("timestamp_ntz")


def quarter_end(day: Column) -> Column:
    """Last day of the calendar quarter that contains ``day``."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def previous_quarter_end(day: Column) -> Column:
    return F.date_sub(F.trunc(day, "quarter").cast("date"), 1)


def fiscal_quarter(day: Column) -> Column:
    """'2024-Q4' style label for fiscal years that end in March; NULL when the month closes no quarter."""
    month = F.month(day)
    label = F.when(month == 3, "Q4").when(month == 6, "Q1").when(month == 9, "Q2").when(month == 12, "Q3")
    return F.when(label.isNotNull(), F.concat(F.year(day).cast("string"), F.lit("-"), label))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down (so -1 hour is -1 day)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(F.try_divide(micros, F.lit(86_400_000_000))).cast("int")


def clock_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)

"""Announcement files: one CSV per symbol, columns differing between files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.functions.dates import parse_day_first
from pitline.session import stage

EXPECTED_COLUMNS = ["desc", "attchmntText", "attchmntFile", "an_dt", "exchdisstime", "hasXbrl"]
OPTIONAL_COLUMNS = ["seq_id", "orgid"]
SKIPPED_SYMBOLS = ["reliance_test"]
#: Most cells of a record, and most distinct column names of a folder.
WIDTH, MAX_NAMES = 64, 1000


def prepare_announcements(raw: DataFrame) -> DataFrame:
    """Trim header names, add missing expected columns as NULL and parse the two day-first datetimes."""
    named = raw.withColumnsRenamed({c: c.strip() for c in raw.columns if c != c.strip()})
    missing = {c: F.lit(None).cast("string") for c in EXPECTED_COLUMNS if c not in named.columns}
    filled = named.withColumns(missing) if missing else named
    return filled.withColumn("announcement_datetime", parse_day_first(F.col("an_dt"))).withColumn(
        "dissemination_datetime", parse_day_first(F.col("exchdisstime"))
    )


def read_announcements(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, width: int = WIDTH) -> DataFrame:
    """All announcement CSVs below a folder, with the symbol taken from the file's name or its ``symbol=`` folder.

    Headers differ from file to file, and a CSV scan applies one header to all its files. So every file is scanned as cells
    without names; its first record, whatever it says, is its header, and each record is read against the header of its own
    file inside the job: one row per file joins the records by path. ``columns`` names the columns wanted besides the
    expected ones. Without it a job looks for them first, and what reaches the driver is one row per distinct name.

    Records may hold quoted line breaks. Columns that a file lacks are NULL, of a repeated name the first counts, and
    columns without a name go. Empty files hold no header and disappear. A record of more than ``width`` cells is an error.
    """
    headers = _headers(spark, folder, width)
    if columns is None:
        headers = stage(headers)
        names = headers.select(F.explode("header").alias("name")).where("name <> ''").distinct().orderBy("name").limit(MAX_NAMES + 1).collect()
        if not 0 < len(names) <= MAX_NAMES:
            raise ValueError(f"{len(names) or 'no'} column names in {folder}")
        wanted = [r["name"] for r in names]
    else:
        wanted = [*EXPECTED_COLUMNS, *OPTIONAL_COLUMNS, *(c for c in columns if c not in EXPECTED_COLUMNS + OPTIONAL_COLUMNS)]
    records = _cells(spark, folder, width, header=True).join(headers, "path")
    named = [F.get("cells", (F.array_position("header", F.lit(c)) - 1).cast("int")).alias(c) for c in wanted if c != "symbol"]
    tagged = records.select(*named, _symbol(F.col("path")).alias("symbol"))
    return prepare_announcements(tagged.where(~F.lower("symbol").isin(*SKIPPED_SYMBOLS)))


def _symbol(path: Column) -> Column:
    """From ``.../symbol=X/part.csv`` or ``.../X.csv``; paths are URL-encoded, folder names of partitions once more."""
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, r"/symbol=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", decoded(decoded(folder))).otherwise(decoded(F.regexp_extract(path, r"([^/]+)\.csv$", 1)))


def _cells(spark: SparkSession, folder: str, width: int, header: bool) -> DataFrame:
    """(path, cells) of every record; with ``header`` the first record of each file is passed over."""
    names = [f"c{k}" for k in range(width + 1)]
    rows = (
        spark.read.schema(", ".join(f"{c} string" for c in names))
        .options(header=header, multiLine=True, mode="PERMISSIVE", escape='"', enforceSchema=True)
        .options(recursiveFileLookup=True, pathGlobFilter="*.csv")
        .csv(folder)
    )
    beyond = F.raise_error(F.lit(f"a record has more than {width} cells")).cast("array<string>")
    cells = F.when(F.col(names[-1]).isNotNull(), beyond).otherwise(F.array(*names[:-1]))
    return rows.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"))


def _headers(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(path, header) with the trimmed names of each file's first record; a file is read by one task, in order."""
    placed = _cells(spark, folder, width, header=False).withColumn("place", F.monotonically_increasing_id())
    first = placed.groupBy("path").agg(F.min_by("cells", "place").alias("cells"))
    name = lambda c: F.trim(F.ltrim(F.coalesce(c, F.lit("")), F.lit("\ufeff")))
    return first.select("path", F.transform("cells", name).alias("header"))

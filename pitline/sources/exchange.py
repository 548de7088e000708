"""Exchange day files, price scans, the index universe and statement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.sources.history import NUMERIC, PRICE_COLUMNS

# Column names of the exchange's daily file.
DAILY_NAMES = {
    "TradDt": "date",
    "TckrSymb": "symbol",
    "ISIN": "isin",
    "OpnPric": "open",
    "HghPric": "high",
    "LwPric": "low",
    "ClsPric": "close",
    "PrvsClsgPric": "prev_close",
    "TtlTradgVol": "volume",
    "TtlTrfVal": "traded_value",
}
DAILY_FILTER = {"Sgmt": "CM", "FinInstrmTp": "STK", "SctySrs": "EQ"}
UNIVERSE_NAMES = {
    "Company Name": "company_name",
    "Industry": "industry",
    "Symbol": "symbol",
    "Series": "series",
    "ISIN Code": "isin",
}


def normalize_daily(raw: DataFrame) -> DataFrame:
    """Cash-market equity rows of the daily file as typed price rows; rows without date or symbol are dropped."""
    missing = [c for c in [*DAILY_FILTER, *DAILY_NAMES] if c not in raw.columns]
    if missing:
        raise ValueError(f"daily file lacks columns: {missing}")
    equity = raw.where(" AND ".join(f"{c} = '{v}'" for c, v in DAILY_FILTER.items()))
    named = equity.select(*[F.col(old).alias(new) for old, new in DAILY_NAMES.items()])
    typed = named.withColumns({c: F.col(c).try_cast("double") for c in NUMERIC} | {"date": F.col("date").try_cast("date")})
    return typed.dropna(subset=["date", "symbol"]).select(*PRICE_COLUMNS)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV files. All columns are read as text and typed by :func:`normalize_daily`, so no inference pass runs."""
    return normalize_daily(spark.read.option("header", True).csv(path))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """All stored days: dates without time zone, NaN as NULL, rows without date, symbol or close dropped."""
    prices = spark.read.parquet(path)
    numbers = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in NUMERIC if c in prices.columns}
    return prices.withColumns(numbers | {"date": F.col("date").cast("date")}).dropna(subset=["date", "symbol", "close"])


def clean_universe(raw: DataFrame) -> DataFrame:
    """Trimmed EQ rows, one per symbol (the first by company name)."""
    named = raw.withColumnsRenamed(UNIVERSE_NAMES)
    trimmed = named.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in UNIVERSE_NAMES.values()])
    rest = [c for c in UNIVERSE_NAMES.values() if c != "symbol"]
    first = F.min_by(F.struct(*rest), F.struct(*rest)).alias("r")
    return trimmed.where("series = 'EQ'").groupBy("symbol").agg(first).select("symbol", "r.*").select(*UNIVERSE_NAMES.values())


def with_company_names(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """``rows`` with the company name of their symbol from a cleaned universe; NULL where the universe lacks the symbol.

    An earlier ``company_name`` is replaced. One row per symbol on the universe's side, so no row multiplies.
    """
    names = universe.select(F.trim("symbol").alias("__symbol"), F.trim("company_name").alias("company_name")).dropDuplicates(["__symbol"])
    return rows.drop("company_name").join(names, F.col("symbol") == F.col("__symbol"), "left").drop("__symbol")


def in_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """The rows whose symbol the universe has."""
    return rows.join(universe.select("symbol"), "symbol", "left_semi").select(rows.columns)


def flatten_constituents(index: DataFrame, index_prefix: str = "NIFTY") -> DataFrame:
    """Securities of an index document (array ``data`` with nested ``meta``), without the index's own summary row."""
    rows = index.select(F.explode("data").alias("d")).select(
        "d.symbol",
        F.col("d.meta.companyName").alias("company_name"),
        F.col("d.meta.isin").alias("isin"),
        F.col("d.meta.series").alias("series"),
    )
    named = rows.where((F.col("symbol") != "") & ~F.upper("symbol").startswith(index_prefix))
    rest = ["company_name", "isin", "series"]
    return named.groupBy("symbol").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("r")).select("symbol", "r.*")


def reshape_statements(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per symbol and period from long statement rows (symbol, statement, item, period, value).

    ``statement`` is one of q_is, q_bs, q_cf, a_is, a_bs, a_cf; columns are named ``statement_item``. ``columns`` lists
    the ones wanted, which spares the pass that would look for them. One aggregation does what a chain of full joins
    on the period would.
    """
    wide = items.where(F.concat_ws("_", "statement", "item").isin(*columns))
    values = [
        F.max(F.when(F.concat_ws("_", "statement", "item") == c, F.col("value").try_cast("double"))).alias(c) for c in columns
    ]
    return wide.groupBy("symbol", F.col("period").try_cast("date").alias("period_end_date")).agg(*values)


def merge_statements(statements: Sequence[DataFrame]) -> DataFrame:
    """Full outer merge of already wide statements on (symbol, period_end_date)."""
    merged = statements[0]
    for statement in statements[1:]:
        merged = merged.join(statement, ["symbol", "period_end_date"], "full")
    return merged


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """One parquet per symbol with differing columns; the symbol is the file name, rows without a period are dropped."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    symbol = F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1))
    return rows.select(
        *[c for c in rows.columns if c not in ("symbol", "period_end_date")],
        symbol.alias("symbol"),
        F.col("period_end_date").cast("date").alias("period_end_date"),
    ).dropna(subset=["period_end_date", "symbol"])

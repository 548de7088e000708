"""Domain tables derived from the star-schema test tables.

Sums run over integers (cents, percent points), so every value is the same whatever order rows are read in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.functions.dates import fiscal_quarter, previous_quarter_end, quarter_end
from pitline.session import read_table, tasks_for

TRAIN_END = "1997-12-31"
VAL_END = "1999-12-31"
#: Line items that one task adds up, and orders that one task sorts, whatever the size of the files they are read from.
LINES_PER_TASK = 1_000_000
ORDERS_PER_TASK = 200_000


def _percent(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _supplier_symbol(c: str) -> Column:
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices: one series per supplier over weekday ship dates. Volume is unknown on some days."""
    lines = read_table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, lines.count(), LINES_PER_TASK)
    # a supplier's day has one or two lines: adding up ahead of the shuffle would fill memory and save next to nothing
    li = lines.where(F.weekday("l_shipdate") < 5).withColumn("date", F.col("l_shipdate").cast("date")).repartition(tasks, "l_suppkey", "date")
    daily = li.groupBy("l_suppkey", "date").agg(
        F.sum(_percent("l_discount")).alias("points"),
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
    )
    return daily.select(
        _supplier_symbol("l_suppkey").alias("symbol"),
        "date",
        _close().alias("close"),
        F.when(F.col("qty").cast("bigint") % 29 != 0, F.col("qty")).alias("volume"),
    )


def _close() -> Column:
    return F.lit(100.0) * (F.lit(1.0) + F.col("points").cast("double") / (F.col("n").cast("double") * F.lit(200.0)))


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same close over all line items of a day; the 13th of every month is missing."""
    li = read_table(spark, sf_dir, "lineitem").where((F.weekday("l_shipdate") < 5) & (F.dayofmonth("l_shipdate") != 13))
    daily = li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(_percent("l_discount")).alias("points"), F.count(F.lit(1)).alias("n")
    )
    return daily.select("date", _close().alias("close"))


def announcements(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Typed filings, one per order, for as many companies as there are suppliers plus two without prices. ``dealt`` spreads them
    by count ahead of an aggregation that sorts what a task reads."""
    orders = read_table(spark, sf_dir, "orders")
    if dealt:
        orders = orders.repartition(tasks_for(spark, orders.count(), ORDERS_PER_TASK), "o_orderkey")
    companies = read_table(spark, sf_dir, "supplier").count() + 2
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    minute = (key * 37) % 1440
    period = (
        F.when(key % 13 == 0, F.lit(None).cast("date"))
        .when(key % 11 == 0, quarter_end(day))
        .otherwise(previous_quarter_end(day))
    )
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "financial_results")
        .when(F.col("o_orderpriority") == "2-HIGH", "financial_result_update")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "media_release")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "earnings_call_transcript")
        .when(key % 4 == 0, "investor_presentation")
        .when(key % 4 == 1, "earnings_call_recording")
        .when(key % 4 == 2, "integrated_financial_filing")
        .otherwise("unclassified")
    )
    scope = (
        F.when(F.col("o_orderstatus") == "F", "consolidated")
        .when(F.col("o_orderstatus") == "O", "standalone")
        .otherwise("unknown")
    )
    text = (
        F.when(key % 4 == 0, "Results for the quarter ended")
        .when(key % 4 == 1, "Financial Result Updates")
        .when(key % 4 == 2, "Outcome of Board Meeting")
        .otherwise("Audited results for the year ended")
    )
    base = orders.select(
        F.concat(F.lit("S"), (F.col("o_custkey") % companies).cast("string")).alias("symbol"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=minute.cast("int"))).alias("announcement_datetime"),
        period.alias("period_ended"),
        kind.alias("document_type"),
        scope.alias("reporting_scope"),
        text.alias("announcement_text"),
        (key % 7).alias("url_no"),
        key.alias("row_no"),
    )
    url = F.concat(F.lit("https://filings.example/"), F.col("symbol"), F.lit("/"), F.col("url_no").cast("string"))
    return base.select(
        F.concat(F.lit("D"), F.col("row_no").cast("string")).alias("document_id"),
        F.concat_ws("_", "symbol", F.coalesce(F.col("period_ended").cast("string"), F.lit("UNKNOWN"))).alias("event_key"),
        "symbol",
        F.concat(F.lit("Company "), F.col("symbol")).alias("company_name"),
        "period_ended",
        fiscal_quarter(F.col("period_ended")).alias("fiscal_quarter"),
        "announcement_datetime",
        "document_type",
        F.col("document_type")
        .isin("financial_results", "financial_result_update", "integrated_financial_filing")
        .alias("is_primary_result"),
        "reporting_scope",
        "announcement_text",
        url.alias("filing_url"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per supplier, some line items missing in some quarters."""
    li = read_table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    disc, tax = _percent("l_discount"), _percent("l_tax")
    sums = li.groupBy("l_suppkey", quarter_end(F.col("l_shipdate").cast("date")).alias("period_end_date")).agg(
        F.sum(cents).alias("gross"),
        F.sum(cents * disc).alias("disc"),
        F.sum(cents * tax).alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.count(F.lit(1)).alias("n"),
    )
    money = lambda c: c.cast("double") / F.lit(10000.0)
    gross, off, tx, n = F.col("gross") * 100, F.col("disc"), F.col("tax"), F.col("n")
    shares = F.when(n % 7 != 0, F.col("qty").cast("double"))
    return sums.select(
        _supplier_symbol("l_suppkey").alias("symbol"),
        "period_end_date",
        money(gross - off).alias("revenue"),
        F.when(n % 5 != 0, money(off)).alias("gross_profit"),
        money(off - tx).alias("operating_income"),
        money((off - tx) * 2).alias("net_income"),
        F.when(n % 3 != 0, money(off - tx)).alias("ebit"),
        F.when(n % 3 != 1, money(off)).alias("ebitda"),
        money(off + tx).alias("normalized_ebitda"),
        F.when(n % 4 != 0, F.try_divide(money(off - tx), F.col("qty").cast("double"))).alias("eps_diluted"),
        F.try_divide(money(off - tx), (F.col("qty") + 10).cast("double")).alias("eps_basic"),
        shares.alias("shares_outstanding"),
        F.col("qty").cast("double").alias("shares_diluted"),
        money(gross * 2).alias("total_assets"),
        money(gross).alias("total_liabilities"),
        F.when(n % 6 != 0, money(gross - tx)).alias("equity"),
        money(gross + tx).alias("total_equity"),
        F.when(n % 8 != 0, money(tx * 3)).alias("total_debt"),
        money(tx).alias("cash"),
        money(gross - tx).alias("current_assets"),
        money(tx * 2).alias("current_liabilities"),
        money(off).alias("operating_cash_flow"),
        money(off - tx * 2).alias("free_cash_flow"),
    )


# Raw filing templates by order key modulo 24: (announcement text, details). {dash}, {long}, {ordinal}, {abbr},
# {dots}, {month} and {token} stand for spellings of the previous quarter end.
#: Made-up filings, in the order of the pattern lists in functions/patterns.py: result filings and their spellings of a
#: period, what looks like one and isn't, then the other kinds.
FILING_TEMPLATES = [
    ("Board papers no. 7 hold the financial results", "Mills and looms, consolidated, quarter ended {dash}"),
    ("Quarterly results of the tannery", "All numbers are standalone and run for the quarter ended {long}"),
    ("Auditors have signed: audited financial results", "Group and parent, standalone and consolidated, year ended {month}"),
    ("Results of the quarter are attached", "Quarter ended on {dots}; the ferry company is non-consolidated"),
    ("Unaudited FinancialResults of the brewery", "They were drawn up for thequarter ended {abbr}"),
    ("Results for the Quarterand nine months ended {ordinal}", "The weaving shed alone, standalone"),
    ("Machine readable sheet", "Opens in any reader and repeats the financial results for the quarter and half year ended {ordinal}"),
    ("We use our option to submit only yearly financial results", "Letter to the exchange"),
    ("Clarification asked by the exchange", "It concerns a footnote of the financial results for the period ended {dash}"),
    ("Newspaper publication in the valley", "Two daily papers carried the audited financial results of {token}"),
    ("Financial result update after the fire", "Standalone books were reopened for the period ended {long}"),
    ("Updates", "The operator cut off the last question"),
    ("Integrated filing of the ferry company", "Sheets in XML, quarter ended {dots}"),
    ("Press release of the dairy", "Milk earned more than cheese, results {token}"),
    ("Forty slides: the tannery's investor presentation", "Charts by region"),
    ("Words spoken to analysts, as a transcript", "Typed by the secretary on the next morning"),
    ("Audio recording of the evening call", "Ninety minutes, the first two without sound"),
    ("Conference call schedule for the spring", "Lines open an hour before noon"),
    ("Board meeting held in the chapel", "It ended before noon on {long}"),
    ("Notice of a board meeting in the harbour office", "The agenda names the dividend and a new crane"),
    ("Limited review report of the dairy's accountants", "Nothing came to their attention"),
    ("Corrigendum: two lines of the financial results were swapped", "Right are those for the period ended 31-Feb-2000"),
    ("Trading window shut for staff", "Until two days after the financial results for the year ended {dash}"),
    ("A mason joined the works council", "Annual dinner with standalone and consolidated guests"),
]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw announcement rows as an exchange delivers them, one in fifty delivered twice."""
    orders = read_table(spark, sf_dir, "orders")
    companies = read_table(spark, sf_dir, "supplier").count() + 2
    key = F.col("o_orderkey")
    announced = F.col("o_orderdate") + F.make_dt_interval(mins=((key * 37) % 1440).cast("int"))
    rows = orders.select(
        key.alias("row_no"),
        F.concat(F.lit("S"), (F.col("o_custkey") % companies).cast("string")).alias("symbol"),
        announced.alias("at"),
        previous_quarter_end(F.col("o_orderdate").cast("date")).alias("p"),
        F.explode(F.sequence(F.lit(1), F.when(key % 50 == 0, 2).otherwise(1))).alias("copy"),
    )
    p = F.col("p")
    spellings = {
        "{dash}": F.date_format(p, "dd-MMM-yyyy"),
        "{long}": F.date_format(p, "MMMM d, yyyy"),
        "{ordinal}": F.concat(
            F.dayofmonth(p).cast("string"), F.when(F.dayofmonth(p) == 31, "st ").otherwise("th "), F.date_format(p, "MMMM yyyy")
        ),
        "{abbr}": F.date_format(p, "MMM d, yyyy"),
        "{dots}": F.date_format(p, "dd.MM.yyyy"),
        "{month}": F.date_format(p, "MMMM yyyy"),
        "{token}": F.concat(F.lit("Q"), F.quarter(p).cast("string"), F.lit(" FY"), F.date_format(p, "yy")),
    }

    def text(position: int) -> Column:
        template = F.element_at(
            F.array(*[F.lit(t[position]) for t in FILING_TEMPLATES]), (F.col("row_no") % len(FILING_TEMPLATES) + 1).cast("int")
        )
        for mark, spelling in spellings.items():
            template = F.replace(template, F.lit(mark), spelling)
        return template

    stamp = F.date_format("at", "dd-MMM-yyyy HH:mm:ss")
    name = F.when(F.col("row_no") % len(FILING_TEMPLATES) == 11, "Transcript_Q4").otherwise("document")
    return rows.select(
        "symbol",
        text(0).alias("desc"),
        text(1).alias("attchmntText"),
        F.concat(F.lit("https://filings.example/"), name, F.lit("_"), (F.col("row_no") % 5).cast("string"), F.lit(".pdf")).alias("attchmntFile"),
        F.when(F.col("row_no") % 97 == 0, "not a date").otherwise(stamp).alias("an_dt"),
        stamp.alias("exchdisstime"),
        F.when(F.col("row_no") % 3 == 0, "True").when(F.col("row_no") % 3 == 1, "yes").otherwise("-").alias("hasXbrl"),
    )

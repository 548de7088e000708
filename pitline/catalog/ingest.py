"""Reader and normaliser queries over rows shaped like the delivered files, derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitline import standins
from pitline.catalog.ctes import with_ctes
from pitline.catalog.registry import query, rounded
from pitline.functions.nullsafe import growth, safe_divide
from pitline.operators.prices import one_row_per_day
from pitline.session import read_table, shared_folder
from pitline.sources import exchange, history
from pitline.sources.announcements import read_announcements


@query(
    "daily_file_normaliser",
    """
SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS symbol, ROUND(SUM(l_extendedprice), 4) AS traded_value, COUNT(l_quantity) FILTER (WHERE l_linenumber <> 3) AS volumes
FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber <> 5 GROUP BY 1, 2""",
)
def daily_file_normaliser(spark, d):
    li = read_table(spark, d, "lineitem")
    raw = li.selectExpr(
        "CASE WHEN l_linestatus = 'F' THEN 'CM' ELSE 'FO' END AS Sgmt",
        "CASE WHEN l_returnflag = 'A' THEN 'STK' ELSE 'IDX' END AS FinInstrmTp",
        "'EQ' AS SctySrs",
        "CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE date_format(l_shipdate, 'yyyy-MM-dd') END AS TradDt",
        "concat('S', l_suppkey) AS TckrSymb",
        "concat('IN', l_partkey) AS ISIN",
        *[f"cast(l_extendedprice AS string) AS {c}" for c in ("OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric", "TtlTrfVal")],
        "CASE WHEN l_linenumber = 3 THEN '-' ELSE cast(l_quantity AS string) END AS TtlTradgVol",
    )
    rows = exchange.normalize_daily(raw)
    return rows.groupBy("date", "symbol").agg(
        F.round(F.sum("traded_value"), 4).alias("traded_value"), F.count("volume").alias("volumes")
    )


@query(
    "last_price_per_day",
    "SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS close, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS volume FROM lineitem GROUP BY 1, 2",
)
def last_price_per_day(spark, d):
    rows = read_table(spark, d, "lineitem").selectExpr(
        "concat('S', l_suppkey) AS symbol", "cast(l_shipdate AS date) AS date", "l_extendedprice AS close", "l_quantity AS volume", "l_orderkey * 10 + l_linenumber AS seq"
    )
    return one_row_per_day(rows, "seq")


@query(
    "universe_cleaner",
    "SELECT c_mktsegment AS symbol, arg_min(c_name, c_name) AS company_name, 'EQ' AS series, arg_min('IN' || c_custkey, c_name) AS isin FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1",
)
def universe_cleaner(spark, d):
    raw = read_table(spark, d, "customer").selectExpr(
        "concat(' ', c_name, ' ') AS `Company Name`", "'x' AS Industry", "concat(c_mktsegment, ' ') AS Symbol",
        "CASE WHEN c_custkey % 2 = 0 THEN 'EQ' ELSE 'BE' END AS Series", "concat('IN', c_custkey) AS `ISIN Code`",
    )
    return exchange.clean_universe(raw).select("symbol", "company_name", "series", "isin")


def _supplier_universe(spark, d):
    raw = read_table(spark, d, "supplier").selectExpr(
        "concat(s_name, ' ') AS `Company Name`", "'x' AS Industry", "concat(' S', s_suppkey) AS Symbol",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'BE' ELSE 'EQ' END AS Series", "concat('IN', s_suppkey) AS `ISIN Code`",
    )
    return exchange.clean_universe(raw)


@query(
    "company_lookup",
    "SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS symbol, CASE WHEN l_suppkey % 3 <> 0 THEN trim(s_name) END AS company_name "
    "FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey",
)
def company_lookup(spark, d):
    rows = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('S', l_suppkey) AS symbol", "'old' AS company_name")
    return exchange.with_company_names(rows, _supplier_universe(spark, d))


@query(
    "universe_filter",
    "SELECT l_orderkey, l_linenumber, 'S' || l_suppkey AS symbol FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier)",
)
def universe_filter(spark, d):
    rows = read_table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('S', l_suppkey) AS symbol")
    return exchange.in_universe(rows, _supplier_universe(spark, d))


@query(
    "index_constituents",
    "SELECT 'P' || p_partkey % 500 AS symbol, MIN(p_name) AS company_name FROM part WHERE p_partkey % 500 <> 7 GROUP BY 1",
)
def index_constituents(spark, d):
    rows = read_table(spark, d, "part").selectExpr(
        "p_partkey div 100 AS index_no", "named_struct('symbol', CASE WHEN p_partkey % 500 = 7 THEN 'NIFTY 50' ELSE concat('P', p_partkey % 500) END,"
        " 'meta', named_struct('companyName', p_name, 'isin', concat('IN', p_partkey), 'series', 'EQ')) AS item"
    )
    # delivered as one JSON document per index; here one per hundred parts
    text = rows.groupBy("index_no").agg(F.to_json(F.struct(F.collect_list("item").alias("data"))).alias("j"))
    schema = "data array<struct<symbol:string,meta:struct<companyName:string,isin:string,series:string>>>"
    parsed = text.select(F.from_json("j", schema).alias("doc")).select("doc.data")
    return exchange.flatten_constituents(parsed).select("symbol", "company_name")


@query(
    "statement_reshaper",
    """
SELECT 'S' || l_suppkey AS symbol, CAST(last_day(l_shipdate) AS DATE) AS period_end_date, MAX(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS "q_is_Total Revenue", MAX(l_quantity) FILTER (WHERE l_returnflag = 'R') AS "q_bs_Total Assets"
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""",
)
def statement_reshaper(spark, d):
    items = read_table(spark, d, "lineitem").selectExpr(
        "concat('S', l_suppkey) AS symbol", "CASE l_returnflag WHEN 'A' THEN 'q_is' WHEN 'R' THEN 'q_bs' ELSE 'q_cf' END AS statement",
        "CASE l_returnflag WHEN 'A' THEN 'Total Revenue' WHEN 'R' THEN 'Total Assets' ELSE 'Capital Expenditure' END AS item",
        "cast(last_day(l_shipdate) AS string) AS period", "cast(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE l_quantity END AS string) AS value",
    )
    return exchange.reshape_statements(items, ["q_is_Total Revenue", "q_bs_Total Assets"])


@query(
    "statement_full_merge",
    """
WITH a AS (SELECT l_suppkey, last_day(l_shipdate) AS p, SUM(l_quantity) AS x FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 GROUP BY 1, 2), b AS (SELECT l_suppkey, last_day(l_shipdate) AS p, SUM(l_quantity) AS y FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 2 GROUP BY 1, 2)
SELECT 'S' || COALESCE(a.l_suppkey, b.l_suppkey) AS symbol, CAST(COALESCE(a.p, b.p) AS DATE) AS period_end_date, x AS q_is_x, y AS q_bs_y FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.p = b.p""",
)
def statement_full_merge(spark, d):
    li = read_table(spark, d, "lineitem").selectExpr("*", "concat('S', l_suppkey) AS symbol", "cast(last_day(l_shipdate) AS date) AS period_end_date")
    part = lambda flag, line, name: li.where(f"l_returnflag = '{flag}' AND l_linenumber = {line}").groupBy("symbol", "period_end_date").agg(F.sum("l_quantity").alias(name))
    return exchange.merge_statements([part("A", 1, "q_is_x"), part("N", 2, "q_bs_y")])


@query(
    "safe_ratios",
    """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, ROUND(SUM(l_tax) / NULLIF(SUM(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 0), 10) AS ratio,
  ROUND((SUM(l_quantity) - SUM(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END)) / NULLIF(abs(SUM(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END)), 0), 10) AS change
FROM lineitem GROUP BY 1, 2""",
)
def safe_ratios(spark, d):
    sums = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_tax").alias("t"), F.sum("l_quantity").alias("q"),
        F.expr("sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0.0D END) AS a"), F.expr("sum(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0.0D END) AS b"),
    )
    return rounded(sums.select("l_suppkey", "day", safe_divide(F.col("t"), F.col("a")).alias("ratio"), growth(F.col("q"), F.col("b")).alias("change")))


@query(
    "resumed_day_sink",
    with_ctes("SELECT CAST(date_trunc('month', date) AS DATE) AS date, COUNT(*) AS rows, ROUND(SUM(close), 6) + 0.0 AS close FROM px GROUP BY 1", "px"),
)
def resumed_day_sink(spark, d):
    """All prices, filed under the first of their month, written in two runs with a lost one in between, and read back by the
    commit records."""
    path = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    prices = standins.prices(spark, d).withColumn("date", F.trunc("date", "month"))
    month = F.month("date")
    history.append_new_days(prices.where(month <= 6), path)
    torn = prices.where((month == 7) & (F.col("symbol") < "S5"))
    torn.repartition("date").write.partitionBy("date").mode("append").parquet(path)
    history.append_new_days(prices, path)
    found = history.read_committed(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close"))
    return rounded(found, 6)


@query(
    "announcement_files",
    """
WITH o AS (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) AS ym FROM orders)
SELECT 'S/' || ym AS symbol, o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'a "second", line' ELSE '' END AS "desc", 'no ' || o_orderkey AS "attchmntText",
  CASE WHEN ym % 3 > 0 THEN o_orderstatus END AS "attchmntFile", CASE WHEN ym % 3 = 2 THEN CAST(o_custkey AS VARCHAR) END AS seq_id,
  CASE WHEN ym % 3 = 0 THEN CAST(o_totalprice > 100000 AS VARCHAR) END AS "hasXbrl", date_trunc('day', o_orderdate) + INTERVAL 9 HOUR AS announcement_datetime FROM o""",
)
def announcement_files(spark, d):
    """Files written with three headers that differ in names, order and blanks, one file a symbol, and read back by their own."""
    folder = f"{shared_folder(spark)}/announcements-{uuid.uuid4().hex}"
    month = "year(o_orderdate) * 12 + month(o_orderdate)"
    rows = read_table(spark, d, "orders").selectExpr(
        f"({month}) % 3 AS layout", f"concat('S/', {month}) AS symbol", "concat('no ', o_orderkey) AS attchmntText", "o_orderstatus AS attchmntFile",
        "concat(o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN '\\na \"second\", line' ELSE '' END) AS desc", "cast(o_custkey AS string) AS seq_id",
        "cast(o_totalprice > 100000 AS string) AS hasXbrl", "date_format(o_orderdate, 'dd-MMM-yyyy 09:00:00') AS an_dt",
    )
    layouts = {0: ["desc", "attchmntText", "an_dt", "hasXbrl"], 1: ["an_dt", " attchmntFile", "attchmntText ", " desc "], 2: ["seq_id", "attchmntFile", "desc", "an_dt", "attchmntText"]}
    for layout, header in layouts.items():
        own = rows.where(F.col("layout") == layout).select("symbol", *[F.col(c.strip()).alias(c) for c in header])
        own.repartition("symbol").write.partitionBy("symbol").options(header=True, escape='"').csv(f"{folder}/{layout}")
    found = read_announcements(spark, folder, columns=())
    return found.select("symbol", "desc", "attchmntText", "attchmntFile", "seq_id", "hasXbrl", "announcement_datetime")

"""Readers and sinks against small files."""

import datetime as dt

import pytest

from pitline.operators.fundamentals import available_columns, standardize_columns
from pitline.plans.roles import classify_columns, columns_in_groups, feature_group
from pitline.sources import exchange, history, sinks
from pitline.sources.announcements import read_announcements


def test_announcement_files_with_different_headers(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text('desc,attchmntText,an_dt\n"Results, final",text,01-Feb-2024 14:09:11\n')
    (tmp_path / "BBB.csv").write_text(" desc ,attchmntFile,an_dt,hasXbrl\nUpdates,u.pdf,not a date,true\n")
    (tmp_path / "RELIANCE_TEST.csv").write_text("desc,an_dt\nx,01-Feb-2024\n")
    (tmp_path / "EMPTY.csv").write_text("")
    rows = {r.symbol: r for r in read_announcements(spark, str(tmp_path)).collect()}
    assert set(rows) == {"AAA", "BBB"}
    assert rows["AAA"].desc == "Results, final"
    assert rows["AAA"].announcement_datetime == dt.datetime(2024, 2, 1, 14, 9, 11)
    assert rows["AAA"].hasXbrl is None and rows["BBB"].announcement_datetime is None and rows["BBB"].attchmntFile == "u.pdf"


def test_first_line_is_the_header_whatever_it_says(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("attchmntText,attchmntFile\nsome words,a.pdf\n")
    (tmp_path / "BBB.csv").write_text('"orgid","odd, name",seq_id\ndescription of results,x,7\ndesc an_dt,y,8\n')
    rows = read_announcements(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, r.attchmntText, r.orgid, r.seq_id) for r in rows if r.symbol == "AAA") == [("AAA", "some words", None, None)]
    assert sorted((r.orgid, r["odd, name"], r.seq_id) for r in rows if r.symbol == "BBB") == [("desc an_dt", "y", "8"), ("description of results", "x", "7")]


def test_records_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "A+B.csv").write_text('\ufeffdesc, an_dt ,desc,,odd\n"two\nlines, ""quoted""",01-Feb-2024 14:09:11,second,x,7\nshort\n')
    (tmp_path / "symbol=C%2FD").mkdir()
    (tmp_path / "symbol=C%2FD" / "part-0.csv").write_text("attchmntFile,desc\nc.pdf,c\n")
    rows = {(r.symbol, r.desc): r for r in read_announcements(spark, str(tmp_path), columns=["odd"]).collect()}
    assert set(rows) == {("A+B", 'two\nlines, "quoted"'), ("A+B", "short"), ("C/D", "c")}
    full, short, other = rows["A+B", 'two\nlines, "quoted"'], rows["A+B", "short"], rows["C/D", "c"]
    assert full.announcement_datetime == dt.datetime(2024, 2, 1, 14, 9, 11) and full.odd == "7" and full.attchmntFile is None
    assert short.an_dt is None and short.odd is None and other.attchmntFile == "c.pdf" and other.odd is None
    (tmp_path / "WIDE.csv").write_text("desc\n" + ",".join("abcdef") + "\n")
    with pytest.raises(Exception, match="more than 5 cells"):
        read_announcements(spark, str(tmp_path), columns=[], width=5).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no column names"):
        read_announcements(spark, str(tmp_path / "none"))


def test_daily_file(spark, tmp_path):
    head = "TradDt,Sgmt,FinInstrmTp,TckrSymb,ISIN,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal"
    body = ["2024-01-02,CM,STK,A,I1,EQ,1,2,1,1.5,1,100,150", "2024-01-02,CM,STK,B,I2,BE,1,2,1,1.5,1,100,150", "bad,CM,STK,C,I3,EQ,1,2,1,1.5,1,x,150"]
    (tmp_path / "day.csv").write_text("\n".join([head, *body]) + "\n")
    rows = exchange.read_daily(spark, str(tmp_path / "day.csv")).collect()
    assert [(r.symbol, r.date, r.close) for r in rows] == [("A", dt.date(2024, 1, 2), 1.5)]


def _days(spark, *days, close=None):
    rows = [("A", dt.date(2024, 1, d), float(d if close is None else close)) for d in days]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_append_skips_committed_days(spark, tmp_path):
    path = str(tmp_path / "prices")
    history.append_new_days(_days(spark), path)
    assert history.committed_days(spark, path).count() == 0
    history.append_new_days(_days(spark, 1, 2), path)
    history.append_new_days(_days(spark, 2, 3, close=9), path)
    history.append_new_days(_days(spark, 1, 2), path)
    assert sorted(r.close for r in history.read_committed(spark, path).collect()) == [1.0, 2.0, 9.0]
    assert sorted((r.date.day, r.rows) for r in history.committed_days(spark, path).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert spark.read.parquet(path).count() == 3


def test_a_lost_write_is_replaced_and_not_read(spark, tmp_path):
    path = str(tmp_path / "prices")
    history.append_new_days(_days(spark, 1), path)
    # a run that died after half of the 2nd, and after the 3rd but before its record
    _days(spark, 2, 3, close=7).write.partitionBy("date").mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert [r.close for r in history.read_committed(spark, path).collect()] == [1.0]
    history.append_new_days(_days(spark, 1, 2, 2), path)
    assert sorted(r.close for r in history.read_committed(spark, path).collect()) == [1.0, 2.0, 2.0]
    assert {(r.date.day, r.rows) for r in history.committed_days(spark, path).collect()} == {(1, 1), (2, 2)}


def test_fundamentals_from_file_names(spark, tmp_path):
    spark.createDataFrame([("2024-03-31", 1.0)], "period_end_date string, `q_is_Total Revenue` double").coalesce(1).write.parquet(str(tmp_path / "w"))
    source = next((tmp_path / "w").glob("part-*.parquet"))
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "XYZ.parquet").write_bytes(source.read_bytes())
    df = exchange.read_fundamentals(spark, str(folder))
    assert standardize_columns(df).first().asDict() == {"revenue": 1.0, "symbol": "XYZ", "period_end_date": dt.date(2024, 3, 31)}
    assert available_columns(df.columns) == {"revenue": "q_is_Total Revenue"}


def test_prediction_sink_replaces_one_pair(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1,)], "y int")
    sinks.write_predictions(df, path, "e1", "val")
    sinks.write_predictions(df, path, "e1", "test")
    sinks.write_predictions(df.union(df), path, "e1", "val")
    assert {(r.split, r["count"]) for r in spark.read.parquet(path).groupBy("split").count().collect()} == {("val", 2), ("test", 1)}


def test_column_roles():
    columns = ["event_key", "return_5d", "return_5d_after", "abnormal_return_1d", "fund_free_cash_flow", "val_pe", "prior_abn_ret_1d_mean_2", "reaction_start_date", "fundamental_lag_days"]
    roles = classify_columns(columns)
    assert roles["features"] == ["fund_free_cash_flow", "prior_abn_ret_1d_mean_2", "return_5d", "val_pe"]
    assert roles["targets"] == ["abnormal_return_1d", "return_5d_after"] and roles["audit"] == ["fundamental_lag_days"]
    assert feature_group("fund_free_cash_flow") == "fundamental_cashflow"
    assert columns_in_groups(columns, ["valuation", "market_returns"]) == ["return_5d", "val_pe"]


def test_names_filter_and_ordered_sinks(spark, tmp_path):
    universe = spark.createDataFrame([("A", " Alpha "), ("B", "Beta")], "symbol string, company_name string")
    rows = spark.createDataFrame([("B", 2), ("A", 1), ("C", 3), (None, 4)], "symbol string, v int")
    assert {(r.v, r.company_name) for r in exchange.with_company_names(rows, universe).collect()} == {(1, "Alpha"), (2, "Beta"), (3, None), (4, None)}
    assert sorted(r.v for r in exchange.in_universe(rows, universe).collect()) == [1, 2]
    sinks.write_table(rows, str(tmp_path / "t"), ["v"])
    assert [r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1, 2, 3, 4]
    sinks.write_report(rows.repartition(3), str(tmp_path / "r"), ["v"])
    lines = [x for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith("symbol")]
    assert lines == ["A,1", "B,2", "C,3", '"",4'] or lines[:3] == ["A,1", "B,2", "C,3"]

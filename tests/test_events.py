"""Roll-up, canonical choice, re-dating and duplicates."""

import datetime as dt

from pitline.operators import events as ev

SCHEMA = (
    "document_id string, event_key string, symbol string, company_name string, period_ended date, fiscal_quarter string,"
    " announcement_datetime timestamp_ntz, document_type string, is_primary_result boolean, filing_url string"
)


def _docs(spark, late=False):
    t = lambda *a: dt.datetime(2024, *a)
    rows = [
        ("doc1", t(2, 1, 14, 9, 11), "financial_result_update", True, "result"),
        ("doc2", t(2, 1, 14, 14, 37), "media_release", False, "media"),
        ("doc3", t(2, 1, 21, 15, 29), "earnings_call_recording", False, "recording"),
        ("doc4", t(2, 8, 19, 7, 56), "earnings_call_transcript", False, "transcript"),
    ]
    if late:
        rows.append(("doc5", t(3, 15, 10, 0, 0), "earnings_call_transcript", False, "late"))
    full = [(i, "A_2023-12-31", "A", "A Ltd", dt.date(2023, 12, 31), "2023-Q3", ts, k, p, u) for i, ts, k, p, u in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_four_documents_make_one_event(spark):
    rows = ev.roll_up(_docs(spark)).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row.document_count == 4
    assert row.result_announcement_datetime == dt.datetime(2024, 2, 1, 14, 9, 11)
    assert row.has_financial_results and row.has_media_release and row.has_earnings_call and row.has_transcript
    assert row.days_from_period_end == 32 and row.quality_flag == "OK"
    assert row.document_types == "earnings_call_recording:1|earnings_call_transcript:1|financial_result_update:1|media_release:1"


def test_late_transcript_changes_nothing_but_the_count(spark):
    row = ev.roll_up(_docs(spark, late=True)).first()
    assert row.document_count == 5
    assert row.result_announcement_datetime == dt.datetime(2024, 2, 1, 14, 9, 11)


def test_missing_period_is_flagged(spark):
    row = ("d", "A_UNKNOWN", "A", "A Ltd", None, None, dt.datetime(2024, 2, 1, 14, 0), "financial_results", True, "u")
    out = ev.roll_up(spark.createDataFrame([row], SCHEMA)).first()
    assert "MISSING_PERIOD_END" in out.quality_flag and out.period_ended is None


def test_duplicates_by_document_id(spark):
    docs = _docs(spark).union(_docs(spark))
    assert ev.drop_duplicate_documents(docs, ["announcement_datetime"]).count() == 4


def test_canonical_prefers_consolidated_specific_and_penalises_early(spark):
    schema = "document_id string, event_key string, document_type string, reporting_scope string, announcement_text string, announcement_datetime timestamp_ntz, period_ended date"
    d = dt.date(2023, 12, 31)
    rows = [
        ("a", "e", "financial_result_update", "unknown", "Financial Result Updates", dt.datetime(2024, 1, 10), d),
        ("b", "e", "financial_results", "consolidated", "Results for the quarter ended", dt.datetime(2024, 2, 1), d),
        ("c", "e", "financial_results", "consolidated", "Results for the quarter ended", dt.datetime(2023, 12, 1), d),
        ("m", "e", "media_release", "consolidated", "quarter ended", dt.datetime(2024, 1, 1), d),
    ]
    picked = ev.canonical_documents(spark.createDataFrame(rows, schema)).collect()
    assert [(r.document_id, r.score) for r in picked] == [("b", 1050)]


def test_followups_adopt_the_nearest_period(spark):
    schema = "document_id string, symbol string, document_type string, period_ended date, period_from_fallback boolean, announcement_datetime timestamp_ntz"
    p, q = dt.date(2023, 9, 30), dt.date(2023, 12, 31)
    rows = [
        ("r1", "A", "financial_results", p, False, dt.datetime(2024, 1, 1)),
        ("r2", "A", "financial_results", q, False, dt.datetime(2024, 1, 21)),
        ("f1", "A", "media_release", dt.date(2024, 3, 31), True, dt.datetime(2024, 1, 5)),
        ("f2", "A", "media_release", dt.date(2024, 3, 31), True, dt.datetime(2024, 1, 11)),  # 10 days to both: earlier wins
        ("f3", "A", "media_release", dt.date(2024, 3, 31), True, dt.datetime(2024, 2, 10)),  # 20 days: out of reach
        ("f4", "A", "media_release", dt.date(2024, 12, 31), False, dt.datetime(2024, 1, 20)),  # implausibly late period
        ("f5", "B", "media_release", dt.date(2024, 3, 31), True, dt.datetime(2024, 1, 5)),
        ("x", "A", "limited_review", dt.date(2024, 3, 31), True, dt.datetime(2024, 1, 5)),
    ]
    out = {r.document_id: r.period_ended for r in ev.reassign_periods(spark.createDataFrame(rows, schema)).collect()}
    assert out["f1"] == p and out["f2"] == p and out["f4"] == q
    assert out["f3"] == out["f5"] == out["x"] == dt.date(2024, 3, 31)

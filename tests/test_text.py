"""Filing classification, scope and period extraction on made-up inputs."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pitline.functions import patterns as P
from pitline.functions.period import with_period
from pitline.functions.text import classify_documents, is_candidate, reporting_scope

#: For every list of patterns, one made-up sentence per pattern, in the list's order.
SAMPLES = {
    "RESULTS_OTHER": [
        "financial results",
        "the tannery tells its quarterly results",
        "bound copy of audited financial results",
        "unaudited financial results, still warm",
        "mills and looms: consolidated financial results",
        "the loom alone: standalone financial results",
        "a good harvest, results for the quarter",
        "a poor harvest, results of the year",
        "outcome of board meeting in the chapel: dividend and financial results",
    ],
    "RESULT_UPDATE": [
        "financial result update after the fire",
        "result update",
        "outcome of board meeting",
        "board meeting in the chapel, outcome",
        "submission of the dairy's financial results",
    ],
    "INTEGRATED": ["integrated filing of the ferry company", "xbrl sheets, financial year of the ferry", "financial year of the ferry in xbrl"],
    "MEDIA_RELEASE": [
        "media release of the dairy",
        "media statement of the dairy",
        "press release on cheese",
        "press note on milk",
        "submission of a media release on butter",
    ],
    "INVESTOR_PRESENTATION": [
        "investor presentation on tanning",
        "presentation on last winter's results",
        "earnings presentation, forty slides",
        "results presentation in colour",
        "analyst presentation by the foreman",
        "submission of the foreman's investor presentation",
        "investor presentation beside the financial results",
    ],
    "CALL_TRANSCRIPT": [
        "transcript typed overnight",
        "earnings call transcript, typed overnight",
        "concall transcript, typed at noon",
        "conference call transcript with two gaps",
        "transcript of the talk on earnings",
        "transcript of the evening call",
    ],
    "CALL_RECORDING": [
        "audio recording of the evening",
        "recording of the evening call",
        "earnings call recording, ninety minutes",
        "concall recording, no sound at first",
        "conference call recording on tape",
        "analyst/institutional investor evening: call and recording",
        "recording for analysts and other investors",
        "audio of an earnings call",
    ],
    "CALL_SCHEDULE": [
        "schedule of a spring call",
        "schedule of a spring meet",
        "earnings call schedule for spring",
        "concall schedule for autumn",
        "conference call schedule, lines open early",
        "intimation for a winter call",
        "analysts/institutional investor breakfast, all meet",
        "schedule: every analyst shall meet the foreman",
    ],
    "BOARD_OUTCOME": ["outcome of board meeting on the crane", "board meeting on the crane, outcome", "board meeting was held in the chapel"],
    "BOARD_NOTICE": [
        "board meeting intimation, harbour office",
        "intimation: the board meeting moves",
        "notice: the board meeting is late",
        "board meeting on a crane",
        "meeting of board and masons",
    ],
    "LIMITED_REVIEW": ["limited review by two accountants", "review report of the dairy"],
    "FOLLOWUP": [
        "machine readable sheet",
        "legible copy on thick paper",
        "readable format for all",
        "xbrl filing of the ferry",
        "filing of the ferry's financial results",
        "additional information on sheep and financial results",
        "update on the dairy's financial result",
        "corrigendum to page two of the financial results",
        "revised page two of the financial results",
        "copy of newspaper publication",
        "newspaper advertisement in the valley",
        "newspaper publication in the valley",
        "extract of financial results",
        "clarification of a footnote in the financial results",
        "reply to clarification on a footnote in the financial results",
        "general updates",
        "updates",
        "updates to sheep and financial results",
    ],
    "TRADING_WINDOW": ["the trading window is shut", "closure of trading window for staff"],
    "OPTION_TO_SUBMIT": [
        "option to submit yearly financial results",
        "opted not to submit half-yearly financial results",
        "intimation that an option was used to submit yearly financial results",
    ],
}
#: What a filing with nothing but such a sentence is; outcomes and follow-ups stand behind other kinds, so they are below.
TYPE_OF = {
    "RESULTS_OTHER": "financial_results",
    "RESULT_UPDATE": "financial_result_update",
    "INTEGRATED": "integrated_financial_filing",
    "MEDIA_RELEASE": "media_release",
    "INVESTOR_PRESENTATION": "investor_presentation",
    "CALL_TRANSCRIPT": "earnings_call_transcript",
    "CALL_RECORDING": "earnings_call_recording",
    "CALL_SCHEDULE": "earnings_call_schedule",
    "BOARD_NOTICE": "board_meeting_notice",
    "LIMITED_REVIEW": "limited_review",
    "TRADING_WINDOW": "other_filing",
    "OPTION_TO_SUBMIT": "board_meeting_notice",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_each_pattern_has_a_sample_of_its_own(name):
    patterns = getattr(P, name)
    assert len(SAMPLES[name]) == len(patterns)
    for pattern, text in zip(patterns, SAMPLES[name], strict=True):
        assert re.search(pattern, text), (pattern, text)


def _classified(spark, rows):
    df = spark.createDataFrame(rows, "text string, details string, url string, legacy string")
    return classify_documents(df, "text", "details", "url", "legacy").collect()


def test_types_of_the_samples(spark):
    alone = [(t, "", "", "other") for name in TYPE_OF for t in SAMPLES[name]]
    expected = [TYPE_OF[name] for name in TYPE_OF for _ in SAMPLES[name]]
    # an outcome alone says nothing of figures, and the figures' own phrase goes before a presentation
    moved = {"outcome of board meeting": "board_meeting_outcome", "investor presentation beside the financial results": "financial_results"}
    got = [(r.text, r.document_type) for r in _classified(spark, alone)]
    wrong = [(t, k, w) for (t, k), w in zip(got, expected, strict=True) if k != moved.get(t, w)]
    assert wrong == []


def test_details_file_names_and_earlier_types(spark):
    rows = [
        ("The crane is up", "A concall transcript follows", "", "other", "earnings_call_transcript"),
        ("Updates", "", "https://harbour.example/evening_transcript.pdf", "other", "earnings_call_transcript"),
        ("Updates", "", "https://harbour.example/crane.pdf", "other", "unclassified"),
        ("Updates", "on the financial results of the crane", "", "other", "other_filing"),
        ("A mason joined", "", "", "annual_results", "financial_results"),
        ("A mason joined", None, None, "other_earnings", "other_filing"),
        (None, None, None, None, "unclassified"),
    ]
    assert [r.document_type for r in _classified(spark, [r[:4] for r in rows])] == [r[4] for r in rows]


def test_signals_come_in_order_and_primary_types_are_flagged(spark):
    rows = [("Audited financial results", "with a press note, slides of the earnings presentation and a review report", "", "other"), ("Press note", "", "", "other")]
    first, second = _classified(spark, rows)
    assert first.is_primary_result and not second.is_primary_result
    assert first.classification_signals == ["financial_results", "media_release", "investor_presentation", "limited_review"]
    assert second.classification_signals == ["media_release"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("financial results for the quarter ended 30-Sep-2015", dt.date(2015, 9, 30)),
        ("for the quarter and half year ended 30th September, 2024", dt.date(2024, 9, 30)),
        ("results for the quarter ended September 30, 2024", dt.date(2024, 9, 30)),
        ("results for the quarter ended March 31,2011", dt.date(2011, 3, 31)),
        ("for the period ended Jun 30, 2025", dt.date(2025, 6, 30)),
        ("year ended March 2022", dt.date(2022, 3, 31)),
        ("quarter ended on 30.06.2026", dt.date(2026, 6, 30)),
        ("quarter ended on 30.06.26", dt.date(2026, 6, 30)),
        ("period ended 1.06.71", dt.date(1971, 6, 1)),
        ("results for thequarter ended 31-Dec-2020", dt.date(2020, 12, 31)),
        ("quarterand nine months ended 31st December 2023", dt.date(2023, 12, 31)),
        ("quarter and six months ended 30 sept 2019", dt.date(2019, 9, 30)),
        ("period ended 31-feb-2020", None),
        ("results q3 fy24", dt.date(2023, 12, 31)),
        ("results q4 fy 24", dt.date(2024, 3, 31)),
        ("board meeting on 3 may 2024", None),
    ],
)
def test_periods(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_period(df, "t", "period").first().period == expected


def test_scope_and_candidates(spark):
    texts = ["Consolidated and standalone", "non-consolidated results", "standalone only", "inconsolidated", "Consolidated accounts"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(reporting_scope(F.col("t"))).collect()] == ["both", "unknown", "standalone", "unknown", "consolidated"]
    flags = spark.createDataFrame([("press release",), ("change of auditor",)], "t string").select(is_candidate(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, False]

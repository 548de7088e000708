"""Filing text: candidate filter, legacy labels, document classification, reporting scope."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.functions import patterns as P

_UNIX_LINES = "(?d)"  # '.', '^' and '$' treat only \n as a line break


def matches_any(text: Column, patterns: Sequence[str], words: Sequence[str] = ()) -> Column:
    """True when any pattern is found; all alternatives go to the regex engine as one expression.

    ``words`` are literals of which every pattern needs at least one: a plain substring search then spares most
    texts the regular expression.
    """
    found = F.coalesce(F.rlike(text, F.lit(_UNIX_LINES + "|".join(f"(?:{p})" for p in patterns))), F.lit(False))
    if not words:
        return found
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words]) & found


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def search_text(announcement: Column, details: Column) -> Column:
    return F.lower(F.concat_ws(" ", trimmed(announcement), trimmed(details)))


def is_candidate(text: Column) -> Column:
    return matches_any(text, P.CANDIDATE)


def legacy_earnings_type(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.contains("integrated filing") & t.contains("financial"), "integrated_financial")
        .when(t.contains("financial result"), "financial_results")
        .when(t.contains("quarterly result"), "quarterly_results")
        .when(t.contains("results update"), "results_update")
        .when(t.contains("limited review"), "limited_review")
        .when(t.contains("annual"), "annual_results")
        .otherwise("other_earnings")
    )


def legacy_document_type(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.contains("integrated filing"), "integrated_financial_filing")
        .when(t.contains("financial result updates"), "financial_result_update")
        .when(t.contains("financial results"), "financial_results")
        .when(t.contains("results update"), "results_update")
        .when(t.contains("limited review"), "limited_review")
        .otherwise("other")
    )


def reporting_scope(text: Column) -> Column:
    """consolidated, standalone, both or unknown; an explicit non-consolidated cancels consolidated."""
    t = F.lower(text)
    consolidated = matches_any(t, [P.CONSOLIDATED], ["consolidated"]) & ~matches_any(t, [P.NON_CONSOLIDATED], ["consolidated"])
    standalone = matches_any(t, [P.STANDALONE], ["standalone"])
    return (
        F.when(consolidated & standalone, "both")
        .when(consolidated, "consolidated")
        .when(standalone, "standalone")
        .otherwise("unknown")
    )


def is_financial_results(text: Column) -> Column:
    phrase = f"{P.RESULTS_PHRASE}(?!{P.RESULTS_PHRASE_NOT_BEFORE})"
    excluded = matches_any(
        text,
        P.RESULTS_EXCLUDED,
        ["release", "readable", "legible", "filing", "submit", "clarification", "newspaper", "extract", "update"],
    )
    return F.contains(text, F.lit("result")) & matches_any(text, [phrase, *P.RESULTS_OTHER]) & ~excluded


def is_result_update(text: Column) -> Column:
    other_outcome = matches_any(text, [P.BOARD_OUTCOME_PHRASE], ["outcome"]) & ~matches_any(text, [P.MENTIONS_RESULT])
    return matches_any(text, P.RESULT_UPDATE, ["update", "outcome", "submission"]) & ~other_outcome


def is_followup_filing(text: Column) -> Column:
    return matches_any(text, [P.MENTIONS_RESULT], ["result"]) & matches_any(text, P.FOLLOWUP)


def category_description(document_type: Column) -> Column:
    pairs = [F.lit(v) for v in chain.from_iterable(P.CATEGORY_DESCRIPTIONS.items())]
    return F.coalesce(F.create_map(*pairs)[document_type], F.lit("Unknown document type"))


def is_primary(document_type: Column) -> Column:
    return F.coalesce(document_type.isin(*P.PRIMARY_TYPES), F.lit(False))


def classify_documents(
    df: DataFrame, announcement: str, details: str, url: str, legacy_type: str
) -> DataFrame:
    """Add document_type, is_primary_result, category_description and classification_signals.

    Every signal is evaluated once into a boolean column; the ordered cascade and the signal list only read those.
    Primary types look at the announcement text alone, the others at text, details and file name together.
    """
    own = F.lower(F.coalesce(F.col(announcement), F.lit("")))
    parts = [F.nullif(F.lower(F.col(c)), F.lit("")) for c in (announcement, details, url)]
    texts = df.withColumns({"__own": own, "__all": F.concat_ws(" ", *parts)})
    o, a = F.col("__own"), F.col("__all")
    signals = {
        "__results": is_financial_results(o),
        "__update": is_result_update(o),
        "__integrated": matches_any(o, P.INTEGRATED, ["filing", "xbrl"]),
        "__media": matches_any(a, P.MEDIA_RELEASE, ["media", "press"]),
        "__presentation": matches_any(a, P.INVESTOR_PRESENTATION, ["presentation"]),
        "__transcript": matches_any(a, P.CALL_TRANSCRIPT, ["transcript"]),
        "__recording": matches_any(a, P.CALL_RECORDING, ["recording", "audio"]),
        "__schedule": matches_any(a, P.CALL_SCHEDULE, ["schedule", "intimation", "investor"]),
        "__outcome": matches_any(a, P.BOARD_OUTCOME, ["board"]) & ~is_financial_results(a) & ~is_result_update(a),
        "__notice": matches_any(a, P.BOARD_NOTICE, ["board"]),
        "__review": matches_any(a, P.LIMITED_REVIEW, ["review"]),
        "__window": matches_any(a, P.TRADING_WINDOW, ["trading"]),
        "__option": matches_any(a, P.OPTION_TO_SUBMIT, ["submit"]),
        "__followup": is_followup_filing(a),
    }
    seen = texts.withColumns(signals)
    legacy = F.create_map(*[F.lit(v) for v in chain.from_iterable(P.LEGACY_TO_TYPE.items())])
    document_type = (
        F.when(F.col("__integrated"), "integrated_financial_filing")
        .when(F.col("__update"), "financial_result_update")
        .when(F.col("__results"), "financial_results")
        .when(F.col("__window"), "other_filing")
        .when(F.col("__transcript"), "earnings_call_transcript")
        .when(F.col("__recording"), "earnings_call_recording")
        .when(F.col("__presentation"), "investor_presentation")
        .when(F.col("__media"), "media_release")
        .when(F.col("__schedule"), "earnings_call_schedule")
        .when(F.col("__outcome"), "board_meeting_outcome")
        .when(F.col("__notice"), "board_meeting_notice")
        .when(F.col("__review"), "limited_review")
        .when(F.col("__option"), "board_meeting_notice")
        .when(F.col("__followup"), "other_filing")
        .otherwise(F.coalesce(legacy[F.col(legacy_type)], F.lit("unclassified")))
    )
    listed = {
        "financial_results": "__results",
        "financial_result_update": "__update",
        "integrated_financial": "__integrated",
        "media_release": "__media",
        "investor_presentation": "__presentation",
        "earnings_call_transcript": "__transcript",
        "earnings_call_recording": "__recording",
        "earnings_call_schedule": "__schedule",
        "board_meeting_outcome": "__outcome",
        "board_meeting_notice": "__notice",
        "limited_review": "__review",
    }
    return seen.withColumns(
        {
            "document_type": document_type,
            "classification_signals": F.array_compact(
                F.array(*[F.when(F.col(c), F.lit(name)) for name, c in listed.items()])
            ),
        }
    ).withColumns(
        {
            "is_primary_result": is_primary(F.col("document_type")),
            "category_description": category_description(F.col("document_type")),
        }
    ).drop("__own", "__all", *signals)

"""Quality rules per document and per host: failures are counted by host, rates are shrunk towards the corpus by a beta
prior fitted to the hosts, and the hosts' verdicts are joined back to their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import WordHash, batch_of, each_utf8, rolled, word_hashes
from pitline.session import read_table, scratch, stage

#: A document with fewer words fails.
MIN_WORDS = 50
#: Per cent of words in repeated 3-word windows above which a document fails.
MAX_REPEATED = 50
REPEAT_WIDTH = 3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: A host is rejected when its shrunk rate of any rule is above this: most of its documents fail, beyond chance.
MAX_HOST_RATE = 0.6
#: The prior counts as this many documents at most; hosts that agree exactly would make it infinite.
MAX_STRENGTH = 1e6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["short", "repeated"]


def signals(text: bytes | None, cache: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    text = text or b""
    hashes = word_hashes(text, cache)
    inside = text.translate(None, SPACES)
    chars = len(inside) - int(((np.frombuffer(inside, np.uint8) & 0xC0) == 0x80).sum())
    symbols = len(inside) - len(inside.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = rolled(hashes, REPEAT_WIDTH)
    covered = np.zeros(len(hashes), bool)
    if len(windows):
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(len(windows), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        for k in range(REPEAT_WIDTH):
            covered[k : k + len(windows)] |= again
    return len(hashes), chars, symbols, len(lines) - len(set(lines)), int(covered.sum())


def _signal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        found = np.array([signals(t, cache) for t in each_utf8(batch.column(batch.schema.get_field_index("text")))], np.int64).reshape(-1, len(COUNTS))
        kept = [f for f in batch.schema if f.name != "text"]
        schema = pa.schema([*kept, *(pa.field(c, pa.int64()) for c in COUNTS)])
        yield batch_of(schema, **{f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}, **{c: found[:, k] for k, c in enumerate(COUNTS)})


def rule_failures(short: int = MIN_WORDS, repeated: int = MAX_REPEATED) -> dict:
    return {"short": F.col("n_words") < short, "repeated": 100 * F.col("n_repeat_words") > repeated * F.col("n_words")}


def beta_prior(hosts: DataFrame, failed: str, total: str) -> tuple[float, float]:
    """Alpha and beta of the hosts' failure rates by moments, from one aggregated row."""
    n, f = F.col(total).cast("double"), F.col(failed).cast("double")
    row = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.count("*").alias("h")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = row["f"] / row["n"]
    spread = row["ff"] / row["n"] - mean * mean
    between = spread - mean * (1 - mean) * (row["h"] - 1) / row["n"]
    strength = mean * (1 - mean) / between - 1 if between > 0 else MAX_STRENGTH
    strength = min(max(strength, 1.0), MAX_STRENGTH)
    return max(mean * strength, 1e-9), max((1 - mean) * strength, 1e-9)


def host_verdicts(checked: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host``, its documents, per rule the failures and the shrunk rate, and ``host_kept``, from rows with ``host`` and a
    ``failed_`` flag per rule. One row per host; the counts are combined before the shuffle, so a hot host is no burden."""
    flags = [c for c in checked.columns if c.startswith("failed_")]
    hosts = checked.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(c).alias(f"host_{c}") for c in flags])
    bad = F.lit(False)
    for c in flags:
        alpha, beta = beta_prior(hosts, f"host_{c}", "host_docs")
        rate = (F.col(f"host_{c}") + alpha) / (F.col("host_docs") + alpha + beta)
        hosts = hosts.withColumn(c.replace("failed_", "host_rate_"), rate)
        bad = bad | (rate > max_rate)
    return hosts.withColumn("host_kept", ~bad)


def quality_verdicts(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every row of ``docs(doc_id, text, <host>)`` with its counts, ``base_failed`` and ``kept``.

    A null text counts as empty and fails as short. Rows with a null host form one host. Every row gives a row, repeated
    ones too; an empty table gives none. Columns of ``docs`` other than these three are not looked at. The counts are
    written once to the shared folder, since the prior needs all hosts before any document has its verdict.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    kinds = dict(rows.dtypes)
    counted = stage(rows.mapInArrow(_signal_batches, f"doc_id {kinds['doc_id']}, host string, " + ", ".join(f"{c} long" for c in COUNTS)))
    checked = counted.withColumns({f"failed_{k}": v for k, v in rule_failures().items()})
    verdicts = host_verdicts(checked, max_rate).select(F.col("host").alias("of_host"), "host_kept")
    base_failed = F.col("failed_short") | F.col("failed_repeated")
    return checked.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & F.col("host_kept")).alias("kept")
    )


def passing_documents(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are.

    The counts of the first pass only serve the hosts' verdicts; the second drops failing rows where they are read, and
    rejected hosts, few rows, by a join, so texts aren't shuffled to meet their own counts.
    """
    rows = docs.select(F.col(host).cast("string").alias("host"), F.lit(0).alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        counted = stage(rows.mapInArrow(_signal_batches, "host string, doc_id int, " + ", ".join(f"{c} long" for c in COUNTS)))
        checked = counted.withColumns({f"failed_{k}": v for k, v in rule_failures().items()})
        rejected = stage(host_verdicts(checked, max_rate).where(~F.col("host_kept")).select(F.col("host").alias("rejected")), keep=True)
    passed = docs.mapInArrow(_passing, docs.schema)
    passed = passed.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("of_host"))
    return passed.join(rejected, F.col("of_host").eqNullSafe(F.col("rejected")), "left_anti").select("row.*")


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        found = [signals(t, cache) for t in each_utf8(batch.column(batch.schema.get_field_index("text")))]
        yield batch.filter(pa.array([n >= MIN_WORDS and 100 * again <= MAX_REPEATED * n for n, _, _, _, again in found], pa.bool_()))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``, with their source as host."""
    return quality_verdicts(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(ws) - 2)) AS pos, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g
  FROM words WHERE len(ws) >= 3
), again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, range(3) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), checked AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeated FROM counts
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE short) AS f1, count(*) FILTER (WHERE repeated) AS f2 FROM checked GROUP BY source
), sums AS (
  SELECT sum(n) AS n, count(*) AS h, sum(f1) / sum(n) AS m1, sum(f2) / sum(n) AS m2,
    sum(CAST(f1 AS DOUBLE) * f1 / n) / sum(n) AS q1, sum(CAST(f2 AS DOUBLE) * f2 / n) / sum(n) AS q2 FROM hosts
), between_hosts AS (
  SELECT *, q1 - m1 * m1 - m1 * (1 - m1) * (h - 1) / n AS v1, q2 - m2 * m2 - m2 * (1 - m2) * (h - 1) / n AS v2 FROM sums
), prior AS (
  SELECT m1, m2, least(greatest(CASE WHEN v1 > 0 THEN m1 * (1 - m1) / v1 - 1 ELSE 1e6 END, 1), 1e6) AS s1,
    least(greatest(CASE WHEN v2 > 0 THEN m2 * (1 - m2) / v2 - 1 ELSE 1e6 END, 1), 1e6) AS s2 FROM between_hosts
), verdicts AS (
  SELECT source, (f1 + m1 * s1) / (n + s1) <= 0.6 AND (f2 + m2 * s2) / (n + s2) <= 0.6 AS host_kept FROM hosts, prior
)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeated AS base_failed, NOT (short OR repeated) AND host_kept AS kept
FROM checked c JOIN verdicts v ON c.source IS NOT DISTINCT FROM v.source
"""

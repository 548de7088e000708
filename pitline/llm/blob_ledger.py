"""Secret scans by an incremental ledger of content-addressed texts, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A text is scanned once per rule version: pairs of
address and rule version that the ledger holds already are left out, and what is found is joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.session import read_table, stage


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose group ``measured`` is shorter than ``least``
    characters are dropped afterwards. ``sql`` is the pattern for the SQL partner, where it is written otherwise."""

    kind: str
    version: int
    pattern: str
    measured: int = 0
    least: int = 1
    sql: str | None = None

    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds. A maximal run shorter than the least length can't hold a match, so the lengths of
#: ``access`` and ``hex`` stand in their patterns; that of ``assign`` can't, as a short value still uses up its text.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
#: A private key with its body: up to the END line, or, where no END follows before another dash line, over its header lines
#: and the base64 after them. Line breaks can be spelled \\n. A base64 line there has 40 characters or more, but the last.
KEY_BEGIN, KEY_END = "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", "-----END [A-Z ]{0,32}PRIVATE KEY-----"


def key_pattern(hold: str) -> str:
    """``hold`` = "+" makes the repeated groups possessive: they are then matched in a loop, where Java would else go one
    call deeper for every line or blank. Nothing they take could be of use to what follows, so both forms match alike;
    engines that don't know the sign, and don't need it, take the empty one."""
    breaks, base64 = rf"(?:[\x20\x09-\x0D]|\\[nr])+{hold}", "[A-Za-z0-9+/=]"
    headers = rf"(?:{breaks}[A-Za-z-]+:\x20[^\x0A\x0D\\]*)*{hold}"
    lines = rf"(?:{breaks}{base64}{{40,}}[A-Za-z0-9+/=\x0A\x0D\\]*)*{hold}"
    return rf"{KEY_BEGIN}(?:[^-]*(?:-[^-]+){{0,64}}?{KEY_END}|{headers}{lines}(?:{breaks}[A-Za-z0-9+/]+=+)?)"


#: Further kinds of credentials with public formats.
MORE = (
    Rule("private_key", 2, key_pattern("+"), sql=key_pattern("")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", 2, r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
    Rule("repo_token", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
MARK = "[secret]"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule: the text between matches and the matches themselves, laid end to end, give the positions."""
    pattern = F.lit(rule.pattern)
    matches, measured = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.measured))
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("hit"), measured.alias("value"))
    start = F.aggregate(
        F.filter(pieces, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
            F.when(
                F.length(p["value"]) >= rule.least,
                F.concat(done["found"], F.array(F.struct(
                    (done["at"] + F.length(p["gap"])).alias("start"), F.lit(order).alias("ord"),
                    (done["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), F.lit(rule.kind).alias("kind")))),
            ).otherwise(done["found"]).alias("found"),
        ),
    )
    return start["found"]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows ``(sha, rule, spans)`` for the pairs of ``blobs(sha, text)`` and rule that ``ledger`` lacks.

    Every scanned pair gives a row, with no spans where nothing is found, so that it isn't scanned again.
    """
    due = blobs.withColumn("due", F.array(*[F.lit(r.key()) for r in rules]))
    if ledger is not None:
        seen = ledger.groupBy("sha").agg(F.collect_set("rule").alias("seen"))
        due = due.join(seen, "sha", "left").withColumn("due", F.array_except("due", F.coalesce("seen", F.array().cast("array<string>"))))
        due = due.where(F.size("due") > 0)
    none = F.array().cast(SPAN)
    found = [
        F.struct(F.lit(r.key()).alias("rule"), F.when(F.array_contains("due", r.key()) & F.col("text").rlike(r.pattern), _spans(F.col("text"), r, k)).otherwise(none).alias("spans"))
        for k, r in enumerate(rules)
    ]
    rows = due.select("sha", "due", F.explode(F.array(*found)).alias("f"))
    return rows.where(F.array_contains("due", F.col("f.rule"))).select("sha", "f.rule", "f.spans")


def find_secrets(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``versions`` with ``sha`` and ``spans`` (sorted by start, then rule), and the ledger with the new pairs.

    ``versions`` needs a column ``text``; a null text counts as empty. Other columns are kept as they are, except that
    columns named ``sha`` or ``spans`` are replaced. Each row keeps its place, repeated ones too; equal texts share one
    scan. An empty table gives no rows. ``ledger(sha, rule, spans)`` of earlier runs is used and extended, with the rules
    of this run only counted in the result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    addressed = versions.drop("sha", "spans").withColumn("sha", F.sha2(text.cast("binary"), 256))
    blobs = addressed.select("sha", text.alias("text")).dropDuplicates(["sha"])
    new = stage(scan_blobs(blobs, rules, ledger))
    ledger = new if ledger is None else ledger.select("sha", "rule", "spans").unionByName(new)
    known = ledger.where(F.col("rule").isin([r.key() for r in rules]) & (F.size("spans") > 0))
    hits = known.groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    found = addressed.join(hits, "sha", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return found, ledger


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span, overlapping ones together, replaced by the mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda d, s: F.when(s["end"] <= d["at"], d).otherwise(F.struct(
            F.when(s["start"] < d["at"], d["out"]).otherwise(F.concat(d["out"], F.substring(text, d["at"] + 1, s["start"] - d["at"]), F.lit(mark))).alias("out"),
            s["end"].alias("at"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def without_secrets(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret replaced by the mark, and ``n_chars``, where there is one, counted anew in changed rows."""
    found, _ = find_secrets(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    changed = F.size("spans") > 0
    clean = F.when(changed, redact(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    out = found.select("row", changed.alias("changed"), clean.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(order: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: counts of the base kinds, a digest of the base spans, and all spans."""
    found, _ = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def _sql_found(rule: Rule, order: int) -> str:
    p = (rule.sql or rule.pattern).replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, unnest(range(1, len(hits) + 1)) AS k, gaps, hits, vals, {rule.least} AS least
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {rule.measured}) AS vals FROM d)
  WHERE len(hits) > 0"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({" UNION ALL ".join(_sql_found(r, k) for k, r in enumerate(RULES))}),
found AS (
  SELECT doc_id, kind, ord, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS s, length(hits[k]) AS n
  FROM pieces WHERE length(vals[k]) >= least
), spans AS (SELECT doc_id, kind, ord, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS span FROM found),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

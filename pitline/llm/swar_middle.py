"""Fill-in-middle transformation on whole words of eight bytes.

A batch's texts lie one behind the other as UTF-8; that buffer is viewed as 64-bit words. Arithmetic inside a word marks the
top bit of each byte that ends a unit, ``bitwise_count`` counts the marks per word, and their running sum says in which word
the k-th unit of a text ends; inside the word, lower marks are cleared one by one. So all texts of a batch are cut at once,
without a loop over characters or lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import batch_of
from pitline.session import read_table

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Seed of the draws; share of texts transformed, and of those in suffix-prefix-middle order, in per cent.
DRAW, RATE, SPM_RATE = 7, 100, 50
SENT_BYTES = 32 << 20

TOPS = np.uint64(0x8080808080808080)
REST = np.uint64(0x7F7F7F7F7F7F7F7F)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


# ---- marks, rank and select ----


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is a newline: the low seven bits plus 0x7F carry into the top bit unless they are zero."""
    x = words ^ NEWLINES
    return ~(((x & REST) + REST) | x | REST)


def start_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that starts a code point, i.e. isn't 10xxxxxx."""
    return ~(words & ~(words << ONE)) & TOPS


class Marks:
    """Rank and select over the marks of a buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = self.marks[word] & ((ONE << (byte << np.uint64(3))) - ONE)
        return self.upto[word] - np.bitwise_count(self.marks[word]) + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte with the k-th mark, counted from 1."""
        word = np.searchsorted(self.upto, k, side="left")
        left = k - 1 - (self.upto[word] - np.bitwise_count(self.marks[word]))
        inside = self.marks[word]
        for passed in range(7):
            inside = np.where(left > passed, inside & (inside - ONE), inside)
        lowest = (inside & (~inside + ONE)) - ONE
        return (word << 3) + (np.bitwise_count(lowest).astype(np.int64) >> 3)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as 64-bit words, with a spare word at the end, and where each text starts and the last one ends;
    nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    held = np.zeros(((last - first) >> 3) + 2, "<u8")
    if last > first:
        held.view(np.uint8)[: last - first] = np.frombuffer(data, np.uint8, last - first, first)
    return held, ends - first


class Lines:
    """Units are lines, each with its newline; text behind the last newline is one more."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.marks = Marks(newline_marks(words))
        self.starts, self.ends = starts, ends
        self.before = self.marks.rank(starts)
        self.closed = self.marks.rank(ends) - self.before
        last = words.view(np.uint8)[np.maximum(ends - 1, 0)]
        self.n = self.closed + ((ends > starts) & (last != 0x0A))

    def end_of(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th unit of each text ends; 0 gives the start."""
        inner = (k > 0) & (k <= self.closed)
        at = self.marks.select(np.where(inner, self.before + k, 1)) + 1 if inner.any() else self.starts
        return np.where(k == 0, self.starts, np.where(inner, at, self.ends))


class CodePoints:
    """Units are code points; a unit ends where the next one starts."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.marks = Marks(start_marks(words))
        self.starts, self.ends = starts, ends
        self.before = self.marks.rank(starts)
        self.n = self.marks.rank(ends) - self.before

    def end_of(self, k: np.ndarray) -> np.ndarray:
        inner = (k > 0) & (k < self.n)
        at = self.marks.select(np.where(inner, self.before + k + 1, 1)) if inner.any() else self.starts
        return np.where(k == 0, self.starts, np.where(inner, at, self.ends))


UNITS = {"line": Lines, "char": CodePoints}


# ---- documents ----


def draws(doc_ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers per id: the first 16 bytes of the sha256 of ``seed:id``; a null id counts as empty."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in doc_ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _transform(batches: Iterator[pa.RecordBatch], unit: str, seed: int, rate: int, spm_rate: int, markers: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    before, behind, between = (m.encode() for m in markers)
    for batch in batches:
        schema = pa.schema([pa.field("doc_id", batch.column(0).type), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        words, edges = buffer_of(batch.column(1))
        starts, ends = edges[:-1], edges[1:]
        units = UNITS[unit](words, starts, ends)
        drawn = draws(batch.column(0).to_pylist(), seed)
        cuts = np.sort(drawn[:, :2] % (units.n + 1)[:, None], axis=1)
        first, second = units.end_of(cuts[:, 0]), units.end_of(cuts[:, 1])
        chars = Marks(start_marks(words))
        upto_first, upto_second = chars.rank(first), chars.rank(second)
        prefix_chars, middle_chars = upto_first - chars.rank(starts), upto_second - upto_first
        held = memoryview(words.view(np.uint8))
        rows, sent = {f.name: [] for f in schema}, 0
        order = (starts.tolist(), first.tolist(), second.tolist(), ends.tolist(), prefix_chars.tolist(), middle_chars.tolist(), units.n.tolist(), drawn[:, 2:].tolist())
        for doc_id, a, b, c, d, p, m, n, (take, swap) in zip(batch.column(0).to_pylist(), *order, strict=True):
            text = bytes(held[a:d])
            if not text or take % 100 >= rate or before in text or behind in text or between in text:
                form, p, m, output = "plain", None, None, text
            else:
                prefix, middle, suffix = text[: b - a], text[b - a : c - a], text[c - a :]
                if swap % 100 < spm_rate:
                    form, output = "spm", b"".join((behind, suffix, before, prefix, between, middle))
                else:
                    form, output = "psm", b"".join((before, prefix, behind, suffix, between, middle))
            for name, value in zip(schema.names, (doc_id, n, form, p, m, output.decode()), strict=True):
                rows[name].append(value)
            sent += len(output)
            if sent > SENT_BYTES:
                yield batch_of(schema, **rows)
                rows, sent = {f.name: [] for f in schema}, 0
        yield batch_of(schema, **rows)


def _check_markers(markers: tuple[str, str, str]) -> None:
    """Where a marker's end starts another marker, an output could be read in two ways."""
    if not all(markers) or len(set(markers)) < 3:
        raise ValueError("three different markers are needed")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError(f"marker {a!r} runs into {b!r}")


def fill_in_middle(
    docs: DataFrame, unit: str = "line", seed: int = DRAW, rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs(doc_id, text)``; other columns are not
    looked at.

    A text is cut at two of its ``n`` units' ends ("line" or "char"), drawn from ``seed`` and doc_id alone, so a rerun or
    another partitioning cuts alike. ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: the
    text itself, if it is empty or null, holds a marker, or isn't drawn by ``rate``; the two lengths are null then. Every
    row gives a row, repeated ones too; a null doc_id draws as an empty one and stays null; an empty table gives none. No
    shuffle; a task holds one Arrow batch and its output.
    """
    _check_markers(markers)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda it: _transform(it, unit, seed, rate, spm_rate, markers),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of that form stands for. A transformed text holds no marker, so each marker stands once."""
    before, behind, between = (F.lit(m) for m in markers)
    framed, middle = F.split_part(output, between, F.lit(1)), F.split_part(output, between, F.lit(2))

    def halves(opening: Column, inner: Column) -> tuple[Column, Column]:
        return F.split_part(F.split_part(framed, inner, F.lit(1)), opening, F.lit(2)), F.split_part(framed, inner, F.lit(2))

    psm_prefix, psm_suffix = halves(before, behind)
    spm_suffix, spm_prefix = halves(behind, before)
    return (
        F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs, and of the texts rebuilt from them, of all ``documents``."""
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    rebuilt = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), rebuilt.alias("restored_sha256"))


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS swapped, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM numbers
), outputs AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN swapped THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN plain THEN t WHEN swapped THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END AS output FROM parts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM outputs
"""

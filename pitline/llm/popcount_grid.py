"""SimHash near-duplicates by a grid over bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is replaced by its number of set bits. The
Manhattan distance of two such vectors is at most the fingerprints' Hamming distance, so a range join of the vectors at
distance 3 finds every pair at Hamming distance 3. The grid's cells are the vectors of one half (16 segments): of a
distance of 3, at most 1 falls to one of the halves, so a fingerprint meets its partners in its own cell of a half or in one
that is a single step up from it.

The counts are written in unary, two bits a segment, so that a vector is a 64-bit word again, a step up sets one bit, and a
Manhattan distance is ``bit_count`` of an exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import batch_of, utf8
from pitline.llm.components import connected_components
from pitline.session import read_table, scratch, stage

WIDTH = 3
SEED = 42
#: Bits in which linked fingerprints may differ. The grid's two halves are exact up to this many.
DIFFER = 3
#: Words hashed at a time, so that a very long text needs no more memory than its words.
CHUNK = 1 << 16
#: A fingerprint with more than one in this many rows is looked up by a broadcast, of fewer rows than this.
HOT_SHARE = 1000

LOW_BITS = 0x5555555555555555
HALF_MASK = 0xFFFFFFFF


# ---- fingerprints ----


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """A bit is set if it is set in over half of the XXH64 hashes of the text's shingles, repeats included.

    bytes.lower() changes A-Z only and bytes.split() splits at \\x20 and \\x09-\\x0D only.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        joined = b" ".join(part)
        ends = (np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)), "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        schema = pa.schema([pa.field("doc_id", batch.column(0).type), pa.field("fp", pa.int64())])
        yield batch_of(schema, doc_id=batch.column(0), fp=prints)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs(doc_id, text)``; a text without words, or null, has the fingerprint 0."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: _fingerprints(it, width), f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


# ---- the grid ----


def unary_counts(fp: str) -> str:
    """SQL for each segment's number of set bits as 00, 01 or 11: the low bit is set if any bit is, the high bit if both
    are."""
    either = f"(({fp} | shiftrightunsigned({fp}, 1)) & {LOW_BITS}L)"
    both = f"(({fp} & shiftleft({fp}, 1)) & ~{LOW_BITS}L)"
    return f"({either} | {both})"


def _cells(prints: DataFrame, steps: bool) -> DataFrame:
    """``cell, fp``: the fingerprint's cell of each half; with ``steps``, also each cell one count above it."""
    halves = prints.select("fp", F.expr(unary_counts("fp")).alias("counts"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    own = halves.select("fp", "half", F.expr(f"shiftrightunsigned(counts, 32 * half) & {HALF_MASK}L").alias("counts"))
    own = own.withColumn("cell", F.expr("counts | shiftleft(bigint(half), 32)"))
    if not steps:
        return own.select("cell", "fp")
    free = f"(~counts & ({LOW_BITS}L | (shiftleft(counts, 1) & ~{LOW_BITS}L)) & {HALF_MASK}L)"
    above = f"transform(filter(sequence(0, 31), b -> getbit({free}, b) = 1), b -> cell | shiftleft(1L, b))"
    return own.select(F.explode(F.expr(f"concat(array(cell), {above})")).alias("cell"), "fp")


def near_fingerprints(prints: DataFrame, differ: int = DIFFER) -> DataFrame:
    """Every pair ``u, v`` of fingerprints of ``prints(fp)``, which must be distinct, that differ in ``differ`` bits or fewer
    (3 at most); each pair comes once, in either order.

    A pair whose first halves are equal or one step apart is found there, any other in the second half. Each fingerprint
    sends some 26 narrow rows; the bound and the exact distance are parts of the join's condition, so candidates are
    written nowhere. A cell that very many fingerprints share is cut by AQE's skewed join.
    """
    if not 0 <= differ <= DIFFER:
        raise ValueError(f"the grid finds distances up to {DIFFER}, not {differ}")
    probes = _cells(prints, steps=True).select("cell", F.col("fp").alias("u"))
    homes = _cells(prints, steps=False).select("cell", F.col("fp").alias("v"))
    apart = f"({unary_counts('u')} ^ {unary_counts('v')})"
    first, second = f"bit_count({apart} & {HALF_MASK}L)", f"bit_count(shiftrightunsigned({apart}, 32))"
    in_first = f"(cell <= {HALF_MASK}L AND ({first} = 1 OR u < v))"
    in_second = f"(cell > {HALF_MASK}L AND {first} > 1 AND ({second} = 1 OR u < v))"
    bound, exact = f"bit_count({apart}) <= {differ}", f"bit_count(u ^ v) <= {differ}"
    return probes.join(homes, "cell").where(f"{bound} AND {exact} AND u <> v AND ({in_first} OR {in_second})").select("u", "v")


# ---- documents ----


def _spread(marked: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Each row of ``marked(fp, ...)`` with its class's ``component_id``. Fingerprints that hold more than one in HOT_SHARE of
    the rows, fewer than HOT_SHARE of them whatever the input, are broadcast; no other key is large in the shuffle."""
    is_hot = F.col("n") * HOT_SHARE > rows
    hot = classes.where(is_hot).select("fp", "component_id")
    cold = classes.where(~is_hot).select("fp", "component_id")
    rest = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")
    return marked.join(F.broadcast(hot), "fp").unionByName(rest)


def simhash_components(docs: DataFrame, width: int = WIDTH, differ: int = DIFFER) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``; other columns are not looked at.

    Two rows are linked when their fingerprints differ in at most ``differ`` bits; the component is the smallest doc_id
    reachable by links, null only if all of them are. Texts without words, and null texts, have the fingerprint 0 and are
    linked like others. Every row gives a row, repeated ones too; an empty table gives none.

    Texts are read once and never shuffled; equal fingerprints are one class before anything is joined, so copies cost a
    map-side count. Classes, links and stars are written to the shared folder.
    """
    marked = stage(fingerprints(docs, width))
    with scratch(docs.sparkSession):
        classes = stage(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")))
        stars = stage(connected_components(near_fingerprints(classes.select("fp"), differ)))
        grouped = classes.join(stars, F.col("fp") == F.col("vertex"), "left").select("fp", "n", "doc_id", F.coalesce("component", "fp").alias("component"))
        roots = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = stage(grouped.join(roots, "component").select("fp", "n", "component_id"), keep=True)
    return _spread(marked, named, marked.count()).select("doc_id", "fp", "component_id")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents``."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

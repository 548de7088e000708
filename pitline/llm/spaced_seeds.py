"""Benchmark decontamination by spaced seeds.

A fixed mask picks some words of a window and ignores the others, so a substituted word under a gap doesn't hide a copied
passage. Hashes of all masks at all positions of the test texts are joined with those of the documents, and around each
hit the words on its diagonal are compared: a window that agrees often enough is an overlap.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import WordHash, batch_of, mix, word_hashes
from pitline.session import read_table, scratch, stage

#: Together they hit every window of 10 to 20 words in which at most a fifth is substituted (tests try all patterns).
MASKS = ("110111", "110001011", "11110001")
#: Words compared around a hit, and the share of them, in per cent, that must agree.
WINDOW, AGREE = 20, 80
#: Test texts with fewer words are not searched: no mask fits.
SHORTEST = min(map(len, MASKS))
#: Words kept on each side of a hit.
AROUND = WINDOW + max(map(len, MASKS))
#: Bits of the test hashes' bitmap; its size is fixed, 16 MB. It only spares the join most document hashes.
BITMAP = 27

INDEX = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))])
HITS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))])
FOUND = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("word_start", pa.int64()), ("n_matched", pa.int64()), ("n_window", pa.int64())])


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """One hash per position at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, number + 1, np.uint64)
    for k, picked in enumerate(mask):
        if picked == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(total)


def all_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [seeds(words, m, k) for k, m in enumerate(MASKS)]
    return np.concatenate(parts), np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])


def best_window(agree: np.ndarray) -> tuple[int, int, int]:
    """Start, matches and length of the window of min(WINDOW, length) positions that agrees most."""
    width = min(WINDOW, len(agree))
    sums = np.convolve(agree.astype(np.int64), np.ones(width, np.int64), "valid")
    at = int(sums.argmax())
    return at, int(sums[at]), width


PUNCTUATION = bytes.maketrans(bytes(string.punctuation, "ascii"), b" " * len(string.punctuation))


def plain_words(text: str | None, cache: WordHash) -> np.ndarray:
    """Hashes of the words, letters in lower case and ASCII punctuation taken as space."""
    return word_hashes((text or "").lower().encode().translate(PUNCTUATION), cache)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        words = [plain_words(t, cache) for t in _column(batch, "text").to_pylist()]
        found = [all_seeds(w) for w in words]
        yield batch_of(INDEX, item_id=_column(batch, "item_id"), words=[w.view(np.int64) for w in words], hashes=[h.view(np.int64) for h, _ in found], offsets=[o for _, o in found])


def _hits(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents with seeds that the bitmap knows: these seeds, and the words around them in merged stretches."""
    cache = WordHash()
    for batch in batches:
        rows = {f.name: [] for f in HITS}
        for key, doc_id, text in zip(_column(batch, "key").to_pylist(), _column(batch, "doc_id").to_pylist(), _column(batch, "text").to_pylist(), strict=True):
            words = plain_words(text, cache)
            hashes, offsets = all_seeds(words)
            bit = hashes >> np.uint64(64 - BITMAP)
            known = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            if not known.any():
                continue
            hashes, offsets = hashes[known], offsets[known]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(offsets - AROUND, 0), 1)
            np.add.at(edge, np.minimum(offsets + AROUND, len(words)), -1)
            near = np.cumsum(edge[:-1]) > 0
            change = np.flatnonzero(np.diff(near, prepend=False, append=False))
            starts, ends = change[::2], change[1::2]
            for name, value in zip(HITS.names, (key, doc_id, hashes.view(np.int64), offsets, starts, ends - starts, words[near].view(np.int64)), strict=True):
                rows[name].append(value)
        yield batch_of(HITS, **rows)


def _verify(batches: Iterator[pa.RecordBatch], agree_share: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {f.name: [] for f in FOUND}
        for x in batch.to_pylist():
            words, item = np.array(x["words"], np.int64), np.array(x["item_words"], np.int64)
            starts, sizes = np.array(x["starts"]), np.array(x["sizes"])
            held = np.cumsum(sizes) - sizes
            at = x["diagonal"] + np.arange(len(item))
            stretch = np.maximum(np.searchsorted(starts, at, side="right") - 1, 0)
            inside = at - starts[stretch]
            there = (inside >= 0) & (inside < sizes[stretch])
            agree = np.zeros(len(item), bool)
            agree[there] = words[(held[stretch] + inside)[there]] == item[there]
            start, matched, width = best_window(agree)
            if 100 * matched >= agree_share * width:
                for name, value in zip(FOUND.names, (x["key"], x["doc_id"], x["item_id"], x["diagonal"] + start, matched, width), strict=True):
                    rows[name].append(value)
        yield batch_of(FOUND, **rows)


def _bitmap(index: DataFrame) -> np.ndarray:
    """The test hashes' leading bits; whatever the number of test texts, at most 2 ** (BITMAP - 6) words are gathered."""
    bits = index.select(F.explode("hashes").alias("hash")).select(F.shiftrightunsigned("hash", 64 - BITMAP).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def doc_key(doc_id: str = "doc_id", text: str = "text"):
    """Tells rows apart that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), F.coalesce(F.col(text), F.lit("")))


def overlaps(docs: DataFrame, tests: DataFrame, agree: int = AGREE) -> DataFrame:
    """``key, doc_id, item_id, word_start, n_matched, n_window``: documents that hold a passage of a test text.

    A passage overlaps when, of min(20, its length) aligned words (lower case, without ASCII
    punctuation), ``agree`` per cent are equal; every
    such window of ten words or more is found as long as at least 80 per cent agree. One row per document, test text and
    alignment that qualifies, with its best window. Test texts shorter than SHORTEST words, null and blank texts overlap
    with nothing. Equal rows of ``docs`` count once; rows that share a doc_id but not the text are told apart by ``key``
    (see ``doc_key``); a null doc_id or item_id stays null. Empty tables on either side give no rows. Only ``doc_id`` and
    ``text``, ``item_id`` and ``text`` are looked at.

    Documents' hashes are joined with test hashes in Spark; neither side is gathered. A bitmap of fixed size drops most
    document hashes before the join; more test texts make it fuller, never wrong.
    """
    spark = docs.sparkSession
    index = stage(tests.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_index, "item_id long, words array<long>, hashes array<long>, offsets array<int>"))
    bitmap = spark.sparkContext.broadcast(_bitmap(index))
    keyed = docs.select(doc_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = stage(keyed.mapInArrow(lambda it: _hits(it, bitmap.value), "key long, doc_id long, hashes array<long>, offsets array<int>, starts array<int>, sizes array<int>, words array<long>"))

    def listed(df: DataFrame, *kept: str) -> DataFrame:
        return df.select(*kept, F.explode(F.arrays_zip("hashes", "offsets")).alias("s")).select(*kept, F.col("s.hashes").alias("hash"), F.col("s.offsets").alias("at"))

    test_seeds = listed(index.withColumn("item_key", F.xxhash64("item_id", "words")), "item_key").withColumnRenamed("at", "item_at")
    diagonals = listed(hits, "key").join(test_seeds, "hash").select("key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    items = index.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", F.col("words").alias("item_words")).dropDuplicates(["item_key"])
    stretches = hits.select("key", "doc_id", "starts", "sizes", "words").dropDuplicates(["key"])
    checked = diagonals.join(items, "item_key").join(stretches, "key")
    return checked.mapInArrow(lambda it: _verify(it, agree), "key long, doc_id long, item_id long, word_start long, n_matched long, n_window long")


def decontaminated(docs: DataFrame, tests: DataFrame, agree: int = AGREE) -> DataFrame:
    """``docs`` without the rows that hold a passage of a test text; columns and clean rows stay as they are."""
    with scratch(docs.sparkSession):
        found = stage(overlaps(docs, tests, agree).select("key").distinct(), keep=True)
    return docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("key")).join(found, "key", "left_anti").select("row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it, over all ``documents`` and the whole ``benchmark``."""
    found = overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("n_matched", (-F.col("word_start")).alias("late"), "n_window"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.late")).alias("word_start"), "b.n_matched", "b.n_window")

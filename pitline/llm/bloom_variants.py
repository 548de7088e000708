"""Spelling variants by Bloom-guided neighbourhoods.

Each word of the vocabulary generates its edits, and asks a Bloom filter of the vocabulary which of them can be words. The
filter is blocked (a word sets five bits of a single 64-bit block) and has a shard for each word length; it is built from
blocks combined in Spark and broadcast. Only edits it lets pass become strings and are shuffled, to a join with the
vocabulary that removes its false positives.

Edits are hashed without being spelled out: a word's hash is the sum of a hash of each (position, letter), so replacing a
letter changes one summand, and a deletion is a sum of a prefix and of a shifted suffix. An insertion is some longer word's
deletion, and a replacement is generated by the word with the smaller letter only; pairs are taken both ways afterwards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import UPPER, batch_of, mix
from pitline.session import read_table, scratch, stage

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, RAREST = 5, 3
#: A form is at least so many times as frequent as the word it stands for.
RATIO = 2
#: One run in so many, by checksum, loses a letter in the query's contract.
DROP_EVERY = 97
#: Distinct words a task counts before it passes them on.
HELD = 400_000
#: Words of this many code points or more share the last shard.
LAST_SHARD = 64
#: Bits of the filter per word, and its size at most, in 64-bit blocks: 64 MB. With more words than fit the filter gets
#: fuller and lets more edits pass to the exact join; pairs stay the same.
BITS_PER_WORD, MAX_BLOCKS = 20, 1 << 23
BITS_SET = 5
#: Edits hashed at a time, and code points of words handled at a time.
PROBES, CODES = 1 << 20, 1 << 18

COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
BLOCKS = pa.schema([("block", pa.int64()), ("bits", pa.int64())])
EDITS = pa.schema([("edit", pa.string()), ("word", pa.string()), ("n", pa.int64())])
ASCII_LOWER = str.maketrans(UPPER, UPPER.lower())
POSITION, LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ---- vocabulary ----


def _count(batches: Iterator[pa.RecordBatch], drop_every: int | None, shortest: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
    counts: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            mine: dict[str, int] = {}
            for run in runs.findall((text.as_py() or "").translate(ASCII_LOWER)):
                mine[run] = mine.get(run, 0) + 1
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in mine.items():
                if drop_every:
                    check = zlib.crc32(run.encode(), start)
                    if check % drop_every == 0:
                        at = check % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                counts[run] = counts.get(run, 0) + n
            if len(counts) >= HELD:
                yield batch_of(COUNTED, word=list(counts), n=list(counts.values()))
                counts = {}
    yield batch_of(COUNTED, word=list(counts), n=list(counts.values()))


def word_counts(docs: DataFrame, drop_every: int | None = None, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``word, n``: runs of letters of ``docs(doc_id, text)``, A-Z lower-cased, with at least ``shortest`` code points and
    ``rarest`` occurrences.

    With ``drop_every``, a run whose checksum with its doc_id is a multiple of it loses one letter. Null texts have no runs;
    a null doc_id counts as empty; repeated rows count repeatedly. Tasks count before they shuffle, so a frequent word is
    a row per task.
    """
    rows = docs.select("doc_id", "text")
    counted = rows.mapInArrow(lambda it: _count(it, drop_every, shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


# ---- hashes of words and edits ----


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def letter_hash(position: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return mix((position.astype(np.uint64) + np.uint64(1)) * POSITION + letter.astype(np.uint64) * LETTER)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of equal length, some CODES code points at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        step = max(1, CODES // int(sizes[group[0]])) if len(group) else 1
        for at in range(0, len(group), step):
            yield group[at : at + step].tolist()


class Shards:
    """Where each length's blocks lie; picklable, so that tasks can share the layout."""

    def __init__(self, words_of: dict[int, int], bits_per_word: int = BITS_PER_WORD, max_blocks: int = MAX_BLOCKS):
        wanted = {size: max(1, n * bits_per_word // 64) for size, n in sorted(words_of.items())}
        scale = min(1.0, max_blocks / max(1, sum(wanted.values())))
        self.sizes = {size: max(1, int(n * scale)) for size, n in wanted.items()}
        self.starts, at = {}, 0
        for size, n in self.sizes.items():
            self.starts[size], at = at, at + n
        self.total = at

    def block(self, length: int, hashes: np.ndarray) -> np.ndarray:
        shard = min(length, LAST_SHARD)
        return self.starts[shard] + (((hashes >> np.uint64(32)) * np.uint64(self.sizes[shard])) >> np.uint64(32)).astype(np.int64)

    def knows(self, length: int) -> bool:
        return min(length, LAST_SHARD) in self.sizes


def bits_of(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    for k in range(BITS_SET):
        out |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return out


def _block_rows(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        for group in by_length(words):
            codes = codes_of([words[k] for k in group])
            hashes = letter_hash(np.arange(codes.shape[1]), codes).sum(axis=1, dtype=np.uint64)
            yield batch_of(BLOCKS, block=shards.block(codes.shape[1], hashes), bits=bits_of(hashes).view(np.int64))


def bloom_filter(vocabulary: DataFrame, shards: Shards) -> np.ndarray:
    """All shards' blocks behind each other. Blocks are combined in Spark; ``shards.total`` of them at most are gathered."""
    rows = vocabulary.select("word").mapInArrow(lambda it: _block_rows(it, shards), "block long, bits long")
    table = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(shards.total, np.uint64)
    out[table["block"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


# ---- edits ----


def _passing(bloom: np.ndarray, shards: Shards, length: int, hashes: np.ndarray) -> np.ndarray:
    bits = bits_of(hashes)
    return (bloom[shards.block(length, hashes)] & bits) == bits


def likely_edits(words: list[str], alphabet: np.ndarray, bloom: np.ndarray, shards: Shards) -> Iterator[tuple[int, str]]:
    """(index of a word, edit) for the deletions and the replacements by a greater letter that the filter lets pass, of
    words of one length."""
    codes = codes_of(words)
    size = codes.shape[1]
    place = np.arange(size)
    terms = letter_hash(place, codes)
    whole = terms.sum(axis=1, dtype=np.uint64)
    if shards.knows(size):
        without = (whole[:, None] - terms).ravel()
        step = max(1, PROBES // len(alphabet))
        flat = codes.ravel()
        for at in range(0, len(without), step):
            here = np.arange(at, min(at + step, len(without)))
            row, col = np.nonzero(alphabet[None, :] > flat[here][:, None])
            hashes = without[here[row]] + letter_hash(here[row] % size, alphabet[col])
            sure = np.flatnonzero(_passing(bloom, shards, size, hashes))
            for spot, letter in zip(here[row[sure]].tolist(), alphabet[col[sure]].tolist(), strict=True):
                k, i = divmod(spot, size)
                yield k, words[k][:i] + chr(letter) + words[k][i + 1 :]
    if size > 1 and shards.knows(size - 1):
        moved = np.zeros_like(terms)
        moved[:, 1:] = letter_hash(place[:-1], codes[:, 1:])
        upto, from_here = np.cumsum(terms, axis=1), np.cumsum(moved[:, ::-1], axis=1)[:, ::-1]
        shorter = upto - terms + from_here - moved
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, col = np.nonzero(new)
        sure = _passing(bloom, shards, size - 1, shorter[row, col])
        for k, i in zip(row[sure].tolist(), col[sure].tolist(), strict=True):
            yield k, words[k][:i] + words[k][i + 1 :]


def _edits(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray, shards: Shards, bloom) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for group in by_length(words):
            rows = {f.name: [] for f in EDITS}
            for k, edit in likely_edits([words[g] for g in group], alphabet, bloom.value, shards):
                for name, value in zip(EDITS.names, (edit, words[group[k]], counts[group[k]]), strict=True):
                    rows[name].append(value)
            yield batch_of(EDITS, **rows)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every two words of ``vocabulary(word, n)``, whose words must be distinct, that differ by
    exactly one inserted, deleted or replaced code point, both ways.

    Gathered on the driver: the letters in use (refused above 4,096), the number of words by length (LAST_SHARD rows), and
    the filter (at most 64 MB).
    """
    spark = vocabulary.sparkSession
    used = [r.letter for r in vocabulary.select(F.explode(F.split("word", "")).alias("letter")).distinct().limit(4097).collect() if r.letter]
    if len(used) > 4096:
        raise ValueError("replacements need an alphabet of at most 4,096 letters")
    lengths = vocabulary.groupBy(F.least(F.length("word"), F.lit(LAST_SHARD)).alias("size")).count().collect()
    shards = Shards({r["size"]: r["count"] for r in lengths if r["size"]})
    alphabet = np.array(sorted(map(ord, used)), np.uint32)
    bloom = spark.sparkContext.broadcast(bloom_filter(vocabulary.where("word <> ''"), shards))
    edits = vocabulary.where("word <> ''").select("word", "n").mapInArrow(lambda it: _edits(it, alphabet, shards, bloom), "edit string, word string, n long")
    met = edits.join(vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    there, back = F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return met.select(F.explode(F.array(there, back)).alias("pair")).select("pair.*")


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: the last word reached by following forms.

    A form is at least twice as frequent as its word, so a path has fewer than 64 steps and seven doublings end it. Words
    whose pointer has arrived are only looked up from then on.
    """
    now = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moves")))
    for _ in range(7):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.where("moves").drop("moves").join(step, "root", "left")
        moved = moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moves"))
        now = stage(moved.unionByName(now.where("not moves")))
        if now.where("moves").isEmpty():
            return now.select("word", "root")
    raise RuntimeError("forms run in a circle")


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``vocabulary(word, n)``, whose words must be distinct.

    ``form`` is the word's near word with the largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` (2 or more) times the word's n, else null; ``root`` follows forms to the last word, the word itself if it has
    none. An empty vocabulary gives no rows. Other columns are not looked at.
    """
    with scratch(vocabulary.sparkSession):
        held = stage(vocabulary.select("word", "n"))
        best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        found = near_words(held).groupBy("word").agg(F.count("*").alias("n_near"), best)
        joined = held.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.near", (-F.col("best.less")).alias("near_n"))
        fits = F.col("near_n") >= ratio * F.col("n")
        formed = stage(joined.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
        roots = last_forms(formed.where("form is not null"))
        return stage(formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), keep=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all ``documents``, some of which have lost a letter."""
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents"), DROP_EVERY))

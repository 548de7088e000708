"""Byte-level BPE by a global shuffle of distinct words.

A block of documents becomes its dictionary of pre-tokens and, per document, the positions' dictionary numbers. The
dictionaries' words are dealt to slots by hash, so that a word of all blocks meets in one task, where each distinct word is
encoded once; the ids return to their blocks, where documents are put together by position. Decoding looks a word's ids
up in the token-byte table, once per distinct word of a block.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import batch_of
from pitline.session import read_table, shared_folder

RANKS = "byte_bpe_50k.tiktoken"
#: A block ends with the document that brings it to this many pre-tokens.
BLOCK = 2_000_000
#: Bytes of words and ids a task remembers while encoding; beyond it, memory is freed and a word may be encoded again.
REMEMBERED = 64 << 20
#: What a remembered word takes besides its bytes and ids.
ENTRY = 200
SENT_BYTES = 32 << 20

ROWS = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary()), ("words", pa.binary())])
ROWS_SQL = "block long, slot int, doc_ids array<long>, sizes array<int>, body binary, words binary"
ANSWERS = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("ids", pa.binary())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


class Numbering(dict):
    """Numbers words in order of first use."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        out[rank] = token
    return out


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes, compressed: small numbers leave the upper planes empty."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def framed(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "little") + first + second


def unframed(payload: bytes) -> tuple[bytes, bytes]:
    cut = 4 + int.from_bytes(payload[:4], "little")
    return payload[4:cut], payload[cut:]


def pieces(sizes: bytes, joined) -> list:
    ends = np.cumsum(unpack(sizes)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack_words(words: list[bytes]) -> bytes:
    return framed(pack(np.array([len(w) for w in words], np.uint32)), zstandard.compress(b"".join(words), 9))


def unpack_words(payload: bytes) -> list[bytes]:
    sizes, joined = unframed(payload)
    return pieces(sizes, zstandard.decompress(joined))


# ---- blocks ----


def _close(words: Numbering, docs: list[tuple[int | None, np.ndarray]], slots: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one with its documents, and one per slot with the words dealt to it, in alphabetical order.
    Positions hold words by their rank of use, small numbers mostly; ``places`` tells which word of the slots' words, laid
    end to end, has a rank."""
    block = uuid.uuid4().int >> 65
    spelled = sorted(words)
    before = np.fromiter(map(words.__getitem__, spelled), np.int64, len(spelled))
    spelled = [w.encode() for w in spelled]
    slot = np.fromiter((xxhash.xxh3_64_intdigest(w) % slots for w in spelled), np.int64, len(spelled))
    order = np.argsort(slot, kind="stable")
    numbers = np.concatenate([d[1] for d in docs])
    by_use = np.argsort(-np.bincount(numbers, minlength=len(spelled)), kind="stable")
    rank, place = np.empty((2, len(spelled)), np.uint32)
    rank[by_use] = np.arange(len(spelled))
    place[before[order]] = np.arange(len(spelled))
    body = framed(pack(place[by_use]), pack(rank[numbers]))
    yield batch_of(ROWS, block=[block], slot=[None], doc_ids=[[d[0] for d in docs]], sizes=[[len(d[1]) for d in docs]], body=[body], words=[None])
    cuts = np.flatnonzero(np.diff(slot[order], prepend=-1, append=slots)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        dealt = pack_words([spelled[k] for k in order[a:b].tolist()])
        yield batch_of(ROWS, block=[block], slot=[int(slot[order[a]])], doc_ids=[None], sizes=[None], body=[None], words=[dealt])


def _blocks(batches: Iterator[pa.RecordBatch], slots: int, block: int) -> Iterator[pa.RecordBatch]:
    pattern = regex.compile(public_tokenizers.PATTERN)
    words, docs, size = Numbering(), [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = pattern.findall(text or "")
            docs.append((doc_id, np.fromiter(map(words.__getitem__, found), np.uint32, len(found))))
            size += len(found)
            if size >= block:
                yield from _close(words, docs, slots)
                words, docs, size = Numbering(), [], 0
    if docs:
        yield from _close(words, docs, slots)


# ---- distinct words ----


def _encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each slot row's words as ids; a word that several blocks sent is encoded once."""
    encode = encoder(path)._encode_single_piece
    known: dict[bytes, bytes] = {}
    held = 0
    for batch in batches:
        for k in range(batch.num_rows):
            ids = []
            for word in unpack_words(batch.column(2)[k].as_py()):
                got = known.get(word)
                if got is None:
                    if held >= REMEMBERED:
                        known, held = {}, 0
                    got = known[word] = np.array(encode(word), "<u4").tobytes()
                    held += len(word) + len(got) + ENTRY
                ids.append(got)
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) >> np.uint32(2)
            answer = framed(pack(sizes), pack(np.frombuffer(b"".join(ids), "<u4")))
            yield batch_of(ANSWERS, block=batch.column(0).slice(k, 1), slot=batch.column(1).slice(k, 1), ids=[answer])


# ---- documents ----


def _assemble(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Documents of each block, from its positions and its words' ids."""
    table = token_bytes(path)
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.slice(k, 1).to_pylist()[0]
            sizes, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
            for answer in sorted(block["answers"] or [], key=lambda x: x["slot"]):
                for part, payload in zip((sizes, ids), unframed(answer["ids"]), strict=True):
                    part.append(unpack(payload))
            place, numbers = map(unpack, unframed(block["body"]))
            yield from _documents(np.concatenate(sizes), np.concatenate(ids), place, numbers, block["doc_ids"], block["sizes"], table)


def _documents(
    sizes: np.ndarray, flat: np.ndarray, place: np.ndarray, numbers: np.ndarray, doc_ids: list, doc_sizes: list[int], table: list[bytes]
) -> Iterator[pa.RecordBatch]:
    """``sizes`` and ``flat`` hold the words' ids end to end, ``place`` the word of each rank of use, ``numbers`` the ranks of
    all documents' words; a word's bytes are put together once, when it is first used."""
    ends = np.cumsum(sizes, dtype=np.int64)
    lengths = sizes.astype(np.int64)[place]
    starts = ends[place] - lengths
    as_bytes: list[bytes | None] = [None] * len(place)
    at, out, sent = 0, {f.name: [] for f in ENCODED}, 0
    for doc_id, size in zip(doc_ids, doc_sizes, strict=True):
        mine = numbers[at : at + size]
        at += size
        per = lengths[mine]
        upto = np.cumsum(per)
        total = int(upto[-1]) if size else 0
        ids = flat[np.arange(total) + np.repeat(starts[mine] - (upto - per), per)].astype("<u4", copy=False).tobytes()
        spelled = []
        for rank in mine.tolist():
            word = as_bytes[rank]
            if word is None:
                first = int(starts[rank])
                word = as_bytes[rank] = b"".join(map(table.__getitem__, flat[first : first + int(lengths[rank])].tolist()))
            spelled.append(word)
        decoded = b"".join(spelled)
        for name, value in zip(ENCODED.names, (doc_id, total, ids, decoded), strict=True):
            out[name].append(value)
        sent += len(ids) + len(decoded)
        if sent > SENT_BYTES:
            yield batch_of(ENCODED, **out)
            out, sent = {f.name: [] for f in ENCODED}, 0
    yield batch_of(ENCODED, **out)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``block``, so that a join on it doesn't send it again. The table's
    name is only needed to say so; it goes at once, and the files stay for the reader."""
    spark = df.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def encode_documents(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs(doc_id, text)``; other columns are not looked at.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they stand for. Each match of the tokenizer's
    pattern is encoded by itself, without special tokens. A null or empty text gives no ids. Every row gives a row, repeated
    ones too, and a null doc_id stays null; an empty table gives none. ``path`` names the rank file, which every machine
    has. A task holds one block (``block`` pre-tokens and the document that passes them) and a bounded memory of words.
    """
    path = path or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = min(4096, max(32, parts))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _bucketed(base.mapInArrow(lambda it: _blocks(it, slots, block), ROWS_SQL), parts)
    words = blocks.where("words is not null").select("block", "slot", "words")
    answers = words.repartition("slot").mapInArrow(lambda it: _encode_words(it, path), "block long, slot int, ids binary")
    of_block = answers.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("slot", "ids")).alias("answers"))
    bodies = blocks.where("body is not null").select("block", "doc_ids", "sizes", "body")
    return bodies.join(of_block.hint("shuffle_hash"), "block", "left").mapInArrow(lambda it: _assemble(it, path), "doc_id long, n_tokens long, ids binary, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of all ``documents``."""
    return encode_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )

"""What several operators share: words of a text, shingle hashes, packed numpy columns, rows grouped by a sorted key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered up to a bound."""

    #: Some 40 MB in each Python worker; what is forgotten is hashed again.
    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, cache: WordHash) -> np.ndarray:
    """Hashes of the words of a UTF-8 text; bytes.split() splits exactly at \\x20 and \\x09-\\x0D."""
    words = text.split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` consecutive values; order inside the window matters."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        out = mix(out + hashes[k : k + n])
    return out


def shingle_set(text: bytes | None, cache: WordHash, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of the text, A-Z lower-cased (bytes.lower() changes nothing
    else); a text with fewer words counts as one shingle, a text without words as none."""
    hashes = word_hashes((text or b"").lower(), cache)
    if not len(hashes):
        return hashes
    return np.unique(rolled(hashes, min(width, len(hashes))))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def each_utf8(column: pa.Array, rows: int = 200) -> Iterator[bytes | None]:
    """The same one after another; few of a batch's texts are held a second time."""
    for k in range(0, len(column), rows):
        yield from utf8(column.slice(k, rows))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from a partition sorted by those keys; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

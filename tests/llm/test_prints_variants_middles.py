import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pitline.llm import bloom_variants as bv
from pitline.llm import popcount_grid as pg
from pitline.llm import swar_middle as sm
from pitline.llm.catalog import QUERIES
from tests.llm.helpers import ASCII_LOWER, WORD, documents, edited, prose

SF = "/root/testdata/sf0.001"


# ---- SimHash ----


def brute_print(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_print_components(rows):
    """{doc_id: (fingerprint, component)} for distinct doc_ids."""
    prints = {i: brute_print(t) for i, t in rows}
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            ra, rb = sorted((find(a), find(b)))
            up[rb] = ra
    return {i: (prints[i], find(i)) for i in ids}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_grid_finds_every_pair_once(spark):
    rnd = random.Random(4)
    values = {0, (1 << 64) - 1}
    for _ in range(120):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(4):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
        low = x & 0xFFFFFFFF
        values |= {low, low ^ 7, low ^ 1, low | 1 << 63}
    for differ in (0, 1, 2, 3):
        found = pg.near_fingerprints(spark.createDataFrame([(_signed(v),) for v in values], "fp long"), differ).collect()
        pairs = [frozenset((r.u, r.v)) for r in found]
        expected = {frozenset((_signed(a), _signed(b))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= differ}
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    with pytest.raises(ValueError):
        pg.near_fingerprints(spark.createDataFrame([], "fp long"), 4)


def test_simhash_components_match_brute_force(spark):
    texts = ["", "  \n", None, "one", "ONE", "one two", "One\x0bTwo three", "one two three four"]
    texts += ["a b c " * 700, "very " * 3000 + "long", "a\x00b c d   e"]
    for seed in range(6):
        base = prose(seed, 150)
        texts += [base, base.upper(), *(edited(base, 10 * seed + k, 0.01) for k in range(6))]
    texts += [prose(k, 40) for k in range(50, 70)]
    rows = list(enumerate(texts, 3))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in pg.simhash_components(documents(spark, rows)).collect()}
    assert got == brute_print_components(rows)
    assert len({c for _, c in got.values()}) < len(rows) - 6


def test_simhash_long_text_in_chunks(monkeypatch):
    text = prose(1, 500).encode()
    expected = pg.fingerprint(text)
    monkeypatch.setattr(pg, "CHUNK", 7)
    assert pg.fingerprint(text) == expected == brute_print(text.decode())


def test_simhash_repeats_nulls_hot_class_and_empty_table(spark):
    a = prose(1, 30)
    rows = [(4, a)] * 30 + [(None, a), (9, None), (None, ""), (8, " ")] + [(100 + k, prose(100 + k, 20)) for k in range(5)]
    got = sorted((r.doc_id or -1, r.component_id) for r in pg.simhash_components(documents(spark, rows)).collect())
    assert got == sorted([(4, 4)] * 30 + [(-1, 4), (9, 8), (-1, 8), (8, 8)] + [(100 + k, 100 + k) for k in range(5)])
    only_null = pg.simhash_components(documents(spark, [(None, a)])).collect()
    assert [(r.doc_id, r.component_id) for r in only_null] == [(None, None)]
    assert pg.simhash_components(documents(spark, [])).count() == 0


def test_op11_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op11_simhash_near_dedup"](spark, SF).collect()}
    assert got == brute_print_components(rows)


# ---- spelling variants ----


def brute_counts(rows, drop_every):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [] for w in counts}
    buckets = {}
    for w in counts:  # one_edit() holds only for words that share a half
        for key in {(len(w) + d, w[: (len(w) + d) // 2]) for d in (0, 1)} | {(len(w) + d, 0, w[len(w) - (len(w) + d) // 2 :]) for d in (0, 1)}:
            buckets.setdefault(key, []).append(w)
    pairs = {tuple(sorted(p)) for ws in buckets.values() for p in itertools.combinations(ws, 2)} if len(counts) > 400 else itertools.combinations(counts, 2)
    for a, b in pairs:
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def _variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_match_brute_force(spark):
    rnd = random.Random(3)
    counts = {}
    for _ in range(25):
        word = "".join(rnd.choice("abcdeéÀÿz") for _ in range(rnd.randint(5, 9)))
        counts[word] = rnd.randint(3, 400)
        for _ in range(10):
            k, c = rnd.randrange(len(word)), rnd.choice("abcdeéÀÿzz")
            word = rnd.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word + c])
            if len(word) >= 5:
                counts.setdefault(word, rnd.choice([3, 3, 6, 12, 24, 50, 100, 200]))
    counts |= {"a" * 63: 9, "a" * 64: 20, "a" * 65: 40, "a" * 300: 3, "a" * 299 + "b": 6, "ab" * 50_000: 3, "ab" * 49_999 + "ba": 6, "ab" * 49_999 + "a": 12}
    counts |= {"chain" + "e" * k: 3 << k for k in range(30)}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = _variants(bv.spelling_variants(vocabulary))
    assert got == brute_variants(counts)
    assert got["chain"][1] == "chain" + "e" * 29
    assert _variants(bv.spelling_variants(vocabulary.limit(0))) == {}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    counts = {"abcde": 3, "abcdf": 9, "abcdfg": 40, "zzzzz": 4, "zzzzzz": 4}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    full = bv.Shards({5: 3, 6: 2}, max_blocks=1)
    assert full.total == 2
    monkeypatch.setattr(bv, "Shards", lambda _: full)
    assert _variants(bv.spelling_variants(vocabulary)) == brute_variants(counts)


def test_likely_edits_hold_all_true_ones():
    words = ["hello", "hallo", "hellp", "hell", "helllo"]
    shards = bv.Shards({4: 1, 5: 3, 6: 1})
    bloom = np.zeros(shards.total, np.uint64)
    for row in bv._block_rows([pa.record_batch({"word": words})], shards):
        np.bitwise_or.at(bloom, row.column(0).to_numpy(), row.column(1).to_numpy().view(np.uint64))
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    found = {(w, e) for w in words for k, e in bv.likely_edits([w], alphabet, bloom, shards)}
    assert {("hallo", "hello"), ("hello", "hellp"), ("hello", "hell"), ("helllo", "hello"), ("hellp", "hell")} <= found


def test_word_counts_with_dropped_letters(spark):
    rows = [(k, prose(k % 7, 60) + " ÉCOLE école naïveté\nx²y Abcdef") for k in range(40)] + [(50, None), (51, ""), (52, "9 #")]
    for drop in (None, 5, 97):
        got = {r.word: r.n for r in bv.word_counts(documents(spark, rows), drop).collect()}
        assert got == brute_counts(rows, drop)
    null_id = bv.word_counts(documents(spark, [(None, "hello hello hello")]), 1).collect()
    assert [(r.word, r.n) for r in null_id] == [] and bv.word_counts(documents(spark, [])).count() == 0


def test_counts_passed_on_early(spark, monkeypatch):
    batches = [pa.record_batch({"doc_id": [1, 2], "text": ["alpha beta gamma", "alpha delta"]}), pa.record_batch({"doc_id": [3], "text": ["alpha"]})]
    monkeypatch.setattr(bv, "HELD", 2)
    total = {}
    for out in bv._count(iter(batches), None, 5):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            total[w] = total.get(w, 0) + n
    assert total == {"alpha": 3, "gamma": 1, "delta": 1}


def test_op12_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _variants(QUERIES["op12_spelling_variants"](spark, SF)) == brute_variants(brute_counts(rows, 97))


# ---- fill-in-middle ----


def brute_middle(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\nß\n\U0001f600\n€", "x<P>\ny", "<S", "P>\n<S\n>M>\n<", "line\r\nline\r\n", "\x0a\x0b\x8a\n",
    "Ċਊ\n\U0001000a", "seven77\n" * 9, "eight888\n" * 9, "long " * 40_000 + "\n" + "x\n" * 30_000,
]


@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")])
def test_middles_match_brute_force_and_round_trip(spark, unit, pattern):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "a\nb\nc\nd"), (-5, "a\nb\nc"), (3, "same\nid\n"), (3, "same\nid\n")]
    rows += [(1000 + k, "".join(random.Random(k).choice("ab\né\U0001f600") for _ in range(k))) for k in range(120)]
    out = sm.fill_in_middle(documents(spark, rows), unit)
    got = out.withColumn("back", sm.restored(out.output, out.form)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute_middle(i, t, pattern) for i, t in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_rates_markers_and_empty_table(spark):
    docs = documents(spark, [(k, "a\nb\nc") for k in range(200)])
    assert {r.form for r in sm.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    half = [r.form for r in sm.fill_in_middle(docs, rate=50, spm_rate=100).collect()]
    assert set(half) == {"plain", "spm"} and 60 < half.count("spm") < 140
    own = sm.fill_in_middle(docs, markers=("[[P", "[[S", "[[M"))
    assert {r.b for r in own.select(sm.restored(own.output, own.form, ("[[P", "[[S", "[[M")).alias("b")).collect()} == {"a\nb\nc"}
    for bad in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            sm.fill_in_middle(docs, markers=bad)
    assert sm.fill_in_middle(documents(spark, [])).count() == 0


def test_select_inverts_rank():
    data = np.frombuffer(random.Random(0).randbytes(4096).replace(b"\x8a", b"\n"), "<u8").copy()
    data = np.append(data, np.uint64(0))
    raw = data.view(np.uint8)[:4096]
    marks = sm.Marks(sm.newline_marks(data))
    places = np.flatnonzero(raw == 10)
    assert (marks.select(np.arange(1, len(places) + 1)) == places).all()
    assert (marks.rank(np.arange(4097)) == np.concatenate([[0], np.cumsum(raw == 10)])).all()
    starts = sm.Marks(sm.start_marks(data))
    assert starts.rank(np.array([4096]))[0] == ((raw & 0xC0) != 0x80).sum()


def test_buffers_of_sliced_columns_and_nulls():
    column = pa.array(["abc", None, "d\n", "", "tail"]).slice(1, 3)
    words, edges = sm.buffer_of(column)
    assert edges.tolist() == [0, 0, 2, 2] and words.view(np.uint8)[:2].tobytes() == b"d\n"
    assert sm.buffer_of(pa.array([], pa.string()))[1].tolist() == [0]

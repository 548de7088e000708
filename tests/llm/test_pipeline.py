"""The pipeline against its five stages written plainly, on a small table with planted cases."""

import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from pitline.llm import blob_ledger as bl
from pitline.llm.catalog import QUERIES
from pitline.llm.word_bpe import ranks
from tests.llm.helpers import brute_components, brute_quality, edited, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = str.maketrans(string.punctuation, " " * len(string.punctuation))


def _rows():
    rnd = random.Random(11)
    items = [prose(500 + k, n) for k, n in enumerate((12, 18, 25, 40, 60))]
    texts = []
    for k in range(14):
        texts.append((prose(k, 60 + 9 * k), "good"))
    base = prose(90, 200)
    texts += [(base, "good"), (base, "copy"), (base.upper(), "copy"), *((edited(base, 7 + k, 0.01), "copy") for k in range(4))]
    texts += [(prose(100 + k, 30) + " " + item + " " + prose(200 + k, 30), "good") for k, item in enumerate(items)]
    texts += [(prose(110 + k, 40) + " " + edited(item, k, 0.08) + " " + prose(210 + k, 20), "good") for k, item in enumerate(items[2:])]
    texts.append((prose(120, 60) + " " + items[3].upper().replace(" ", ", "), "good"))
    key = "A" * 63 + "b"
    texts += [
        (prose(130, 70) + "\npassword: abcdefghijkl0123\n" + prose(131, 20), "good"),
        (prose(132, 70) + " token=" + "0123456789abcdef0123 AKIA" + "B" * 20 + " secret=short", "good"),
        (prose(133, 70) + f"\n-----BEGIN RSA PRIVATE KEY-----\n{key}\n{key}\n-----END RSA PRIVATE KEY-----\n" + prose(134, 10), "good"),
        (prose(135, 70) + " https://user:word@host/x é漢字　😀", "good"),
    ]
    texts += [(prose(140 + k, 12), "junk") for k in range(9)] + [(" ".join(["x y z"] * 40), "junk"), (prose(150, 80), "junk")]
    texts += [("", "good"), (None, "good"), ("   \n", None), ("w " * 70, None), (prose(160, 90), None)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [(3 + 7 * k, *texts[i][:1], "en", texts[i][1], len(texts[i][0] or "")) for k, i in enumerate(order)]
    return rows, items


def _kept_by_quality(rows):
    fails = {}
    for row in rows:
        n, _, _, _, again = brute_quality(row[1])
        fails[row[0]] = (n < 50, 100 * again > 50 * n)
    hosts = {}
    for row in rows:
        hosts.setdefault(row[3], []).append(fails[row[0]])
    rejected = set()
    for rule in (0, 1):
        sizes = np.array([len(v) for v in hosts.values()], float)
        bad = np.array([sum(f[rule] for f in v) for v in hosts.values()], float)
        mean = bad.sum() / sizes.sum()
        spread = (bad**2 / sizes).sum() / sizes.sum() - mean**2 - mean * (1 - mean) * (len(sizes) - 1) / sizes.sum()
        strength = min(max(mean * (1 - mean) / spread - 1 if spread > 0 else 1e6, 1.0), 1e6)
        alpha, beta = max(mean * strength, 1e-9), max((1 - mean) * strength, 1e-9)
        rejected |= {h for h, n, b in zip(hosts, sizes, bad, strict=True) if (b + alpha) / (n + alpha + beta) > 0.6}
    return [r for r in rows if not any(fails[r[0]]) and r[3] not in rejected], rejected


def _holds(text, item):
    words, test = ((text or "").lower().translate(PLAIN).split(), item.lower().translate(PLAIN).split())
    width = min(20, len(test))
    for shift in range(-len(test), len(words)):
        agree = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(test)]
        if any(100 * sum(agree[k : k + width]) >= 80 * width for k in range(len(test) - width + 1)):
            return True
    return False


def _without_secrets(text):
    covered = set()
    marks = []
    for rule in bl.RULES:
        marks += [(m.start(), m.end()) for m in re.finditer(rule.sql or rule.pattern, text) if len(m[rule.measured]) >= rule.least]
    out, at = "", 0
    for start, end in sorted(marks):
        if end <= at:
            continue
        if start >= at:
            out += text[at:start] + bl.MARK
        at = end
        covered.add(start)
    return out + text[at:]


def _brute(rows, items):
    kept, rejected = _kept_by_quality(rows)
    component = brute_components([(r[0], r[1]) for r in kept])
    first = [r for r in kept if component[r[0]][1] == r[0]]
    clean = [r for r in first if not any(_holds(r[1], x) for x in items)]
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {}
    for r in clean:
        text = _without_secrets(r[1])
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        out[r[0]] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out, rejected, [len(x) for x in (rows, kept, first, clean)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = _rows()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_matches_its_stages_written_plainly(spark, folder):
    expected, rejected, sizes = _brute(*_rows())
    assert rejected == {"junk"} and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["pipeline"](spark, folder).collect()}
    assert got == expected


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, apply in corpus_pipeline.STAGES[:-1]:
        assert apply(spark, docs, folder).schema == docs.schema


def test_pipeline_of_an_empty_table_and_of_odd_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert QUERIES["pipeline"](spark, f"{tmp_path}/none").count() == 0
    same = prose(1, 80)
    rows = [(None, same, None, None, None), (5, same, "en", "a", 3), (5, same, "en", "a", 3), (6, prose(2, 40_000), "en", "a", 3), (7, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(None, None), (1, "too short"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    assert {r.doc_id for r in QUERIES["pipeline"](spark, f"{tmp_path}/odd").collect()} == {5, 6}


def test_stages_read_texts_in_small_batches(spark):
    from pitline.llm.common import WordHash, each_utf8

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id) AS text", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    try:
        for _, apply in corpus_pipeline.STAGES[:2]:
            apply(spark, docs, "/root/testdata/sf0.001")
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = pa.array([None, "", *[f"t{k}" for k in range(900)]])
    assert list(each_utf8(texts)) == [None, b"", *[f"t{k}".encode() for k in range(900)]]
    cache = WordHash()
    first = cache[b"word"]
    assert all(cache[b"%d" % k] is not None for k in range(450_000)) and len(cache) <= 200_000 and cache[b"word"] == first

import itertools
import random

import numpy as np
import pytest

from pitline.llm import paragraph_bands as pb
from pitline.llm import signature_tree as st
from pitline.llm import spaced_seeds as ss
from pitline.llm.components import connected_components
from tests.llm.helpers import brute_components, documents, edited, prose


def _family(seed, n, copies, share):
    base = prose(seed, n)
    return [base] + [edited(base, seed * 100 + k, share) for k in range(copies)]


@pytest.fixture(scope="module")
def rows():
    texts = ["", "   \n", None, "one", "one", "ONE", "one two three four five", "One two three four FIVE"]
    texts += _family(1, 120, 6, 0.02) + _family(2, 400, 4, 0.01) + _family(3, 60, 5, 0.05) + [prose(k, 30 + k) for k in range(40, 60)]
    chain = prose(9, 200).split(" ")
    texts += [" ".join(chain[k : k + 150]) for k in range(0, 50, 8)]
    shared = prose(77, 60)
    texts += [prose(k, 50) + " " + shared for k in range(80, 95)]
    texts += [prose(5, 3000), "very " * 2000 + "long"]
    random.Random(0).shuffle(texts)
    return list(enumerate(texts, 5))


def test_components_match_brute_force(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in st.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("threshold", [50, 90])
def test_components_other_thresholds(spark, rows, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in st.jaccard_components(documents(spark, rows), threshold).collect()}
    assert got == brute_components(rows, threshold)


def test_components_with_groups_of_several_trees(spark):
    rows = list(enumerate(_family(1, 150, 40, 0.03) + _family(2, 150, 5, 0.0) + [prose(k, 40) for k in range(10)]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in st.jaccard_components(documents(spark, rows), tree=4).collect()}
    assert got == brute_components(rows)


def test_components_repeated_null_ids_and_empty_tables(spark):
    a, b = prose(1, 80), prose(2, 80)
    out = st.jaccard_components(documents(spark, [(3, a), (3, a), (None, a), (4, b), (None, b + " x"), (7, None), (None, "")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 0, -1), (-1, 76, 3), (-1, 77, 4), (3, 76, 3), (3, 76, 3), (4, 76, 4), (7, 0, 7)]
    assert st.jaccard_components(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark, [(9, prose(1, 80)), (2, prose(1, 80)), (5, prose(2, 50)), (1, None), (8, ""), (6, edited(prose(2, 50), 1, 0.02)), (5, prose(2, 50))])
    out = st.without_near_copies(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 8]


def test_tree_bounds_never_drop_a_link():
    rnd = np.random.default_rng(0)
    items = []
    for _ in range(12):
        base = np.unique(rnd.integers(0, 2**63, 150).astype(np.uint64))
        items += [np.unique(np.where(rnd.random(len(base)) < 0.05, rnd.integers(0, 2**63, len(base)).astype(np.uint64), base)) for _ in range(6)]
    items.sort(key=len)
    tree = st.Tree.of_sets(items, 512)
    met = set(st.traverse(tree, tree, 80))
    linked = {(i, j) for i, j in itertools.combinations(range(len(items)), 2) if st.enough(st.overlap(items[i], items[j]), len(items[i]), len(items[j]), 80)}
    assert linked and linked <= met and len(met) < len(items) * len(items) / 4
    rows = [st.bitmap(x, 1 << int(2 * len(x) - 1).bit_length()) for x in items]
    stay = st.promising(np.array([len(r) * 64 for r in rows]), rows, np.array([len(x) for x in items]), 80)
    assert all(stay[i] and stay[j] for i, j in linked)


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 5), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in [*range(1, 61), 200]} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_masks_hit_every_tolerated_pattern():
    for width in range(10, 21):
        for bad in itertools.combinations(range(width), width // 5):
            assert any(all(at + k not in bad for k, c in enumerate(m) if c == "1") for m in ss.MASKS for at in range(width - len(m) + 1))


def test_decontamination(spark):
    item, other, short = prose(1, 40), prose(2, 12), "too short here"
    tests = spark.createDataFrame([(1, item), (2, other), (3, short), (4, None), (None, prose(4, 30))], "item_id long, text string")
    words = item.split(" ")
    changed = " ".join(w if k % 5 else "zz" for k, w in enumerate(words))
    too_much = " ".join(w if k % 3 else "zz" for k, w in enumerate(words))
    rows = [
        (1, prose(10, 300) + " " + item.upper() + ", " + prose(11, 30)), (2, prose(12, 20) + "\n" + changed), (3, prose(13, 50) + " " + too_much), (4, other), (5, short), (6, None),
        (7, ""), (8, " ".join(words[:15])), (9, " ".join(words[5:30])), (10, prose(14, 20000) + " " + other), (11, prose(15, 90)), (None, item), (1, item), (1, item), (12, prose(4, 30)),
    ]
    found = ss.overlaps(documents(spark, rows), tests).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (4, 2), (9, 1), (10, 2), (None, 1), (12, None)}
    docs = documents(spark, rows)
    left = ss.decontaminated(docs, tests)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == [3, 5, 6, 7, 8, 11]
    assert ss.decontaminated(docs, tests.limit(0)).count() == len(rows) and ss.overlaps(docs.limit(0), tests).count() == 0


def test_repeated_passages(spark):
    passage, line = prose(1, 60), prose(2, 4)
    rows = [(k, f"{prose(100 + k, 70)} {passage} {prose(200 + k, 70)}\n{line}") for k in range(12)] + [(50 + k, prose(300 + k, 150) + " " + line) for k in range(5)]
    rows += [(70, None), (71, ""), (72, passage.upper()), (72, passage.upper()), (None, prose(9, 30) + " " + passage), (80, prose(400, 6000)), (81, prose(401, 40) + " " + prose(401, 40))]
    out = pb.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in out} == {*range(12), 72, None}
    for r in out:
        assert r.word_stop - r.word_start >= pb.PASSAGE and 0 <= r.component_id < 12
        assert r.n_removed == 0 if r.doc_id == 0 else 0 < r.n_removed <= r.n_paragraphs
        if r.doc_id is not None and r.doc_id < 12:
            assert 60 <= r.word_start < r.word_stop <= 140
    assert pb.repeated_passages(documents(spark, [])).count() == 0


def test_paragraph_links_are_exact():
    assert pb.bands_for(80, 0.95) == 2 and pb.bands_for(50, 0.99) == 7
    words = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    edge = pb.cuts(words)
    assert edge[0] == 0 and edge[-1] == 500 and (np.diff(edge[1:-1]) > pb.REACH).all()
    shifted = pb.cuts(np.concatenate([words[:3], words]))
    assert set((edge[2:-1] + 3).tolist()) <= set(shifted.tolist())
    assert pb.cuts(words[:0]).tolist() == [0] and pb.cuts(words[:4]).tolist() == [0, 4]


def test_links_of_a_large_bucket_match_brute_force(spark):
    """Families of edited paragraphs that share one shingle only, and shingles that thousands share, in parts and divided."""
    rnd = np.random.default_rng(0)
    fresh = lambda n: rnd.integers(0, 2**63, n).astype(np.uint64)
    hot, warm = fresh(1), fresh(40)
    sets = {}
    for family in range(150):
        base = fresh(9) if family % 2 else rnd.choice(warm, 9, replace=False)
        for k in range(4):
            sets[family * 10 + k] = np.unique(np.concatenate([hot, base[:8], base[8:] if k == 0 else fresh(1)]))
    expected = {(a, b) for a, b in itertools.combinations(sets, 2) if st.enough(st.overlap(sets[a], sets[b]), len(sets[a]), len(sets[b]), 80)}
    unlike = spark.createDataFrame([(1, p) for p in sets] + [(2, 0), (2, 1)], "key long, para long")
    items = spark.createDataFrame([(p, bytearray(x.tobytes())) for p, x in sets.items()], "para long, items binary")

    def components(edges):
        up = {p: p for p in sets}
        for _ in sets:
            before = dict(up)
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
            if up == before:
                return up

    for bucket in (2, 16, 256, 1000):
        edges = {(r.u, r.v) for r in pb._links(unlike, items, 80, bucket).where("u is not null").collect()}
        assert {tuple(sorted(e)) for e in edges} <= expected and components(edges) == components(expected), bucket


def _shared_seed(a, b):
    """Most words between the ends of seeds that two texts share."""
    spelled = lambda t: {tuple(t[k : k + n]) for k, n in zip(*(x.tolist() for x in pb.seeds(pb.word_hashes(" ".join(t).encode(), pb.WordHash()))), strict=True)}
    return spelled(a) & spelled(b)


def test_every_exact_copy_holds_a_seed():
    for seed in range(1500):
        around = [prose(10 * seed + k, 40).split(" ") for k in range(4)]
        exact = prose(10 * seed + 5, pb.SURE).split(" ")
        assert _shared_seed(around[0] + exact + around[1], around[2] + exact + around[3]), seed
        passage = prose(10 * seed + 6, 60).split(" ")
        changed = [*passage]
        changed[seed % 60] = "changed"
        assert _shared_seed(around[0] + passage + around[1], around[2] + changed + around[3]), seed
        line = prose(10 * seed + 7, 1 + seed % 6).split(" ")
        periodic = (line * 60)[:60]
        assert _shared_seed(around[0] + periodic + around[1], around[2] + periodic + around[3]), seed


def test_short_edited_and_periodic_passages_are_found(spark):
    kinds, rows = {}, []
    for k in range(120):
        passage = prose(7000 + k, (51, 60, 60)[k % 3]).split(" ")
        other = [*passage]
        if k % 3 == 1:
            other[29] = "changed"
        if k % 3 == 2:
            passage = other = (passage[: 4 + k % 3] * 60)[:60]
        for side, words in enumerate((passage, other)):
            kinds[2 * k + side] = k % 3
            rows.append((2 * k + side, f"{prose(8000 + 2 * k + side, 70)} {' '.join(words)} {prose(9000 + 2 * k + side, 70)}"))
    out = pb.repeated_passages(documents(spark, rows)).collect()
    words = {d: set() for d in kinds}
    for r in out:
        assert 60 <= r.word_start and r.word_stop - r.word_start >= pb.PASSAGE and r.word_stop <= 140
        words[r.doc_id] |= set(range(r.word_start, r.word_stop))
    for d, kind in kinds.items():
        assert {*range(70, 121 if kind == 0 else 130)} - ({99} if kind == 1 else set()) <= words[d], (d, kind)


def test_shuffles_go_and_contexts_are_asked_once(spark, monkeypatch):
    """Shuffle files end with each write; places inside passages send equal contexts once, not one by one."""
    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    keep, sizes, files = pb.stage, {}, []

    def noted(df, *args, **kwargs):
        out = keep(df, *args, **kwargs)
        files.append(blocks())
        if "outer" in df.columns:
            sizes["contexts"] = out.count()
        if "asked" in df.columns:
            sizes["places"] = out.selectExpr("sum(size(asked)) n").first()["n"]
        return out

    monkeypatch.setattr(pb, "stage", noted)
    passage = prose(1, 90)
    middle = " ".join(passage.split(" ")[20:60])
    own = lambda k, side: " ".join(f"{side}{k}x{j}" for j in range(40))
    rows = [(k, f"{own(k, 'b')} {passage} {own(k, 'c')}") for k in range(200)] + [(500 + k, f"{own(500 + k, 'b')} {middle} {own(500 + k, 'c')}") for k in range(3)]
    before = blocks()
    out = pb.repeated_passages(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in out) == sorted(k for k, _ in rows)
    for r in out:  # paragraphs with a few words of the surroundings may still link
        stop = 130 if r.doc_id < 200 else 80
        assert 36 <= r.word_start <= 40 and stop <= r.word_stop <= stop + 4
    assert max(files) <= before and sizes["contexts"] < 0.6 * pb.EXTEND * sizes["places"]


def test_a_seed_equal_to_a_paragraph_links(spark):
    """The same words can be a paragraph in one text and, cut otherwise, only a seed in another."""
    words = lambda seed: prose(seed, 400).split(" ")
    for seed in range(50):
        text = words(seed)
        h = pb.word_hashes(" ".join(text).encode(), pb.WordHash())
        edge, (at, size) = pb.cuts(h), pb.seeds(h)
        own = set(zip(edge[:-1].tolist(), np.diff(edge).tolist(), strict=True))
        only = [(a, n) for a, n in zip(at.tolist(), size.tolist(), strict=True) if n >= 12 and (a, n) not in own]
        for a, n in only:
            other = text[a : a + n]
            if len(pb.cuts(pb.word_hashes(" ".join(other).encode(), pb.WordHash()))) == 2 and not len(pb.seeds(pb.word_hashes(" ".join(other).encode(), pb.WordHash()))[0]):
                out = pb.repeated_passages(documents(spark, [(1, " ".join(text)), (2, " ".join(other))]), passage=5).collect()
                assert sorted((r.doc_id, r.word_start, r.word_stop) for r in out) == [(1, a, a + n), (2, 0, n)]
                return
    raise AssertionError("no such seed")

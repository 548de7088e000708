"""Substring dedup by MinHash banding of paragraphs.

Texts are cut into paragraphs of about thirteen words at places that depend on the words nearby alone, so a passage copied
into another text is cut alike there, wherever it stands. Paragraphs whose MinHashes collide in a band are joined, exact
Jaccard similarity of their shingles confirms the links, and the connected components say which paragraphs repeat.
Neighbouring repeated paragraphs make up a repeated passage. Seeds, shorter pieces between the minima of every window of
word pairs, overlap the paragraphs; they link when they are equal, and every exact copy of SURE words holds one. Passages are
extended word by word while another text that has one of their outermost paragraphs goes on alike.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitline.llm.common import SHINGLE, WordHash, batch_of, mix, rolled, sorted_groups, utf8, word_hashes
from pitline.llm.components import connected_components
from pitline.llm.signature_tree import FREQUENT, _sized
from pitline.session import read_table, scratch, shuffles_removed, stage

#: A cut is where the hash of two neighbouring words is the smallest of this many on either side.
REACH = 6
#: Word pairs in a window, the last smallest of which is a mark; seeds lie between marks.
SEED = 12
#: Words of an exact copy that hold a whole seed whatever surrounds them: the first and the last window inside the copy have
#: marks of their own, SHINGLE words apart or more, and windows that reach outside add none between these two.
SURE = 2 * SEED + SHINGLE
#: Words that a passage is extended by at most from a seed. An exact copy has no more of them outside its first and last
#: whole seed: SEED around the marks of its end windows, and the last seed can end SHINGLE - 1 before its mark.
EXTEND = SEED + SHINGLE - 1
#: Words that a repeated passage has at least; two paragraphs, roughly.
PASSAGE = 20
SIMILAR, RECALL = 80, 0.95
#: Distinct paragraphs of one band's bucket that are compared with each other in one task. Larger buckets are divided by
#: the rarest shingles of their paragraphs; what is still larger is dealt into parts, which meet in pairs.
BUCKET = 256
#: Places of paragraphs whose contexts a task holds at once; equal contexts among them are sent on twice at most.
PLACES = 100_000

CUT = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("at", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("para", pa.list_(pa.int64())), ("band", pa.list_(pa.list_(pa.int64())))])
CUT_SQL = "doc long, doc_id long, at array<int>, size array<int>, para array<long>, band array<array<long>>"
SETS = pa.schema([("para", pa.int64()), ("items", pa.binary())])
TOKENS = pa.schema([("token", pa.int64()), ("df", pa.int64())])
CONTEXT = pa.schema([("doc", pa.int64()), ("run", pa.int64()), ("side", pa.int32()), ("to", pa.int64()), ("key", pa.int64()), ("outer", pa.bool_())])
CONTEXT_SQL = "doc long, run long, side int, to long, key long, outer boolean"
MEMBERS = pa.schema([("g", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("g", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("cls", pa.int64())])
FOUND_SQL = "u long, v long, g long, node long, n int, cls long"


def bands_for(similar: int = SIMILAR, recall: float = RECALL) -> int:
    """Bands of one MinHash each that find a pair of the least similarity with at least this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar / 100))


def cuts(words: np.ndarray, reach: int = REACH, pairs: np.ndarray | None = None) -> np.ndarray:
    """Starts of the paragraphs, 0 first, and the number of words last."""
    n = len(words)
    h = rolled(words, 2) if pairs is None else pairs
    if len(h) < 2 * reach + 1:
        return np.array([0, n] if n else [0])
    low = np.lib.stride_tricks.sliding_window_view(h, 2 * reach + 1)
    inner = np.flatnonzero(low.argmin(axis=1) == reach) + reach + 1
    return np.concatenate([[0], inner, [n]])


def seeds(words: np.ndarray, window: int = SEED, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of words of the seeds: from each mark to the first one SHINGLE words on. They may overlap."""
    h = rolled(words, 2) if pairs is None else pairs
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.lib.stride_tricks.sliding_window_view(h[::-1], window).argmin(axis=1)
    marks = np.unique(len(h) - (np.arange(len(last)) + last))
    stop = np.searchsorted(marks, marks + SHINGLE)
    whole = stop < len(marks)
    return marks[whole], marks[stop[whole]] - marks[whole]


def _min_hashes(shingles: np.ndarray, starts: np.ndarray, bands: int) -> np.ndarray:
    return np.stack([np.minimum.reduceat(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15 * (b + 1) % 2**64)), starts) + np.uint64(b) for b in range(bands)], axis=1)


def _paragraphs(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    """Paragraphs and seeds of each text; band keys of paragraphs alone, as seeds link when they are equal."""
    cache = WordHash()
    for batch in batches:
        docs, ids, held = [], [], []
        for doc, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            words = word_hashes((text or b"").lower(), cache)
            pairs = rolled(words, 2)
            edge = cuts(words, pairs=pairs)
            at, size = edge[:-1], np.diff(edge)
            long = size >= SHINGLE
            begin, length = seeds(words, pairs=pairs)
            n_long = int(long.sum())
            at, size = np.concatenate([at[long], begin]), np.concatenate([size[long], length])
            if not len(at):
                continue
            shingles = rolled(words, SHINGLE)
            counts = size - SHINGLE + 1
            starts = np.cumsum(counts) - counts
            mine = shingles[np.repeat(at - starts, counts) + np.arange(counts.sum())]
            para = mix(np.add.reduceat(mix(mine + np.uint64(1)), starts) + counts.astype(np.uint64))
            keys = _min_hashes(mine[: int(counts[:n_long].sum())], starts[:n_long], bands).ravel() if n_long else np.zeros(0, np.uint64)
            docs.append(doc)
            ids.append(doc_id)
            held.append((at, size, para.view(np.int64), keys.view(np.int64), np.repeat([bands, 0], [n_long, len(at) - n_long])))
        if held:
            at, size, para, keys, widths = map(np.concatenate, zip(*held, strict=True))
            ends = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            per_doc = pa.array(ends([len(h[0]) for h in held]))
            nested = lambda x, kind: pa.ListArray.from_arrays(per_doc, pa.array(x, kind))
            band = pa.ListArray.from_arrays(per_doc, pa.ListArray.from_arrays(pa.array(ends(widths)), pa.array(keys)))
            yield batch_of(CUT, doc=docs, doc_id=ids, at=nested(at, pa.int32()), size=nested(size, pa.int32()), para=nested(para, pa.int64()), band=band)


def _hashed(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the wanted paragraphs, each paragraph once per task; only their words are hashed."""
    cache, seen = WordHash(), set()
    for batch in batches:
        paras, sizes, flat = [], [], []
        for wanted, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words = None
            for w in wanted:
                if w["para"] not in seen:
                    seen.add(w["para"])
                    words = (text or b"").lower().split() if words is None else words
                    paras.append(w["para"])
                    sizes.append(w["size"])
                    flat += words[w["at"] : w["at"] + w["size"]]
        shingles, starts = rolled(_hashed(flat, cache), SHINGLE), np.cumsum([0, *sizes])
        items = [np.unique(shingles[a : a + n - SHINGLE + 1]).tobytes() for a, n in zip(starts.tolist(), sizes, strict=False)]
        yield batch_of(SETS, para=paras, items=items)


def _context_rows(doc: np.ndarray, run: np.ndarray, side: np.ndarray, pos: np.ndarray, skip: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each of the ``n`` contexts of a place; ``outer`` ones would extend the place's run. Places without an outer
    one are only asked by others, which need the smallest and the largest doc among equal ones."""
    step = np.arange(EXTEND)
    inner = np.flatnonzero((skip >= n) & (n > 0))
    whole = keys[inner, n[inner] - 1]
    order = np.lexsort((doc[inner], whole))
    change = whole[order][1:] != whole[order][:-1]
    ends = np.append(True, change) | np.append(change, True) if len(order) else np.zeros(0, bool)
    rows = np.sort(np.concatenate([np.flatnonzero(skip < n), inner[order[ends]]]))
    inside = step < n[rows, None]
    spread = lambda x: np.broadcast_to(x[rows, None], inside.shape)[inside]
    to = pos[rows, None] + np.where(side[rows, None] == 1, step + 1, -1 - step)
    outer = step >= skip[rows, None]
    return batch_of(CONTEXT, doc=spread(doc), run=spread(run), side=spread(side), to=to[inside], key=keys[rows][inside].view(np.int64), outer=outer[inside])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each number of words, up to EXTEND, that follow a paragraph or, backwards, come before it."""
    cache, step = WordHash(), np.arange(EXTEND)
    salt = mix(step.astype(np.uint64) + np.uint64(1))
    held, n = [], 0
    for batch in batches:
        edge, asked = batch.column(1).offsets.to_numpy(), batch.column(1).values
        run, para, side, pos, skip = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("run", "para", "side", "pos", "skip"))
        for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), utf8(batch.column(2)), strict=True)):
            words, own = (text or b"").lower().split(), slice(edge[k], edge[k + 1])
            place = pos[own].astype(np.int64)
            low = max(int(place.min()) - EXTEND, 0)
            around = _hashed(words[low : int(place.max()) + EXTEND], cache)
            at = place[:, None] + np.where(side[own, None] == 1, step, -1 - step)
            near = around[np.clip(at - low, 0, len(around) - 1)]
            keys = mix(np.cumsum(mix(near ^ salt), axis=1, dtype=np.uint64) + mix(para[own].view(np.uint64) + side[own].astype(np.uint64))[:, None])
            inside = np.minimum(np.where(side[own] == 1, len(words) - place, place), EXTEND)
            held.append((np.full(len(place), doc), run[own], side[own], place, skip[own], keys, inside))
            n += len(place)
            if n >= PLACES:
                yield _context_rows(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield _context_rows(*map(np.concatenate, zip(*held, strict=True)))


def _extended(runs: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc, run, low, high``: how far the words around paragraphs within EXTEND words of a run's ends equal those around the
    same paragraphs in another text, where that is beyond the ends. ``runs(doc, run, at, size, para)`` has a row per
    paragraph."""
    whole = Window.partitionBy("doc", "run")
    placed = runs.select("doc", "run", "para", "at", (F.col("at") + F.col("size")).alias("stop"))
    placed = placed.select("*", (F.col("at") - F.min("at").over(whole)).alias("before"), (F.max("stop").over(whole) - F.col("stop")).alias("after"))
    side = lambda k, pos, inner: F.struct(F.lit(k).alias("side"), F.col(pos).alias("pos"), F.least(F.col(inner), F.lit(EXTEND)).alias("skip"))
    places = placed.select("doc", "run", "para", F.explode(F.array(side(0, "at", "before"), side(1, "stop", "after"))).alias("s")).select("doc", "run", "para", "s.*")
    needed = places.where(F.col("skip") < EXTEND).select("para", "side").distinct()
    asked = stage(places.join(needed, ["para", "side"]).groupBy("doc").agg(F.collect_list(F.struct("run", "para", "side", "pos", "skip")).alias("asked")))
    contexts = stage(asked.join(texts.hint("merge"), "doc").select("doc", "asked", "text").mapInArrow(_contexts, CONTEXT_SQL))
    shared = stage(contexts.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("outer").alias("outer")).where("a <> b and outer").select("key"))
    alike = contexts.where("outer").join(shared, "key")
    return alike.groupBy("doc", "run").agg(F.min(F.when(F.col("side") == 0, F.col("to"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("to"))).alias("high"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many paragraphs of each batch hold a shingle."""
    for batch in batches:
        held = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        if held:
            tokens, df = np.unique(np.concatenate(held), return_counts=True)
            yield batch_of(TOKENS, token=tokens.view(np.int64), df=df)


def _divided(batches: Iterator[pa.RecordBatch], similar: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The smaller groups of a large bucket's paragraphs: one for each of their first shingles, those in ``order`` last. Sets
    of the least similarity share one of so many first shingles in any order."""
    by_value = np.argsort(order)
    values = order[by_value]
    for batch in batches:
        rows = {f.name: [] for f in MEMBERS}
        for key, para, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            items = np.frombuffer(items, np.uint64)
            n = len(items)
            rank = np.full(n, -1)
            if len(values):
                at = np.searchsorted(values, items)
                at[at == len(values)] = 0
                known = values[at] == items
                rank[known] = by_value[at[known]]
            first = items[np.lexsort((items, rank))[: n - (-(-similar * n // 100)) + 1]]
            rows["g"] += mix(first ^ np.array([key]).view(np.uint64)).view(np.int64).tolist()
            rows["cls"] += [para] * len(first)
            rows["n"] += [n] * len(first)
        yield batch_of(MEMBERS, **rows)


def _compared(sets: dict[int, np.ndarray], visitors: set[int], similar: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links that join components, and each paragraph's component here; visitors are compared with the others alone."""
    up = {p: p for p in sets}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    edges, holders = [], defaultdict(list)
    for p in sorted(sets, key=lambda p: (p in visitors, len(sets[p]), p)):
        mine = sets[p].tolist()
        both = Counter()
        for token in mine:
            both.update(holders.get(token, ()))
        for q, n in both.items():
            if 100 * n >= similar * (len(mine) + len(sets[q]) - n) and find(p) != find(q):
                up[find(p)] = find(q)
                edges.append((q, p))
        if p not in visitors:
            for token in mine:
                holders[token].append(p)
    return edges, {p: find(p) for p in sets}


def _found(edges: list, members: list) -> pa.RecordBatch:
    rows = [(u, v, *[None] * 4) for u, v in edges] + [(None, None, *m) for m in members]
    return batch_of(FOUND, **{f.name: [r[k] for r in rows] for k, f in enumerate(FOUND)})


def _sets(rows: pa.Table) -> dict[int, np.ndarray]:
    return {p: np.frombuffer(x, np.uint64) for p, x in zip(rows["cls"].to_pylist(), rows["items"].to_pylist(), strict=True)}


def _within(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Links among a group's or a part's paragraphs; of parts also the paragraphs that are apart from the group's hub."""
    edges, members = [], []
    for rows in sorted_groups(batches, ["g", "node"]):
        sets, hub = _sets(rows), rows["hub"][0].as_py()
        links, component = _compared(sets, set(), similar)
        edges += links
        if hub is not None:
            members += [(rows["g"][0].as_py(), rows["node"][0].as_py(), len(x), p) for p, x in sets.items() if component[p] != component[hub]]
        if len(edges) + len(members) > 50_000:
            yield _found(edges, members)
            edges, members = [], []
    yield _found(edges, members)


def _across(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Links between a part's paragraphs and the visitors from another part."""
    edges = []
    for rows in sorted_groups(batches, ["g", "node", "origin"]):
        visits = rows["visits"].to_numpy(zero_copy_only=False).astype(bool)
        residents, visitors = _sets(rows.filter(pa.array(~visits))), _sets(rows.filter(pa.array(visits)))
        edges += _compared(visitors | residents, set(visitors) - set(residents), similar)[0]
        if len(edges) > 50_000:
            yield _found(edges, [])
            edges = []
    yield _found(edges, [])


def _links(unlike: DataFrame, sets: DataFrame, similar: int, bucket: int) -> DataFrame:
    """Verified links ``u, v`` of the paragraphs of ``unlike(key, para)`` that share a key; every similar pair of a key is
    linked, over others or directly, however large its bucket is."""
    spark = unlike.sparkSession
    counts = stage(unlike.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > bucket))
    none = F.lit(None).cast("long")
    if counts.isEmpty():
        rows = unlike.select(F.col("key").alias("g"), F.col("para").alias("cls")).join(sets, F.col("cls") == F.col("para")).select("g", F.lit(-1).alias("node"), none.alias("hub"), "cls", "items")
        return rows.repartition("g", "node").sortWithinPartitions("g", "node").mapInArrow(lambda it: _within(it, similar), FOUND_SQL).select("u", "v")
    few = unlike.join(counts, "key", "left_anti").select(F.col("key").alias("g"), F.col("para").alias("cls"), F.lit(-1).cast("long").alias("node"))
    large = stage(unlike.join(counts, "key", "left_semi").join(sets, "para").select("key", "para", "items"))
    chunks = large.dropDuplicates(["para"]).select("items").mapInArrow(_counted, "token long, df long")
    top = chunks.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") > bucket).orderBy(F.desc("df"), "token").limit(FREQUENT)
    order = spark.sparkContext.broadcast(top.select("token").toArrow().column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64))
    members = large.mapInArrow(lambda it: _divided(it, similar, order.value), "g long, cls long, n int").distinct()
    sized = stage(_sized(stage(members), similar, bucket))

    parts = sized.where("node >= 0")
    hubs = parts.groupBy("g").agg(F.min("cls").alias("hub"))
    trees = parts.select("g", "cls", "node").join(hubs, "g")
    trees = trees.unionByName(trees.select("g", F.col("hub").alias("cls"), "node", "hub").distinct()).distinct()
    alone = few.unionByName(sized.where("node < 0").select("g", "cls", "node")).withColumn("hub", none)

    def with_items(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.join(sets, F.col("cls") == F.col("para")).drop("para").repartition(*keys).sortWithinPartitions(*keys)

    found = stage(with_items(alone.unionByName(trees), "g", "node").mapInArrow(lambda it: _within(it, similar), FOUND_SQL))
    others = found.where("cls is not null").select("g", F.col("node").alias("origin"), "n", "cls")
    nodes = parts.groupBy("g", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    visits = (
        others.join(nodes, "g")
        .where((F.col("origin") != F.col("node")) & (100 * F.col("n") >= similar * F.col("low")) & (100 * F.col("high") >= similar * F.col("n")))
        .select("g", "node", "origin", "cls", F.lit(1).alias("visits"))
    )
    hosts = visits.select("g", "node", "origin").distinct().join(parts.select("g", "node", "cls"), ["g", "node"]).select("g", "node", "origin", "cls", F.lit(0).alias("visits"))
    met = with_items(visits.unionByName(hosts), "g", "node", "origin").mapInArrow(lambda it: _across(it, similar), FOUND_SQL)
    return found.where("u is not null").select("u", "v").unionByName(met.select("u", "v"))


def repeated_passages(docs: DataFrame, similar: int = SIMILAR, recall: float = RECALL, passage: int = PASSAGE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, word_start, word_stop, n_paragraphs, n_removed, component_id``: the passages of ``docs(doc_id, text)``, in
    words, whose paragraphs repeat in other texts. One row per passage.

    Paragraphs repeat when they link (exact Jaccard similarity of ``similar`` per cent of five-word shingles, A-Z
    lower-cased) over any chain to a paragraph of another text. Each component keeps its first paragraph, that of the
    smallest doc_id; n_removed counts the passage's other ones. component_id is the smallest doc_id that holds the passage's
    first paragraph. Passages under ``passage`` words aren't given, nor repeats within one text. Links at the least
    similarity are found with chance ``recall``, equal paragraphs always. Equal rows count once; rows that share a doc_id
    but not the text are different texts; null doc_ids count as the largest. Null, empty and short texts have no passages,
    an empty table none. Only doc_id and text are looked at.
    """
    bands = bands_for(similar, recall)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    with shuffles_removed(spark), scratch(spark):
        with scratch(spark):
            cut = stage(keyed.mapInArrow(lambda it: _paragraphs(it, bands), CUT_SQL))
            placed = cut.select("doc", "doc_id", F.explode(F.arrays_zip("at", "size", "para", "band")).alias("p")).select("doc", "doc_id", "p.*")
            exact = stage(placed.groupBy("para").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("para"))

            with scratch(spark):
                banded = placed.select("doc", "at", "size", "para", F.explode("band").alias("key"))
                ends = banded.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min("para").alias("hub"), F.max("para").alias("top"))
                met = stage(banded.join(stage(ends.where("a <> b and hub <> top").select("key")), "key"))
                unlike = stage(met.select("key", "para").distinct())
                first = met.groupBy("para").agg(F.min(F.struct("doc", "at", "size")).alias("f"))
                wanted = stage(first.groupBy("f.doc").agg(F.collect_list(F.struct("para", "f.at", "f.size")).alias("wanted")))
                sets = wanted.join(keyed.select("doc", "text").hint("merge"), "doc").select("wanted", "text").mapInArrow(_spelled, "para long, items binary")
                edges = _links(unlike, stage(sets.dropDuplicates(["para"])), similar, bucket)
                component = stage(connected_components(edges).select(F.col("vertex").alias("para"), "component"), keep=True)

            known = exact.join(component, "para", "full").select("para", F.coalesce("component", "para").alias("component"))
            paras = placed.select("doc", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "at", "size", "para")
            named = stage(paras.join(known, "para"), keep=True)

        owners = named.groupBy("component").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.min(F.struct("doc_id", "doc")).alias("owner"))
        repeated = named.join(owners.where("a <> b").select("component", "owner"), "component")
        repeated = repeated.select("doc", "doc_id", "at", "size", "para", F.col("owner.doc_id").alias("owner"), (F.col("owner.doc") != F.col("doc")).alias("removed"))
        repeated = repeated.repartition("doc").dropDuplicates(["doc", "at", "size", "para"])

        inside = Window.partitionBy("doc").orderBy("at")
        fresh = (F.col("at") > F.max(F.col("at") + F.col("size")).over(inside.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
        runs = stage(repeated.select("*", F.sum(F.coalesce(fresh, F.lit(1))).over(inside).alias("run")))
        found = stage(runs.groupBy("doc", "run").agg(
            F.min("doc_id").alias("doc_id"), F.min("at").cast("long").alias("start"), F.max(F.col("at") + F.col("size")).cast("long").alias("stop"),
            F.count("*").alias("n"), F.count_if("removed").alias("removed"), F.min_by("owner", "at").alias("component_id"),
        ), keep=True)
        more = stage(_extended(runs.select("doc", "run", "at", "size", "para"), keyed.select("doc", "text")), keep=True)
    found = found.join(more, ["doc", "run"], "left").withColumns({
        "start": F.least("start", "low"), "stop": F.greatest("stop", "high")})
    along = Window.partitionBy("doc").orderBy("start", "run")
    fresh = (F.col("start") > F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    out = found.select("*", F.sum(F.coalesce(fresh, F.lit(1))).over(along).alias("passage")).groupBy("doc", "passage").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("word_start"), F.max("stop").alias("word_stop"),
        F.sum("n").alias("n_paragraphs"), F.sum("removed").alias("n_removed"), F.min_by("component_id", "start").alias("component_id"),
    )
    null = lambda c: F.when(F.col(c) < 2**63 - 1, F.col(c)).alias(c)
    return out.where(F.col("word_stop") - F.col("word_start") >= passage).select(null("doc_id"), "word_start", "word_stop", "n_paragraphs", "n_removed", null("component_id"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all ``documents``."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))

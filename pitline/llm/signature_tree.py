"""N-gram Jaccard join by signature trees.

Classes of equal shingle sets are joined, not documents. Every class posts the first 20 % of its shingles in one global
order (rare ones first), so two linked classes share at least one posted shingle. The classes that share posted shingles
with the same hub (their bucket's smallest class) form the members of that hub, and these go into signature trees: leaves
hold classes of similar size, every node the OR of its members' token bitmaps and their range of sizes. A dual traversal
drops node pairs whose largest possible overlap can't reach the threshold, or that are one component already; pairs of
classes that are left are verified on their whole sets. Signatures alone go into the first walk; texts are sent only for
the members that it leaves a possible partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitline.llm.common import WordHash, batch_of, each_utf8, shingle_set, sorted_groups, utf8
from pitline.llm.components import connected_components
from pitline.session import read_table, scratch, stage

#: Shingles ordered behind all others, most frequent last. Any list keeps the join exact; a good one keeps buckets small.
#: At eight bytes each, the size of the broadcast is bounded by this number.
FREQUENT = 500_000
#: Classes in one tree; larger groups are cut into several trees, which meet in pairs.
TREE = 512
LEAF, FANOUT = 8, 8
COUNTED_AT_ONCE = 2_000_000

POST = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("rare", pa.list_(pa.int64())), ("frequent", pa.list_(pa.int64())), ("signature", pa.binary())])
MEMBERS = pa.schema([("g", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("node", pa.int64())])
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("g", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("apart", pa.bool_()), ("text", pa.binary())])
FOUND_SQL = "u long, v long, g long, node long, n int, cls long, apart boolean, text binary"


def class_of(items: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def enough(overlap: int, a: int, b: int, threshold: int) -> bool:
    """100 * overlap >= threshold * union, in integers."""
    return 100 * overlap >= threshold * (a + b - overlap)


# ---- shingle counts: which shingles come last in the order ----


def _count_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    cache, held, size = WordHash(), [], 0
    schema = pa.schema([("token", pa.int64()), ("df", pa.int64())])

    def counted() -> pa.RecordBatch:
        tokens, df = np.unique(np.concatenate(held), return_counts=True)
        return batch_of(schema, token=signed(tokens[df > 2]), df=df[df > 2])

    for batch in batches:
        for text in each_utf8(batch.column(0)):
            held.append(shingle_set(text, cache, width))
            size += len(held[-1])
            if size >= COUNTED_AT_ONCE:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles, rarest first. A shingle rarer than three in a chunk of two million is not counted there:
    these counts only order the shingles."""
    chunks = texts.mapInArrow(lambda it: _count_chunks(it, width), "token long, df long")
    top = chunks.groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(FREQUENT)
    found = top.select("token").toArrow().column(0).to_numpy()
    return found[::-1].astype(np.int64).view(np.uint64)


# ---- postings ----


def _postings(batches: Iterator[pa.RecordBatch], width: int, threshold: int, order: np.ndarray) -> Iterator[pa.RecordBatch]:
    cache, seen = WordHash(), set()
    by_value = np.argsort(order)
    values = order[by_value]
    none = np.zeros(0, np.int64)
    for batch in batches:
        rows = {f.name: [] for f in POST}
        for text in each_utf8(batch.column(batch.schema.get_field_index("text"))):
            items = shingle_set(text, cache, width)
            n = len(items)
            cls = class_of(items) if n else None
            rare, late, signature = none, none, None
            if n and cls not in seen:
                if len(seen) > 5_000_000:
                    seen.clear()
                seen.add(cls)
                signature = bitmap(items, 1 << max(6, int(2 * n - 1).bit_length())).tobytes()
                length = n - (-(-threshold * n // 100)) + 1
                at = np.searchsorted(values, items)
                at[at == len(values)] = 0
                known = values[at] == items if len(values) else np.zeros(n, bool)
                rare = items[~known][:length]
                if len(rare) < length:
                    late = order[np.sort(by_value[at[known]])[: length - len(rare)]]
            rows["cls"].append(cls)
            rows["n"].append(n)
            rows["rare"].append(signed(rare))
            rows["frequent"].append(signed(late))
            rows["signature"].append(signature)
        rows["doc_id"], rows["th"] = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("th"))
        yield batch_of(POST, **rows)


# ---- trees ----


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """One bit per leading bits of a shingle's hash; ``bits`` is a power of two, 64 at least."""
    at = np.unique(items >> np.uint64(65 - bits.bit_length()))
    row = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return row


def halved(row: np.ndarray) -> np.ndarray:
    """The bitmap of half as many bits: each new bit is the OR of two neighbours."""
    bits = np.unpackbits(row.view(np.uint8), bitorder="little").reshape(-1, 2).any(axis=1)
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


class Tree:
    """Classes in order of size; level 0 are single classes, each level above holds the OR of up to FANOUT nodes, their
    range of sizes, and the most shingles that fell on a bit another shingle of the same class had set."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        excess = size - np.bitwise_count(words).sum(axis=1)
        self.levels = [(words, size, size, excess)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            words, low, high, excess = self.levels[-1]
            cut = np.arange(0, len(words), step)
            self.levels.append((np.bitwise_or.reduceat(words, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut)))
            step = FANOUT

    @classmethod
    def of_sets(cls, items: list[np.ndarray], bits: int) -> Tree:
        return cls(np.stack([bitmap(x, bits) for x in items]), np.array([len(x) for x in items]))

    def below(self, level: int, k: int) -> range:
        step = LEAF if level == 1 else FANOUT
        return range(k * step, min((k + 1) * step, len(self.levels[level - 1][0])))


class Merged:
    """Union-find over the classes of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def possible(one: tuple, i: int, two: tuple, js: np.ndarray, threshold: int) -> np.ndarray:
    """Which nodes js of level two can hold a partner for something under node i of level one."""
    words, low, high, excess = one
    their_words, their_low, their_high, their_excess = two
    fits = (100 * high[i] >= threshold * their_low[js]) & (100 * their_high[js] >= threshold * low[i])
    shared = np.bitwise_count(words[i] & their_words[js]).sum(axis=1) + np.minimum(excess[i], their_excess[js])
    return js[fits & ((100 + threshold) * shared >= threshold * (low[i] + their_low[js]))]


def traverse(one: Tree, two: Tree, threshold: int) -> Iterator[tuple[int, int]]:
    """Pairs of classes that the bounds leave, from a depth-first walk over node pairs; ``one is two`` walks each once."""
    same = one is two
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la == 0 and lb == 0:
            if not same or i < j:
                yield i, j
            continue
        down_a = la >= lb and la > 0
        down_b = lb >= la and lb > 0
        for x in one.below(la, i) if down_a else (i,):
            js = np.array(two.below(lb, j) if down_b else (j,))
            if same and la == lb and i == j:
                js = js[js >= x]
            for y in possible(one.levels[la - down_a], x, two.levels[lb - down_b], js, threshold).tolist():
                stack.append((la - down_a, x, lb - down_b, y))


def links(one: Tree, ids_one: list[int], items_one: list, two: Tree, ids_two: list[int], items_two: list, merged: Merged, threshold: int) -> Iterator[tuple[int, int]]:
    """Verified links that join components; pairs that are one component already are passed over."""
    for i, j in traverse(one, two, threshold):
        if merged.find(ids_one[i]) != merged.find(ids_two[j]):
            a, b = items_one[i], items_two[j]
            if enough(overlap(a, b), len(a), len(b), threshold):
                merged.join(ids_one[i], ids_two[j])
                yield ids_one[i], ids_two[j]


def promising(widths: np.ndarray, rows: list[np.ndarray], size: np.ndarray, threshold: int) -> np.ndarray:
    """Which classes, in order of size, have a partner that their signatures allow. Classes of fitting size have signatures
    of the same width or of the next; each width is walked with the next one folded onto it."""
    out = np.zeros(len(rows), bool)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) > 1:
            folded = np.stack([rows[k] if widths[k] == width else halved(rows[k]) for k in at.tolist()])
            tree = Tree(folded, size[at])
            for i, j in traverse(tree, tree, threshold):
                a, b = at[i], at[j]
                if widths[a] == width or widths[b] == width:
                    out[a] = out[b] = True
    return out


def _bits(items: list[np.ndarray]) -> int:
    return 1 << min(17, max(8, int(4 * max(map(len, items)) - 1).bit_length()))


def _by_size(rows: pa.Table, cache: WordHash, width: int) -> tuple[list[int], list[np.ndarray]]:
    """Classes of the rows and their sets, smallest first; a class that comes twice counts once."""
    at = {c: k for k, c in enumerate(rows["cls"].to_pylist())}
    texts = utf8(rows["text"].combine_chunks())
    sets = {c: shingle_set(texts[k], cache, width) for c, k in at.items()}
    ids = sorted(sets, key=lambda c: (len(sets[c]), c))
    return ids, [sets[c] for c in ids]


def _found(edges: list, members: list) -> pa.RecordBatch:
    rows = [(u, v, *[None] * 6) for u, v in edges] + [(None, None, *m) for m in members]
    return batch_of(FOUND, **{f.name: [r[k] for r in rows] for k, f in enumerate(FOUND)})


def _within(batches: Iterator[pa.RecordBatch], threshold: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links inside each tree; of groups with several trees also their members, with whether they are apart from the hub
    and their texts, which the walks across trees need."""
    cache, edges, members = WordHash(), [], []
    for rows in sorted_groups(batches, ["g", "node"]):
        g, node = rows["g"][0].as_py(), rows["node"][0].as_py()
        ids, items = _by_size(rows, cache, width)
        merged = Merged()
        if len(ids) > 1:
            tree = Tree.of_sets(items, _bits(items))
            edges += links(tree, ids, items, tree, ids, items, merged, threshold)
        if node >= 0:
            texts = dict(zip(rows["cls"].to_pylist(), utf8(rows["text"].combine_chunks()), strict=True))
            members += [(g, node, len(x), c, merged.find(c) != merged.find(g), texts[c]) for c, x in zip(ids, items, strict=True)]
        if len(edges) > 50_000 or len(members) > TREE:
            yield _found(edges, members)
            edges, members = [], []
    yield _found(edges, members)


def _across(batches: Iterator[pa.RecordBatch], threshold: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links between the visitors and the residents of each tree pair."""
    cache, edges = WordHash(), []
    for rows in sorted_groups(batches, ["g", "node", "origin"]):
        visits = rows["visits"].to_numpy(zero_copy_only=False).astype(bool)
        one, two = rows.filter(pa.array(visits)), rows.filter(pa.array(~visits))
        if one.num_rows and two.num_rows:
            (ids_one, items_one), (ids_two, items_two) = _by_size(one, cache, width), _by_size(two, cache, width)
            bits = _bits(items_one + items_two)
            edges += links(Tree.of_sets(items_one, bits), ids_one, items_one, Tree.of_sets(items_two, bits), ids_two, items_two, Merged(), threshold)
        if len(edges) > 50_000:
            yield _found(edges, [])
            edges = []
    yield _found(edges, [])


def _prune(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Members that keep a possible partner in their tree."""
    kept = {f.name: [] for f in MEMBERS}
    for rows in sorted_groups(batches, ["g"]):
        first = {c: k for k, c in enumerate(rows["cls"].to_pylist())}
        size = rows["n"].to_numpy()
        order = sorted(first, key=lambda c: (size[first[c]], c))
        at = [first[c] for c in order]
        signatures = rows["signature"].to_pylist()
        maps = [np.frombuffer(signatures[k], np.uint64) for k in at]
        stay = promising(np.array([len(x) * 64 for x in maps]), maps, size[at], threshold)
        for cls, k, yes in zip(order, at, stay.tolist(), strict=True):
            if yes:
                for name, value in zip(MEMBERS.names, (rows["g"][0].as_py(), cls, int(size[k]), -1), strict=True):
                    kept[name].append(value)
        if len(kept["g"]) > 50_000:
            yield batch_of(MEMBERS, **kept)
            kept = {f.name: [] for f in MEMBERS}
    yield batch_of(MEMBERS, **kept)


# ---- the join ----


def _members(posts: DataFrame, threshold: int) -> DataFrame:
    """``(g, cls, n)``: every class with the hubs of the buckets it shares with a class of fitting size.

    The bucket of a rare shingle, a window over few rows, is cut wherever the next larger class is too large for the one
    before; each piece with two classes or more has its smallest class as hub. A frequent shingle's bucket is never
    gathered: its hubs are map-side combined minima, one for each size band and the next. As there are at most FREQUENT
    such shingles and sizes span few bands, these hubs are broadcast.
    """
    rare = posts.select("cls", "n", F.explode("rare").alias("token"))
    bucket = Window.partitionBy("token").orderBy("n", "cls")
    before, after = F.lag("n").over(bucket), F.lead("n").over(bucket)
    cut = rare.select(
        "token", "cls", "n",
        (before.isNull() | (100 * before < threshold * F.col("n"))).alias("first"),
        (after.isNull() | (100 * F.col("n") < threshold * after)).alias("final"),
    ).where("not (first and final)")
    near = cut.select("cls", "n", F.last(F.when(F.col("first"), F.col("cls")), ignorenulls=True).over(bucket).alias("g"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / threshold) if threshold < 100 else 1.0) - 1e-9)
    late = posts.select("cls", "n", F.explode("frequent").alias("token"), band.alias("band"))
    late = late.select("cls", "n", "token", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    hubs = late.groupBy("token", "band").agg(F.min("cls").alias("g"), F.max("cls").alias("top")).where("g <> top").select("token", "band", "g")
    both = near.unionByName(late.join(F.broadcast(hubs), ["token", "band"]).select("cls", "n", "g"))
    return both.select("g", "cls", "n").distinct()


def _sized(members: DataFrame, threshold: int, tree: int) -> DataFrame:
    """Members with their tree: -1 for a group that fits into one, else a size class and a salt of the group's own."""
    step = float(np.log(100 / threshold) / 2) if threshold < 100 else 1.0
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long"))
    counts = members.groupBy("g", "band").agg(F.count("*").alias("here"))
    groups = members.groupBy("g").agg(F.count("*").alias("all"), F.min("n").alias("least"), F.max("n").alias("most"))
    sized = members.join(groups, "g").where("all > 1")
    few = sized.where(F.col("all") <= tree).select("g", "cls", "n", F.lit(-1).cast("long").alias("node"))
    salts = F.ceil(F.col("here") / tree)
    many = (
        sized.where(F.col("all") > tree)
        .join(counts, ["g", "band"])
        .select("g", "cls", "n", (F.col("band") * 1_000_000_000 + F.pmod(F.xxhash64("cls"), salts)).alias("node"))
    )
    return few.unionByName(many)


def _linked(docs: DataFrame, threshold: int, width: int, tree: int) -> DataFrame:
    """``doc_id, th, cls, n, component`` per row; component is a class, null where there are no shingles."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = spark.sparkContext.broadcast(frequent_shingles(base.select("text"), width))
    keyed = base.withColumn("th", F.xxhash64("text"))
    posts = stage(keyed.select("doc_id", "th", "text").mapInArrow(
        lambda it: _postings(it, width, threshold, order.value), "doc_id long, th long, cls long, n int, rare array<long>, frequent array<long>, signature binary"))
    classes = posts.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "th")).alias("first"))
    sized = stage(_sized(_members(posts.where("cls is not null"), threshold), threshold, tree))
    signatures = posts.where("signature is not null").select("cls", "signature")
    small = _dealt(sized.where("node = -1").join(signatures, "cls").select("g", "cls", "n", "signature"), "g")
    pruned = small.mapInArrow(lambda it: _prune(it, threshold), "g long, cls long, n int, node long")
    members = stage(pruned.unionByName(sized.where("node >= 0")))

    firsts = classes.select("cls", "first.doc_id", "first.th")
    texts = keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))

    def with_texts(rows: DataFrame) -> DataFrame:
        return rows.join(firsts, "cls").join(texts.hint("merge"), ["doc_id", "th"]).drop("doc_id", "th")

    trees = members.select("g", "node", "cls")
    hubs = trees.where("node >= 0").select("g", "node").distinct().select("g", "node", F.col("g").alias("cls"))
    rows = _dealt(with_texts(trees.unionByName(hubs)), "g", "node")
    found = stage(rows.mapInArrow(lambda it: _within(it, threshold, width), FOUND_SQL))
    edges = found.where("u is not null").select("u", "v")

    others = found.where("apart").select("g", F.col("node").alias("origin"), "n", "cls").distinct()
    nodes = members.where("node >= 0").groupBy("g", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    visits = (
        others.join(nodes, "g")
        .where((F.col("origin") != F.col("node")) & (100 * F.col("n") >= threshold * F.col("low")) & (100 * F.col("high") >= threshold * F.col("n")))
        .select("g", "node", "origin", "cls", F.lit(1).alias("visits"))
    )
    if not visits.isEmpty():
        hosts = visits.select("g", "node", "origin").distinct().join(trees, ["g", "node"]).select("g", "node", "origin", "cls", F.lit(0).alias("visits"))
        held = found.where("cls is not null").select("cls", "text").dropDuplicates(["cls"])
        met = _dealt(visits.unionByName(hosts).join(held, "cls"), "g", "node", "origin")
        edges = edges.unionByName(met.mapInArrow(lambda it: _across(it, threshold, width), FOUND_SQL).select("u", "v"))

    component = connected_components(edges)
    named = classes.select("cls").join(component, F.col("cls") == F.col("vertex"), "left").select("cls", F.coalesce("component", "cls").alias("component"))
    return posts.select("doc_id", "th", "n", "cls").join(named, "cls", "left")


def jaccard_components(docs: DataFrame, threshold: int = 80, width: int = 5, tree: int = TREE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``; other columns are not looked at.

    Texts link when 100 * |intersection| >= threshold * |union| of their sets of ``width``-word shingles (A-Z lower-cased;
    fewer words: the whole sequence is the one shingle). component_id is the smallest doc_id reachable over links. A null
    or blank text has no shingles and links with nothing, so it keeps its own doc_id. Every row gives a row: rows with the
    same text are one class; a null doc_id stays null and is never the smallest unless its component has no other. An
    empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    rows = _linked(docs, threshold, width, tree)
    least = rows.where("cls is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "component", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (nulls last, then by the text's hash); rows
    without shingles all stay. Rows that repeat both doc_id and text count once. Columns stay as they are."""
    with scratch(docs.sparkSession):
        rows = _linked(docs, threshold, width, TREE).withColumn("kept_id", F.coalesce("doc_id", F.lit(2**63 - 1)))
        first = rows.where("cls is not null").groupBy("component").agg(F.min(F.struct("kept_id", "th")).alias("first")).select("first.*")
        kept = stage(first.unionByName(rows.where("cls is null").select("kept_id", "th")).distinct(), keep=True)
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("kept_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")
    )
    return keyed.join(kept, ["kept_id", "th"], "left_semi").dropDuplicates(["kept_id", "th"]).select("row.*")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies over all of ``documents``."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))

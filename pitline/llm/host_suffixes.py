"""Main text of web pages by structure and by a suffix array of each host.

Pages are cut into blocks of text. Blocks in menus, headers, footers, forms and the like go by their elements; blocks of an
article stay. What is left open, text outside any article, is settled by the host: the open blocks' words of its pages are
laid end to end, a suffix array finds the long stretches that stand on several distinct pages, and covered words go.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm.common import batch_of, rolled, sorted_groups
from pitline.session import read_table, stage

#: Words of a stretch that makes boilerplate when distinct pages of a host share it.
STRETCH = 5
#: Words of a host that go into one suffix array; larger hosts are dealt into several, and stretches are also counted
#: across them.
ARRAY = 400_000

#: Element names of HTML.
DROPPED = frozenset("script style template noscript svg math canvas iframe object embed nav footer aside form button select option textarea input dialog menu head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the named kind ends, if they are open inside the nearest of the holders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids of page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|respond|disqus|cookies?|consent|gdpr|footer|masthead|menu|nav|navbar|navigation|newsletter|"
    r"notices?|pagination|pager|popup|modal|promo\w*|related|share|sharing|sidebar|side-bar|signup|sign-up|skip-?link|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
#: In an article, words that name page furniture anywhere in a class or id, and words that do so only where nothing but
#: words for places and containers stands beside them: "share-buttons" goes, "share-price" and "related-work" stay.
ARTICLE_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:advert\w*|adsense|breadcrumbs?|comments?|comment-?list|respond|disqus|cookies?|consent|gdpr|footer|masthead|nav|navbar|navigation|newsletter|pagination|"
    r"popup|modal|promo\w*|sidebar|side-bar|signup|sign-up|skip-?link|sponsor\w*|subscribe)(?:$|[\s_-])",
    re.I,
)
AMBIGUOUS = frozenset("ad ads banner menu notice notices pager related share sharing social toolbar topbar widget".split())
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons col column container content footer global header icons inline inner left legal link links list main mobile page "
    "panel post posts right row section side site slot sticky stories top unit wrap wrapper".split()
)
DRAWN = frozenset("svg math".split())
CLASS_PART = re.compile(r"[_-]+")
NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
TAG_PART = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"\s+")

OPENS = re.compile(r"<[/A-Za-z!?]")
OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|related|promo\w*|sponsor\w*|advert\w*|ads?|teaser)(?:$|[\s_-])", re.I)
FURNITURE_TEXT, OPEN_TEXT, ARTICLE_TEXT = 0, 1, 2

OUTSIDE = pa.schema([("host", pa.string()), ("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("n", pa.int64())])
CUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())])
SEEN = pa.schema([("host", pa.string()), ("page", pa.int64()), ("block", pa.int32()), ("covered", pa.binary())])
WINDOWS = pa.schema([("host", pa.string()), ("window", pa.int64()), ("page", pa.int64())])


def _names_furniture(value: str) -> bool:
    """Whether a class or id inside an article names furniture."""
    if ARTICLE_FURNITURE.search(value):
        return True
    for name in value.lower().split():
        parts = [p for p in CLASS_PART.split(name) if p and not p.isdigit()]
        if any(p in AMBIGUOUS for p in parts) and all(p in AMBIGUOUS or p in BESIDE for p in parts):
            return True
    return False


def _is_furniture(name: str, attributes: str, in_article: bool = False) -> bool:
    """By element, role, class or id. Outside articles hidden elements and drawings count too; in one they are its text."""
    if name in DROPPED and not (in_article and name in DRAWN):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("body", "html", "main"):
            if OTHER_ARTICLE.search(value) if name == "article" else _names_furniture(value) if in_article else FURNITURE.search(value):
                return True
        if key == "role" and value.lower() in ROLES:
            return True
        if not in_article and (key == "hidden" or key == "aria-hidden" and value.lower() == "true"):
            return True
    return False


class Tags:
    """The tags of a page, from left to right, in time linear in its length however broken it is.

    A tag ends at the first ``>`` outside quotes. Where a quote is never closed, or no ``>`` follows, the ``<`` is text. The
    quotes from which a search came to nothing are remembered, as every later search that reaches them must too.
    """

    def __init__(self, html: str):
        self.html = html
        self.dead: set[int] = set()
        self.part = -1
        self.none = {c: len(html) for c in "\"'<>"}
        self.no_part = len(html)
        self.failed = 0

    def _next_part(self, at: int) -> int:
        if at >= self.no_part:
            return -1
        m = TAG_PART.search(self.html, at)
        if m:
            return m.start()
        self.no_part = at
        return -1

    def _find(self, c: str, at: int) -> int:
        if at >= self.none[c]:
            return -1
        found = self.html.find(c, at)
        if found < 0:
            self.none[c] = at
        return found

    def _end(self, at: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``at``, or -1; ``at`` never falls."""
        if self.part < at:
            self.part = self._next_part(at)
            if self.part < 0:
                self.part = len(self.html)
        part, passed = self.part, []
        while 0 <= part < len(self.html) and part not in self.dead:
            if self.html[part] == ">":
                return part
            passed.append(part)
            closed = self._find(self.html[part], part + 1)
            part = self._next_part(closed + 1) if closed >= 0 else -1
        self.dead.update(passed)
        return -1

    def find(self, at: int) -> tuple[int, int, str, str, str, str] | None:
        """(start, end, slash before, name, attributes, slash behind) of the next tag; comments and the like have no name."""
        html = self.html
        while True:
            start = self._find("<", at)
            if start < 0:
                return None
            if html.startswith("!--", start + 1):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", "", "", ""
            if html[start + 1 : start + 2] in ("!", "?"):
                end = html.find(">", start + 2)
                return start, len(html) if end < 0 else end + 1, "", "", "", ""
            # a name in which another one begins ends where that one does
            m = NAME.match(html, start + 1) if start >= self.failed else None
            end = self._end(m.end()) if m else -1
            if m and end < 0:
                self.failed = m.end()
            if m and end >= 0:
                behind = "/" if end > m.end() and html[end - 1] == "/" else ""
                return start, end + 1, m[1], m[2].lower(), html[m.end() : end - len(behind)], behind
            at = start + 1


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order, each with its kind: FURNITURE_TEXT, OPEN_TEXT or ARTICLE_TEXT.

    A header is furniture outside articles; in one it usually holds the heading and stays. White space in a block,
    character references decoded, becomes one space. Elements left open end where their holder ends; a tag that the page
    breaks off in is no text.

    Time is linear in the page: open elements are found by name, not by going through all of them. An element that ends out
    of turn leaves a nameless entry, of its holder's kind, until those above it end.
    """
    html = html or ""
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    stack: list[tuple[str, int]] = []
    placed: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    kind = OPEN_TEXT

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(piece))).strip()
        piece.clear()
        if text:
            out.append((kind, text))

    def cut(depth: int) -> None:
        while len(stack) > depth:
            gone, _ = stack.pop()
            if gone:
                placed[gone].pop()
                if gone in BLOCK:
                    blocks.pop()

    def close(depth: int) -> None:
        nonlocal kind
        flush()
        cut(depth)
        kind = stack[-1][1] if stack else OPEN_TEXT

    tags, at = Tags(html), 0
    while True:
        tag = tags.find(at)
        if tag is None:
            broken = OPENS.search(html, max(at, html.rfind(">", at) + 1))
            piece.append(html[at : broken.start()] if broken else html[at:])
            break
        start, end, closing, name, attributes, ended_itself = tag
        piece.append(html[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            piece.append(" ")
        elif closing:
            if name in BLOCK:
                flush()
            if placed[name]:
                depth = placed[name][-1]
                if name in BLOCK or stack[depth][1] != (stack[depth - 1][1] if depth else OPEN_TEXT):
                    close(depth)
                else:
                    placed[name].pop()
                    stack[depth] = ("", stack[depth][1])
                    while stack and not stack[-1][0]:
                        stack.pop()
        else:
            if name in BLOCK:
                flush()
                if name in ENDS:
                    ended, holders = (max((placed[n][-1] for n in names if placed[n]), default=-1) for names in ENDS[name])
                    if ended > holders:
                        close(ended)
                elif blocks and stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
            if name in VOID or ended_itself:
                continue
            if kind == FURNITURE_TEXT or _is_furniture(name, attributes, kind == ARTICLE_TEXT) or name == "header" and kind != ARTICLE_TEXT:
                inside = FURNITURE_TEXT
            else:
                inside = ARTICLE_TEXT if name in ("article", "main") else kind
            if inside != kind:
                flush()
            placed[name].append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            stack.append((name, inside))
            kind = inside
            if name in RAW:
                ending = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = ending.end() if ending else len(html)
                piece.clear()
                close(len(stack) - 1)
    flush()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _page(url: str | None, html: str | None) -> tuple[str, int, list[tuple[int, str]]]:
    found = page_blocks(html)
    host = host_of(url)
    return host, xxhash.xxh3_64_intdigest("\n".join([host, *(t for _, t in found)]).encode()) - (1 << 63), found


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages' blocks outside articles, which is what a host's suffix array sees."""
    for batch in batches:
        rows = {f.name: [] for f in OUTSIDE}
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, page, found = _page(url, html)
            blocks = [t for kind, t in found if kind != ARTICLE_TEXT]
            if blocks:
                for name, value in zip(OUTSIDE.names, (host, page, blocks, sum(t.count(" ") + 1 for t in blocks)), strict=True):
                    rows[name].append(value)
        yield batch_of(OUTSIDE, **rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages' articles, or else their open blocks and where these stand among the blocks outside articles."""
    for batch in batches:
        rows = {f.name: [] for f in CUT}
        for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            host, page, found = _page(url, html)
            article = [t for kind, t in found if kind == ARTICLE_TEXT]
            places = [k for k, (kind, _) in enumerate(x for x in found if x[0] != ARTICLE_TEXT) if kind == OPEN_TEXT]
            blocks = article or [t for kind, t in found if kind == OPEN_TEXT]
            for name, value in zip(CUT.names, (page_id, url, host, page, blocks, None if article else places), strict=True):
                rows[name].append(value)
        yield batch_of(CUT, **rows)


# ---- the suffix array of a host ----


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared prefix; tokens are ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    n, width = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1 and width < n:
        after = np.full(n, -1, np.int64)
        after[:-width] = rank[width:]
        order = np.lexsort((after, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]]))
        rank, width = new, width * 2
    return order


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix each suffix shares with the one before it in order."""
    n = len(tokens)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    values = tokens.tolist()
    for i, k in enumerate(place.tolist()):
        if k:
            j = int(order[k - 1])
            while i + h < n and j + h < n and values[i + h] == values[j + h]:
                h += 1
            out[k] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def covered_words(streams: list[np.ndarray], stretch: int = STRETCH) -> list[np.ndarray]:
    """Per stream, which words lie in a stretch of at least ``stretch`` words that another stream holds too."""
    ends = np.cumsum([len(s) + 1 for s in streams])
    tokens = np.concatenate([np.append(s, [-(k + 1)]) for k, s in enumerate(streams)]).astype(np.int64)
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    order = suffix_array(tokens)
    shared = common_prefixes(tokens, order)
    best = np.zeros(len(tokens), np.int64)
    bounds = np.flatnonzero(shared < stretch).tolist() + [len(order)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1 and len(set(owner[order[a:b]].tolist())) > 1:
            best[order[a:b]] = stretch
    reach = np.zeros(len(tokens) + stretch, np.int64)
    for k in range(stretch):
        reach[k : k + len(tokens)] |= best > 0
    covered = reach[: len(tokens)] > 0
    return [covered[e - len(s) - 1 : e - 1] for s, e in zip(streams, ends.tolist(), strict=True)]


def _words(text: str) -> np.ndarray:
    words = text.split(" ")
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) >> 1 for w in words), np.int64, len(words))


def _boilerplate(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """Covered words of the open blocks of one part of a host."""
    for rows in sorted_groups(batches, ["host", "part"]):
        pages, blocks = rows["page"].to_pylist(), rows["blocks"].to_pylist()
        places = [(p, k) for p, own in enumerate(blocks) for k in range(len(own))]
        page_streams = [np.concatenate([np.append(_words(t), [-1 - k]) for k, t in enumerate(own)]) for own in blocks]
        covered = covered_words(page_streams, stretch)
        out = {f.name: [] for f in SEEN}
        for p, k in places:
            cut = np.flatnonzero(page_streams[p] < 0)
            start = 0 if k == 0 else int(cut[k - 1]) + 1
            hit = covered[p][start : int(cut[k])]
            if hit.any():
                for name, value in zip(SEEN.names, (rows["host"][0].as_py(), pages[p], k, np.packbits(hit).tobytes()), strict=True):
                    out[name].append(value)
        yield batch_of(SEEN, **out)


def _windows(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {f.name: [] for f in WINDOWS}
        for host, page, blocks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = {int(w) for t in blocks for w in rolled(_words(t).view(np.uint64), stretch).view(np.int64)}
            out["host"] += [host] * len(found)
            out["window"] += list(found)
            out["page"] += [page] * len(found)
        yield batch_of(WINDOWS, **out)


def _finish(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {f.name: [] for f in TEXTS}
        for row in batch.to_pylist():
            covered = {c["block"]: np.unpackbits(np.frombuffer(c["covered"], np.uint8)).astype(bool) for c in row["covered"] or []}
            across = set(row["windows"] or [])
            lines = row["blocks"]
            if row["places"] is not None:
                lines = []
                for place, text in zip(row["places"], row["blocks"], strict=True):
                    words = text.split(" ")
                    gone = covered[place][: len(words)].copy() if place in covered else np.zeros(len(words), bool)
                    if across:
                        for at in np.flatnonzero(np.isin(rolled(_words(text).view(np.uint64), stretch).view(np.int64), list(across))).tolist():
                            gone[at : at + stretch] = True
                    lines.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            text = "\n".join(x for x in lines if x)
            for name, value in zip(TEXTS.names, (row["page_id"], row["url"], text, sum(int(c.sum()) for c in covered.values())), strict=True):
                out[name].append(value)
        yield batch_of(TEXTS, **out)


def extract_text(pages: DataFrame, stretch: int = STRETCH, array: int = ARRAY) -> DataFrame:
    """``page_id, url, text, n_shared`` for every row of ``pages(page_id, url, html)``; other columns are not looked at.

    Text is the blocks of the page's articles (or main element), in order, one per line. Pages without an article give
    their other blocks, less furniture and less the stretches of ``stretch`` words or more that distinct pages of the same
    host share. n_shared counts the words outside articles in such stretches, of the page's part of its host. Pages of a
    host with equal blocks count as one, so mirrored pages keep their text. A null html is empty and gives an empty text; a
    null url has the empty host. Every row gives a row, repeated ones too; an empty table gives none.

    A host's words outside articles are dealt into suffix arrays of about ``array`` words by page, so a hot host is spread;
    stretches that pages of different arrays share are found by a map-side combined count of word windows. Pages are read
    twice, so that their texts needn't be kept while the hosts' arrays are built.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    outside = stage(base.select("url", "html").mapInArrow(_outside, "host string, page long, blocks array<string>, n long").dropDuplicates(["host", "page"]))
    parts = outside.groupBy("host").agg(F.ceil(F.sum("n") / array).alias("parts"))
    dealt = outside.join(parts, "host").select("host", F.pmod(F.xxhash64("page"), "parts").alias("part"), "page", "blocks")
    seen = dealt.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(lambda it: _boilerplate(it, stretch), "host string, page long, block int, covered binary")
    covered = stage(seen).groupBy("host", "page").agg(F.collect_list(F.struct("block", "covered")).alias("covered"))

    wide = outside.join(parts.where("parts > 1").select("host"), "host", "left_semi").select("host", "page", "blocks")
    windows = wide.mapInArrow(lambda it: _windows(it, stretch), "host string, window long, page long")
    shared = windows.groupBy("host", "window").agg(F.min("page").alias("a"), F.max("page").alias("b")).where("a <> b").select("host", "window")
    across = windows.join(shared, ["host", "window"]).groupBy("host", "page").agg(F.collect_list("window").alias("windows"))

    cut = base.mapInArrow(_cut, "page_id long, url string, host string, page long, blocks array<string>, places array<int>")
    joined = cut.join(covered, ["host", "page"], "left").join(across, ["host", "page"], "left")
    return joined.select("page_id", "url", "blocks", "places", "covered", "windows").mapInArrow(lambda it: _finish(it, stretch), "page_id long, url string, text string, n_shared long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all ``pages``."""
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")

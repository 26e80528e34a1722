"""Main text of web pages by wrapper induction.

A page's DOM is folded into its skeleton: children of one parent with the same label (tag,
classes, id; digits masked) are one node, so that lists are one node whatever their length. The
skeletons of a host are aligned by simple tree matching and merged into its wrapper, which counts
at each node the pages. A second pass counts on how many pages each text fills its node; a text
that fills its node on at least CONSTANT of the host's pages (and LEAST_PAGES) is template;
varying slots are content, unless their element says otherwise (navigation, headers,
footers, asides, forms, adverts, notices, comments by tag, role, class or id; lists of links).

What is left is cut to the article: all article elements but those that are mostly links, else main or elements
named as content, else the node of the wrapper that holds most of the host's varying text. Template texts stay
where pages are copies: on a page that has no other text, and, if they are more than half of all that the host's
pages have in their articles, also on a page of which they are more than half.

Wrappers are built by each task for the hosts it meets, and merged first within salts, then by
host; a host of any size thus never passes through one task as pages, only as wrappers. The
wrappers are sent to all tasks if they take at most SEND bytes, else joined by host and salt.
Texts are counted exactly, as hashes by host, node and text, which spreads a hot host; each task adds
up its own first. A wrapper gets the template texts only: at most 2 for each that a page has on average.

Cases: null html counts as empty and has the empty text; a null url is a host of its own; a host
with fewer than LEAST_PAGES pages has no template texts; broken markup is closed as browsers do for
paragraphs, list items and cells; an unfinished tag or comment ends the page; repeated rows count as pages.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CONSTANT, LEAST_PAGES = 0.5, 4
#: A node found on fewer than one in RARE pages is forgotten once a wrapper has MOST_NODES.
MOST_NODES, RARE = 4000, 1000
SALTS, SEND = 32, 32 << 20
#: Counts that a task adds up before it hands them on.
TALLY = 200_000

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that an opening tag closes, and the tags beyond which it doesn't look for them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
_DROP = frozenset("nav footer aside form script style noscript template button select textarea iframe svg head title menu dialog object canvas audio video math input label datalist".split())
_NAMED = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars side nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead cookie cookies notice notices consent gdpr popup modal overlay comment comments reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup widget widgets pagination pager toolbar login search copyright legal disclaimer hidden alert toast skip topbar paywall".split())
_CONTENT = frozenset("content article post entry story articlebody".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_NONE, _OUT, _HEAD, _MAY = 0, 1, 2, 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


class Page:
    """Skeleton of a page and its blocks of text in page order."""

    def __init__(self, html: str):
        self.label, self.parent, self.children = ["#"], [-1], [[]]
        self.index: list[dict[str, int]] = [{}]
        #: state by skeleton node: kept, out, heading-only, out by name
        self.state, self.kind = [_NONE], [""]
        #: (node, text, characters within links)
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)

    def _node(self, parent: int, tag: str, attrs: dict[str, str]) -> int:
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        label = f"{tag}.{_DIGITS.sub('0', names)}" if names else tag
        at = self.index[parent].get(label)
        if at is not None:
            return at
        at = len(self.label)
        self.label.append(label)
        self.parent.append(parent)
        self.children.append([])
        self.index.append({})
        self.children[parent].append(at)
        self.index[parent][label] = at
        words = {w.lower() for w in _WORDS.findall(names)}
        kind = ""
        if tag == "article" or "articlebody" in attrs.get("itemprop", "").lower():
            kind = "article"
        elif tag == "main" or attrs.get("role") == "main":
            kind = "main"
        elif words & _CONTENT and tag not in ("body", "html"):
            kind = "content"
        above = self.state[parent]
        state = above
        if above != _OUT:
            if tag in _DROP or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
                state = _OUT
            elif words & _NAMED and tag not in ("html", "body", "main") and not (tag == "article" and not words & {"comment", "comments", "reply", "related", "ad", "promo", "sponsored"}):
                state = _HEAD if words & _NAMED <= {"header"} and self._within(parent) else _MAY if above in (_NONE, _MAY) else above
            elif tag == "header":
                state = _HEAD if self._within(parent) else _OUT
            elif above == _HEAD and re.fullmatch("h[1-6]", tag):
                state = _NONE
        self.state.append(state)
        self.kind.append(kind)
        return at

    def _within(self, node: int) -> bool:
        while node > 0:
            if self.kind[node] in ("article", "main"):
                return True
            node = self.parent[node]
        return False

    def _parse(self, html: str) -> None:
        stack = [("#", 0)]
        parts: list[str] = []
        at, end, links, in_link, owner = 0, len(html), 0, 0, 0

        def flush() -> None:
            nonlocal parts, links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((owner, text, links))
                parts, links = [], 0

        def pop_to(k: int) -> None:
            nonlocal in_link
            for tag, _ in stack[k:]:
                if tag == "a":
                    in_link -= 1
            del stack[k:]

        def block_node() -> int:
            for tag, node in reversed(stack):
                if tag in BLOCKS or tag == "#" or self.state[node] == _OUT:
                    return node
            return 0

        def text(raw: str) -> None:
            nonlocal links, owner
            if not raw:
                return
            if self.state[stack[-1][1]] == _OUT:
                return
            if "&" in raw:
                raw = unescape(raw)
            if not parts:
                owner = block_node()
            parts.append(raw)
            if in_link:
                links += len(raw.strip())

        while at < end:
            m = _MARK.search(html, at)
            if m is None:
                rest = html[at:]
                cut = re.search(r"<(?:[a-zA-Z/!?])", rest)
                text(rest[: cut.start()] if cut else rest)
                break
            text(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if tag in BLOCKS:
                            flush()
                        pop_to(k)
                        break
                    if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section"):
                        break
                continue
            if tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
                if tag in _CLOSES:
                    closes, stop = _CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in closes:
                            pop_to(k)
                            break
                        if stack[k][0] in stop:
                            break
            if tag == "br":
                parts.append(" ") if parts else None
                continue
            if tag in VOID:
                continue
            node = self._node(stack[-1][1], tag, _attributes(m[3]))
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if m[3].endswith("/") and tag not in BLOCKS and tag != "a":
                continue
            stack.append((tag, node))
            in_link += tag == "a"
        flush()

    def hashes(self) -> list[int]:
        return [int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for _, t, _ in self.blocks]

    def shape(self) -> tuple:
        return tuple(zip(self.parent, self.label))

    def good(self) -> list[bool]:
        """Whether each block may be content by its elements; names count only if they don't take most of the text."""
        size = sum(len(t) for n, t, _ in self.blocks if self.state[n] in (_NONE, _MAY))
        named = sum(len(t) for n, t, _ in self.blocks if self.state[n] == _MAY)
        # the page keeps its text if names alone would take nearly all of it and it has no article
        lenient = named > 0.9 * size and not any(k in ("article", "main") for k in self.kind)
        return [self.state[n] == _NONE or lenient and self.state[n] == _MAY for n, _, _ in self.blocks]


class Wrapper:
    """Merged skeletons of a host."""

    def __init__(self) -> None:
        self.pages = 0
        self.label, self.parent, self.children = ["#"], [-1], [[]]
        self.count, self.mass = [0], [0]
        #: pages on which each template text fills the node; empty until texts are counted
        self.texts: list[dict[int, int]] = [{}]
        #: whether template texts are more than half of what the pages' articles hold
        self.copies = False
        self._known: dict[tuple, list[int]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._known = {}

    def align(self, other: Page | Wrapper) -> list[int]:
        """For each node of the other tree, the node of this one it is matched with, or -1."""
        out = [-1] * len(other.label)
        scores: dict[tuple[int, int], int] = {}

        def score(a: int, b: int) -> int:
            """Size of the largest matching of two trees whose roots have equal labels."""
            key = (a, b)
            if key not in scores:
                scores[key] = 1 + _table(self.children[a], other.children[b])[-1][-1]
            return scores[key]

        def _table(xs: list[int], ys: list[int]) -> list[list[int]]:
            t = [[0] * (len(ys) + 1)]
            for x in xs:
                above, row = t[-1], [0]
                for j, y in enumerate(ys):
                    best = max(row[j], above[j + 1])
                    if self.label[x] == other.label[y]:
                        best = max(best, above[j] + score(x, y))
                    row.append(best)
                t.append(row)
            return t

        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            out[b] = a
            xs, ys = self.children[a], other.children[b]
            t = _table(xs, ys)
            i, j = len(xs), len(ys)
            while i and j:
                if t[i][j] == t[i - 1][j]:
                    i -= 1
                elif t[i][j] == t[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((xs[i], ys[j]))
        return out

    def _grow(self, other: Page | Wrapper) -> list[int]:
        """Aligns the other tree; what has no match is inserted after its left sibling's match."""
        out = self.align(other)
        for b in range(1, len(other.label)):  # parents come before their children
            if out[b] < 0:
                a = out[other.parent[b]]
                at = len(self.label)
                self.label.append(other.label[b])
                self.parent.append(a)
                self.children.append([])
                self.count.append(0)
                self.mass.append(0)
                self.texts.append({})
                own = other.children[other.parent[b]]
                k = own.index(b)
                place = self.children[a].index(out[own[k - 1]]) + 1 if k else 0
                self.children[a].insert(place, at)
                out[b] = at
        return out

    def place(self, page: Page, grow: bool = False) -> list[int]:
        shape = page.shape()
        if shape not in self._known:
            if len(self._known) > 1000:
                self._known.clear()
            self._known[shape] = self._grow(page) if grow else self.align(page)
        return self._known[shape]

    def absorb(self, page: Page) -> None:
        at = self.place(page, True)
        self.pages += 1
        for a in at:
            self.count[a] += 1
        for (node, text, linked), good in zip(page.blocks, page.good()):
            if good and linked * 2 < len(text):
                self.mass[at[node]] += len(text)
        self._prune()

    def filled(self, page: Page) -> tuple[set[tuple[int, int, int]], int]:
        """(node, hash, characters) of the texts of the page's article, each counted once a page, and all its characters."""
        at, kept = self.place(page), _kept(page, self)
        texts = {(at[node], h, len(text)) for (node, text, _), h, k in zip(page.blocks, page.hashes(), kept) if k and at[node] >= 0}
        return texts, sum(len(b[1]) for b, k in zip(page.blocks, kept) if k)

    def merge(self, other: Wrapper) -> None:
        at = self._grow(other)
        self._known = {}
        self.pages += other.pages
        for b, a in enumerate(at):
            self.count[a] += other.count[b]
            self.mass[a] += other.mass[b]
        self._prune()

    def _prune(self) -> None:
        if len(self.label) <= MOST_NODES:
            return
        keep = [self.count[i] * RARE >= self.pages or i == 0 for i in range(len(self.label))]
        for i in range(1, len(keep)):
            keep[i] = keep[i] and keep[self.parent[i]]
        new = {old: k for k, old in enumerate(i for i in range(len(keep)) if keep[i])}
        self.children = [[new[c] for c in self.children[i] if keep[c]] for i in new]
        self.parent = [new.get(self.parent[i], -1) for i in new]
        for name in ("label", "count", "mass", "texts"):
            setattr(self, name, [getattr(self, name)[i] for i in new])
        self._known = {}

    def template(self, node: int, h: int) -> bool:
        return node >= 0 and self.texts[node].get(h, 0) >= max(LEAST_PAGES, CONSTANT * self.pages)

    def region(self) -> int:
        """The node that holds most varying text."""
        total = list(self.mass)
        order = list(range(1, len(self.label)))
        depth = [0] * len(self.label)
        for i in order:
            depth[i] = depth[self.parent[i]] + 1
        for i in sorted(order, key=lambda i: -depth[i]):
            total[self.parent[i]] += total[i]
        at = 0
        while True:
            inner = [c for c in self.children[at] if total[c] * 10 >= total[at] * 7 and total[c] and self.label[c].split(".")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "span", "article", "main")]
            if not inner:
                return at
            at = inner[0]


def _inside(page: Page, tops: set[int]) -> list[bool]:
    inside = [False] * len(page.label)
    for i in range(len(page.label)):
        inside[i] = i in tops or (i > 0 and inside[page.parent[i]])
    return [inside[n] for n, _, _ in page.blocks]


def _article(page: Page, wrapper: Wrapper | None, good: list[bool]) -> list[bool]:
    """Whether each block lies in the article."""
    for kind in ("article", "main", "content"):
        tops = {i for i, k in enumerate(page.kind) if k == kind and page.state[i] in (_NONE, _MAY)}
        tops = {i for i in tops if not any(p in tops for p in _above(page, i))}
        if tops:
            sizes, linked = {}, {}
            for t in tops:
                own = _inside(page, {t})
                sizes[t] = sum(len(b[1]) for b, g, o in zip(page.blocks, good, own) if g and o)
                linked[t] = sum(b[2] for b, g, o in zip(page.blocks, good, own) if g and o)
            most = max(sizes.values())
            total = sum(len(b[1]) for b, g in zip(page.blocks, good) if g)
            if most and (kind != "content" or 2 * most >= total):
                # what is mostly links points at other pages
                return _inside(page, {t for t, s in sizes.items() if s and (s == most or 2 * linked[t] <= s)})
    if wrapper is not None:
        at, region = wrapper.place(page), wrapper.region()
        tops = {i for i, a in enumerate(at) if a == region}
        own = _inside(page, tops)
        if any(o and g for o, g in zip(own, good)):
            return own
    return [True] * len(page.blocks)


def _link_lists(page: Page) -> set[int]:
    """Skeleton nodes of lists that are mostly links."""
    length: dict[int, list[int]] = {}
    for node, text, linked in page.blocks:
        for i in (node, *_above(page, node)):
            if page.label[i].split(".")[0] in ("ul", "ol", "dl"):
                s = length.setdefault(i, [0, 0])
                s[0] += len(text)
                s[1] += linked
    return {i for i, (n, linked) in length.items() if linked * 3 > n * 2}


def _above(page: Page, node: int) -> Iterator[int]:
    node = page.parent[node]
    while node > 0:
        yield node
        node = page.parent[node]


def _kept(page: Page, wrapper: Wrapper | None) -> list[bool]:
    """Whether each block is the article's, as far as its element tells."""
    good = page.good()
    own = _article(page, wrapper, good)
    menus = _link_lists(page)
    return [g and o and not (menus and any(i in menus for i in (b[0], *_above(page, b[0])))) for b, g, o in zip(page.blocks, good, own)]


def extract(html: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Page(html)
    kept = _kept(page, wrapper)
    if wrapper is not None and wrapper.pages >= LEAST_PAGES:
        at = wrapper.place(page)
        fixed = [k and wrapper.template(at[b[0]], h) for b, k, h in zip(page.blocks, kept, page.hashes())]
        size = sum(len(b[1]) for b, k in zip(page.blocks, kept) if k)
        gone = sum(len(b[1]) for b, f in zip(page.blocks, fixed) if f)
        if 2 * gone <= size or gone < size and not wrapper.copies:
            kept = [k and not f for k, f in zip(kept, fixed)]
    return "\n".join(b[1] for b, k in zip(page.blocks, kept) if k)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _built(pages: DataFrame) -> DataFrame:
    """(host, part, wrapper): one wrapper for each host that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: dict[str, Wrapper] = {}
        part = TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([part] * len(own), pa.int32()), pa.array([pickle.dumps(w, 5) for w in own.values()], pa.binary())], ["host", "part", "wrapper"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if host not in own:
                    if sum(1 for _ in own) >= 2000:  # so many hosts: hand on what there is
                        yield out()
                        own.clear()
                    own[host] = Wrapper()
                if html.is_valid and (text := html.as_py()):
                    own[host].absorb(Page(text))
        if own:
            yield out()

    return pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, part int, wrapper binary")


def _merged(wrappers: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each value of the keys, merged as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for key, own in groupby(rows(), key=lambda r: r[: len(keys)]):
            total = Wrapper()
            for r in own:
                total.merge(pickle.loads(r[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1] if len(key) > 1 else 0], pa.int32()), pa.array([pickle.dumps(total, 5)], pa.binary())], ["host", "part", "wrapper"])

    return wrappers.repartition(*keys).sortWithinPartitions(*keys, F.xxhash64("wrapper")).select(*keys, "wrapper").mapInArrow(run, "host string, part int, wrapper binary")


def _met(pages: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """(page_id, url, html, host, wrapper) of each page; the wrappers of all hosts, if they are sent instead."""
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), _host().alias("host"))
    if size <= SEND:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: bytes(r["wrapper"]) for r in wrappers.collect()})
        return rows.select("page_id", "url", "html", "host", F.lit(None).cast("binary").alias("wrapper")), sent
    # pages of a hot host meet copies of its wrapper in SALTS places
    copies = wrappers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(copies.hint("shuffle_hash"), ["host", "part"], "left").select("page_id", "url", "html", "host", "wrapper"), None


def _opened(known: dict[str, Wrapper | None], host: str, raw: pa.BinaryScalar, sent: Broadcast | None) -> Wrapper | None:
    """The wrapper of a host; known keeps the last ones."""
    if host not in known:
        if len(known) > 500:
            known.clear()
        blob = sent.value.get(host) if sent is not None else raw.as_py()
        known[host] = pickle.loads(blob) if blob else None
    return known[host]


def _templates(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, found): node, hash, characters and pages of the template texts of each host that has any; node -1
    has as its pages the characters of all its articles."""
    rows, sent = _met(pages, wrappers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        counts: Counter[tuple[str, int, int, int, int]] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in counts], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))), pa.array(list(counts.values()), pa.int64())], ["host", "pages", "node", "hash", "chars", "n"])

        for batch in batches:
            for html, host, raw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                w = _opened(known, host, raw, sent)
                if w is not None and w.pages >= LEAST_PAGES and html.is_valid and (text := html.as_py()):
                    texts, size = w.filled(Page(text))
                    counts.update((host, w.pages, *x) for x in texts)
                    counts[host, w.pages, -1, 0, 0] += size
                if len(counts) >= TALLY:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    counts = rows.select("html", "host", "wrapper").mapInArrow(run, "host string, pages long, node int, hash long, chars long, n long")
    sums = counts.groupBy("host", "pages", "node", "hash").agg(F.max("chars").alias("chars"), F.sum("n").alias("n"))
    found = sums.where((F.col("node") < 0) | (F.col("n") >= F.greatest(F.lit(LEAST_PAGES), CONSTANT * F.col("pages"))))
    return found.groupBy("host").agg(F.collect_list(F.struct("node", "hash", "chars", "n")).alias("found"))


def induce(pages: DataFrame) -> DataFrame:
    """(host, part, wrapper) with part 0: the wrapper of each host, over all its pages."""
    common.prepare(pages.sparkSession)
    wrappers = common.materialise(_merged(_merged(_built(pages), ["host", "part"]), ["host"]), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                w = pickle.loads(blob)
                fixed = every = 0
                for x in found or []:
                    if x["node"] < 0:
                        every = x["n"]
                    else:
                        w.texts[x["node"]][x["hash"]] = x["n"]
                        fixed += x["n"] * x["chars"]
                w.copies = 2 * fixed > every
                out.append(pickle.dumps(w, 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["host", "part", "wrapper"])

    joined = wrappers.join(_templates(pages, wrappers), "host", "left").select("host", "part", "wrapper", "found")
    return common.materialise(joined.mapInArrow(run, "host string, part int, wrapper binary"), "templates")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows, sent = _met(pages, induce(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for batch in batches:
            out = [extract(html.as_py(), _opened(known, host, raw, sent)) for html, host, raw in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main-text extraction by wrapper induction.

Pages are parsed to trees of block elements. Of each host, and of each layout of a host (pages with the same label
paths), up to REFERENCES pages of distinct text are taken (those with the smallest hash of their text) and one wrapper
is induced: the trees are aligned with the first of them by simple tree matching, and a text slot that holds the same
text in every aligned page, in MIN_SUPPORT pages at least, is a constant of the template; other slots vary. Pages
whose text is the same count once, before the choice, so that copies of one article neither turn it into template nor
take the places of others. Every page is then aligned with its host's and its layout's wrapper, and constant slots
are dropped.

What varies but is not the article is told by the elements themselves: menus, headers, footers, sidebars, forms
and the like by tag or by the whole words of their class, id or role; if a page has an article or main element, only
text inside one counts; elsewhere, lists made of links alone do not count. Such a cue does not stand where it would take
away the only article element, or, on a page without one, most of the text that the template leaves open.

Wrappers are small (a few hundred bytes a host). If all of them together stay below BROADCAST_BYTES they are
broadcast and pages are not shuffled; beyond it pages are joined with them by host.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, small

REFERENCES = 8
MIN_SUPPORT = 4
BROADCAST_BYTES = 32 << 20
DP_CELLS = 40_000

BLOCKS = set(
    "html body div section article main header footer nav aside form ul ol li p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote "
    "pre figure figcaption dl dt dd head title address details summary dialog menu fieldset legend button select option textarea noscript template "
    "iframe object svg hgroup search label canvas video audio".split()
)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "svg", "template", "xmp"}
DROPPED = {"head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "video", "audio", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "menu", "dialog", "search", "fieldset", "legend", "label"}
CLOSES_P = BLOCKS - {"html", "body", "head", "label", "button", "option"}
#: Elements that hold a page's text at times, and are then no cue.
LIFTED = {"form", "fieldset", "label", "dialog", "header"}
_WORDS = (
    r"ads?|advert\w*|adsense|banners?|promos?|promotions?|sponsor\w*|side-?bars?|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notices?|alerts?|"
    r"newsletters?|subscribe|subscription|share|sharing|social|comments?|commentlist|respond|replies|disqus|footer|masthead|related|recommended|popup|modal|overlay|"
    r"widgets?|login|signup|search|toolbar|pagination|pager|skip-?link|complementary|contentinfo"
)
_PLACES = "site|page|main|top|bottom|left|right|global|primary|secondary|article|post|user|reader|google|cookie|social|share"
_PARTS = "bar|box|block|list|links?|buttons?|icons?|wrap|wrapper|container|section|area|panel|inner|items?|form|slot|unit|widget|banner|notice|message|thread|feed|posts?|stories|articles|signup|nav|menu"
#: A whole word of a class, id or role: a telling word, where it stands before it and what part of it after it. A word that
#: tells of the layout around it (content-with-sidebar, has-sidebar) or of its subject (share-price) is not one.
NOISE = re.compile(rf"(?:(?:{_PLACES})[-_]+)?(?:{_WORDS})(?:[-_]+(?:{_PARTS}))?|(?:site|page)-?header", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


@dataclass
class Node:
    tag: str
    names: str = ""
    children: list = field(default_factory=list)
    #: text slots: (number of child elements before it, text, all of it inside links)
    slots: list = field(default_factory=list)

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}"


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements leave their text in the block around them; unclosed elements end
    where their parent ends, and a paragraph or list item where the next begins."""
    root = Node("#")
    stack = [root]
    buffer: list[str] = []
    plain = linked = 0
    link = 0

    def flush():
        nonlocal plain, linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                top = stack[-1]
                top.slots.append((len(top.children), text, linked > 0 and plain == 0))
            buffer.clear()
        plain = linked = 0

    def put(text: str):
        nonlocal plain, linked
        if text:
            buffer.append(text)
            if not text.isspace():
                if link:
                    linked += 1
                else:
                    plain += 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        link = 0
                        break
            continue
        closed = m[3].rstrip().endswith("/")
        if tag in RAW and not closed:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag in ("script", "style"):
                put(" ")
            else:
                flush()
                stack[-1].children.append(Node(tag))
            at = end.end() if end else n
            continue
        if tag == "a":
            link += 1
        elif tag in ("br", "hr", "img", "input", "wbr"):
            put(" " if tag != "wbr" else "")
        elif tag in BLOCKS:
            flush()
            link = 0
            if tag in CLOSES_P:
                _close(stack, {"p"}, {"table", "button", "object"})
                if tag == "li":
                    _close(stack, {"li"}, {"ul", "ol", "menu"})
                elif tag in ("dt", "dd"):
                    _close(stack, {"dt", "dd"}, {"dl"})
                elif tag in ("td", "th"):
                    _close(stack, {"td", "th"}, {"table", "tr"})
                elif tag == "tr":
                    _close(stack, {"tr"}, {"table", "thead", "tbody", "tfoot"})
                elif tag == "body":
                    _close(stack, {"head"}, set())
            names = " ".join(sorted({w for x in _NAMES.findall(m[3]) for y in x for w in y.split()}))
            node = Node(tag, names)
            stack[-1].children.append(node)
            if not closed:
                stack.append(node)
    flush()
    return root


def _close(stack: list[Node], tags: set[str], until: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in until:
            return
        if stack[k].tag in tags:
            del stack[k:]
            return


class Shapes:
    """Trees by what matching looks at: labels and children. Nodes of one shape share a number, and so all scores."""

    def __init__(self, *trees: Node):
        self.of: dict[int, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self._memo: dict[tuple[int, int], tuple[int, list]] = {}
        known: dict[tuple, int] = {}
        for tree in trees:
            for _, x in reversed(_preorder(tree)):
                kids = tuple(self.of[id(c)] for c in x.children)
                key = (x.label, kids)
                if key not in known:
                    known[key] = len(self.labels)
                    self.labels.append(x.label)
                    self.children.append(kids)
                    self.sizes.append(1 + sum(self.sizes[k] for k in kids))
                self.of[id(x)] = known[key]

    def score(self, a: int, b: int) -> int:
        """The number of pairs in the largest mapping of two trees."""
        if a == b:
            return self.sizes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        if not self.children[a] or not self.children[b]:
            return 1
        return self.aligned(a, b)[0]

    def aligned(self, a: int, b: int) -> tuple[int, list]:
        """The score of two trees of one label, and which of their children are paired."""
        if a == b:  # no other mapping pairs all nodes
            return self.sizes[a], [(k, k) for k in range(len(self.children[a]))]
        key = (a, b)
        if key not in self._memo:
            self._memo[key] = _align(self.children[a], self.children[b], self.score)
        return self._memo[key]


def _align(p: tuple[int, ...], q: tuple[int, ...], score) -> tuple[int, list]:
    """1 and the largest sum of scores of an order-preserving pairing of two lists of shapes, with its pairs.

    Equal shapes at both fronts, then at both ends, are paired at once: no pairing scores more. Of what remains, all rows of
    the recurrence are held up to DP_CELLS cells; beyond, the list is halved (Hirschberg), in linear memory. Among pairings of
    equal score both ways give the one whose path through the table stays furthest to the right.
    """
    lo, n, m = 0, len(p), len(q)
    while lo < min(n, m) and p[lo] == q[lo]:
        lo += 1
    while n > lo and m > lo and p[n - 1] == q[m - 1]:
        n, m = n - 1, m - 1
    held: dict[int, np.ndarray] = {}
    kinds = sorted(set(q[lo:m]))
    at = np.searchsorted(kinds, q[lo:m]) if kinds else np.zeros(0, np.int64)

    def weights(i: int) -> np.ndarray:
        """The scores of child i with all of q[lo:m]."""
        if p[i] not in held:
            held[p[i]] = np.array([score(p[i], t) for t in kinds], np.int64)[at]
        return held[p[i]]

    def last_row(rows: range, c: int, d: int, back: bool) -> np.ndarray:
        row = np.zeros(d - c + 1, np.int64)
        for i in rows:
            w = weights(i)[c - lo : d - lo]
            new = row.copy()
            np.maximum(new[1:], row[:-1] + (w[::-1] if back else w), out=new[1:])
            row = np.maximum.accumulate(new)
        return row

    pairs: list[tuple[int, int]] = []
    todo = [(lo, n, lo, m)]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > DP_CELLS:
            mid = (a + b) // 2
            both = last_row(range(a, mid), c, d, False) + last_row(range(b - 1, mid - 1, -1), c, d, True)[::-1]
            cut_at = c + len(both) - 1 - int(both[::-1].argmax())
            todo += [(mid, b, cut_at, d), (a, mid, c, cut_at)]
            continue
        table, found = [[0] * (d - c + 1)], []
        rows = [weights(i)[c - lo : d - lo].tolist() for i in range(a, b)]
        for w in rows:
            above, own = table[-1], [0]
            for j, x in enumerate(w):
                own.append(max(above[j + 1], own[j], above[j] + x))
            table.append(own)
        i, j = b - a, d - c
        while i and j:
            best = table[i][j]
            if best == table[i - 1][j]:
                i -= 1
            elif rows[i - 1][j - 1] and best == table[i - 1][j - 1] + rows[i - 1][j - 1]:
                i, j = i - 1, j - 1
                found.append((a + i, c + j))
            else:
                j -= 1
        pairs += found[::-1]
    ends = [(n + k, m + k) for k in range(len(p) - n)]
    pairs = [(k, k) for k in range(lo)] + pairs + ends
    return 1 + sum(score(p[i], q[j]) for i, j in pairs), pairs


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest order-preserving top-down mapping of two trees (simple tree matching)."""
    if a.label != b.label:
        return []
    shapes = Shapes(a, b)
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += [(x.children[i], y.children[j]) for i, j in shapes.aligned(shapes.of[id(x)], shapes.of[id(y)])[1]]
    return out


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) | len(text) << 32


def _preorder(node: Node) -> list[tuple[int, Node]]:
    """(depth, node) in page order."""
    out, todo = [], [(0, node)]
    while todo:
        depth, x = todo.pop()
        out.append((depth, x))
        todo += [(depth + 1, c) for c in reversed(x.children)]
    return out


def _tree(flat: list[tuple]) -> Node:
    """The tree of rows (depth, tag, names, slots) in page order."""
    path: list[Node] = []
    for depth, tag, names, slots in flat:
        node = Node(tag, names, [], slots)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def induce(pages: list[str]) -> bytes:
    """The wrapper of same-host pages: the first page's tree, whose slots hold the hash of a constant text or 0."""
    trees = [parse(p) for p in pages]
    distinct, seen = [], set()
    for t in trees:
        texts = tuple(main_text(t))
        if texts not in seen:
            seen.add(texts)
            distinct.append(t)
    if not distinct:
        return b""
    base = distinct[0]
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], int] = {}
    for t in distinct:
        for x, y in match(base, t):
            for k, (_, text, _) in enumerate(x.slots):
                if k < len(y.slots):
                    total[id(x), k] = total.get((id(x), k), 0) + 1
                    count[id(x), k] = count.get((id(x), k), 0) + (y.slots[k][1] == text)

    def constants(x: Node) -> list[int]:
        return [_hash(s[1]) if total[id(x), k] == count[id(x), k] >= MIN_SUPPORT else 0 for k, s in enumerate(x.slots)]

    return pickle.dumps([(depth, x.tag, x.names, constants(x)) for depth, x in _preorder(base)])


def layout(tree: Node) -> int:
    """Hash of the label paths of a page: how often a path occurs, and all text, leaves it unchanged."""
    paths, trail = set(), []
    for depth, x in _preorder(tree):
        del trail[depth:]
        trail.append(xxhash.xxh64_intdigest(x.label.encode(), trail[-1] if trail else 0))
        paths.add(trail[-1])
    return _signed(xxhash.xxh64_intdigest(repr(sorted(paths)).encode()) | 1)  # 0 stands for the whole host


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _facts(page: str) -> tuple[int, int]:
    """Hash of the blocks of text before any template is dropped, and the layout."""
    tree = parse(page)
    return _signed(xxhash.xxh64_intdigest("\0".join(main_text(tree)).encode())), layout(tree)


TEMPLATE, CUE, CONTENT = "template", "cue", "content"


def blocks(tree: Node, *wrappers: Node | None) -> list[tuple[str, str]]:
    """(verdict, text) of every text slot, in page order. Slots that any wrapper holds as constant are template; what
    the wrappers leave open is decided by cues of the page itself: its tags, and the words of class, id and role."""
    constant: set[tuple[int, int]] = set()
    for wrapper in wrappers:
        if wrapper is None:
            continue
        for x, y in match(wrapper, tree):
            for k, (_, text, _) in enumerate(y.slots):
                if k < len(x.slots) and x.slots[k] and x.slots[k] == _hash(text):
                    constant.add((id(y), k))

    lifted: set[int] = set()

    def noise(x: Node, inside: bool) -> bool:
        if id(x) in lifted:
            return False
        if x.tag in DROPPED or (x.tag == "header" and not inside):
            return True
        return bool(x.names) and x.tag not in ("html", "body", "article", "main", "#") and any(NOISE.fullmatch(w) for w in x.names.split())

    def has_article(x: Node) -> bool:
        return not noise(x, True) and (x.tag in ("article", "main") or any(has_article(c) for c in x.children))

    def links_only(x: Node) -> bool:
        return all(s[2] for s in x.slots) and all(links_only(c) for c in x.children)

    def can_lift(x: Node) -> bool:
        return x.tag not in DROPPED or x.tag in LIFTED

    # how much open text each subtree holds; told from its end, so that children come first
    mass: dict[int, int] = {}
    above: dict[int, Node] = {}
    order = [x for _, x in _preorder(tree)]
    for x in reversed(order):
        mass[id(x)] = sum(mass[id(c)] for c in x.children) + sum(len(s[1]) for k, s in enumerate(x.slots) if (id(x), k) not in constant)
        above.update((id(c), x) for c in x.children)
    if not has_article(tree):
        # cues may not take away the only article, nor, where there is none, most of the text that varies
        articles = [x for x in order if x.tag in ("article", "main")]
        if articles:

            def path(x: Node) -> list[Node]:
                out = [x]
                while id(out[-1]) in above:
                    out.append(above[id(out[-1])])
                return out

            # the one that fewest cues speak against, then the largest
            cues = {id(x): [y for y in path(x) if noise(y, True)] for x in articles}
            x = min(articles, key=lambda x: (len(cues[id(x)]), -mass[id(x)]))
            if all(can_lift(y) for y in cues[id(x)]):
                lifted.update(id(y) for y in cues[id(x)])
        else:
            lifted.update(id(x) for x in order if can_lift(x) and 2 * mass[id(x)] > mass[id(tree)])

    out: list[tuple[str, str]] = []
    strict = has_article(tree)

    def walk(x: Node, inside: bool, told: bool) -> None:
        told = told or noise(x, inside)
        inside = inside or x.tag in ("article", "main")
        told = told or (not inside and x.tag in ("ul", "ol") and bool(x.children) and links_only(x))
        s = 0
        for i in range(len(x.children) + 1):
            while s < len(x.slots) and x.slots[s][0] == i:
                open_ = (id(x), s) not in constant
                out.append((TEMPLATE if not open_ else CUE if told or (strict and not inside) else CONTENT, x.slots[s][1]))
                s += 1
            if i < len(x.children):
                walk(x.children[i], inside, told)

    walk(tree, False, False)
    return out


def main_text(tree: Node, *wrappers: Node | None) -> list[str]:
    """The blocks of the main text, in page order."""
    return [text for verdict, text in blocks(tree, *wrappers) if verdict == CONTENT]


def extract(pages: DataFrame, references: int = REFERENCES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text (blocks joined by a newline), n_chars of every row.

    Null or empty html gives an empty text. Pages whose url names no host share one wrapper. Repeated rows give
    repeated results; an empty table gives none. Deep nesting is bounded by Python's own recursion limit, which is
    raised for the parse; other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    rows = rows.withColumn("_p", F.xxhash64("page_id", F.isnull("page_id"), "url", "html"))

    def described(batches):
        for b in batches:
            found = [_deep(_facts, h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["host", "_p", "_text", "layout"])

    # copies of a text count once, so that they take no other page's place
    facts = rows.filter("html IS NOT NULL").select("host", "_p", "html").mapInArrow(described, "host string, _p long, _text long, layout long")
    distinct = cut(facts.groupBy("host", "layout", "_text").agg(F.min("_p").alias("_p")), "wrapper-texts")
    whole = distinct.groupBy("host", "_text").agg(F.min("_p").alias("_p")).withColumn("layout", F.lit(0).cast("long"))
    # layouts get a wrapper of their own if they can support constants and are not all of their host
    per = distinct.groupBy("host", "layout").agg(F.count("*").alias("_n"))
    every = distinct.groupBy("host").agg(F.count("*").alias("_all"))
    own = distinct.join(per.join(every, "host").filter(f"_n >= {MIN_SUPPORT} AND _n < _all").select("host", "layout"), ["host", "layout"], "left_semi")
    w = Window.partitionBy("host", "layout").orderBy("_text", "_p")
    chosen = whole.unionByName(own).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= references)
    # a few rows per layout: where they are few in all, pages stay where they are
    chosen = small(cut(chosen.select("_p", "host", "layout", "_r"), "wrapper-refs"))
    refs = rows.filter("html IS NOT NULL").select("_p", "host", "html").join(chosen, ["_p", "host"]).dropDuplicates(["host", "layout", "_p"])

    def wrappers(t: pa.Table) -> pa.Table:
        order = sorted(zip(t.column("_r").to_pylist(), t.column("html").to_pylist()))
        return pa.table({"host": t.column("host").slice(0, 1), "layout": t.column("layout").slice(0, 1), "wrapper": pa.array([_deep(induce, [x for _, x in order])], pa.binary())})

    made = cut(refs.groupBy("host", "layout").applyInArrow(wrappers, "host string, layout long, wrapper binary"), "wrappers")
    held = made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0
    schema = "page_id long, url string, text string, n_chars long"

    def results(ids, urls, htmls, packed):
        """packed: per page a function that gives the wrapper of a layout (0: of the host), or none."""
        cache: dict[bytes, Node] = {}
        texts = []

        def wrapper(p: bytes | None) -> Node | None:
            if not p:
                return None
            if p not in cache:
                if len(cache) > 1000:
                    cache.clear()
                cache[p] = _tree(pickle.loads(p))
            return cache[p]

        for h, find in zip(htmls, packed):
            texts.append("\n".join(_deep(_page, h, lambda k, find=find: wrapper(find(k)))) if h else "")
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if held <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({(r[0], r[1]): bytes(r[2]) for r in made.toLocalIterator()})

        def run(batches):
            for b in batches:
                hosts = b.column(3).to_pylist()
                yield results(b.column(0), b.column(1), b.column(2).to_pylist(), [lambda k, h=h: shared.value.get((h, k)) for h in hosts])

        return rows.select("page_id", "url", "html", "host").mapInArrow(run, schema)

    def laid_out(batches):
        for b in batches:
            keys = [_deep(_facts, h)[1] if h else None for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(keys, pa.int64())], names=["page_id", "url", "html", "host", "layout"])

    def joined(batches):
        for b in batches:
            both = zip(b.column(3).to_pylist(), b.column(4).to_pylist())
            yield results(b.column(0), b.column(1), b.column(2).to_pylist(), [lambda k, x=x, y=y: y if k else x for x, y in both])

    keyed = rows.select("page_id", "url", "html", "host").mapInArrow(laid_out, "page_id long, url string, html string, host string, layout long")
    keyed = keyed.join(made.filter("layout = 0").select("host", "wrapper"), "host", "left")
    keyed = keyed.join(made.filter("layout <> 0").select("host", "layout", F.col("wrapper").alias("_own")), ["host", "layout"], "left")
    return keyed.select("page_id", "url", "html", "wrapper", "_own").mapInArrow(joined, schema)


def _page(html: str, find) -> list[str]:
    tree = parse(html)
    return main_text(tree, find(0), find(layout(tree)))


def _deep(f, *args):
    """f with room for deep trees: on a thread with a large stack if the usual recursion limit is not enough."""
    try:
        return f(*args)
    except RecursionError:
        import sys
        import threading

        out: list = []
        limit, size = sys.getrecursionlimit(), threading.stack_size(512 << 20)
        sys.setrecursionlimit(1_000_000)
        try:
            t = threading.Thread(target=lambda: out.append(f(*args)))
            t.start()
            t.join()
        finally:
            sys.setrecursionlimit(limit)
            threading.stack_size(size)
        return out[0]

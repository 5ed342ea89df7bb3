"""Main text of web pages by wrapper induction.

All different pages of a host are parsed and their DOM trees are aligned by simple tree matching with a base page of
their layout. A node whose text is the same in most pages of a layout is constant: it belongs to the template. Every page
is then read on its own: blocks outside scripts, menus and the like, inside the article where the page marks one, whose
(path, text) is not a constant of the host, in page order.

Nothing is counted on a sample. Bases are found in rounds: some pages per host that are like no base so far are looked at
together, one of each layout among them is a new base, and all pages that are like no earlier base are aligned with it;
the rounds end when every page has a base. A page is left out of the alignment if most of what varies in it, that is of its
blocks which most pages do not have, stands in another page that comes first (by a hash), so copies of an article do not
become template. Trees may be as deep and lists as long as they like: equal subtrees are weighed once, level by level.

Defined cases: NULL and empty html give an empty text; a tag cut off at the end is dropped; a page whose url
is NULL has no host template; a host with fewer than three different pages has none either; a page whose
blocks are all constant keeps them; repeated rows are read one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import small, written
from .text import appended, quoted, refuse_clash, with_columns

PICKED_PAGES = 8  # per host among which new bases are looked for in the first round; four times as many in each further one
MOST_PICKED = 128
_KEPT_SHAPES = 200_000  # of pairs of subtrees weighed in a task; beyond that it starts anew. Results do not depend on it.
CONSTANT_SHARE = 0.6
SAME_LAYOUT = 0.5  # share of a base page's nodes that a page of its layout has

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style textarea title noscript template iframe svg select button object canvas audio video math".split())
_CHROME_TAGS = frozenset("head nav footer aside form menu dialog".split()) | _RAW
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words of a class or id that mark what is no article.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer copyright sidebar sidenav aside widget widgets related recommended cookie cookies consent gdpr notice notices "
    "notification banner popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist "
    "respond replies disqus discussion pagination pager skip hidden".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<rest>(?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|(?P<cut></?[a-zA-Z][^>]*\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_NAMES = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


_LONGS = pa.list_(pa.int64())


class Node:
    __slots__ = ("label", "path", "chrome", "article", "children", "texts", "shape")

    def __init__(self, label: str, parent: "Node | None", chrome: bool, article: bool):
        self.label = label
        self.path = zlib.crc32(label.encode(), parent.path if parent else 0)
        self.chrome, self.article, self.children, self.texts = chrome, article, [], []


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    def key(self) -> int:
        return (self.node.path << 32 | zlib.crc32(self.text.encode())) - (1 << 63)


def _attributes(tag: str, rest: str) -> tuple[str, bool]:
    """The label of a node (tag and class) and whether its attributes mark it as no article."""
    kind, chrome = "", False
    for name, value in _NAMES.findall(rest):
        name, value = name.lower(), value.strip("\"'")
        if name == "class":
            kind = value
        if name in ("class", "id"):
            chrome |= tag not in ("html", "body", "article", "main") and not _CHROME_WORDS.isdisjoint(w.lower() for w in _SPLIT.split(value))
            chrome |= tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(_SPLIT.split(value.lower()))
        elif name == "role":
            chrome |= value.lower() in _CHROME_ROLES
        elif name == "style":
            chrome |= "display:none" in value.replace(" ", "").lower()
        elif name == "aria-hidden" or name == "hidden":
            chrome |= value.lower() != "false"
    return f"{tag}.{kind}" if kind else tag, chrome or bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", rest)))


def parse(page: str | None) -> tuple[Node, list[Block]]:
    """The DOM of a page, and its blocks of text in page order (scripts and other raw elements left out)."""
    root = Node("", None, False, False)
    stack: list[tuple[str, Node]] = [("", root)]
    blocks: list[Block] = []
    pieces: list[str] = []
    home, linked, links = root, 0, 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(home, text, linked))
                home.texts.append(text)
            pieces.clear()
        linked = 0

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"]
        if text is not None:
            if not pieces:
                home = next(n for t, n in reversed(stack) if t in _BLOCK or t == "")
            pieces.append(text)
            linked += len(text) if links else 0
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a" and links:
                links -= 1
            if any(t == tag for t, _ in stack):
                if tag in _BLOCK:
                    flush()
                while len(stack) > 1:
                    t, _ = stack.pop()
                    if t == tag:
                        break
                    if t in _BLOCK:
                        flush()
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW and not m["rest"].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            if tag in ("button", "select", "iframe", "video", "audio", "object"):
                pieces.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK:
            flush()
            if any(t == "p" for t, _ in stack):  # a block ends an open paragraph
                while stack[-1][0] != "p":
                    stack.pop()
                stack.pop()
        if tag in _CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in _CLOSES[tag]:
                    del stack[depth:]
                    break
                if stack[depth][0] in _BARRIERS[tag]:
                    break
        if tag == "body":  # an unclosed head
            while any(t == "head" for t, _ in stack):
                stack.pop()
        if tag in _VOID:
            continue
        parent = stack[-1][1]
        label, marked = _attributes(tag, m["rest"]) if m["rest"] else (tag, False)
        inside = parent.article or tag in ("article", "main")
        chrome = parent.chrome or marked or tag in _CHROME_TAGS or (tag == "header" and not parent.article)
        if tag in _BLOCK or tag == "head" or chrome:
            node = Node(label, parent, chrome, inside)
            parent.children.append(node)
        else:
            node = parent
        if not m["rest"].endswith("/") or tag in _BLOCK:
            stack.append((tag, node))
            links += tag == "a"
    flush()
    return root, blocks


class Shapes:
    """Equal subtrees get one number; the weight of the best matching of two of them is found once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> int:
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            key = (node.label, *[c.shape for c in node.children])
            node.shape = self.numbers.setdefault(key, len(self.numbers))
            if node.shape == len(self.labels):
                self.labels.append(node.label)
                self.children.append(key[1:])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1:]))
        return root.shape

    def weight(self, s: int, t: int) -> int:
        """Size of the best matching of two subtrees; its parts come first, without recursion."""
        stack = [(s, t)]
        while stack:
            s, t = pair = stack[-1]
            if pair in self.weights:
                stack.pop()
            elif s == t or self.labels[s] != self.labels[t]:
                self.weights[pair] = self.sizes[s] if s == t else 0
            else:
                x, y = self._middle(self.children[s], self.children[t])[1:]
                open_ = [(i, j) for i in set(x) for j in set(y) if (i, j) not in self.weights]
                if open_:
                    stack += open_
                    continue
                kept = self.sizes[s] - 1 - sum(self.sizes[i] for i in x)
                rows = self._rows(x, y)
                self.weights[pair] = 1 + kept + (int(rows[-1][-1]) if len(rows) else 0)
        return self.weights[pair]

    @staticmethod
    def _middle(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """How many equal children both begin with, and what is left between those and the equal ones at the end: matching
        equal children there is never worse."""
        head, most = 0, min(len(x), len(y))
        while head < most and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < most - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, x[head : len(x) - tail], y[head : len(y) - tail]

    def _weights(self, x: tuple[int, ...], y: tuple[int, ...]) -> np.ndarray:
        xs, at_x = np.unique(x, return_inverse=True)
        ys, at_y = np.unique(y, return_inverse=True)
        table = np.array([[self.weights[(i, j)] for j in ys.tolist()] for i in xs.tolist()], np.int32)
        return table[at_x][:, at_y]

    def _rows(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[np.ndarray]:
        """Best totals of the first children of both, row by row."""
        if not x or not y:
            return []
        rows = [np.zeros(len(y) + 1, np.int32)]
        for w in self._weights(x, y):
            best = np.maximum(rows[-1][1:], rows[-1][:-1] + w)
            rows.append(np.concatenate([[0], np.maximum.accumulate(best)]).astype(np.int32))
        return rows

    def align(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the children of both that one best matching pairs."""
        head, mid_x, mid_y = self._middle(x, y)
        pairs = [(i, i) for i in range(head)]
        tail = len(x) - head - len(mid_x)
        pairs += [(len(x) - 1 - i, len(y) - 1 - i) for i in range(tail)]
        rows = self._rows(mid_x, mid_y)
        i, j = len(mid_x), len(mid_y)
        while rows and i and j:
            w = self.weights[(mid_x[i - 1], mid_y[j - 1])]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((head + i, head + j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return pairs


def matching(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, shapes: Shapes | None = None) -> int:
    """Simple tree matching: the largest number of node pairs that keep labels, order and ancestors.
    With ``pairs``, the pairs of one best matching are added to it."""
    if shapes is None:
        shapes = Shapes()
        shapes.number(a)
        shapes.number(b)
    total = shapes.weight(a.shape, b.shape)
    if pairs is None or not total:
        return total
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        for i, j in shapes.align(shapes.children[x.shape], shapes.children[y.shape]):
            shapes.weight(x.children[i].shape, y.children[j].shape)
            stack.append((x.children[i], y.children[j]))
    return total


def induce(pages: list[str]) -> list[int]:
    """Keys of the constant blocks of a few pages of a host, all held at once."""
    parsed = [parse(page) for page in sorted(set(pages))]
    having = Counter(t for _, blocks in parsed for t in {b.text for b in blocks if not b.node.chrome})
    shapes, trees, seen = Shapes(), [], set()
    for root, blocks in parsed:
        varying = {b.text for b in blocks if not b.node.chrome and having[b.text] < max(2, CONSTANT_SHARE * len(parsed))}
        size = sum(map(len, varying))
        if size and 2 * sum(len(t) for t in varying & seen) <= size:  # no copy of an earlier page
            shapes.number(root)
            trees.append((root, blocks))
        seen |= varying
    constants: set[int] = set()
    bases: list[Node] = []
    for base, blocks in trees:
        size = shapes.sizes[base.shape]
        if any(shapes.weight(base.shape, b.shape) >= SAME_LAYOUT * size for b in bases):
            continue
        bases.append(base)
        of_node: dict[int, list[Block]] = {}
        for b in blocks:
            of_node.setdefault(id(b.node), []).append(b)
        equal, alike = Counter(), 0
        for other, _ in trees:
            if other is base or shapes.weight(base.shape, other.shape) < SAME_LAYOUT * size:
                continue
            alike += 1
            pairs: list[tuple[Node, Node]] = []
            matching(base, other, pairs, shapes)
            equal.update({id(b) for x, y in pairs for b in of_node.get(id(x), []) if b.text in y.texts})
        if alike >= 2:
            constants |= {b.key() for b in blocks if equal[id(b)] >= max(2, CONSTANT_SHARE * alike)}
    return sorted(constants)


def main_text(page: str | None, constants: frozenset[int] | set[int]) -> str:
    _, blocks = parse(page)
    plain = [b for b in blocks if not b.node.chrome]
    if any(b.node.article for b in plain):
        plain = [b for b in plain if b.node.article]
    else:
        plain = [b for b in plain if 2 * b.linked <= len(b.text)]
    varying = [b for b in plain if b.key() not in constants]
    return "\n".join(b.text for b in varying or plain)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different texts of a page's blocks outside menus and the like, as hashes, and their lengths."""
    for batch in batches:
        found = [{b.text for b in parse(page)[1] if not b.node.chrome} for page in batch.column("html").to_pylist()]
        hashes = [[int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for t in own] for own in found]
        sizes = [[len(t) for t in own] for own in found]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("h"), pa.array(hashes, _LONGS), pa.array(sizes, _LONGS)], names=["host", "h", "texts", "sizes"])


def _bases_of(frame: pd.DataFrame) -> pd.DataFrame:
    """One page of each layout among those picked of a host."""
    shapes, bases, found = Shapes(), [], []
    for page in frame.sort_values("h").html:
        root = parse(page)[0]
        shapes.number(root)
        if not any(shapes.weight(base.shape, root.shape) >= SAME_LAYOUT * shapes.sizes[base.shape] for base in bases):
            bases.append(root)
            found.append(page)
    return pd.DataFrame({"host": frame.host.iloc[0], "base_html": found})


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every page and base of its layout: the base's blocks (number and key) whose text the page has at the same node."""
    shapes, bases = Shapes(), {}
    for batch in batches:
        out, parsed = [], (None, None)
        for host, h, page, base, base_page in zip(*(batch.column(c).to_pylist() for c in ("host", "h", "html", "base", "base_html"))):
            if len(shapes.weights) > _KEPT_SHAPES or len(bases) > 1000:
                shapes, bases, parsed = Shapes(), {}, (None, None)
            if base not in bases:
                root, blocks = parse(base_page)
                shapes.number(root)
                of_node: dict[int, list[int]] = {}
                for i, b in enumerate(blocks):
                    of_node.setdefault(id(b.node), []).append(i)
                bases[base] = root, blocks, of_node
            root, blocks, of_node = bases[base]
            if parsed[0] != h:
                other = parse(page)[0]
                shapes.number(other)
                parsed = h, other
            if shapes.weight(root.shape, parsed[1].shape) < SAME_LAYOUT * shapes.sizes[root.shape]:
                continue
            pairs: list[tuple[Node, Node]] = []
            matching(root, parsed[1], pairs, shapes)
            equal = sorted({i for x, y in pairs for i in of_node.get(id(x), []) if blocks[i].text in y.texts})
            out.append((host, h, base, equal, [blocks[i].key() for i in equal]))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), _LONGS, _LONGS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "h", "base", "places", "keys"])


def _alignable(given: DataFrame) -> DataFrame:
    """(host, h) of all different pages but those that mostly repeat what varies in a page before them."""
    blocks = written(given.mapInArrow(_blocks_of, "host string, h long, texts array<long>, sizes array<long>").dropDuplicates(["host", "h"]))
    pages = small(written(blocks.groupBy("host").agg(F.count("*").alias("pages"))), 64)
    each = blocks.select("host", "h", F.explode(F.arrays_zip("texts", "sizes")).alias("t")).select("host", "h", F.col("t.texts").alias("text"), F.col("t.sizes").alias("size"))
    counts = each.groupBy("host", "text").agg(F.count("*").alias("n"), F.min("h").alias("first")).where("n > 1")
    shared = counts.join(pages, "host").select("host", "text", "first", (F.col("n") >= F.greatest(F.lit(2.0), F.lit(CONSTANT_SHARE) * F.col("pages"))).alias("constant"))
    marked = each.join(small(written(shared), 64), ["host", "text"], "left")
    varies = F.when(F.coalesce("constant", F.lit(False)), 0).otherwise(F.col("size"))
    sums = marked.groupBy("host", "h").agg(F.sum(varies).alias("size"), F.sum(F.when(F.col("first") < F.col("h"), varies).otherwise(0)).alias("seen"))
    return written(sums.where("size > 0 and 2 * seen <= size").select("host", "h"))


def _templates(given: DataFrame) -> DataFrame:
    """host, constants: keys of the constant blocks, counted over all different pages of the host."""
    open_ = _alignable(given)
    found, picked = [], PICKED_PAGES
    while open_.limit(1).count():
        number = F.row_number().over(Window.partitionBy("host").orderBy("h"))
        chosen = written(open_.withColumn("number", number).where(F.col("number") <= picked).select("host", "h"))
        taken = given.join(small(chosen, 64), ["host", "h"]).groupBy("host", "h").agg(F.first("html").alias("html"))
        bases = written(taken.groupBy("host").applyInPandas(_bases_of, "host string, base_html string").withColumn("base", F.xxhash64("base_html")))
        longest = bases.agg(F.max(F.octet_length("base_html"))).first()[0]
        asked = small(open_, 64)
        pages = given.join(asked, ["host", "h"], "left_semi") if found else given
        met = pages.join(small(bases, longest + 64), "host").select("host", "h", "html", "base", "base_html")
        rows = met.mapInArrow(_aligned, "host string, h long, base long, places array<long>, keys array<long>").dropDuplicates(["host", "h", "base"])
        found.append(written(rows.join(asked, ["host", "h"], "left_semi")))
        open_ = written(open_.join(small(written(found[-1].select("host", "h").distinct()), 64), ["host", "h"], "left_anti"))
        picked = min(4 * picked, MOST_PICKED)
    if not found:
        return given.sparkSession.createDataFrame([], "host string, constants array<long>")
    others = reduce(DataFrame.unionByName, found).where("h <> base")
    alike = small(written(others.groupBy("host", "base").agg(F.count("*").alias("alike")).where("alike > 1")), 64)
    places = others.select("host", "base", F.explode(F.arrays_zip("places", "keys")).alias("b")).select("host", "base", F.col("b.places").alias("place"), F.col("b.keys").alias("key"))
    counts = places.groupBy("host", "base", "place").agg(F.count("*").alias("n"), F.first("key").alias("key")).join(alike, ["host", "base"])
    constant = counts.where(F.col("n") >= F.greatest(F.lit(2.0), F.lit(CONSTANT_SHARE) * F.col("alike")))
    return constant.groupBy("host").agg(F.collect_set("key").alias("constants"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns of ``pages`` plus main_text and n_chars."""
    refuse_clash(pages, ["host", "constants", "main_text", "n_chars"])
    known = pages.withColumn("host", host_of(F.col(quoted(url))))
    given = known.select("host", F.col(quoted(html)).alias("html")).where("html is not null and host <> ''").withColumn("h", F.xxhash64("html"))
    templates = small(written(_templates(given)), 2048)
    joined = known.join(templates, "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, set(c or ())) for p, c in zip(batch.column(html).to_pylist(), batch.column("constants").to_pylist())]
            yield appended(batch, {"main_text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return joined.mapInArrow(work, with_columns(joined, "main_text string, n_chars long")).drop("host", "constants")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")

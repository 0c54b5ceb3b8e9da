"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with a binary
label, content or not.  Unary potentials come from a node's own features (tag, words of class
and id, length, link share, punctuation), parent-child potentials from the kind of the child.
Sum-product passes messages from the leaves to the root and back and gives the exact content
marginal of every node; a page's text is its text nodes with a marginal of one half or more.
Weights are trained by gradient ascent on the likelihood of labelled pages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import ship

#: Elements that do not end a block of text, that have no content, and whose content is no markup.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base col embed hr input link meta param source track".split())
RAW = set("script style textarea title iframe noembed noframes template svg math object canvas audio video select".split())
#: Elements whose start ends an open paragraph, and those that an open paragraph cannot reach through.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SCOPE = set("html body table td th caption button article section div main aside nav header footer form blockquote ul ol dl figure".split())
#: What a start tag ends when it is open, and the elements that hide it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/><]*)", re.S)
#: The rest of a tag; where quotes are broken it ends at the next ">" instead.
REST = re.compile(r"((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

FEATURES, KINDS = 1 << 13, 64


class Forest:
    """The trees of some pages as flat lists: parents, depths, kinds, features and texts of nodes."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.features: list[int] = []
        self.ends: list[int] = []
        self.page: list[int] = []
        self.leaves: list[tuple[int, str]] = []
        self._known: dict[tuple, tuple[int, list[int]]] = {}

    def _ids(self, key: tuple, names) -> tuple[int, list[int]]:
        got = self._known.get(key)
        if got is None:
            if len(self._known) > 100_000:
                self._known.clear()
            first, *more = names()
            got = zlib.crc32(first.encode()) % KINDS, [zlib.crc32(x.encode()) % FEATURES for x in (first, *more)]
            self._known[key] = got
        return got

    def _node(self, parent: int, page: int, kind: int, features: list[int]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.features += features
        self.ends.append(len(self.features))
        self.page.append(page)
        return len(self.parent) - 1

    def _element(self, parent: int, parent_tag: str, page: int, tag: str, attributes: str) -> int:
        def names():
            yield f"t:{tag}"
            yield f"p:{parent_tag}>{tag}"
            for m in ATTRIBUTE.finditer(attributes):
                for w in WORD.findall(html.unescape(m[2] or m[3] or m[4] or "")):
                    w = w.lower()
                    yield f"w:{w}"
                    yield f"q:{w[:4]}"

        return self._node(parent, page, *self._ids((parent_tag, tag, attributes), names))

    def _leaf(self, parent: int, parent_tag: str, page: int, parts: list[tuple[str, bool]]) -> None:
        text = " ".join("".join([p for p, _ in parts]).split())
        if not text:
            return
        linked = sum(len(p) for p, in_link in parts if in_link)
        whole = sum(len(p) for p, _ in parts)
        share = 4 * linked // whole
        size, stop = min(len(text).bit_length(), 10), text[-1] if text[-1] in ".!?:;,\"»…" else "-"
        commas = min(text.count(","), 2)
        early = int("©" in text[:20])

        def names():
            yield f"leaf:{parent_tag}"
            yield f"n:{size}"
            yield f"l:{share}"
            yield f"s:{stop}"
            yield f"c:{commas}"
            yield f"©:{early}"
            yield f"nl:{size}:{share}"

        node = self._node(parent, page, *self._ids((parent_tag, size, share, stop, commas, early, 0), names))
        self.leaves.append((node, text))

    def add(self, source: str, page: int) -> None:
        """Parse one page of any length and depth; markup that is broken is read as browsers would, roughly.

        The time follows the length: what is on the stack is found by tag, and a tag that is
        never ended is text.
        """
        root = self._element(-1, "", page, "html", "")
        stack: list[tuple[str, int, bool]] = [("html", root, False)]
        places: dict[str, list[int]] = defaultdict(list)  # where each tag stands on the stack
        parts: list[tuple[str, bool]] = []
        link, at, end, last = False, 0, len(source), source.rfind(">")

        def flush():
            if parts:
                self._leaf(stack[-1][1], stack[-1][0], page, parts)
                parts.clear()

        def pop(n: int):
            nonlocal link
            flush()
            link = stack[n][2]
            while len(stack) > n:
                places[stack.pop()[0]].pop()

        def innermost(tags) -> int:
            return max((places[x][-1] for x in tags if places.get(x)), default=0)

        def close(targets, hidden_by, whole_scope=True):
            while (n := innermost(targets)) and n > innermost(hidden_by - targets):
                pop(n)
                if not whole_scope:
                    return

        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                parts.append((html.unescape(source[at:stop]), link))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            if at > last:
                parts.append((html.unescape(m[0]), link))
                continue
            rest = REST.match(source, at)
            attributes = rest[1] if rest else source[at : source.find(">", at)]
            at += len(attributes) + 1
            tag, closing = m[2].lower(), bool(m[1])
            if tag in INLINE:
                if tag == "a":
                    link = not closing
                continue
            if tag == "br":
                parts.append((" ", link))
                continue
            if closing:
                if tag not in ("html", "body") and places.get(tag):
                    pop(places[tag][-1])
                else:
                    flush()
                continue
            flush()
            if tag in RAW:
                gone = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = gone.end() if gone else end
                continue
            if tag == "html":
                continue
            if tag in ENDS_P:
                close({"p"}, SCOPE, False)
                if tag[0] == "h" and tag[1:].isdigit() and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                    pop(len(stack) - 1)
            if tag in ENDS:
                close(*ENDS[tag])
            node = self._element(stack[-1][1], stack[-1][0], page, tag, attributes)
            if tag not in VOID:
                places[tag].append(len(stack))
                stack.append((tag, node, link))
        flush()

    def arrays(self):
        """Parents, levels of the trees from the root, kinds, and the features with their nodes."""
        parent, depth, kind = (np.array(x, np.int64) for x in (self.parent, self.depth, self.kind))
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        ends = np.array(self.ends, np.int64)
        nodes = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        return parent, levels, kind, np.array(self.features, np.int64), nodes


@dataclass
class Model:
    """Unary weights by feature, and parent-child weights (kind of child, parent's label, child's label)."""

    unary: np.ndarray
    pair: np.ndarray

    def beliefs(self, forest: Forest):
        """Content marginals of all nodes, and the joint of every node's parent and itself."""
        parent, levels, kind, features, nodes = forest.arrays()
        n = len(parent)
        own = np.zeros((2, n))
        own[1] = np.bincount(nodes, self.unary[features], n)
        up, told = np.zeros((2, n)), np.zeros((2, n))  # from the children; to the parent
        for at in reversed(levels[1:]):
            w, a = self.pair[kind[at]], own[:, at] + up[:, at]
            for y in range(2):
                told[y, at] = np.logaddexp(a[0] + w[:, y, 0], a[1] + w[:, y, 1])
                np.add.at(up[y], parent[at], told[y, at])
        down, joint = np.zeros((2, n)), np.zeros((n, 2, 2))
        for at in levels[1:]:
            w, p = self.pair[kind[at]], parent[at]
            rest = own[:, p] + up[:, p] + down[:, p] - told[:, at]
            for y in range(2):
                down[y, at] = np.logaddexp(rest[0] + w[:, 0, y], rest[1] + w[:, 1, y])
            both = rest.T[:, :, None] + w + (own[:, at] + up[:, at]).T[:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[at] = both / both.sum((1, 2), keepdims=True)
            down[:, at] -= down[:, at].max(0)
        whole = own + up + down
        return 1 / (1 + np.exp(np.clip(whole[0] - whole[1], -700, 700))), joint

    def texts(self, sources: list[str]) -> list[str]:
        """The main text of each page."""
        forest = Forest()
        for i, s in enumerate(sources):
            forest.add(s, i)
        content = self.beliefs(forest)[0] if sources else np.zeros(0)
        out: list[list[str]] = [[] for _ in sources]
        for node, text in forest.leaves:
            if content[node] >= 0.5:
                out[forest.page[node]].append(text)
        return ["\n\n".join(x) for x in out]


def train(pages: list[tuple[str, str]], steps: int = 80, rate: float = 0.15, shrink: float = 1e-3) -> Model:
    """Weights from labelled pages (html, main text): a text node is content when its block is one of the text's.

    An element is content when something below it is.  Full-batch gradient ascent on the mean
    log-likelihood of the labels, with adaptive steps.
    """
    forest, label_of = Forest(), []
    for i, (source, text) in enumerate(pages):
        before = len(forest.leaves)
        forest.add(source, i)
        blocks = set(text.split("\n\n"))
        label_of += [t in blocks for _, t in forest.leaves[before:]]
    parent, levels, kind, features, nodes = forest.arrays()
    label = np.zeros(len(parent), np.int64)
    label[[n for n, _ in forest.leaves]] = label_of
    for at in reversed(levels[1:]):
        np.maximum.at(label, parent[at], label[at])
    below = np.flatnonzero(parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kind[below], label[parent[below]], label[below]), 1)
    wanted = np.bincount(features, label[nodes], FEATURES)
    model = Model(np.zeros(FEATURES), np.zeros((KINDS, 2, 2)))
    squares = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    moved = [np.zeros_like(model.unary), np.zeros_like(model.pair)]
    for step in range(1, steps + 1):
        content, joint = model.beliefs(forest)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, kind[below], joint[below])
        slopes = [(wanted - np.bincount(features, content[nodes], FEATURES)) / len(pages) - shrink * model.unary, (seen - expected) / len(pages) - shrink * model.pair]
        for w, g, m, s in zip((model.unary, model.pair), slopes, moved, squares, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    The text is the content blocks in page order, joined by two line feeds; character
    references are decoded and white space inside a block is one space.  A null or empty page,
    or one without content, has an empty text; very long and very deep ones are read whole.  Ids and urls pass through, null or repeated;
    other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def read(batches):
        for b in batches:
            for lo in range(0, len(b), 128):
                part = b.slice(lo, 128)
                texts = held.value.texts([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(id_col, url_col, html_col).mapInArrow(read, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")

"""Main-content extraction from HTML by gradient-boosted trees over DOM nodes.

Pages are parsed into elements and text nodes in document order.  Each node has features of itself (tag, depth,
attribute tokens), of its subtree (text length, density, share of link text, punctuation) and of its siblings and
ancestors.  Boosted regression trees, trained here in numpy, give each node a log-odds of being main content.  Decoding
is hierarchical: a node can be kept only if its parent is, and the kept set is the one with the highest sum of
log-odds under that rule, found by one pass up and one down the tree; so no part of a dropped subtree survives and
a block inside the content can still be dropped.

Training labels come from pages whose main text is known: a text node is content if it is found in that text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import released, small_batches
from codelattice.llm.textvec import column

#: Bound of the training sample, in pages.
TRAINING_PAGES = 300
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 4, 32, 0.3, 20
_LONG = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template svg title meta link".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_CLOSED_BY = {"p": BLOCK - {"br", "html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TAGS = {t: i + 1 for i, t in enumerate("#text p div span a li ul ol nav header footer aside article section main h1 h2 h3 h4 b i em strong table tr td th form button img br body html blockquote pre code figure".split())}
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
#: For tags after one with a quote that nothing closes: they end at the next >.
_OPEN_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Buckets of the attribute tokens.
TOKENS = 24
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_GOOD = re.compile(r"article|content|main|post|body|text|entry|story", re.I)
_BAD = re.compile(r"(?:^|[^a-z])ads?(?:[^a-z]|$)|banner|nav|menu|foot|head|side|comment|share|social|related|promo|cookie|sponsor", re.I)


class Dom:
    """Nodes of one page in document order: parent, tag, text (for text nodes), end of the subtree, attribute flags."""

    __slots__ = ("attrs", "bad", "end", "good", "parent", "tag", "text")

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.text, self.end, self.good, self.bad, self.attrs = [-1], ["#root"], [""], [0], [False], [False], [0]
        open_now, at, size = [0], 0, len(source)
        last = source.rfind(">") + 1  # no tag ends after it
        opens, pattern = {}, _OPEN
        start = 0
        while at < last:
            at = source.find("<", at)
            if at < 0 or at >= last:
                break
            follows = source[at + 1 : at + 2]
            if follows in ("!", "?"):
                self._text(open_now[-1], source[start:at])
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 4)
                    start = at = end + 3 if end >= 0 else size
                else:
                    start = at = source.index(">", at) + 1
                continue
            if follows != "/" and not follows.isalpha():
                at += 1
                continue
            m = pattern.match(source, at)
            if m is None and pattern is _OPEN:
                m = _OPEN_LOOSE.match(source, at)
                if m:
                    pattern = _OPEN_LOOSE
            if m is None:
                at += 1
                continue
            self._text(open_now[-1], source[start:at])
            start = at = m.end()
            name = m[2].lower()
            if m[1]:
                if opens.get(name):
                    i = len(open_now) - 1
                    while self.tag[open_now[i]] != name:
                        i -= 1
                    self._close(open_now, i, opens)
                continue
            while len(open_now) > 1 and name in _CLOSED_BY.get(self.tag[open_now[-1]], ()):
                self._close(open_now, len(open_now) - 1, opens)
            node = self._node(open_now[-1], name, "", m[3])
            if name in ("script", "style"):
                close = re.compile(f"</{name}[^>]*>", re.I).search(source, at)
                start = at = close.end() if close else size
            elif name not in VOID and not m[3].endswith("/"):
                open_now.append(node)
                opens[name] = opens.get(name, 0) + 1
        self._text(open_now[-1], source[start:])
        self._close(open_now, 0, opens)

    def _text(self, parent: int, piece: str) -> None:
        if piece and not piece.isspace():
            self._node(parent, "#text", piece, "")

    def _node(self, parent: int, tag: str, text: str, attributes: str) -> int:
        number = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        self.end.append(number + 1)
        good = bad = False
        tokens = 0
        if attributes and (found := _ATTRIBUTE.findall(attributes)):
            words = " ".join(x for group in found for x in group if x)
            good, bad = bool(_GOOD.search(words)), bool(_BAD.search(words))
            for token in set(_SPLIT.findall(words)):
                tokens |= 1 << crc32(token.lower().encode()) % TOKENS
        self.good.append(good)
        self.bad.append(bad)
        self.attrs.append(tokens)
        return number

    def _close(self, open_now: list[int], until: int, opens: dict[str, int]) -> None:
        for node in open_now[until:]:
            self.end[node] = len(self.tag)
            if node:
                opens[self.tag[node]] -= 1
        del open_now[until:]


_FOREIGN = re.compile(r"[^\x00-\x7f]")
FEATURES = ["tag", *(f"token_{i}" for i in range(TOKENS)), *"depth good bad good_above bad_above text words link_share elements density punctuation digits sibling siblings parent_share before after position is_text longest_below hidden".split()]


def _digits(text: str) -> int:
    """Digits of the whole text: those of ASCII by the bytes that go without them, others one by one."""
    data = text.encode(errors="replace")
    return len(data) - len(data.translate(None, b"0123456789")) + (0 if text.isascii() else sum(map(str.isdigit, _FOREIGN.findall(text))))


def features(doms: list[Dom]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node by feature, parent, end) of the nodes of all pages, numbered through; parents and ends too."""
    sizes = [len(d.tag) for d in doms]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = int(starts[-1])
    page = np.repeat(np.arange(len(doms)), sizes)
    parent = np.fromiter((p for d in doms for p in d.parent), np.int64, n) + starts[page]
    root = np.zeros(n, bool)
    root[starts[:-1]] = True
    parent[root] = starts[:-1]
    end = np.fromiter((e for d in doms for e in d.end), np.int64, n) + starts[page]
    tags = [t for d in doms for t in d.tag]
    texts = [t for d in doms for t in d.text]
    tag = np.fromiter((TAGS.get(t, 0) for t in tags), np.float32, n)
    is_text = tag == TAGS["#text"]
    own = np.fromiter(map(len, texts), np.int64, n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, n)
    marks = np.fromiter((t.count(",") + t.count(".") if t else 0 for t in texts), np.int64, n)
    digits = np.fromiter(map(_digits, texts), np.int64, n)
    hidden = np.fromiter((t in HIDDEN for t in tags), bool, n)
    link = np.fromiter((t == "a" for t in tags), bool, n)
    flags = [np.fromiter((x for d in doms for x in getattr(d, k)), np.int64, n) for k in ("good", "bad", "attrs")]

    def inherited(own_flag: np.ndarray) -> np.ndarray:
        """Whether the node or one above has the flag: intervals of subtrees, summed up."""
        edges = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(own_flag)
        np.add.at(edges, at, 1)
        np.add.at(edges, end[at], -1)
        return np.cumsum(edges[:-1]) > 0

    depth_edges = np.zeros(n + 1, np.int64)
    depth_edges[:-1] += 1
    np.add.at(depth_edges, end, -1)
    depth = np.cumsum(depth_edges[:-1])
    in_link, below_hidden = inherited(link), inherited(hidden)
    visible = np.where(below_hidden, 0, own)

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[end] - sums[:n]

    text, linked, marks, words, digits = (subtree(np.where(below_hidden, 0, v)) for v in (visible, np.where(in_link, visible, 0), marks, words, digits))
    elements = subtree((~is_text).astype(np.int64))
    order = np.lexsort((np.arange(n), parent))
    order = order[~root[order]]
    first = np.ones(len(order), bool)
    first[1:] = parent[order][1:] != parent[order][:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(order)))
    sibling, siblings, before, after = (np.zeros(n) for _ in range(4))
    if len(order):
        rank = np.arange(len(order)) - np.repeat(begin, count)
        sibling[order], siblings[order] = rank / np.repeat(np.maximum(count - 1, 1), count), np.repeat(count, count)
        t = text[order]
        before[order] = np.where(first, 0, np.concatenate(([0], t[:-1])))
        last = np.append(first[1:], True)
        after[order] = np.where(last, 0, np.concatenate((t[1:], [0])))
    running = np.cumsum(visible) - visible
    page_text = np.maximum(text[starts[:-1]], 1)
    longest = np.array([0] * n, np.int64)
    leaf = np.flatnonzero(is_text)
    np.maximum.at(longest, parent[leaf], visible[leaf])
    x = np.column_stack((
        tag, flags[2][:, None] >> np.arange(TOKENS) & 1, depth, flags[0], flags[1], inherited(flags[0] > 0), inherited(flags[1] > 0), np.log1p(text), np.log1p(words), linked / np.maximum(text, 1),
        np.log1p(elements), text / (elements + 1), marks / np.maximum(words, 1), digits / np.maximum(text, 1), sibling, np.log1p(siblings), text / np.maximum(text[parent], 1),
        np.log1p(before), np.log1p(after), (running - running[starts[:-1]][page]) / page_text[page], is_text, np.log1p(longest), below_hidden,
    )).astype(np.float32)
    return x, parent, end


class Boosted:
    """Logistic boosting of regression trees on binned features; trees are complete, in arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        quantiles = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [q.astype(np.float32) for q in quantiles]
        bins = self.binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(y), self.base)
        width = bins.shape[1]
        flat = bins.astype(np.int64) + np.arange(width) * BINS
        for _ in range(TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, threshold, value = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.uint8), np.zeros(2**DEPTH)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * LEAST_ROWS:
                        continue
                    cells = flat[rows].ravel()
                    gs, hs, ns = (np.bincount(cells, np.repeat(v[rows], width), width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h, np.ones(len(y))))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < LEAST_ROWS) | (nt - ns < LEAST_ROWS)] = -1
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[k], threshold[k] = divmod(best, BINS)
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > threshold[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((feature, threshold, value))
            score += value[leaf]
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, row = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[row, feature[node]] > threshold[node])
            out += value[node - (2**DEPTH - 1)]
        return out


def decode(scores: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The kept nodes: closed under parents, with the highest sum of scores. Roots are kept and count nothing."""
    gain, up = scores.tolist(), parent.tolist()
    for i in range(len(gain) - 1, -1, -1):
        if up[i] == i:
            gain[i] = 1.0
        elif gain[i] > 0:
            gain[up[i]] += gain[i]
    keep = [False] * len(gain)
    for i, p in enumerate(up):
        keep[i] = gain[i] > 0 and (p == i or keep[p])
    return np.array(keep, bool)


def _squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def labels(dom: Dom, gold: str) -> np.ndarray:
    """1 content, 0 not, -1 unknown for each node, given the page's main text."""
    gold, n = _squeezed(gold), len(dom.tag)
    out = np.full(n, -1)
    found = [-1] * n
    for i in range(n):
        if dom.tag[i] == "#text" and len(t := _squeezed(dom.text[i])) >= _LONG:
            found[i] = int(t in gold)
    content = [i for i in range(n) if found[i] == 1 and not _is_hidden(dom, i)]
    first, last = (content[0], content[-1]) if content else (n, -1)
    weight = np.zeros((n, 2))
    for i in range(n):
        if dom.tag[i] == "#text":
            inside = found[i] == 1 or found[i] < 0 and first < i < last and _squeezed(dom.text[i]) in gold
            out[i] = int(inside and not _is_hidden(dom, i))
            weight[i, out[i]] = len(dom.text[i])
    for i in range(n - 1, 0, -1):
        weight[dom.parent[i]] += weight[i]
        if out[i] < 0 and weight[i].any():
            # An element holds content if it holds a sizeable part of it, else dropping it would lose that.
            out[i] = int(weight[i, 1] >= 0.2 * weight[i].sum())
    return out


def _is_hidden(dom: Dom, i: int) -> bool:
    while i > 0:
        if dom.tag[i] in HIDDEN:
            return True
        i = dom.parent[i]
    return False


def train(pages: DataFrame, gold: DataFrame, id_col: str = "page_id", html_col: str = "html", gold_id_col: str = "page_id", gold_text_col: str = "text", sample: int = TRAINING_PAGES) -> Boosted:
    """A model fitted to the ``sample`` pages with a known main text whose ids have the smallest hashes."""
    known = gold.select(F.col(gold_id_col).alias("id"), F.col(gold_text_col).alias("gold")).where("id is not null and gold is not null")
    some = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where("id is not null and html is not null")
    rows = some.join(known, "id").orderBy(F.xxhash64("id"), "id", "html", "gold").limit(sample).collect()
    doms = [Dom(r["html"]) for r in rows]
    if not doms:
        return Boosted().fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x, _, _ = features(doms)
    y = np.concatenate([labels(d, r["gold"]) for d, r in zip(doms, rows, strict=True)])
    return Boosted().fit(x[y >= 0], y[y >= 0].astype(float))


def text_of(dom: Dom, keep: np.ndarray) -> str:
    """The kept text, a line for each block."""
    lines, line = [], []
    for i, tag in enumerate(dom.tag):
        if tag in BLOCK and line:
            lines.append(_squeezed(" ".join(line)))
            line = []
        if tag == "#text" and keep[i]:
            line.append(dom.text[i])
    return "\n".join(x for x in [*lines, _squeezed(" ".join(line))] if x)


def _extracting(model: Boosted, pages_at_once: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources = column(batch, "page_id"), column(batch, "html")
            for a in range(0, batch.num_rows, pages_at_once):
                z = min(batch.num_rows, a + pages_at_once)
                doms = [Dom(s or "") for s in sources[a:z].to_pylist()]
                x, parent, _ = features(doms)
                scores = model.scores(x)
                scores[x[:, -1] > 0] = -1e9  # what is not shown is no content
                keep = decode(scores, parent)
                texts, kept, nodes, at = [], [], [], 0
                for dom, source in zip(doms, sources[a:z], strict=True):
                    own = keep[at : at + len(dom.tag)]
                    at += len(dom.tag)
                    texts.append(text_of(dom, own) if source.is_valid else None)
                    kept.append(int(own[1:].sum()))
                    nodes.append(len(own) - 1)
                yield pa.RecordBatch.from_arrays([ids[a:z], pa.array(texts, pa.string()), pa.array(nodes, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "text", "nodes", "kept"])

    return released(run)


def extracted(pages: DataFrame, model: Boosted, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, nodes, kept) for every row, repeated and null ids included.

    A null page gives a null text, an empty one or one without visible text an empty text.  Very long pages are parsed
    whole, in linear time.  Unclosed and stray tags are put up with; of nodes with equal scores all are treated alike.
    Entities are resolved and white space is squeezed.  A model without training pages keeps
    nothing.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(_extracting(model), f"page_id {kind}, text string, nodes int, kept int")


def gold_of(pages: DataFrame, documents: DataFrame, sample: int = TRAINING_PAGES) -> DataFrame:
    """(page_id, text): the document that a page shows, whose id is the last number in the URL's path, for the pages of the sample."""
    number = F.try_to_number(F.regexp_extract("url", r"^[^?#]*/(\d+)[^/?#]*/?(?:[?#].*)?$", 1), F.lit("9" * 18)).cast("long")
    some = pages.where("html is not null").select("page_id", number.alias("doc_id")).where("doc_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(2 * sample).collect()
    wanted = documents.where(F.col("doc_id").isin(sorted({r["doc_id"] for r in some}))).select("doc_id", "text") if some else documents.limit(0).select("doc_id", "text")
    links = pages.sparkSession.createDataFrame([(r["page_id"], r["doc_id"]) for r in some], "page_id long, doc_id long")
    return links.join(wanted, "doc_id").select("page_id", "text")

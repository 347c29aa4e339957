"""HTML extraction: gradient-boosted trees over DOM nodes.

Nodes are a page's block elements. A node's features are its subtree's text, link and tag density, its shares of the page
and the parent, its depth, place and neighbours among its siblings, its kind of element and that of its ancestors, and words
of class, id and role attributes, its own and its ancestors'. Boosted trees give each node log-odds that it holds main text.

Decoding is hierarchical: a node can be kept only if its ancestors are, and a node without text of its own only if something in
it is. Of all such choices the one with the largest sum of log-odds is taken, by one pass from the leaves up and one down. So
no kept block stands in a dropped one, no kept container is empty, and a container is kept just if it and what it holds
are worth it together.

No table has labelled pages. The trees are fitted on pages that are generated here with labels, from a seed: `pages` of them,
with menus, mastheads, sidebars, notices, adverts, forms, related links, reader comments and footers, with and without
telling element names and attributes, with articles of all sizes. Their words are random letters, so no language is learned.

Text: character references are decoded, white space inside a block becomes one space, blocks stand in page order with an
empty line between them. Every kept node's text is taken whole.

Defined results: null and empty pages, and pages without main text, give an empty text. Markup that the page's end cuts off
is dropped. Repeated rows are rows of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.dom import GROUPS, TOKENS, Page, blocks_of, parse


def subtree_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[end] - total[start]


def node_features(pages: list[Page]) -> np.ndarray:
    """A row for each node of the pages, in order."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)

    def gathered(name: str) -> np.ndarray:
        return np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, int(sizes.sum()))

    here = np.arange(len(base))
    parent, end = gathered("parent"), gathered("end") + base
    parent = np.where(parent < 0, here, parent + base)
    own, links, tags, marks, group, depth = (gathered(n) for n in ("own", "links", "tags", "sentence_marks", "group", "depth"))
    text, linked, inside, said = (subtree_sums(x, here, end).astype(float) for x in (own, links, tags, marks))
    whole = text[base]
    before = np.concatenate(([0], np.cumsum(own)))[here] - np.concatenate(([0], np.cumsum(own)))[base]
    kinds = [subtree_sums(own * (group == g), here, end) for g in (8, 9, 10)]  # list items, paragraphs, headings
    # Place among siblings: the order of nodes by parent.
    order = np.lexsort((here, parent))
    first = np.concatenate(([True], parent[order][1:] != parent[order][:-1]))
    index = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    place = np.empty(len(order), np.int64)
    place[order] = index
    children = np.bincount(parent[here != base], minlength=len(base))
    last = np.concatenate((first[1:], [True]))
    previous, following = np.full(len(base), -1), np.full(len(base), -1)
    previous[order[1:]] = np.where(first[1:], -1, order[:-1])
    following[order[:-1]] = np.where(last[:-1], -1, order[1:])
    density = linked / np.maximum(text, 1)
    side = lambda x, at: np.where(at >= 0, x[np.maximum(at, 0)], -1.0)
    log = np.log1p(text)
    ancestors = np.zeros(len(base), np.int64)
    for g in (3, 4, 5, 6, 12, 0):  # what encloses the node: elements whose names tell something
        spans = np.zeros(len(base) + 1, np.int64)
        np.add.at(spans, here[group == g] + 1, 1)
        np.add.at(spans, end[group == g], -1)
        ancestors = ancestors * 2 + (np.cumsum(spans)[:-1] > 0)
    own_marks, above_marks = gathered("marks"), gathered("ancestor_marks")
    columns = [
        log, density, np.log1p(text / (1 + inside)), depth, children, place, children[parent], before / np.maximum(whole, 1), text / np.maximum(whole, 1), text / np.maximum(text[parent], 1),
        *(k / np.maximum(text, 1) for k in kinds), said / np.maximum(text, 1) * 100, np.log1p(own), side(log, previous), side(log, following), side(density, previous), side(density, following),
        np.log1p(text / np.maximum(1, children)), density[parent], side(said / np.maximum(text, 1) * 100, previous), group[parent],
        *((group == g) for g in range(len(GROUPS))), *(ancestors >> k & 1 for k in range(6)), *(own_marks >> k & 1 for k in range(len(TOKENS))), *(above_marks >> k & 1 for k in range(len(TOKENS))),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


class BoostedTrees:
    """Trees of fixed depth on binned features, fitted to the gradient of the logistic loss, each on half the rows and a third of the
    features. A tree is arrays by node, in level order."""

    def __init__(self, trees: int = 120, depth: int = 5, bins: int = 24, rate: float = 0.15, seed: int = 3):
        self.trees, self.depth, self.bins, self.rate, self.seed = trees, depth, bins, rate, seed
        self.base = 0.0
        self.feature, self.cut, self.value = (np.zeros((0, 0)) for _ in range(3))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, wide = x.shape
        rng = np.random.default_rng(self.seed)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(wide)]
        binned = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        inner = (1 << self.depth) - 1
        self.feature, self.cut = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf, np.float32)
        self.value = np.zeros((self.trees, 1 << self.depth))
        raw = np.full(n, self.base)
        some = max(1, wide // 3)
        for t in range(self.trees):
            rows, columns = rng.permutation(n)[: -(-n // 2)], np.sort(rng.permutation(wide)[:some])
            own = x[rows]
            p = 1 / (1 + np.exp(-raw[rows]))
            g, h = y[rows] - p, p * (1 - p)
            flat = (binned[rows][:, columns] + np.arange(some) * self.bins).ravel()
            many_g, many_h = np.repeat(g, some), np.repeat(h, some)
            at = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                width = 1 << level
                key = np.repeat(at * some * self.bins, some) + flat
                sg, sh = (np.bincount(key, w, width * some * self.bins).reshape(width, some, self.bins).cumsum(axis=2) for w in (many_g, many_h))
                tg, th = sg[:, :1, -1:], sh[:, :1, -1:]
                won = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                won[:, :, -1] = 0
                best = won.reshape(width, -1).argmax(axis=1)
                gains = won.reshape(width, -1)[np.arange(width), best]
                feature, b = columns[best // self.bins], best % self.bins
                for k in range(width):
                    if gains[k] > 1e-3 and b[k] < len(edges[feature[k]]):
                        self.feature[t, width - 1 + k], self.cut[t, width - 1 + k] = feature[k], edges[feature[k]][b[k]]
                at = 2 * at + (own[np.arange(len(rows)), self.feature[t, width - 1 + at]] >= self.cut[t, width - 1 + at])
            leaf_g, leaf_h = (np.bincount(at, w, 1 << self.depth) for w in (g, h))
            self.value[t] = self.rate * leaf_g / (leaf_h + 1)
            raw += self._tree(x, t)
        return self

    def _tree(self, x: np.ndarray, t: int) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(self.depth):
            k = (1 << level) - 1 + at
            at = 2 * at + (x[rows, self.feature[t, k]] >= self.cut[t, k])
        return self.value[t][at]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._tree(x, t) for t in range(self.trees))


class PageMaker:
    """Generated pages; each block element has data-kind 1 if it is or holds main text, else 0."""

    def __init__(self, seed: int):
        self.r = Random(seed)
        self.block = "p"  # what paragraphs of this page are made of
        self.told = 0.65  # how often attributes tell what an element is

    def words(self, low: int, high: int) -> str:
        r, out, n = self.r, [], self.r.randint(low, high)
        for i in range(n):
            word = "".join(r.choice("abcdefghilmnoprstuvwé") for _ in range(min(14, 1 + int(r.expovariate(0.22)))))
            out.append(word + ("." if r.random() < 0.08 or i == n - 1 and n > 4 else "," if r.random() < 0.06 else ""))
        return " ".join(out)

    def tag(self, kind: int, names: list[str], body: str, tokens: list[str] | None = None) -> str:
        name = self.r.choice(names)
        told = tokens and self.r.random() < self.told
        attributes = f' {self.r.choice(["class", "id"])}="{self.r.choice(tokens)}{self.r.choice(["", "-1", " box", "_w"])}"' if told else ""
        return f'<{name} data-kind="{kind}"{attributes}>{body}</{name}>'

    def link_list(self, low: int, high: int) -> str:
        items = [f'<li data-kind="0"><a href="/x">{self.words(1, 4)}</a></li>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.2:
            return " | ".join(f'<a href="/y">{self.words(1, 3)}</a>' for _ in items)
        return f'<ul data-kind="0">{"".join(items)}</ul>'

    def menu(self) -> str:
        return self.tag(0, ["nav", "nav", "div", "ul"], self.link_list(2, 12), ["nav", "menu", "navigation", "breadcrumb", "topnav", "navbar", "main-menu"])

    def masthead(self) -> str:
        return self.tag(0, ["header", "div"], f'<div data-kind="0">{self.words(1, 6)}</div>' + (self.menu() if self.r.random() < 0.5 else ""), ["header", "masthead", "topbar", "logo"])

    def advert(self) -> str:
        body = self.words(3, 40) if self.r.random() < 0.8 else f'<a href="/buy">{self.words(2, 8)}</a>'
        return self.tag(0, ["div", "div", "aside", "section"], body if self.r.random() < 0.7 else f'<p data-kind="0">{body}</p>', ["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-box", "advertisement-top"])

    def notice(self) -> str:
        return self.tag(0, ["div", "section", "dialog"], f'<p data-kind="0">{self.words(5, 40)}</p><a href="#">{self.words(1, 2)}</a>', ["cookie", "notice", "consent", "popup", "alert"])

    def form(self) -> str:
        return self.tag(0, ["form", "form", "div"], f'<p data-kind="0">{self.words(2, 15)}</p><input name="q"><label>{self.words(1, 3)}</label>', ["newsletter", "subscribe", "search", "signup", "login"])

    def sidebar(self) -> str:
        parts = "".join(self.r.choice([self.advert, self.form, lambda: self.link_list(2, 8), lambda: f'<p data-kind="0">{self.words(4, 40)}</p>'])() for _ in range(self.r.randint(1, 4)))
        return self.tag(0, ["aside", "aside", "div"], f'<h3 data-kind="0">{self.words(1, 3)}</h3>' + parts, ["sidebar", "widget", "rail", "side"])

    def related(self) -> str:
        return self.tag(0, ["div", "section", "aside"], f'<h3 data-kind="0">{self.words(1, 3)}</h3>' + self.link_list(2, 8), ["related", "recommended", "share", "social", "popular", "related-posts", "sharebar"])

    def comments(self) -> str:
        said = lambda: f'<p data-kind="0">{self.words(3, 70)}</p>' if self.r.random() < 0.7 else self.words(3, 70)
        by = lambda: f'<div data-kind="0">{self.words(1, 3)}</div>' if self.r.random() < 0.7 else ""
        each = lambda: self.tag(0, ["div", "li", "article"], by() + said(), ["comment", "reply", "comment-body"])
        body = (f'<h2 data-kind="0">{self.words(1, 2)}</h2>' if self.r.random() < 0.7 else "") + "".join(each() for _ in range(self.r.randint(1, 6)))
        name = self.r.choice(["section", "div", "div", "ol", "ul"])
        return f'<{name} data-kind="0" {self.r.choice(["id", "class"])}="{self.r.choice(["comments", "comment-list", "commentlist", "discussion", "respond", "replies", "reader-comments"])}">{body}</{name}>'

    def footer(self) -> str:
        body = f"&copy; {self.words(1, 3)} &middot; {self.words(2, 25)}"
        return self.tag(0, ["footer", "footer", "footer", "div"], body if self.r.random() < 0.6 else f'<p data-kind="0">{body}</p>' + self.link_list(2, 8), ["footer", "copyright", "legal", "foot"])

    def paragraph(self) -> str:
        r = self.r
        text = self.words(3, 12) if r.random() < 0.2 else self.words(10, r.choice([35, 70, 160]))
        if r.random() < 0.15:
            text = text.replace(" ", f' <a href="/r">{self.words(1, 3)}</a> ', 1)
        if r.random() < 0.2 and self.block == "p":
            return f'<p data-kind="1"><b>{text}<br>'  # never ended
        return f'<{self.block} data-kind="1">{text}</{self.block}>'

    def article(self) -> str:
        r = self.r
        parts = [f'<h1 data-kind="1">{self.words(1, 12)}</h1>'] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            parts.append(self.paragraph())
            if r.random() < 0.12:
                parts.append(f'<h2 data-kind="1">{self.words(2, 7)}</h2>')
            if r.random() < 0.08:
                parts.append('<ul data-kind="1">' + "".join(f'<li data-kind="1">{self.words(3, 25)}</li>' for _ in range(r.randint(2, 6))) + "</ul>")
            if r.random() < 0.06:
                parts.append(f'<blockquote data-kind="1">{self.words(8, 50)}</blockquote>')
            if r.random() < 0.05:
                parts.append(f'<pre data-kind="1">{self.words(1, 30)}</pre>')
            if r.random() < 0.05:
                parts.append('<table data-kind="1">' + "".join(f'<tr data-kind="1"><td data-kind="1">{self.words(1, 3)}</td><td data-kind="1">{self.words(1, 3)}</td></tr>' for _ in range(r.randint(2, 5))) + "</table>")
            if r.random() < 0.15:
                self.told = 1.0 if self.block == "div" else 0.65  # else nothing would tell them from the paragraphs
                parts.append(r.choice([self.advert, self.related, self.form, self.notice])())
                self.told = 0.65
        if len(parts) > 3 and r.random() < 0.25:  # some parts in a box of their own
            k = r.randint(1, len(parts) - 2)
            parts[k:] = [f'<{(name := r.choice(["div", "section"]))} data-kind="1">{"".join(parts[k:])}</{name}>']
        body = "".join(parts)
        if self.block == "div" or r.random() < 0.3:
            return self.tag(1, ["div", "div", "section"], body, ["article", "content", "post", "entry", "story", "main", "entry-content", "post-body", "article-text"])
        return self.tag(1, ["article", "article", "article", "main"], body, ["article", "content", "post", "entry", "story", "main"])

    def page(self) -> str:
        r = self.r
        self.block = "div" if r.random() < 0.35 else "p"
        maybe = lambda make, p: make() if r.random() < p else ""
        top = maybe(self.notice, 0.2) + maybe(self.masthead, 0.35) + maybe(self.menu, 0.75) + maybe(self.advert, 0.5)
        middle = maybe(self.sidebar, 0.2) + (self.article() if r.random() < 0.97 else "") + maybe(self.related, 0.2) + maybe(self.comments, 0.25) + maybe(self.sidebar, 0.2) + maybe(self.advert, 0.15) + maybe(self.form, 0.15)
        if r.random() < 0.4:
            middle = f'<div{r.choice([" class=wrap", " id=page", "", " class=container"])}>{middle}</div>'
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{top}{middle}{maybe(self.footer, 0.85)}{maybe(self.notice, 0.1)}</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.08 else page


def node_labels(page: Page) -> np.ndarray:
    """1 for nodes that are or hold main text; nodes without a mark hold it if something in them does."""
    kind = page.kind[:]
    for i in range(len(kind) - 1, -1, -1):
        if kind[i] < 0:
            kind[i] = int(any(kind[j] == 1 for j in range(i + 1, page.end[i])))
    return np.array(kind, float)


@lru_cache(maxsize=4)
def fitted(pages: int = 2500, seed: int = 7) -> BoostedTrees:
    maker = PageMaker(seed)
    parsed = [parse(maker.page()) for _ in range(pages)]
    return BoostedTrees().fit(node_features(parsed), np.concatenate([node_labels(p) for p in parsed]))


def choose(page: Page, odds: list[float]) -> list[bool]:
    """The best choice of nodes in which each kept node's parent is kept, and each kept node has text or a kept node in it."""
    parent = page.parent
    n = len(parent)
    worth = [max(-4.0, min(4.0, x)) for x in odds]
    best: list[tuple[float, int]] = [(-1e9, -1)] * n  # the best child, for a node that has no text and no child worth keeping
    gain = [0.0] * n
    for i in range(n - 1, 0, -1):
        if gain[i] > 0 or page.own[i]:
            worth[i] += gain[i]
        else:
            worth[i] += best[i][0]
        above = parent[i]
        if worth[i] > 0:
            gain[above] += worth[i]
        if worth[i] > best[above][0]:
            best[above] = (worth[i], i)
    kept = [True] * n  # the page itself holds whatever is kept
    forced = [False] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and (worth[i] > 0 or forced[i])
        if kept[i] and not gain[i] > 0 and not page.own[i]:
            forced[best[i][1]] = True
    return kept


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    out = []
    for at in range(0, len(pages), 256):
        parsed = [parse(p) for p in pages[at : at + 256]]
        odds = model.log_odds(node_features(parsed)).tolist()
        k = 0
        for p in parsed:
            n = len(p.parent)
            out.append(blocks_of(p, choose(p, odds[k : k + n])))
            k += n
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, training_pages: int = 2500) -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars."""
    model = fitted(training_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = main_texts([x or "" for x in some.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    found = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {id_type}, url {url_type}, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})

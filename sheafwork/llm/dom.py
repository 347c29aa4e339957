"""Block elements of HTML pages as flat arrays in page order, and their texts."""

from __future__ import annotations

import html
import re
from collections import Counter

#: One tag, comment or declaration; also one that the page's end cuts off.
MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))""", re.S)
TOKEN = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
LABEL = re.compile(r'data-kind="([01])"')
WORD = re.compile(r"[a-z]+")

# The HTML elements of each kind.
GROUPS = [
    {"article", "main"}, {"section"}, {"div", "center", "body", "html"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer", "address"}, {"aside"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"form", "fieldset", "dialog", "legend"}, {"blockquote", "pre", "figure", "figcaption", "details", "summary"},
]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "title", "textarea", "select", "button", "object", "canvas", "math", "datalist", "head"}
# An element that is open is ended by the start of one of these, if no element that is a border to it stands between them.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
# Words of class, id and role attributes by what they tell.
TOKENS = [
    {"article", "content", "post", "entry", "story", "main", "body", "text", "page"}, {"comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "reader"},
    {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "dfp"}, {"nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "tabs", "pagination", "pager", "toc"},
    {"sidebar", "side", "aside", "widget", "widgets", "rail"}, {"footer", "foot", "copyright", "legal", "colophon", "contentinfo"}, {"header", "head", "masthead", "logo", "branding", "topbar"},
    {"cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message"}, {"form", "search", "newsletter", "subscribe", "signup", "login", "contact"},
    {"related", "share", "social", "recommended", "popular", "meta", "tags", "byline", "author", "trending", "more"},
]

SCOPES = {"ul", "ol", "dl", "table", "tbody", "tfoot", "div", "article", "section"}
BORDERS = {"li": SCOPES | {"tr", "td", "th"}, "td": SCOPES | {"tr"}, "tr": SCOPES, "tbody": SCOPES, "tfoot": SCOPES}
BORDERS |= {"dt": BORDERS["li"], "dd": BORDERS["li"], "th": BORDERS["td"]}

BLOCK = {name: g for g, names in enumerate(GROUPS) for name in names}
ENDS_P = set(BLOCK) | {"hr"}
KNOWN_TOKEN = {word: 1 << i for i, words in enumerate(TOKENS) for word in words}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in UNSEEN}


class Page:
    """Nodes are block elements; node 0 is the page. Each list has an entry for each node, except for the texts."""

    __slots__ = ("ancestor_marks", "depth", "end", "group", "kind", "links", "marks", "own", "parent", "sentence_marks", "tags", "texts")

    def __init__(self) -> None:
        self.parent, self.end, self.depth, self.group = [-1], [1], [0], [2]
        self.own, self.links, self.tags, self.sentence_marks = [0], [0], [0], [0]
        self.marks, self.ancestor_marks, self.kind = [0], [0], [-1]
        self.texts: list[tuple[int, bool, str]] = []  # node, whether a block begins, text


MARKS: dict[str, int] = {}  # of words met


def word_marks(word: str) -> int:
    """Marks of a word, or of known words of four letters or more that it begins or ends with."""
    found = MARKS.get(word, KNOWN_TOKEN.get(word))
    if found is None:
        found = 0
        for known, mark in KNOWN_TOKEN.items():
            if (len(known) >= 4 or known == "nav") and (word.startswith(known) or word.endswith(known)):
                found |= mark
        if len(MARKS) < 4096:
            MARKS[word] = found
    return found


def attribute_marks(attributes: str) -> int:
    found = 0
    for m in TOKEN.finditer(attributes):
        for word in WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            found |= word_marks(word)
    return found


def parse(page: str) -> Page:
    out = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their node, for inline ones the node they stand in
    blocks = [0]  # places of the open blocks in the stack
    scopes: list[int] = []  # those of them that end others or can be ended
    open_blocks: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # for each open block the inline elements that are open in it, but not in a block in it
    at, size, fresh, in_link = 0, len(page), True, 0
    search = MARKUP.search

    def text(raw: str) -> None:
        nonlocal fresh
        if not raw or raw.isspace():
            if raw and out.texts and not fresh:
                out.texts.append((stack[-1][1], False, " "))
            return
        if "&" in raw:
            raw = html.unescape(raw)
        node = stack[-1][1]
        n = len(raw)
        out.own[node] += n
        if in_link:
            out.links[node] += n
        out.sentence_marks[node] += raw.count(".") + raw.count(",") + raw.count("!") + raw.count("?")
        out.texts.append((node, fresh, raw))
        fresh = False

    def close(k: int) -> None:
        """End the elements from place k of the stack."""
        nonlocal fresh, in_link
        last = len(out.parent)
        for name, node in stack[k:]:
            if name in BLOCK:
                out.end[node] = last
                open_blocks[name] -= 1
                fresh = True
            elif name == "a":
                in_link -= 1
        while blocks[-1] >= k:
            blocks.pop()
            inline.pop()
        while scopes and scopes[-1] >= k:
            scopes.pop()
        for name, _ in stack[max(k, blocks[-1] + 1) :]:
            inline[-1][name] -= 1
        del stack[k:]

    def innermost(name: str) -> int:
        """Place of the last open element of that name, which there is: the elements after it are closed with it."""
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)

    while at < size:
        m = search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:  # an inline end tag doesn't end a block
            if open_blocks[name] if name in BLOCK else inline[-1][name]:
                close(innermost(name))
            continue
        if name in UNSEEN and name != "head":
            if not m[3].endswith("/"):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else size
            continue
        out.tags[stack[-1][1]] += 1
        if name in VOID:
            if name == "br":
                out.texts.append((stack[-1][1], False, "\n"))
            elif name == "hr":
                fresh = True
            continue
        if name in ENDS_P and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if name == "a" and inline[-1]["a"]:
            close(innermost("a"))
        if name in BORDERS:
            for k in reversed(scopes):
                open_name = stack[k][0]
                if name in ENDED_BY.get(open_name, ()):
                    close(k)
                    break
                if open_name in BORDERS[name]:
                    break
        if m[3].endswith("/") and name not in BLOCK:
            continue
        if name in BLOCK:
            above = stack[-1][1]
            node = len(out.parent)
            marks = attribute_marks(m[3]) if "=" in m[3] else 0
            out.parent.append(above)
            out.end.append(-1)
            out.depth.append(out.depth[above] + 1)
            out.group.append(BLOCK[name])
            for own in (out.own, out.links, out.tags, out.sentence_marks):
                own.append(0)
            out.marks.append(marks)
            out.ancestor_marks.append(out.ancestor_marks[above] | out.marks[above])
            label = LABEL.search(m[3]) if "data-kind" in m[3] else None
            out.kind.append(int(label[1]) if label else -1)
            blocks.append(len(stack))
            inline.append(Counter())
            open_blocks[name] += 1
            if name in SCOPES or name in ENDED_BY:
                scopes.append(len(stack))
            stack.append((name, node))
            fresh = True
        else:
            if name == "a":
                in_link += 1
            inline[-1][name] += 1
            stack.append((name, stack[-1][1]))
    close(1)
    out.end[0] = len(out.parent)
    return out


def blocks_of(page: Page, kept: list[bool]) -> str:
    """Texts of the kept nodes, a paragraph for each block."""
    blocks: list[list[str]] = []
    last = None
    for node, fresh, raw in page.texts:
        if not kept[node]:
            last = None
            continue
        if fresh or last != node or not blocks:
            blocks.append([])
        blocks[-1].append(raw)
        last = node
    return "\n\n".join(x for b in blocks if (x := " ".join("".join(b).split())))

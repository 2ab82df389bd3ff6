"""Main text of web pages by tag path ratios.

A page is cut into text nodes, each with its path of tags from the root. Text
length and punctuation are added up per path and divided by the path's nodes;
both ratios are smoothed over the page in order, multiplied, and paths whose
fused ratio reaches a share of its spread hold content. The smallest container
with all of that content and all headings is the article (an ``article``,
``main`` or ``body`` needs nearly all of the content); its blocks are the text,
except what markup names as something else (menus, adverts, comments ...). A
name is a hint only: it has to stand for the whole class, id or role, and what
holds an article or nearly all of the text stays whatever its name, as do
headings and paragraphs.

Defined cases: null and empty pages give an empty text; pages cut short keep
what there is; unknown and unclosed tags are allowed; a page without any
container is read from its body; repeated rows are treated alike.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

# A tag with quoted attributes, a comment or declaration, or a tag cut short.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…¿¡]")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINER = {"article", "main", "section", "div", "body", "td", "html", "center"}
#: Elements and the words in class, id or role that never hold the article.
DROP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu", "head", "fieldset"}
DROP_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
              "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "menu", "nav", "navbar", "navigation",
              "breadcrumb", "breadcrumbs", "sidebar", "widget", "related", "recommended", "share", "sharing", "social", "comment", "comments", "respond", "reply",
              "replies", "disqus", "footer", "masthead", "toolbar", "pagination", "pager", "contentinfo", "complementary", "search", "login", "signup", "skip", "hidden"}
#: Words that may stand beside those in one name, as in site-footer or ad-box-2.
BESIDE = {"list", "box", "block", "wrapper", "wrap", "container", "area", "section", "item", "items", "post", "posts", "article", "articles", "link", "links",
          "bar", "site", "page", "left", "right", "top", "bottom", "main", "primary", "secondary", "form", "slot", "unit", "button", "buttons", "icons", "group", "panel",
          "header", "inner", "outer", "global", "content", "stories", "thread", "media"}
#: Elements whose names mean nothing, and those whose ids are places to jump to.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_TAGS = HEADINGS | {"p", "blockquote", "pre"}
_ANCHORED = INLINE | {"section", "figure", "table", "li", "dt", "dd", "header"}
#: Share of all text from which a name is not believed, without an article outside and within one.
MOST, NEARLY_ALL = 0.5, 0.9
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "td"}
KEEP_SHARE = 0.9
SPREAD_SHARE = 0.3


class _Node:
    """An element. What its ancestors say is copied down, so nothing walks up."""

    __slots__ = ("article", "block", "drop", "hint", "holder", "order", "parent", "path", "tag")

    def __init__(self, tag: str, parent: _Node | None, page: _Page, drop: bool = False, hint: bool = False):
        self.tag, self.parent, self.drop, self.hint = tag, parent, drop, hint
        # A path is known by its parent's number and its last tag.
        self.path = page.paths.setdefault((-1 if parent is None else parent.path, tag), len(page.paths))
        self.article = tag == "article" or parent is not None and parent.article
        #: The closest article or main part about it, itself included.
        self.holder = self if tag in ("article", "main") else None if parent is None else parent.holder
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.order = len(page.nodes)
        page.nodes.append(self)


class _Page:
    """Elements in page order, parents first, and numbers of tag paths."""

    def __init__(self):
        self.nodes: list[_Node] = []
        self.paths: dict[tuple[int, str], int] = {}

    def added_up(self, own: list) -> list:
        """Sums over each element and all inside it."""
        out = list(own)
        for x in reversed(self.nodes):
            if x.parent is not None:
                out[x.parent.order] += out[x.order]
        return out


def _dropped(tag: str, attrs: str, parent: _Node) -> bool:
    if parent.drop or tag in DROP_TAGS:
        return True
    if tag == "header":
        # A header inside an article holds its title.
        return not parent.article
    if not attrs or tag in ("article", "main", "body", "html"):
        return False
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", attrs))


def _named(tag: str, attrs: str) -> bool:
    """Whether a class, id or role as a whole names something else than the article."""
    if not attrs or tag in TEXT_TAGS or tag in ("article", "main", "body", "html"):
        return False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        if key not in ("class", "id", "role") or key == "id" and tag in _ANCHORED:
            continue
        for name in " ".join(v for v in m.groups()[1:] if v).split():
            parts = set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            if parts & DROP_NAMES and parts <= DROP_NAMES | BESIDE:
                return True
    return False


def _unbelieved(page: _Page, parts: list[tuple[str, _Node]]) -> set[_Node]:
    """Elements with a name that hold too much to be what it says."""
    inside, articles = [0] * len(page.nodes), [0] * len(page.nodes)
    for t, node in parts:
        n = len("".join(t.split()))
        inside[node.order] += n
        articles[node.order] += n * (node.holder is not None)
    total, in_articles = sum(inside), sum(articles)
    inside, articles = page.added_up(inside), page.added_up(articles)
    out = set()
    for x in page.nodes:
        k = x.order
        if not x.hint or not inside[k]:
            continue
        holder = x.parent.holder
        if holder is not None:
            believed = inside[k] < NEARLY_ALL * inside[holder.order]
        elif articles[k]:
            # Teasers in a sidebar are articles too, but not most of them.
            believed = 2 * articles[k] < in_articles
        else:
            believed = in_articles > 0 or inside[k] < MOST * total
        if not believed:
            out.add(x)
    return out


def blocks(text: str) -> tuple[_Page, list[tuple[str, _Node]]]:
    """The page's elements, and blocks of text with the element that holds each."""
    page, raw, parts, at = _Page(), [], [], 0
    node = _Node("html", None, page)
    # Open elements by tag: an end tag of none that is open is passed over.
    opened: dict[str, int] = defaultdict(int)

    def close_block() -> None:
        nonlocal parts
        if parts:
            raw.append(parts)
        parts = []

    def add(part: str) -> None:
        if part and not node.drop:
            parts.append((part, node))

    def leave(last: _Node) -> None:
        nonlocal node
        while node is not last.parent:
            opened[node.tag] -= 1
            node = node.parent

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attrs = m[3] if m[2] else m[6]
        if tag not in INLINE:
            close_block()
        if m[1] or m[4]:
            x = node if opened[tag] else None
            while x is not None and x.tag != tag:
                # An end tag of an inline element never closes a block.
                x = None if tag in INLINE and x.tag not in INLINE else x.parent
            if x is not None and x.parent is not None:
                leave(x)
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag == "html":
            continue
        ends = CLOSES.get(tag, () if tag in INLINE else {"p"})
        x = node if any(opened[e] for e in ends) else None
        while x is not None and x.tag not in ends:
            x = None if x.tag in _SCOPE else x.parent
        if x is not None and x.parent is not None:
            leave(x)
        node = _Node(tag, node, page, _dropped(tag, attrs, node), _named(tag, attrs))
        opened[tag] += 1
    close_block()
    kept = _unbelieved(page, [x for block in raw for x in block])
    gone: list[bool] = []
    for x in page.nodes:
        gone.append(x.hint and x not in kept or x.parent is not None and gone[x.parent.order])
    out = []
    for block in raw:
        stays = [(part, x) for part, x in block if not gone[x.order]]
        joined = " ".join(entities.unescape("".join(part for part, _ in stays)).split())
        if joined:
            out.append((joined, stays[0][1].block))
    return page, out


def _smooth(x: np.ndarray, radius: int = 2) -> np.ndarray:
    if len(x) < 2:
        return x
    k = np.exp(-np.square(np.arange(-radius, radius + 1)) / 2.0)
    padded = np.pad(x, radius, mode="edge")
    return np.convolve(padded, k / k.sum(), mode="valid")


def main_text(text: str | None) -> str:
    """Blocks of the article, two line ends between them."""
    page, found = blocks(text or "")
    if not found:
        return ""
    paths = [h.path for _, h in found]
    length, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for (t, _), p in zip(found, paths, strict=True):
        length[p] += len(t)
        marks[p] += len(_PUNCTUATION.findall(t))
        nodes[p] += 1
    fused = _smooth(np.array([length[p] / nodes[p] for p in paths])) * _smooth(np.array([marks[p] / nodes[p] for p in paths]))
    limit = SPREAD_SHARE * float(fused.std())
    content = {p for p, f in zip(paths, fused.tolist(), strict=True) if f >= limit}
    # Characters of content in each element, and blocks that have to stay:
    # content and headings. The article holds all of these.
    chars, stays = [0] * len(page.nodes), [0] * len(page.nodes)
    for (t, h), p in zip(found, paths, strict=True):
        chars[h.order] += len(t) * (p in content)
        stays[h.order] += p in content or h.tag in HEADINGS
    chars, stays = page.added_up(chars), page.added_up(stays)
    inside = defaultdict(list)
    for x in page.nodes:
        if x.parent is not None and x.tag in CONTAINER:
            inside[x.parent].append(x)
    root = page.nodes[0]
    while root.tag != "article":
        # An article is taken at its word; beside any other container nothing may be lost.
        below = [x for x in inside[root] if chars[x.order] >= KEEP_SHARE * chars[0] and (x.tag in ("article", "main", "body") or stays[x.order] == stays[root.order])]
        if not below:
            break
        root = below[0]
    under: list[bool] = []
    for x in page.nodes:
        under.append(x is root or x.parent is not None and under[x.parent.order])
    return "\n\n".join(t for t, h in found if under[h.order])


ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _extract(pages: pa.Array) -> list:
    texts = [main_text(p) for p in pages.to_pylist()]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``_row`` with the kept columns, ``_new`` with text and n_chars."""
    return map_texts(pages, [html], [c for c in pages.columns if c != html] if keep is None else keep, _extract, ADDED)

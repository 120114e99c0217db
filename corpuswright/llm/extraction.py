"""Main text of web pages by composite text density.

Every DOM node has characters C, link characters LC, tags T and link tags LT
below it.  Its composite density (Sun, Song and Liao, 2011) is C/T, scaled by
a logarithm that falls with the share of links.  The node with the largest sum
of its children's densities roots the main text, or the article around it; the smallest density on its
path to the body is the threshold below which parts made of links are cut.
Densities alone tell prose from links, but not an article from other prose: so
no root is sought within parts that their elements, or the words of their class and id, mark as
menus, forms, adverts, comments and the like, and such parts of the main text are cut.  A part that
wraps an article is never one, nor is one whose words leave room for doubt (UNSURE) and which holds
half of the page's prose or more, nor, whatever its words, one with three quarters of it on a page without an article.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|math|xmp|noembed|noframes)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")

#: Elements without content, and which open elements a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "option": {"select"}}
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "caption"}
_P_SCOPE = {"td", "th", "table", "caption", "button", "html", "body"}
#: Elements without prose; elements, roles and words of class or id that mark no main text (own choice).
BARE = {"head", "button", "select", "label", "input", "object", "audio", "video", "canvas"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "advertorial", "adsense", "adslot", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "disclaimer",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "trending",
    "comment", "comments", "commentlist", "disqus", "respond", "replies", "pagination", "pager", "search", "widget", "skip", "form", "copyright", "outbrain", "taboola",
}
#: Those of them that also name wrappers of main text.
UNSURE = {
    "search", "form", "related", "notice", "notices", "notification", "alert", "widget", "banner", "share", "sharing", "social", "recommended", "trending", "overlay", "disclaimer",
    "copyright", "subscribe", "promo", "promotion", "sponsor", "sponsors", "sponsored", "login", "signup", "skip", "masthead", "respond", "replies", "subscription", "newsletter",
}
_KEEPS = {"article", "main"}


class Node:
    __slots__ = ("name", "parent", "parts", "words", "hidden", "role", "chars", "link_chars", "tags", "link_tags", "keeps", "gone", "density", "paragraph")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.parts = name, parent, []
        self.words, self.hidden, self.role = (), False, ""
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.keeps, self.gone, self.density = False, False, 0.0
        #: The open paragraph that a block within ends.
        self.paragraph = self if name == "p" else None if parent is None or name in _P_SCOPE else parent.paragraph

    def prose(self) -> int:
        return self.chars - self.link_chars


def parse(page: str) -> tuple[Node, list[Node]]:
    """(root, nodes in page order); parts of a node are child nodes and decoded strings.  Any input has a tree."""
    root = Node("#root", None)
    nodes, at, position = [root], root, 0
    #: How many elements of a name are open.
    opened: Counter[str] = Counter()

    def up_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[at.name] -= 1
            at = at.parent

    for token in _TOKEN.finditer(page):
        if token.start() > position:
            at.parts.append(entities.unescape(page[position : token.start()]))
        position = token.end()
        if token["cdata"]:
            at.parts.append(token["cdata"])
        name = token["name"] or token["name2"]
        if not name:
            continue
        name = sys.intern(name.lower())
        if token["close"] or token["close2"]:
            found = at if opened[name] > 0 else None
            while found is not None and found.name != name:
                found = None if found.name in ("table", "td", "th", "article", "body") and name not in BLOCK else found.parent
            if found is not None and found.parent is not None:
                up_to(found.parent)
            continue
        if name in _ENDS_P and at.paragraph is not None:
            up_to(at.paragraph.parent)
        if ends := _ENDS.get(name):
            above, limit = at, _HOLDS[name]
            last = None
            while above is not None and above.name not in limit:
                if above.name in ends:
                    last = above
                above = above.parent
            if last is not None:
                up_to(last.parent)
        node = Node(name, at)
        at.parts.append(node)
        nodes.append(node)
        attributes = token["attrs"] or token["attrs2"] or ""
        if attributes.strip(" \t\n\r\f/"):
            for key, *values in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id"):
                    node.words = (*node.words, *(w.lower() for w in _WORD.findall(value)))
                elif key == "role":
                    node.role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    node.hidden = True
        if name not in VOID and not attributes.endswith("/"):
            at = node
            opened[name] += 1
    if position < len(page):
        at.parts.append(entities.unescape(page[position:]))
    return root, nodes


def _marked(node: Node, prose: int, article: bool) -> bool:
    """Whether it is a menu, form, advert or the like, on a page with so much prose and with an article or not."""
    if node.keeps or node.parent is None:
        return False
    if node.name in DROPPED or node.role in ROLES:
        return True
    words = WORDS.intersection(node.words)
    spared = words <= UNSURE and 2 * node.prose() >= prose or not article and 4 * node.prose() >= 3 * prose > 0
    return bool(words) and not spared


def densities(nodes: list[Node]) -> Node:
    """Sets every kept node's counts and composite density; returns the body (or the root)."""
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None and (node.keeps or node.name in _KEEPS and WORDS.isdisjoint(node.words)):
            node.keeps = node.parent.keeps = True
    for node in nodes:
        node.gone = node.parent is not None and (node.name in BARE or node.hidden)
    for node in nodes:
        node.parts = [x for x in node.parts if isinstance(x, str) or not x.gone]
    for node in reversed(nodes):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x.strip())
            else:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.tags += x.tags + 1
                node.link_tags += x.link_tags + (x.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if n.chars:
            base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / max(n.tags, 1) * max(math.log(n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)), 1.0) / base
    return body


def main_node(nodes: list[Node]) -> tuple[Node, float]:
    """(root of the main text, threshold); marks as gone what is no main text."""
    body = densities(nodes)
    best, most = body, -1.0
    inside, prose = {id(body)}, body.prose()
    for node in nodes:
        if node is not body:
            if node.parent is None or id(node.parent) not in inside or node.gone:
                continue
            if _marked(node, prose, nodes[0].keeps):
                node.gone = True
                continue
            inside.add(id(node))
        total = sum(x.density for x in node.parts if not isinstance(x, str)) + sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        if total > most:
            best, most = node, total
    threshold, up = math.inf, best
    while up is not None:
        threshold = min(threshold, up.density)
        if up is body:
            break
        up = up.parent
    #: Text that stands in an article belongs to the whole of it.
    up = best
    while up is not None and up is not body:
        if up.name in _KEEPS:
            best = up
            break
        up = up.parent
    return best, threshold


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; empty if there is none."""
    if not page:
        return ""
    _, nodes = parse(page)
    best, threshold = main_node(nodes)
    blocks: list[list[str]] = [[]]
    stack: list[tuple[object, bool]] = [(best, False)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            blocks[-1].append(item)
            continue
        block = item.name in BLOCK
        if item.gone:
            continue
        if not done and item is not best and block and item.density < threshold and item.link_chars > 0.8 * item.chars > 0:
            continue
        if block:
            blocks.append([])
        elif item.name == "br":
            blocks[-1].append(" ")
        if not done:
            stack.append((item, True))
            stack.extend((x, False) for x in reversed(item.parts))
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


@F.arrow_udf(T.StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    One row for each input row; a null or empty html, and one without main
    text, gives an empty text; repeated rows stay; an empty table gives no rows.
    """
    found = pages.select("page_id", "url", _main_texts("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))

"""Tag-soup HTML: a tolerant parser and the mark-up features of its tree.

Names keep their case, so only lower-case ``script`` is raw text and only
lower-case ``br`` is void.  Any input has a tree; trees may be as deep as the
page, so nothing here recurses.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from html.entities import name2codepoint
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.hashing import hash_bytes
from ..functions.text import HTML_WINDOW, STOP_WORDS, decode_lenient

#: Elements without content; groups of elements that a start tag can end; and which groups each ends.
VOID = {"br", "hr", "col", "img", "area", "base", "link", "meta", "frame", "input", "param", "isindex", "basefront"}
GROUP = {"p": 0, "dd": 1, "dt": 1, "li": 2, "td": 3, "th": 3, "tr": 4, "tbody": 5, "tfoot": 5, "thead": 5, "colgroup": 4, "option": 6}
ENDS = {
    "colgroup": {4}, "dd": {0, 1}, "div": {0}, "dt": {0}, "h1": {0}, "h2": {0}, "h3": {0}, "h4": {0}, "hr": {0}, "li": {2}, "ol": {0}, "option": {6}, "p": {0}, "pre": {0},
    "table": {0}, "tbody": {5}, "td": {3}, "tfoot": {5}, "th": {3}, "thead": {5}, "tr": {3, 4}, "ul": {0},
}
#: Entities whose decimal numbers were written as hexadecimal.
MISCODED = "lrm rlm zwj Yuml circ emsp ensp euro zwnj OElig bdquo ldquo lsquo mdash ndash oelig rdquo rsquo sbquo tilde Dagger Scaron dagger lsaquo permil rsaquo scaron thinsp".split()

ROOT, CONTENT, COMMENT = "#<ROOT>#", "#<CONTENT>#", "#<COMMENT>#"
_SPACE = " \t\n\r\f"
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));?")
_STOP = frozenset(STOP_WORDS)
_TOKEN = re.compile(rb"[0-9A-Za-z][0-9A-Za-z'\x80-\xff]*|[^\s][^\s0-9A-Za-z\x80-\xff]*")
#: Rows that a task gives to Spark at once.
BATCH_ROWS = 20_000
_ROW = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


@dataclass
class Node:
    name: str
    parent: Node | None
    content: str = ""
    attributes: list[tuple[str, str]] = field(default_factory=list)

    def attribute(self, name: str) -> str | None:
        """First of that name."""
        return next((v for k, v in self.attributes if k == name), None)


@dataclass
class Document:
    """Nodes in page order, the root first; ``doctype`` is what the declaration names."""

    nodes: list[Node]
    doctype: str = ""

    def children(self, of: Node) -> list[Node]:
        return [n for n in self.nodes if n.parent is of]


def unescape(text: str, legacy: bool = False) -> str:
    """Entities by name (the classic 252) or number, the semicolon optional; unknown ones stay."""

    def one(m: re.Match) -> str:
        if m[3]:
            point, rest = name2codepoint.get(m[3]), ""
            if point is None:
                return m[0]
            if legacy and m[3] in MISCODED:
                point = int(str(point), 16)
        else:
            point, rest = int(m[1], 16) if m[1] else int(m[2]), ""
        return (chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else "�") + rest

    return _ENTITY.sub(one, text) if "&" in text else text


def parse(page: str, legacy_entities: bool = False) -> Document:
    root = Node(ROOT, None)
    doc, at, i, n = Document([root]), root, 0, len(page)
    text_from = 0

    def flush(end: int, raw: bool = False) -> None:
        if end > text_from:
            doc.nodes.append(Node(CONTENT, at, page[text_from:end] if raw else unescape(page[text_from:end], legacy_entities)))

    while i < n:
        i = page.find("<", i)
        if i < 0:
            break
        if page.startswith("<![CDATA[", i):  # its marks stay in the text
            end = page.find("]]>", i)
            i = n if end < 0 else end + 3
            continue
        follows = page[i + 1 : i + 2]
        flush(i)
        if page.startswith("<!--", i):
            end = page.find("-->", i + 5)  # an empty comment reads on to the next end
            body = page[i + 4 :] if end < 0 else page[i + 4 : end]
            if end >= 0:
                doc.nodes.append(Node(COMMENT, at, body))
            i = text_from = n if end < 0 else end + 3
        elif page.startswith("<!DOCTYPE", i):  # what it names is text of the page too
            end = page.find(">", i)
            doc.doctype = page[i + 9 : n if end < 0 else end].strip()
            text_from = i + 9
            while text_from < n and page[text_from] in _SPACE:
                text_from += 1
            i = n if end < 0 else end + 1
        elif follows == "/":
            end = page.find(">", i)
            name = page[i + 2 : n if end < 0 else end].strip(_SPACE).lower()
            up = at
            while up is not root and up.name.lower() != name:
                up = up.parent
            at = root if up is root else up.parent
            i = text_from = n if end < 0 else end + 1
        elif not follows.isascii() or not follows.isalpha():
            end = page.find(">", i)
            i = text_from = n if end < 0 else end + 1
        else:
            at, i = _start_tag(doc, page, at, i + 1, legacy_entities)
            text_from = i
            if at.name in ("script", "style") and doc.nodes[-1] is at:
                end = page.find(f"</{at.name}>", i)
                if end < 0:
                    end = n
                flush(end, True)
                i = text_from = end
    flush(n)
    return doc


def _start_tag(doc: Document, page: str, at: Node, i: int, legacy: bool) -> tuple[Node, int]:
    """(where content goes next, place after the tag)."""
    n, begin = len(page), i
    while i < n and page[i] not in _SPACE and page[i] not in "/>":
        i += 1
    name = page[begin:i]
    up = at
    while up.parent is not None and GROUP.get(up.name, -1) in ENDS.get(name, ()):
        up = up.parent
    node = Node(name, up)
    doc.nodes.append(node)
    closed, bare_end = name in VOID, False
    while i < n and page[i] != ">":
        c = page[i]
        if c in _SPACE:
            i += 1
            continue
        if c == "/":
            closed, i = True, i + 1
            continue
        begin = i
        while i < n and page[i] not in _SPACE and page[i] not in "=/>":
            i += 1
        key = unescape(page[begin:i], legacy)
        after = i
        while after < n and page[after] in _SPACE:
            after += 1
        if after >= n or page[after] != "=":
            if key:
                node.attributes.append((key, key))
            bare_end = i < n and page[i] == ">"
            i = max(i, begin + 1) if not key else i
            continue
        i = after + 1
        while i < n and page[i] in _SPACE:
            i += 1
        begin = i
        if i < n and page[i] in "\"'":
            quote, i = page[i], i + 1
            while i < n and page[i] not in (quote, ">"):
                i += 1
            if i < n and page[i] == quote:
                value, i = page[begin + 1 : i], i + 1
            else:  # the tag's end ends the value as well; its quote stays
                value = page[begin:i]
        else:
            while i < n and page[i] not in _SPACE and page[i] != ">":
                i += 1
            value = page[begin:i]
            bare_end = i < n and page[i] == ">"
        node.attributes.append((key, unescape(value, legacy)))
    #: A void element stays open where its tag ends inside a bare name or value.
    if closed and not bare_end:
        return up, i + 1
    return node, i + 1


def serialise(doc: Document) -> str:
    """The tree as mark-up again."""
    below: dict[int, list[Node]] = {}
    for node in doc.nodes[1:]:
        below.setdefault(id(node.parent), []).append(node)
    out, stack = [], [(x, False) for x in reversed(below.get(id(doc.nodes[0]), []))]
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    while stack:
        node, done = stack.pop()
        if node.name == CONTENT:
            out.append(node.content if node.parent.name in ("script", "style") else escape(node.content))
        elif node.name == COMMENT:
            out.append(f"<!--{node.content}-->")
        elif done:
            out.append(f"</{node.name}>")
        else:
            out.append("<" + node.name + "".join(f' {k}="{escape(v)}"' for k, v in node.attributes) + ">")
            if node.name not in VOID:
                stack.append((node, True))
                stack.extend((x, False) for x in reversed(below.get(id(node), [])))
    return "".join(out)


def _bytes(text: str) -> bytes:
    """A text's bytes, those that were none of UTF-8 too."""
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:  # half a pair, named by a reference
        return text.encode("utf-8", "replace")


def _valid(text: str | None) -> str | None:
    return text if text is None or text.isascii() else _bytes(text).decode("utf-8", "replace")


def features(page: str | bytes, legacy_entities: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(kind, a, b) of every feature of a page, given as text or as any bytes, in page order, repeated as they occur.

    Kinds: tag, tag2 (name in its parent), attr, attrval, url, attrurl, word,
    gram1 and gram2 (a word and the one or two before), ctx (a word in its
    parent's tag), point (a code point from 128).
    """
    raw = page if isinstance(page, bytes) else _bytes(page)
    doc = parse(raw.decode("utf-8", "surrogateescape"), legacy_entities)
    labels: dict[int, str] = {}
    past: list[str] = []
    for node in doc.nodes:
        if node.name == ROOT:
            continue
        parent = labels.get(id(node.parent), "")
        if node.name in (CONTENT, COMMENT):
            for found in _TOKEN.findall(_bytes(node.content)):
                token = found.decode("latin-1")
                if token in _STOP:
                    continue
                yield "word", token, None
                for d, before in enumerate(past, 1):
                    yield f"gram{d}", token, before
                past = [token, *past][: len(HTML_WINDOW)]
                if parent:
                    yield "ctx", parent, token
            continue
        fused = {"meta": ("name", "property", "http-equiv"), "link": ("rel",)}.get(node.name, ())
        used = next((k for k, (key, _) in enumerate(node.attributes) if key in fused), None)
        label = node.name if used is None else f"{node.name}[{node.attributes[used][1].lower()}]"
        labels[id(node)] = label
        yield "tag", label, None
        if parent:
            yield "tag2", label, parent
        for k, (key, value) in enumerate(node.attributes):
            if k == used:
                continue
            yield "attr", f"{label}.{key}", None
            yield "attrval", f"{label}.{key}", value
            if value.startswith(("http://", "https://")):
                for part in filter(None, value.split("/")):
                    yield "url", part, None
                    yield "attrurl", f"{label}.{key}", part
    for point in decode_lenient(raw):
        yield "point", str(point), None


def html_features(pages: DataFrame, key: str = "page_id", html: str = "html", legacy_entities: bool = False, kinds: Collection[str] | None = None) -> DataFrame:
    """(doc_id, kind, a, b, n): each page's (text or bytes) features, of some kinds or all, and how often each occurs; a null page has none.

    A task holds a page's features and BATCH_ROWS rows, however many pages come to it at once.
    """
    from collections import Counter

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, raw in zip(batch.column("doc_id"), batch.column("html")):
                if page := raw.as_py():
                    k = k.as_py()
                    for (kind, a, b), c in Counter(features(page, legacy_entities)).items():
                        if kinds is None or kind in kinds:
                            yield k, kind, _valid(a), _valid(b), c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ROW.types)], schema=_ROW)

    return pages.selectExpr(f"cast(`{key}` as string) as doc_id", f"cast(`{html}` as binary) as html").mapInArrow(run, "doc_id string, kind string, a string, b string, n long")


def feature_hashes(found: list[tuple[str, str, str | None]]) -> np.ndarray:
    """64-bit identities of symbolic features."""
    return hash_bytes(["\x1f".join(x or "" for x in f).encode() for f in found])

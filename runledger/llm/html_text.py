"""Visible text of HTML pages, laid out as text.

A tolerant tokenizer feeds a tree builder that supplies implied end tags (paragraphs, list
items, table parts, options) and ignores stray ones. Rendering walks the tree: hidden elements
are left out, white space collapses outside preformatted text, blocks stand on lines of their
own with blank lines around paragraphs, headings, lists and tables, list items get bullets or
numbers with indentation, and table cells are aligned in columns.

All visible text is emitted, boilerplate included. Elements may nest to any depth: the tree is
built and walked without recursion, and only the indentation stops growing, at ``INDENT``
columns. Defined results: a null page gives null, an empty one an empty text; very long pages
are handled whole; repeated rows are kept; an empty table gives no rows; extra columns stay, but
for one named like the result, which is replaced.
"""
from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDENT = 512              # columns; deeper lists and quotations are indented no further
BATCH_CHARS = 1 << 23

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript"))
RCDATA = frozenset(("title", "textarea"))
HIDDEN = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas "
                   "datalist map area base link meta param source track embed rp".split())
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu fieldset".split(), 1)
BLOCK = {**MARGIN, **dict.fromkeys(
    "html body div section article header footer nav main aside address li dt dd form figcaption caption center "
    "details summary dialog legend option optgroup select tr thead tbody tfoot textarea hgroup search".split(), 0)}
# a start tag closes these open elements, up to the boundary elements of its own kind
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th", "caption"), ("table",)),
    "th": (("td", "th", "caption"), ("table",)), "caption": (("caption",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("html",)), "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
CLOSES_P = frozenset(BLOCK) - {"li", "option", "optgroup", "html", "body", "select", "textarea", "caption", "legend"} | {"li"}
SCOPE = frozenset(("table", "td", "th", "caption", "button", "html", "template"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                  r"""|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>]|["'])*?)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html_lib.unescape(value) if "&" in value else value)
    return out


def _text(source: str) -> str:
    return html_lib.unescape(source) if "&" in source else source


class _Open:
    """The open elements, innermost last, with the places of each tag.

    Places are serial numbers that stay when an element further out is closed, so each lookup is
    a bisection, however deep the page."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.serial = [root], [0], 0
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.serial += 1
        self.nodes.append(node)
        self.places.append(self.serial)
        self.by_tag[node.tag].append(self.serial)
        if node.tag in BLOCK:
            self.blocks.append(self.serial)

    def last(self, tags) -> int:
        """Place of the innermost element with one of ``tags``; 0 (the root) if there is none."""
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=0)

    def close_from(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while self.places[-1] >= place > 0:
            self.close_one(len(self.nodes) - 1)

    def close_one(self, at: int) -> None:
        """Close one element; those inside it stay open."""
        node, place = self.nodes.pop(at), self.places.pop(at)
        held = self.by_tag[node.tag]
        del held[bisect_left(held, place)]
        if node.tag in BLOCK:
            del self.blocks[bisect_left(self.blocks, place)]

    def close_within(self, tags, bounds) -> None:
        """Close the outermost of ``tags`` inside the innermost of ``bounds``."""
        bound = self.last(bounds)
        first = [held[k] for held in map(self.by_tag.get, tags) if held and (k := bisect_right(held, bound)) < len(held)]
        if first:
            self.close_from(min(first))


TABLE_PARTS = frozenset(("tr", "tbody", "thead", "tfoot", "table", "body", "html"))


def parse(source: str) -> Node:
    """The page's tree; text nodes are strings."""
    root = Node("html", {})
    open_, at, size = _Open(root), 0, len(source)

    while at < size:
        inner = open_.nodes[-1].children
        m = _TAG.search(source, at)
        if m is None:
            inner.append(_text(source[at:]))
            break
        if m.start() > at:
            inner.append(_text(source[at:m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            place = open_.last((tag,))
            if tag == "br":
                inner.append(Node("br", {}))
            elif tag == "p" and place <= open_.last(SCOPE):
                inner.append(Node("p", {}))
            elif place and (tag in TABLE_PARTS or place >= open_.last(("td", "th", "table"))):
                # an end tag does not reach out of a table cell, and an inline one leaves the
                # blocks inside its element open
                if tag not in BLOCK and open_.blocks and open_.blocks[-1] > place:
                    open_.close_one(bisect_left(open_.places, place))
                else:
                    open_.close_from(place)
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag == "html":
            root.attrs.update(attrs)
            continue
        if tag in CLOSES_P and (place := open_.last(("p",))) > open_.last(SCOPE):
            open_.close_from(place)
        if tag in CLOSES:
            open_.close_within(*CLOSES[tag])
        elif open_.nodes[-1].tag == "head" and tag not in HIDDEN:
            open_.close_from(open_.places[-1])
        node = Node(tag, attrs)
        open_.nodes[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(source, at)
            body = source[at:end.start()]
            node.children.append(_text(body) if tag in RCDATA else body)
            at = end.end()
        else:
            open_.push(node)
    return root


def hidden(node: Node, parent: Node | None) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return True
    if "style" in a and _STYLE.search(a["style"]):
        return True
    if node.tag == "input":
        return a.get("type", "text").lower() in ("hidden", "password", "checkbox", "radio", "file", "image")
    if node.tag == "dialog" and "open" not in a:
        return True
    return parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary"


class _Flow:
    """Lines of text with collapsed white space, blank-line margins and indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.space, self.indent, self.lead = 0, False, "", ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = True
            s = s[1:]
        if not s:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = s.endswith(" ")
        self.parts.append(s[:-1] if self.space else s)

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.parts.append(first)
        for line in rest:
            self.end(True)
            if line:
                self.parts.append(line)

    def end(self, force: bool = False) -> None:
        """Close the current line; ``force`` keeps an empty one."""
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.space = [], False
        if not line and not force:
            return
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append((self.indent + self.lead + line).rstrip(" ") if line or self.lead else "")
        if self.lead:
            self.indent, self.lead = (self.indent + " " * len(self.lead))[:INDENT], ""

    def block(self, margin: int) -> None:
        self.end()
        self.gap = max(self.gap, margin)

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).replace("\xa0", " ").strip("\n")


def _number(value: str | None, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def _finish(walk: Generator):
    """Run a walk to its end. A walk yields the walks of inner elements and is sent their results,
    so nesting uses this list and not the call stack."""
    stack, result = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as done:
            stack.pop()
            result = done.value
    return result


def _walk(node: Node, flow: _Flow, pre: bool, depth: int) -> Generator:
    for child in node.children:
        if isinstance(child, str):
            if node.tag == "details" and "open" not in node.attrs:
                continue
            if pre:
                flow.raw(child)
            elif node.tag not in ("ul", "ol", "table", "tr") or child.strip():
                flow.text(child)
            continue
        if hidden(child, node):
            continue
        tag = child.tag
        if tag == "br":
            flow.end(True)
        elif tag == "wbr":
            continue
        elif tag == "input":
            flow.text(child.attrs.get("value", ""))
        elif tag == "table":
            flow.block(1)
            yield _table(child, flow, depth)
            flow.block(1)
        elif tag in ("ul", "ol", "menu"):
            flow.block(0 if depth else 1)
            yield _list(child, flow, pre, depth)
            flow.block(0 if depth else 1)
        elif tag in BLOCK:
            margin = BLOCK[tag]
            flow.block(margin)
            inner = pre or tag in ("pre", "textarea")
            indent = flow.indent
            if tag in ("blockquote", "dd"):
                flow.indent = (flow.indent + "  ")[:INDENT]
            if inner and child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
                child.children[0] = child.children[0][1:]
            yield _walk(child, flow, inner, depth)
            flow.block(margin)
            flow.indent = indent
        else:
            yield _walk(child, flow, pre, depth)


def _list(node: Node, flow: _Flow, pre: bool, depth: int) -> Generator:
    number = _number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                flow.text(child)
            continue
        if hidden(child, node):
            continue
        flow.end()
        if child.tag != "li":
            holder = Node("div", {})
            holder.children.append(child)
            yield _walk(holder, flow, pre, depth + 1)
            continue
        indent, lead = flow.indent, flow.lead
        if node.tag == "ol":
            number = _number(child.attrs.get("value"), number)
            flow.lead = (lead + f"{number}. ")[-INDENT:]
            number += 1
        else:
            flow.lead = (lead + "- ")[-INDENT:]
        yield _walk(child, flow, pre, depth + 1)
        flow.end()
        flow.indent, flow.lead = indent, ""


def _cell(node: Node) -> Generator:
    flow = _Flow()
    yield _walk(node, flow, False, 1)
    return " ".join(x.strip() for x in flow.result().split("\n") if x.strip())


def _rows(node: Node) -> Iterator[Node]:
    """The rows of a table and of its parts (which never nest)."""
    for child in node.children:
        if isinstance(child, Node) and not hidden(child, node):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from (c for c in child.children if isinstance(c, Node) and c.tag == "tr" and not hidden(c, child))


def _table(node: Node, flow: _Flow, depth: int) -> Generator:
    loose = Node("div", {})            # captions and what stands outside of rows
    for part in [node, *[c for c in node.children if isinstance(c, Node) and c.tag in ("thead", "tbody", "tfoot")]]:
        loose.children.extend(c for c in part.children if isinstance(c, str) and c.strip()
                              or isinstance(c, Node) and c.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"))
    yield _walk(loose, flow, False, depth)
    flow.end()
    grid, held = [], {}                # held: column -> rows that a cell above still covers
    for row in _rows(node):
        cells, column = {}, 0
        for child in row.children:
            if isinstance(child, str):
                if child.strip():
                    cells[column] = (cells.get(column, "") + " " + _SPACE.sub(" ", child).strip()).strip()
                continue
            if hidden(child, row):
                continue
            while held.get(column, 0) > 0:
                column += 1
            cells[column] = (cells.get(column, "") + " " + (yield _cell(child))).strip()
            span, down = (min(max(_number(child.attrs.get(k), 1), 1), 1000) for k in ("colspan", "rowspan"))
            for c in range(column, column + span):
                held[c] = max(held.get(c, 0), down)
            column += span
        held = {c: n - 1 for c, n in held.items() if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, text in cells.items():
            widths[c] = max(widths.get(c, 0), len(text))
    order = [c for c in sorted(widths) if widths[c]]
    for cells in grid:
        line = "  ".join(cells.get(c, "").ljust(widths[c]) for c in order).rstrip()
        if line:
            flow.parts.append(line)
            flow.end()


def visible_text(source: str | None) -> str | None:
    """The visible text of one page."""
    if source is None:
        return None
    flow = _Flow()
    _finish(_walk(parse(source), flow, False, 0))
    return flow.result()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            texts, size, start = [], 0, at
            while at < n and size < BATCH_CHARS:
                page = batch.column(0)[at].as_py()
                texts.append(visible_text(page))
                size += len(page or "")
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(start, at - start), pa.array(texts, pa.string())],
                                             names=["row", "text"])


def extract_text(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without the HTML, with the column ``name`` (a column of that name is replaced)."""
    stay = [c for c in pages.columns if c.lower() not in (html_col.lower(), name.lower())]
    rows = pages.select(F.col(html_col).cast("string").alias("html"), F.struct(*[pages[f"`{c}`"] for c in stay]).alias("row"))
    done = rows.mapInArrow(_extract, rows.select("row").schema.add("text", "string"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in stay], F.col("text").alias(name))

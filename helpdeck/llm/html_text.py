"""HTML extraction: a tree builder with implied tags, and a renderer of what is visible.

``build`` reads tags into a tree, ends elements whose end tag may be left out
(paragraphs, list items, table parts, options) and supplies a row for cells
outside one.  ``render`` leaves out what a browser does not show and lays the
rest out: blocks on lines of their own, blank lines around paragraphs and
headings, list items with marks and indents, table cells in aligned columns,
``pre`` as it is.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import arrow_map, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link base object iframe canvas svg math audio video "
                   "datalist noframes noembed".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer main nav aside address form li dt dd tr thead tbody "
                           "tfoot caption details summary figcaption legend center dialog hgroup search option select".split())
#: An opening tag ends these open elements, unless one of the fences stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_CLOSES_P = BLOCK - {"li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "option", "html", "body"}
#: Elements beyond which an end tag or a paragraph's implied end does not reach.
_SCOPE = frozenset("table td th caption button object template html".split())
MAX_DEPTH = 200
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _end(self, tags, fences) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in fences:
                return
            if tag in tags:
                del self.open[i:]
                if tag in ("p",):
                    return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag == "body":
                self._end({"head"}, frozenset())
            return
        if self.open[-1].tag == "head" and tag not in HIDDEN:
            self.open.pop()
        if tag in _CLOSES_P:
            self._end({"p"}, _SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        if len(self.open) >= MAX_DEPTH:  # deeper elements become siblings
            self.open.pop()
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID - {"br"}:
            return
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in _SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def build(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return True
    if node.tag == "input" and (node.attrs.get("type") or "").lower() == "hidden":
        return True
    style = node.attrs.get("style")
    return bool(style) and bool(re.search(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", style, re.I))


class _Lines:
    """Lines being laid out: inline text gathers until a block boundary."""

    def __init__(self):
        self.out: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        self.inline.append(s)

    def flush(self) -> None:
        joined = "".join(self.inline)
        self.inline = []
        for part in joined.split("\x00"):
            line = _BLANK.sub(" ", part).strip(" ")
            if line or ("\x00" in joined and self.out and not self.gap):
                self.line(line)
        while self.out and self.out[-1] == "" and "\x00" in joined:
            self.out.pop()

    def line(self, s: str) -> None:
        if self.gap and self.out:
            self.out.append("")
        self.gap = False
        self.out.append(s)

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or (spaced and bool(self.out))

    def add(self, lines: list[str]) -> None:
        for s in lines:
            self.line(s)


def width(s: str) -> int:
    """Columns of a string on a fixed grid (wide characters take two, combining ones none)."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _children(node: Node, lines: _Lines) -> None:
    for child in node.children:
        if isinstance(child, str):
            lines.text(child)
        elif not hidden(child):
            _element(child, lines)


def _sub(node: Node) -> list[str]:
    inner = _Lines()
    _children(node, inner)
    inner.flush()
    return inner.out


def _element(node: Node, lines: _Lines) -> None:
    tag = node.tag
    if tag == "br":
        lines.text("\x00")
    elif tag == "hr":
        lines.block(True)
        lines.line("---")
        lines.block(True)
    elif tag == "pre":
        lines.block(True)
        lines.flush()
        raw = _raw(node).strip("\n")
        if raw:
            lines.add([s.rstrip() for s in raw.split("\n")])
        lines.block(True)
    elif tag in ("ul", "ol", "menu"):
        _list(node, lines)
    elif tag == "table":
        _table(node, lines)
    elif tag == "input":
        if (node.attrs.get("type") or "text").lower() in ("submit", "button", "reset", "text", "search", "email", "tel", "url"):
            lines.text(" " + (node.attrs.get("value") or "") + " ")
    elif tag == "dd":
        lines.block(False)
        lines.add(["    " + s if s else s for s in _sub(node)])
        lines.block(False)
    elif tag in BLOCK:
        lines.block(tag in SPACED)
        _children(node, lines)
        lines.block(tag in SPACED)
    else:
        _children(node, lines)


def _raw(node: Node) -> str:
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif not hidden(child):
            parts.append(_raw(child))
    return "".join(parts)


def _list(node: Node, lines: _Lines) -> None:
    lines.block(True)
    number = node.attrs.get("start") or "1"
    at = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    for child in node.children:
        if isinstance(child, str):
            lines.text(child)
            continue
        if hidden(child):
            continue
        lines.flush()
        if child.tag != "li":
            _element(child, lines)
            continue
        mark = f"{at}. " if node.tag == "ol" else "- "
        at += 1
        own = [s for s in _sub(child)]
        if own:
            lines.add([(mark if i == 0 else " " * len(mark)) + s if s else s for i, s in enumerate(own)])
    lines.block(True)


def _table(node: Node, lines: _Lines) -> None:
    """Rows with each column as wide as its widest cell line; a cell's lines stand below each other;
    ``colspan`` takes columns and ``rowspan`` keeps its column free below."""
    lines.block(True)
    rows: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}

    def walk(part: Node) -> None:
        nonlocal taken
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    lines.text(child)
                continue
            if hidden(child):
                continue
            if child.tag in ("thead", "tbody", "tfoot"):
                walk(child)
            elif child.tag == "tr":
                row, col = [], 0
                free = {c: n - 1 for c, n in taken.items() if n > 1}
                for cell in child.children:
                    if isinstance(cell, str) or hidden(cell) or cell.tag not in ("td", "th"):
                        if isinstance(cell, str) and not cell.strip() or not isinstance(cell, str) and hidden(cell):
                            continue
                        if isinstance(cell, str):
                            lines.text(cell)
                        else:
                            _element(cell, lines)
                        continue
                    while taken.get(col, 0) > 0:
                        col += 1
                    span, down = (_span(cell.attrs.get(k)) for k in ("colspan", "rowspan"))
                    row.append((col, span, _sub(cell)))
                    if down > 1:
                        free.update({c: down - 1 for c in range(col, col + span)})
                    col += span
                taken = free
                rows.append(row)
            else:
                _element(child, lines)

    walk(node)
    lines.flush()
    widths: dict[int, int] = {}
    for row in rows:
        for col, span, cell in row:
            if span == 1:
                widths[col] = max(widths.get(col, 0), *(width(s) for s in cell), 0)
    for row in rows:
        for k in range(max((len(cell) for _, _, cell in row), default=0)):
            text, at = "", 0
            for col, _, cell in row:
                start = sum(widths.get(c, 0) + 2 for c in range(col))
                text += " " * (start - at)
                s = cell[k] if k < len(cell) else ""
                text, at = text + s, max(start, at) + width(s)
            lines.line(text.rstrip())
    lines.block(True)


def _span(value: str | None) -> int:
    return min(int(value), 100) if value and value.isascii() and value.isdigit() and int(value) > 0 else 1


def render(html: str) -> str:
    """The visible text of a page; empty for an empty one."""
    lines = _Lines()
    _children(build(html), lines)
    lines.flush()
    return "\n".join(lines.out).strip("\n")


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_lines`` per row of ``pages``: the visible text of the whole page.

    A null or empty page has an empty text (0 lines); what cannot be parsed as a
    tag stays text; nesting beyond 200 levels is flattened; repeated rows stay;
    other columns are ignored.  One pass, no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(h) for h in strings(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_lines"])

    return arrow_map(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.col(html_col).alias("html")), run,
                     "page_id bigint, url string, text string, n_chars bigint, n_lines bigint")

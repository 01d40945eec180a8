"""Operator 7: layout-aware rendering of HTML to text.

A tree is built from the markup, with the tags that HTML lets authors leave out
implied (an open paragraph ends before a block, a list item before the next, a
cell before the next cell or row).  Rendering emits all visible text: what
visibility rules hide (head, scripts, styles, templates, ``hidden``,
``display:none``, ``visibility:hidden``, closed details) is left out, nothing
else is.  Scripts run, so ``noscript`` is hidden, and so is what stands inside
``iframe``, ``canvas``, ``audio`` and ``video``, which browsers show themselves;
the fallback inside an ``object`` is shown, as its resource isn't at hand.  Of
``math`` and ``svg`` the text is shown, without annotations, titles and other
parts that are never drawn; each piece of text in a drawing is set off by a
space.  Blocks start on their own lines, paragraphs and headings are set off
by an empty line, list items carry a bullet or their number and are indented by
depth, preformatted text keeps its white space, and the cells of a table are
padded to aligned columns, with spans counted.

A null or empty page gives an empty text.  Malformed markup never fails: an
unclosed tag is text, an unmatched end tag is ignored, an unclosed comment or
script runs to the end.  Tags and attributes may be of any length.  Spans of
cells have the bounds that the HTML standard sets (1000 across, 65534 down), and
elements nest as deep as in browsers (DEPTH), deeper ones becoming siblings, so
no text is lost.  Work grows with the length of a page, and with the rows of a
table times the spans that reach into them.  Repeated rows are repeated in the
result; an empty table gives no rows; ids are integers; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_maps import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe canvas audio video datalist".split())
#: Parts of formulas and drawings that are never drawn.
UNDRAWN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Parts of them that stand apart from what is before.
APART = frozenset("text foreignobject mtr mtd".split())
_DRAWING = re.compile(r"<(?:svg|math)[\s/>]", re.I)
RAW = frozenset("script style textarea title xmp".split())
#: Blocks with an empty line around them, and plain blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure form fieldset article section hr".split())
BLOCK = SPACED | frozenset(
    "html body div main header footer nav aside address li dt dd tr caption figcaption center details summary legend thead tbody tfoot option hgroup search".split()
)
#: What the start of a tag ends, as far up as the given limits.
ENDS_P = SPACED | frozenset("div main header footer nav aside address center details summary fieldset".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Elements whose start inside an open head ends the head.
IN_HEAD = frozenset("title meta link script style template noscript base".split())
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
#: What matters inside a tag: its end, or a quoted value.
_EVENT = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Elements nest so deep at most; deeper ones become siblings.  Browsers have the same limit.
DEPTH = 512
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))
#: The largest spans of the HTML standard.
MOST_ACROSS, MOST_DOWN = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children", "hidden")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.hidden = (
            tag in HIDDEN
            or "hidden" in attrs
            or (tag == "input" and attrs.get("type", "").lower() == "hidden")
            or (bool(attrs) and "style" in attrs and _HIDING.search(attrs["style"]) is not None)
        )


class _TagEnds:
    """Where tags end: at a ``>`` that isn't in a quoted value.

    A search that comes to the page's end without finding one tells that any other search that meets one of its
    events fails as well, so each event is passed in vain once.
    """

    def __init__(self, page: str):
        self.page = page
        self.failing: set[int] = set()
        self.since, self.event = len(page) + 1, None  # the event that follows every place from here on to its start

    def _next(self, at: int) -> re.Match | None:
        known = self.since <= at and (self.event is None or at <= self.event.start())
        if not known:
            self.since, self.event = at, _EVENT.search(self.page, at)
        return self.event

    def find(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if nothing does."""
        passed = []
        while True:
            event = self._next(at)
            if event is None or event.start() in self.failing:
                break
            if event[1] is None:
                return event.start()
            passed.append(event.start())
            close = self.page.find(event[1], event.end())
            if close < 0:
                break
            at = close + 1
        self.failing.update(passed)
        return -1


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack = [root]
    opened: Counter[str] = Counter()  # tags on the stack
    at, size = 0, len(page)
    ends = _TagEnds(page)
    drawings = _DRAWING.search(page) is not None

    def text(piece: str) -> None:
        if piece:
            top = stack[-1]
            if top.tag == "head" and piece.strip():
                cut(len(stack) - 1)
            elif top.tag in ("table", "tbody", "thead", "tfoot", "tr") and not piece.strip():
                return
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def cut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def close_until(tags: frozenset, limits: frozenset) -> None:
        if not any(opened[t] for t in tags):
            return
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in limits:
                break
            if stack[k].tag in tags:
                found = k
        if found is not None:
            cut(found)

    begin = 0  # text from here on isn't in the tree yet
    while at < size:
        m = _OPEN.search(page, at)
        if m is None:
            break
        if m[2] is not None:
            end = ends.find(m.end())
        elif m[0] == "<!--":
            end = page.find("-->", m.end())
            end = size if end < 0 else end + 2
        else:
            end = page.find(">", m.end())
        at = m.end()
        if end < 0:  # no tag: text
            continue
        text(page[begin : m.start()])
        raw = page[at:end]
        at = begin = end + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            else:
                if tag == "br":
                    stack[-1].children.append(Node("br", {}))
                elif tag == "p":
                    stack[-1].children.append(Node("p", {}))
            continue
        attrs = {}
        if raw and not raw.isspace():
            for a in _ATTR.finditer(raw):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attrs.setdefault(a[1].lower(), unescape(value) if "&" in value else value)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in IMPLIED:
            close_until(*IMPLIED[tag])
        elif tag in ENDS_P:
            close_until(frozenset(["p"]), frozenset(["td", "th", "table", "li", "button"]))
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        drawn = drawings and (tag in ("svg", "math") or opened["svg"] + opened["math"] > 0)
        node.hidden = node.hidden or drawn and tag in UNDRAWN
        if tag in VOID or raw.endswith("/") and (drawn or tag == "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            body = page[at : end.start() if end else size]
            if tag not in ("script", "style") and body:
                node.children.append(unescape(body))
            close = page.find(">", end.start()) if end else -1
            at = begin = size if close < 0 else close + 1
        elif len(stack) < DEPTH:
            stack.append(node)
            opened[tag] += 1
    text(page[begin:])
    return root


class _Writer:
    """Lines of text, with white space collapsed as a browser would."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a space is due before the next word
        self.prefix = ""
        self.indent = ""

    def words(self, piece: str) -> None:
        body = _SPACE.sub(" ", piece)
        if body == " ":
            self.gap = self.gap or bool(self.line)
            return
        if body.startswith(" "):
            self.gap, body = self.gap or bool(self.line), body[1:]
        trailing = body.endswith(" ")
        if self.gap and self.line:
            self.line.append(" ")
        self.line.append(body[:-1] if trailing else body)
        self.gap = trailing

    def verbatim(self, piece: str) -> None:
        first, *rest = piece.split("\n")
        if first:
            self.line.append(first)
        for r in rest:
            self.newline(force=True)
            if r:
                self.line.append(r)

    def newline(self, force: bool = False) -> None:
        if self.line or self.prefix or force:
            joined = "".join(self.line)
            self.lines.append((self.indent + self.prefix + joined).rstrip())
            if self.prefix:
                self.indent += " " * len(self.prefix)
            self.prefix = ""
        self.line, self.gap = [], False

    def blank(self) -> None:
        self.newline()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def text(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def _list_items(node: Node, out: _Writer, depth: int) -> None:
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    outer = out.indent
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.words(child)
            continue
        if child.tag != "li":
            _render(child, out, depth)
            continue
        if child.hidden:
            continue
        out.newline()
        if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", child.attrs.get("value", "")):
            number = int(child.attrs["value"])
        out.indent, out.prefix = outer, f"{number}. " if node.tag == "ol" else "- "
        number += 1
        for c in child.children:
            _render(c, out, depth)
        out.newline()
        out.prefix, out.indent = "", outer


def _rows(node: Node) -> list[Node]:
    out = []
    for c in node.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag == "tr":
                out.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                out += _rows(c)
    return out


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    if name == "rowspan" and re.fullmatch("0+", value):
        return most  # to the end of the table
    return min(int(value[:9]), most) if re.fullmatch(r"0*[1-9]\d*", value) else 1


def _table(node: Node, out: _Writer, depth: int) -> None:
    rows = _rows(node)
    inside = {id(r) for r in rows}
    for c in node.children:
        if isinstance(c, str) or c.tag not in ("thead", "tbody", "tfoot", "tr", "colgroup", "col"):
            _render(c, out, depth)
            out.newline()
        elif c.tag in ("thead", "tbody", "tfoot") and not c.hidden:
            for g in c.children:
                if id(g) not in inside:
                    _render(g, out, depth)
                    out.newline()
    grid: list[dict[int, list[str]]] = []
    reaching: list[tuple[int, int, int]] = []  # (first column, column after the last, last row) of what spans rows
    widths: dict[int, int] = {}
    for r, row in enumerate(rows):
        cells: dict[int, list[str]] = {}
        reaching = [x for x in reaching if x[2] >= r]
        fresh: list[tuple[int, int, int]] = []
        k = passed = 0
        for c in row.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                c, loose = Node("td", {}), c
                c.children.append(loose)
            if c.hidden:
                continue
            while passed < len(reaching) and reaching[passed][0] <= k:
                k = max(k, reaching[passed][1])
                passed += 1
            inner = _Writer()
            for x in c.children if c.tag in ("td", "th") else [c]:
                _render(x, inner, depth)
            lines = inner.text().split("\n")
            cells[k] = lines
            across, last = _span(c, "colspan", MOST_ACROSS), min(r + _span(c, "rowspan", MOST_DOWN), len(rows)) - 1
            if last > r and fresh and fresh[-1][1:] == (k, last):
                fresh[-1] = (fresh[-1][0], k + across, last)
            elif last > r:
                fresh.append((k, k + across, last))
            widths[k] = max(widths.get(k, 0), max(map(len, lines)) if across == 1 else 0)
            k += across
        reaching = sorted(reaching + fresh)
        grid.append(cells)
    # only columns in which a cell starts take room
    starts, lefts, left = sorted(widths), {}, 0
    for k in starts:
        lefts[k] = left
        left += widths[k] + 3
    for cells in grid:
        for n in range(max((len(v) for v in cells.values()), default=0)):
            line, place = "", 0
            for k, lines in cells.items():
                if k:
                    line = line.ljust(max(lefts[k] - 3, place)) + " | "
                line += lines[n] if n < len(lines) else ""
                place = len(line)
            out.newline()
            out.line.append(line)
            out.newline()


def _render(node: Node | str, out: _Writer, depth: int = 0, pre: bool = False) -> None:
    if isinstance(node, str):
        (out.verbatim if pre else out.words)(node)
        return
    if node.hidden or depth > DEPTH:
        return
    tag = node.tag
    if tag == "br":
        out.newline(force=True)
    elif tag == "hr":
        out.blank()
    elif tag in ("ul", "ol", "menu"):
        nested = bool(out.indent or out.prefix)
        out.newline() if nested else out.blank()
        _list_items(node, out, depth + 1)
        out.newline() if nested else out.blank()
    elif tag == "table":
        out.blank()
        _table(node, out, depth + 1)
        out.blank()
    elif tag == "details" and "open" not in node.attrs:
        out.newline()
        for c in node.children:
            if isinstance(c, Node) and c.tag == "summary":
                _render(c, out, depth + 1)
        out.newline()
    else:
        spaced, block = tag in SPACED, tag in BLOCK
        if spaced:
            out.blank()
        elif block:
            out.newline()
        if tag in ("td", "th") or tag == "option" or tag in APART:
            out.gap = True
        inside = pre or tag in ("pre", "textarea", "xmp")
        outer = out.indent
        if tag in ("blockquote", "dd"):
            out.indent += "  "
        for c in node.children:
            _render(c, out, depth + 1, inside)
        if spaced:
            out.blank()
        elif block:
            out.newline()
        out.indent = outer if tag in ("blockquote", "dd") else out.indent


def render(page: str) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    out = _Writer()
    for c in parse(page).children:
        _render(c, out)
    return out.text()


def render_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col``, ``text`` (the visible text), ``n_chars`` and ``n_lines`` of it."""
    key = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("_text"))

    def work(batch: pa.RecordBatch, texts: list[str]) -> dict:
        return {"page_id": batch.column("page_id"), "text": pa.array([render(t) for t in texts], pa.string())}

    made = map_texts(key, "_text", "page_id long, text string", work)
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return made.select(
        F.col("page_id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines")
    )

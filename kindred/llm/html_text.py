"""Visible text of HTML pages, laid out: blocks on lines of their own, lists with markers,
table cells aligned in columns.

A tokenizer feeds a stack of open elements that closes what HTML lets authors leave open
(p, li, dt, dd, option, table parts) and ignores end tags that match nothing. Elements that
a browser without scripts doesn't show (head, script, style, template, closed details,
hidden attributes, display:none) give no text; nor does what is visibility:hidden, but
children of it that are visible again do. Of a select's options only the shown one gives
text: the last one marked selected, else the first that is not disabled, and all of a list
box (multiple, or a size above 1).

Text and elements that stand in a table but in no cell or caption are placed before it, as
browsers do. Cells take as many columns and rows as they say (bounds of the standard: 1000
and the rows there are); a column is as wide as its widest cell, in columns of a terminal
(wide East Asian characters take two, combining ones none).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]++|(?=>)|\Z))?|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|(?![\"'])([^\s>]++)))?")
_SELECT = re.compile(r"</?select[\s/>]", re.I)
_GAP = re.compile(r"[ \t\n\f\r]+")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "iframe", "noembed", "noframes", "xmp", "textarea", "title"}
UNSEEN = {"head", "script", "style", "template", "title", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas", "meta", "link"}
#: Unseen inside svg and math; title is RAW and unseen anywhere.
UNSEEN_DRAWN = {"desc", "defs", "metadata", "symbol", "annotation", "annotation-xml"}
# Blocks with an empty line around, and blocks without.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "figure", "table", "menu", "hr", "fieldset"}
BLOCK = SPACED | set("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr thead tbody tfoot td th".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "body", "html", "legend"}
#: For a start tag: open elements that it ends, and elements that stop the search for them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_GROUPS = {"thead", "tbody", "tfoot"}
#: Where parts of tables may stand: what is open above the nearest of these ends.
TABLE_PART = {"td": {"tr", *_GROUPS, "table"}, "th": {"tr", *_GROUPS, "table"}, "tr": {*_GROUPS, "table"}, "caption": {"table"}} | dict.fromkeys(("thead", "tbody", "tfoot", "colgroup"), {"table"})
SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}


class Flow:
    """Lines of one flow: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # empty lines due before the next text
        self.lead = ""  # a list marker due before the next text
        self.indent = 0

    def text(self, s: str) -> None:
        s = _GAP.sub(" ", s)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            s = s.lstrip(" ")
        if s:
            self.line.append(s)

    def end(self, keep: bool = False) -> None:
        s = "".join(self.line).rstrip(" ")
        self.line = []
        if s or keep:
            if self.lines and self.gap > 1:
                self.lines.append("")
            pad = " " * self.indent
            self.lines.append(f"{pad[: max(0, self.indent - len(self.lead))]}{self.lead}{s}".rstrip(" "))
            self.gap, self.lead = 1, ""

    def block(self, space: bool) -> None:
        self.end()
        if self.lines:
            self.gap = max(self.gap, 2 if space else 1)


def _columns(s: str) -> int:
    """Columns of a terminal that a string takes."""
    return len(s) if s.isascii() else sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in s)


def _number(s: str | None, other: int, most: int) -> int:
    """The whole number that an attribute begins with, up to a bound."""
    m = re.match(r"\s*([0-9]+)", s or "")
    return min(int(m[1][:20]), most) if m else other


def _shown(options: str) -> int:
    """The number of the option that a closed select shows; -1 if there is none."""
    first = last = -1
    for n, m in enumerate(m for m in _TAG.finditer(options) if m[3] and not m[2] and m[3].lower() == "option"):
        got = {a[1].lower() for a in _ATTR.finditer(m[4])}
        last = n if "selected" in got else last
        first = n if first < 0 and "disabled" not in got else first
    return last if last >= 0 else first


class Page:
    def __init__(self):
        self.flow, self.stack = Flow(), []  # stack: (tag, hidden, extra, invisible before)
        self.hidden, self.pre = 0, 0
        self.invisible = False
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements, by tag
        self.blocks = self.items = self.rows = 0

    def pop(self) -> None:
        tag, unseen, extra, self.invisible = self.stack.pop()
        self.at[tag].pop()
        self.hidden -= unseen
        if self.hidden or unseen:
            return
        if tag == "pre":
            self.pre -= 1
        if tag in ("td", "th") and extra:
            self.flow.end()
            extra["cells"].append((self.flow.lines, *extra["span"]))
            self.flow = extra["outer"]
        elif tag == "tr" and extra:
            extra["rows"].append(extra["cells"])
            self.rows += 1
        elif tag == "table" and extra:
            self.flow = extra["flow"]
            self._table(extra["rows"])
            self.flow.block(True)
        elif tag == "text" and self.flow.line:
            self.flow.line.append(" ")
        elif tag in BLOCK and extra != "inline":
            self.flow.block(tag in SPACED)
            if tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
                self.flow.indent -= 3 if tag == "ol" else 2
            if tag == "li":
                self.flow.lead = ""

    def _table(self, rows: list[list[tuple[list[str], int, int]]]) -> None:
        """Cells (lines, columns, rows) on a grid; cells of one column make the widths, wider ones stretch their last column."""
        self.flow.block(False)
        grid: list[list[tuple[int, list[str]]]] = []
        busy: list[tuple[int, int, int]] = []  # (from, to, rows left) of cells from above, by place
        width: dict[int, int] = {}
        wide: list[tuple[int, int, int]] = []
        for cells in rows:
            at, line, more, b = 0, [], [], 0
            for lines, columns, deep in cells:
                while b < len(busy) and busy[b][0] <= at:
                    at, b = max(at, busy[b][1]), b + 1
                line.append((at, lines))
                need = max(map(_columns, lines), default=0)
                if columns == 1:
                    width[at] = max(width.get(at, 0), need)
                else:
                    wide.append((at, at + columns, need))
                if deep > 1:
                    more.append((at, at + columns, deep))
                at += columns
            busy = sorted((x, y, n - 1) for x, y, n in busy + more if n > 1)
            grid.append(line)
        for at, stop, need in wide:
            if not any(c in width for c in (at, stop - 1)):
                width[at] = 0
        known = sorted(width)
        for at, stop, need in wide:
            own = known[bisect_left(known, at) : bisect_left(known, stop)]
            if own:
                width[own[-1]] += max(0, need - sum(width[c] + 2 for c in own) + 2)
        begin, x = [], 0
        for c in known:
            begin.append(x)
            x += width[c] + 2
        for line in grid:
            for k in range(max((len(lines) for _, lines in line), default=0)):
                text, done = [], 0
                for at, lines in line:
                    if k < len(lines) and lines[k]:
                        c = bisect_right(known, at) - 1
                        x = max(begin[c] if c >= 0 else 0, done + 2 if done else 0)
                        text.append(" " * (x - done) + lines[k])
                        done = x + _columns(lines[k])
                self.flow.line = ["".join(text)]
                self.flow.end(keep=True)
                self.flow.gap = 1

    def down_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.pop()

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of some tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def close(self, tags: set[str], stop: set[str]) -> None:
        """End open elements down to the outermost of `tags` above the innermost of `stop`."""
        floor = self.last(stop)
        above = [self.at[t][i] for t in tags if (i := bisect_right(self.at[t], floor)) < len(self.at[t])]
        if above:
            self.down_to(min(above))

    def open(self, tag: str, attrs: str, rest: str = "") -> None:
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in TABLE_PART and self.at["table"]:
            self.down_to(self.last(TABLE_PART[tag]) + 1)
        got = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /\n\t") else {}
        inside = self.stack[-1][0] if self.stack else ""
        drawn = tag in UNSEEN_DRAWN and bool(self.at["svg"] or self.at["math"])
        style = got.get("style", "")
        unseen = int(tag in UNSEEN or drawn or "hidden" in got or bool(_NONE.search(style)) or (tag == "dialog" and "open" not in got) or (inside == "details" and tag != "summary" and self.stack[-1][2] == "shut"))
        if tag in VOID:
            if not self.hidden and not unseen and not self.invisible:
                if tag == "br":
                    self.flow.end(keep=True)
                elif tag == "hr":
                    self.flow.block(True)
            return
        if drawn and attrs.rstrip().endswith("/"):
            return
        box = self.stack[self.at["select"][-1]][2] if tag in ("option", "optgroup") and self.at["select"] else None
        extra = None
        if tag == "option" and box:
            unseen |= box["shown"] not in (None, box["n"])
            box["n"] += 1
        if box and box["shown"] is not None:
            extra = "inline"
        if tag == "select":
            extra = {"shown": None if "multiple" in got or (got.get("size", "").isdigit() and _number(got["size"], 1, 1000) > 1) else _shown(rest), "n": 0}
        if not self.hidden and not unseen:
            if tag == "table":
                self.flow.block(True)
                extra = {"flow": self.flow, "rows": []}
            elif tag in ("tr", "td", "th"):
                table = self.stack[self.at["table"][-1]] if self.at["table"] else None
                if tag == "tr" and table and table[2]:
                    extra = {"rows": table[2]["rows"], "cells": []}
                elif tag != "tr" and table and table[2]:
                    if inside != "tr":
                        self.open("tr", "")
                    extra = {"cells": self.stack[-1][2]["cells"] if self.stack[-1][2] else [], "outer": self.flow, "span": (_number(got.get("colspan"), 1, 1000) or 1, _number(got.get("rowspan"), 1, 65_534) or 65_534)}
                    self.flow = Flow()
            if tag in BLOCK and not extra:
                self.flow.block(tag in SPACED)
                self.blocks += 1
            if tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
                self.flow.indent += 3 if tag == "ol" else 2
                extra = {"n": _number(got.get("start"), 1, 10**9)} if tag == "ol" else extra
            elif tag == "li":
                at = self.last(("ul", "ol", "menu", "dir"))
                box = self.stack[at] if at >= 0 else None
                self.flow.lead = "- "
                if box and box[0] == "ol" and box[2]:
                    self.flow.lead = f"{box[2]['n']}. "
                    box[2]["n"] += 1
                self.items += 1
            elif tag == "pre":
                self.pre += 1
            elif tag == "details":
                extra = None if "open" in got else "shut"
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, unseen, extra, self.invisible))
        self.hidden += unseen
        if seen := _VISIBILITY.search(style):
            self.invisible = seen[1].lower() != "visible"

    def shut(self, tag: str) -> None:
        if tag == "br":
            self.open("br", "")
        elif self.at[tag]:
            here = self.at[tag][-1]
            table = tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption")
            # What stands in a cell ends nothing outside it, and a part of a table nothing of the table around.
            wall = -1 if tag in ("table", "body", "html") else self.last(("table",) if table else ("td", "th", "caption", "table"))
            if here > wall:
                self.down_to(here)

    def text(self, s: str) -> None:
        if not s or self.hidden or self.invisible or (self.stack and (self.stack[-1][2] == "shut" or self.stack[-1][0] in ("select", "optgroup"))):
            return
        if self.stack and self.stack[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not s.strip():
            return
        s = unescape(s) if "&" in s else s
        if self.pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self.flow.line.append(first)
            for part in more:
                self.flow.end(keep=True)
                self.flow.line.append(part)
        else:
            self.flow.text(s)


def render(html: str | None) -> tuple[str, int, int, int]:
    """The visible text of a page, and its numbers of blocks, list items and table rows."""
    html, page, at = html or "", Page(), 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        m = _TAG.match(html, lt)
        if not m:
            page.text(html[at : lt + 1])
            at = lt + 1
            continue
        page.text(html[at:lt])
        at = m.end()
        if m[1]:
            page.text(m[1])
        elif m[3]:
            tag = m[3].lower()
            if m[2]:
                page.shut(tag)
            else:
                end = _SELECT.search(html, at) if tag == "select" else None
                page.open(tag, m[4], html[at : end.start() if end else len(html)] if tag == "select" else "")
                if tag in RAW:
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                    if tag in ("textarea", "xmp"):
                        page.text(html[at : end.start() if end else len(html)])
                    at = end.start() if end else len(html)
    while page.stack:
        page.pop()
    page.flow.end()
    return "\n".join(page.flow.lines), page.blocks, page.items, page.rows


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [render(h) for h in batch.column("html").to_pylist()]
        text, *counts = zip(*got) if got else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *[pa.array(c, pa.int64()) for c in counts]], ["page_id", "text", "n_chars", "n_blocks", "n_items", "n_rows"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_blocks, n_items and n_rows of every row of pages; one pass, no shuffle.

    Null or empty HTML and pages with nothing visible give an empty text and counts of what
    was opened. Equal pages give equal texts. Only page_id and html are read. Broken markup
    never fails: a "<" that starts no tag is text, and what is open at the end is closed.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_extract, f"page_id {kind}, text string, n_chars long, n_blocks long, n_items long, n_rows long")

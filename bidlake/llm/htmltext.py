"""Layout-aware text of HTML: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style template noscript title meta link base object iframe canvas svg math audio video select datalist".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dt dd caption".split())
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
_blank = re.compile(r"[ \t\n\r\f\xa0]+")
#: Columns and rows that a cell spans at most, as HTML has it.
SPAN = 1000
#: Columns that lists and quotations indent by at most, so that deep pages don't become mostly blanks.
INDENT = 80


class Node:
    """An element: name, what it holds (elements and strings), what its tag says."""

    __slots__ = ("children", "hidden", "name", "said")

    def __init__(self, name: str, said: dict[str, str | None]) -> None:
        self.name, self.said, self.children = name, said, []
        self.hidden = name in UNSEEN or "hidden" in said or said.get("aria-hidden") == "true" or bool(_hidden(said.get("style") or "")) or (name == "input" and said.get("type") == "hidden")


class TreeBuilder(HTMLParser):
    """Builds the tree of a page; end tags that are left out are implied, those without a start are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # by name, where in ``open`` elements are
        self.depth = 1
        self.ending = False

    def close(self) -> None:
        self.ending = True
        super().close()

    def _whole(self, end: int) -> int:
        """What isn't ended where the page ends, a comment, declaration or tag, goes up to there and shows nothing."""
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._whole(super().parse_comment(i, report))

    def parse_html_declaration(self, i: int) -> int:
        return self._whole(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._whole(super().parse_pi(i))

    def parse_starttag(self, i: int) -> int:
        return self._whole(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._whole(super().parse_endtag(i))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as <![foo]> are skipped up to their end, whatever they are called; -1 if that is missing."""
        return self.rawdata.find(">", i) + 1 or -1

    def updatepos(self, i: int, j: int) -> int:
        return j  # places in the source aren't asked for

    def _cut(self, at: int) -> None:
        while len(self.open) > at:
            self.at[self.open.pop().name].pop()

    def _nearest(self, names: tuple[str, ...] | frozenset[str]) -> int:
        """The place of the innermost open element of these names; 0 without one."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=0)

    def _end(self, names: frozenset[str], until: frozenset[str]) -> None:
        inside = self._nearest(until)
        found = [self.at[n][i] for n in names if (i := bisect_right(self.at[n], inside)) < len(self.at[n])]
        if found:
            self._cut(min(found))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._end(frozenset(["p"]), frozenset(["table", "td", "th", "li", "body"]))
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        elif self.open[-1].name == "head" and tag not in UNSEEN:
            self._cut(len(self.open) - 1)
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)
            self.depth = max(self.depth, len(self.open))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self._nearest((tag,))
        if at and (tag in ("table", "tr", "tbody", "thead", "tfoot") or self._nearest(("td", "th", "table")) <= at):
            self._cut(at)

    def handle_data(self, data: str) -> None:
        if self.open[-1].name == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


class Renderer:
    """Lays out a tree as lines; ``gap`` is the number of newlines owed before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.indent, self.fresh = 0, "", True

    def owe(self, lines: int) -> None:
        self.gap = max(self.gap, lines)

    def put(self, text: str) -> None:
        if self.gap:
            if self.parts:
                while self.parts and self.parts[-1] == " ":
                    self.parts.pop()
                self.parts.append("\n" * self.gap)
            self.parts.append(self.indent)
            self.gap, self.fresh = 0, True
        self.parts.append(text)
        self.fresh = text.endswith((" ", "\n"))

    def words(self, text: str) -> None:
        text = _blank.sub(" ", text)
        if self.gap or self.fresh or not self.parts:
            text = text.lstrip(" ")
        if text:
            self.put(text)

    def children(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.words(child)
            elif not child.hidden:
                self.element(child)

    def element(self, node: Node) -> None:
        name = node.name
        if name == "br":
            self.gap += 1
        elif name == "table":
            self.table(node)
        elif name == "pre":
            self.owe(2)
            for line in plain(node).strip("\n").split("\n"):
                self.put(line)
                self.gap += 1
            self.owe(2)
        elif name in ("img", "area"):
            if node.said.get("alt"):
                self.words(f" {node.said['alt']} ")
        elif name == "input":
            if (node.said.get("type") or "text") in ("submit", "button", "reset", "text") and node.said.get("value"):
                self.words(f" {node.said['value']} ")
        elif name == "textarea":
            self.words(plain(node))
        elif name in ("ul", "ol", "menu"):
            self.list(node)
        elif name in BLOCK:
            space = 2 if name in SPACED else 1
            self.owe(space)
            held = self.indent
            if name in ("blockquote", "dd"):
                self.indent = (held + "    ")[:INDENT]
            self.children(node)
            self.indent = held
            self.owe(space)
        else:
            self.children(node)

    def list(self, node: Node) -> None:
        nested = bool(self.indent)
        self.owe(1 if nested else 2)
        said = re.match(r"\s*([+-]?[0-9]{1,9})(?![0-9])", node.said.get("start") or "")
        number = int(said[1]) if said else 1
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    self.owe(1)
                    self.words(child)
                continue
            if child.hidden:
                continue
            self.owe(1)
            if child.name != "li":
                self.element(child)
                continue
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            held, before = self.indent, len(self.parts)
            self.put(mark)
            self.fresh = True
            self.indent = (held + " " * len(mark))[:INDENT]
            self.children(child)
            if len(self.parts) <= before + 2 and self.parts[-1] == mark:
                self.parts.pop()  # an empty item
            self.indent = held
            self.owe(1)
        self.owe(1 if nested else 2)

    def table(self, node: Node) -> None:
        rows, captions = cells(node)
        self.owe(2)
        for caption in captions:
            self.children(caption)
            self.owe(1)
        grid: list[list[tuple[list[str], int]]] = []
        widths: dict[int, int] = {}
        held: dict[int, tuple[int, int]] = {}  # by column: rows below that a cell reaches into, and its columns
        for row in rows:
            line, at, below = [], 0, {}
            waiting, reached = deque(row), deque(sorted(held))
            while waiting or reached:
                if reached and reached[0] == at:
                    left, span = held[reached.popleft()]
                    line.append(([""], span))
                    if left > 1:
                        below[at] = (left - 1, span)
                    at += span
                    continue
                if not waiting:
                    line.append(([""], reached[0] - at))
                    at = reached[0]
                    continue
                cell = waiting.popleft()
                inner = Renderer()
                inner.children(cell)
                text = inner.text().split("\n")
                span, deep = spanned(cell, "colspan"), spanned(cell, "rowspan")
                span = min(span, reached[0] - at) if reached else span
                if deep > 1:
                    below[at] = (deep - 1, span)
                line.append((text, span))
                if any(text):
                    widths[at] = max(widths.get(at, 0), *map(len, text)) if span == 1 else widths.get(at, 0)
                at += span
            held = below
            grid.append(line)
        columns = sorted(widths)  # those with text of their own; others need no room
        before = [0]
        for column in columns:
            before.append(before[-1] + widths[column] + 3)
        for line in grid:
            if not any("".join(text) for text, _ in line):
                continue
            for y in range(max(len(text) for text, _ in line)):
                out, at = [], 0
                for text, span in line:
                    i, j = bisect_right(columns, at - 1), bisect_right(columns, at + span - 1)
                    if i < j:
                        out.append((text[y] if y < len(text) else "").ljust(before[j] - before[i] - 3))
                    at += span
                self.owe(1)
                self.put(" | ".join(out).rstrip())
        self.owe(2)

    def text(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")


def spanned(cell: Node, said: str) -> int:
    number = cell.said.get(said) or ""
    return min(SPAN, int(number)) if re.fullmatch(r"[1-9][0-9]{0,8}", number) else 1


def plain(node: Node) -> str:
    """The text below a node, as it stands."""
    parts, waiting = [], node.children[::-1]
    while waiting:
        child = waiting.pop()
        if isinstance(child, str):
            parts.append(child)
        elif child.name == "br":
            parts.append("\n")
        elif not child.hidden:
            waiting += child.children[::-1]
    return "".join(parts)


def cells(table: Node) -> tuple[list[list[Node]], list[Node]]:
    """Rows of cells, and captions; what stands between rows becomes a row of its own, so that no text is lost."""
    rows: list[list[Node]] = []
    captions: list[Node] = []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                loose = Node("td", {})
                loose.children.append(child)
                rows.append([loose])
        elif child.hidden:
            continue
        elif child.name == "caption":
            captions.append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            inner, more = cells(child)
            rows += inner
            captions += more
        elif child.name == "tr":
            row = []
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip():
                        row.append(loose := Node("td", {}))
                        loose.children.append(cell)
                elif not cell.hidden:
                    if cell.name in ("td", "th"):
                        row.append(cell)
                    else:
                        row.append(loose := Node("td", {}))
                        loose.children.append(cell)
            rows.append(row)
        elif child.name not in ("col", "colgroup"):
            loose = Node("td", {})
            loose.children.append(child)
            rows.append([loose])
    return rows, captions


def render(html: str) -> tuple[str, str]:
    """The title and the visible text of a page."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    page = Renderer()
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * builder.depth + 1000))  # calls between Python functions need no stack of the machine
    try:
        page.children(builder.root)
    finally:
        sys.setrecursionlimit(limit)
    title = re.search(r"<title[^>]*>(.*?)</title\s*>", html, re.I | re.S)
    return _blank.sub(" ", title[1]).strip() if title else "", page.text()


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", title_col: str = "title") -> DataFrame:
    """Add title and visible text of every whole page.

    Blocks stand on lines of their own, paragraphs, headings, lists and tables with a blank line around; list items have marks and
    indents, table cells are padded to columns. Scripts, styles, forms' choices, hidden elements and comments aren't visible.
    Pages may have any length and depth; a cell that spans rows leaves its columns empty below, and a column in which no cell with text begins takes no
    room. A comment or tag that isn't ended shows nothing; a list's start that isn't a number of up to nine digits counts as 1. Texts of SVG images and choices of
    forms count as not visible. Null or empty pages give empty texts; broken markup is read as far as it goes; text without tags is one
    block. Equal pages give equal texts; other columns stay, clashing ones are replaced.
    """
    kept = [c for c in pages.columns if c not in (text_col, title_col)]
    place = kept.index(html_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [render(x.as_py() or "") for x in batch.column(place)]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*kept, title_col, text_col])

    return pages.select(*kept).mapInArrow(work, pages.select(*kept).schema.add(title_col, T.StringType()).add(text_col, T.StringType()))

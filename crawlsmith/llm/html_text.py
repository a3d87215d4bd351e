"""HTML to text as a reader sees it: a tree with implied tags, visibility rules, and a layout of blocks.

The page is cut into tags, comments and text by one pattern. The tree builder closes elements that HTML lets
authors leave open (p, li, dt, dd, option, table parts), keeps void elements empty and ignores stray end
tags. Elements that are never shown (head, script, style, template, ...), the ``hidden`` attribute,
``display: none`` (the last display counts), closed ``dialog`` and ``popover`` elements, and all but the summary of closed ``details`` stay out; ``visibility: hidden`` hides what does not
turn visible again further in. Of drawings and formulas the text is kept, of choices all options, of buttons their labels.
The renderer collapses white space, puts blocks on lines of their own with a blank line between paragraphs,
headings and the like, marks list items by level, numbers ordered lists, keeps preformatted text, and pads
table cells so that columns line up (a page that nests tables gets the inner one as lines in a cell). Columns that only spans reach take no
room; a table whose grid has more than SPARSE places a cell, which only long spans make, is laid out row by row, and one that padding would make
SPARSE times as long is not padded, so that text and time grow with the page and not with the numbers in it.

Nulls and edge cases: null html gives null title and text and 0 blocks; empty html gives empty text; tags left open at
the end are closed; numbers that are none count as missing; nesting has no bound; very long pages are rendered whole, one at a time; null or repeated page_ids are rows like others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsmith.llm._arrow import chunks, text_bytes

SCHEMA = "page_id bigint, title string, text string, n_blocks bigint"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template noscript title iframe object video audio canvas datalist noembed noframes map desc metadata defs symbol annotation annotation-xml rp".split())
_FOREIGN = frozenset("svg math".split())
_APART = frozenset("textarea svg text".split())  # boxes of their own within a line
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section figure form fieldset hr details main".split())
_BLOCK = _SPACED | frozenset("html body div header footer nav aside address li dt dd tr figcaption summary caption thead tbody tfoot center hgroup legend menu search option optgroup".split())
_ENDS_P = _BLOCK - frozenset("html body li dt dd tr caption thead tbody tfoot summary legend option optgroup".split())
#: A start tag closes an open element of the second set, unless one of the third is in between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"body"}),
}
_SCOPE = frozenset("table td th caption button html object".split())
_REMARK = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
_LAST = re.compile(_REMARK + "|()()()(?!)", re.S)  # behind the last >, where no tag can end
_TOKEN = re.compile(_REMARK + r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(\w+)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
_BUTTONS = frozenset("submit button reset".split())
SPARSE = 64  # places of a table's grid for each of its cells


class Node:
    __slots__ = ("tag", "attributes", "children", "holds_cells")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, attributes, []
        self.holds_cells = False  # rows or cells of the table around it

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def number(self, name: str, least: int, most: int, otherwise: int) -> int:
        """An attribute's leading number between bounds; ``otherwise`` where it has none."""
        m = _NUMBER.match(self.get(name) or "")
        return min(max(int(m[1]), least), most) if m else otherwise

    def seen(self) -> bool:
        if self.tag in _UNSEEN or self.tag == "dialog" and self.get("open") is None:
            return False
        if not self.attributes:
            return True
        if self.get("hidden") is not None or self.get("popover") is not None:
            return False
        shown = _DISPLAY.findall(self.get("style") or "")
        return not shown or shown[-1].lower() != "none"

    def veiled(self, around: bool) -> bool:
        """Whether its own text is hidden, given whether the text around it is."""
        if self.attributes and (found := _VISIBILITY.findall(self.get("style") or "")):
            return found[-1].lower() in ("hidden", "collapse") or around and found[-1].lower() != "visible"
        return around


def parse(page: str) -> tuple[Node, int]:
    """The tree of a page and its depth; text is in it as strings."""
    root = Node("#root")
    stack, depth = [root], 1
    opened: Counter[str] = Counter()  # elements of each name in the stack, so that what is not there is not looked for

    def close(until: set[str], within: frozenset[str] | set[str]) -> None:
        if not any(opened[tag] for tag in until):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                for x in stack[k:]:
                    opened[x.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in within:
                return

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = (_TOKEN if at <= last else _LAST).search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag in _BLOCK or tag == "body":
                close({tag}, {"table"} if tag not in ("table", "html", "body") else set())
            else:
                close({tag}, _SCOPE)
            continue
        if tag in _ENDS_P:
            close({"p"}, _SCOPE)
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
            if tag == "tr":
                close({"td", "th", "tr"}, {"table"})
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            opened[stack.pop().tag] -= 1
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            text = page[at : end.start()]
            node.children.append(html.unescape(text) if tag in ("title", "textarea") else text)
            at = end.end()
        elif tag not in _VOID and not (m[3].endswith("/") and (tag in _FOREIGN or any(opened[x] for x in _FOREIGN))):
            if tag in ("tr", "td", "th"):
                for x in reversed(stack):
                    if x.holds_cells or x.tag in ("table", "caption", "pre", "details"):
                        break
                    x.holds_cells = True
            stack.append(node)
            opened[tag] += 1
            depth = max(depth, len(stack))
    return root, depth


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Collects lines. ``gap`` is the number of blank lines owed before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent = ""
        self.first = ""  # a list mark that the next line starts with
        self.blocks = 0
        self.veiled = False  # whether text is hidden here
        self.pre = False  # whether white space counts

    def add(self, text: str) -> None:
        """Inline text: white space is collapsed, also across elements, but for preformatted text."""
        if self.veiled:
            return
        if self.pre:
            head, *rest = text.split("\n")
            self.line.append(head)
            for x in rest:
                self.break_line()
                self.line.append(x)
            return
        text = _WHITE.sub(" ", text)
        if text[:1] == " " and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.line.append(text)

    def taken(self) -> str:
        text = "".join(self.line)
        self.line = []
        return text.rstrip() if self.pre else text.strip(" ")

    def end_line(self) -> None:
        if text := self.taken():
            self.put(text)

    def break_line(self) -> None:
        """Ends the line even if it is empty, but for the first ones of a block."""
        if text := self.taken():
            self.put(text)
        elif self.lines and not self.gap and (self.pre or self.lines[-1]):
            self.lines.append("")

    def put(self, text: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.blocks += 1
        self.lines.append((self.first or self.indent) + text)
        self.first = ""

    def space(self) -> None:
        self.end_line()
        self.gap = 1


def split_table(node: Node, rows: list[list[tuple[Node, bool]]], loose: list[tuple[Node | str, bool]], veiled: bool, row: list[tuple[Node, bool]] | None = None) -> None:
    """Sorts what is seen in a table into rows of cells and all else, which stands before the table; with whether it is veiled."""
    for child in node.children:
        if isinstance(child, str):
            loose.append((child, veiled))
        elif not child.seen():
            continue
        elif child.tag == "tr":
            rows.append([])
            split_table(child, rows, loose, child.veiled(veiled), rows[-1])
        elif child.tag in ("td", "th"):
            rows.append([(child, veiled)]) if row is None else row.append((child, veiled))
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup") or child.holds_cells:
            split_table(child, rows, loose, child.veiled(veiled), row)
        else:
            loose.append((child, veiled))


def render_table(table: Node, out: Layout) -> None:
    rows: list[list[tuple[Node, bool]]] = []
    loose: list[tuple[Node | str, bool]] = []
    split_table(table, rows, loose, out.veiled)
    around = out.veiled
    for node, out.veiled in loose:
        if isinstance(node, Node):
            render(node, out)
            out.end_line()
        elif node.strip():
            out.add(node)
    out.end_line()
    out.veiled = around
    placed: list[list[tuple[int, list[str]]]] = []  # by row: column and lines of each cell
    places = placed_cells([[(cell.number("colspan", 1, 1000, 1), cell.number("rowspan", 0, 65534, 1)) for cell, _ in row] for row in filter(None, rows)])
    for row, columns in zip(filter(None, rows), places, strict=True):
        placed.append([])
        for (cell, veiled), column in zip(row, columns, strict=True):
            inner = Layout()
            inner.veiled, inner.pre = cell.veiled(veiled), out.pre
            for child in cell.children:
                render_child(child, inner)
            inner.end_line()
            placed[-1].append((column, [x for x in inner.lines if x] or [""]))
    widths: dict[int, int] = {}
    for row in placed:
        for column, lines in row:
            widths[column] = max(widths.get(column, 0), *map(width, lines))
    texts = [width(line) for row in placed for _, lines in row for line in lines]
    if sum(widths.values()) * sum(max(len(lines) for _, lines in row) for row in placed) > SPARSE * (sum(texts) + 1000):
        widths = dict.fromkeys(widths, 0)  # few long cells among many short ones: padding would outgrow the page
    order = {column: k for k, column in enumerate(sorted(widths))}
    padded = [widths[column] for column in sorted(widths)]
    for row in placed:
        for k in range(max(len(lines) for _, lines in row)):
            parts, at = [], 0
            for column, lines in row:
                # Columns that a cell from above covers stay empty here.
                parts += [" " * w for w in padded[at : order[column]]]
                text = lines[k] if k < len(lines) else ""
                parts.append(text + " " * (widths[column] - width(text)))
                at = order[column] + 1
            text = " | ".join(parts).rstrip(" ")
            if text.strip(" |"):
                out.put(text)


def placed_cells(rows: list[list[tuple[int, int]]]) -> list[list[int]]:
    """Columns of the cells (colspan, rowspan) of each row; their places in the row where alignment would cost too much."""
    cells = sum(map(len, rows))
    left = SPARSE * cells + 1000  # places that may be looked at or left empty
    out: list[list[int]] = []
    held: list[tuple[int, int, int]] = []  # columns from, to, and the row up to which a cell covers them; in order
    starts: set[int] = set()
    for r, row in enumerate(rows):
        columns: list[int] = []
        now = [h for h in held if h[2] > r]
        after: list[tuple[int, int, int]] = []
        column = k = 0
        for across, down in row:
            while k < len(now) and now[k][0] <= column:
                column = max(column, now[k][1])
                after.append(now[k])
                k += 1
            columns.append(column)
            upto = column + across
            if k < len(now):
                upto = min(upto, max(now[k][0], column + 1))
            last = len(rows) if down == 0 else min(r + down, len(rows))
            if last > r + 1:
                if after and after[-1][1] == column and after[-1][2] == last:
                    after[-1] = (after[-1][0], upto, last)
                else:
                    after.append((column, upto, last))
            column = upto
        held = after + now[k:]
        starts.update(columns)
        out.append(columns)
        left -= len(now) + len(row)
        if left < 0:
            return [list(range(len(row))) for row in rows]
    order = {column: k for k, column in enumerate(sorted(starts))}
    if sum(order[columns[-1]] + 1 for columns in out if columns) > SPARSE * cells + 1000:
        return [list(range(len(row))) for row in rows]
    return out


def render_child(child: Node | str, out: Layout) -> None:
    if isinstance(child, str):
        out.add(child)
    elif child.seen():
        render(child, out)


def render(node: Node, out: Layout) -> None:
    around = out.veiled
    out.veiled = node.veiled(around)
    if node.tag in _APART:
        out.add(" ")
    render_as_seen(node, out)
    if node.tag in _APART:
        out.add(" ")
    out.veiled = around


def render_as_seen(node: Node, out: Layout) -> None:
    tag = node.tag
    if tag == "br":
        if not out.veiled:
            out.break_line()
        return
    if tag == "img":
        if alt := (node.get("alt") or "").strip():
            out.add(f" {alt} ")
        return
    if tag == "hr":
        out.space()
        return
    if tag == "input":
        if (node.get("type") or "").lower() in _BUTTONS and (label := (node.get("value") or "").strip()):
            out.add(f" {label} ")
        return
    spaced, block = tag in _SPACED, tag in _BLOCK
    if block:
        out.end_line()
        if spaced and not (tag in ("ul", "ol") and out.indent):
            out.gap = 1
    if tag in ("option", "optgroup") and (label := (node.get("label") or "").strip()):
        out.add(label)
        out.end_line()
        if tag == "option":
            return
    if tag == "pre":
        start, outer, out.pre = len(out.lines), out.pre, True
        for child in node.children:
            render_child(child, out)
        out.end_line()
        while len(out.lines) > start and not out.lines[-1]:
            out.lines.pop()
        out.pre = outer
    elif tag == "table":
        render_table(node, out)
    elif tag in ("ul", "ol", "menu"):
        number = node.number("start", -(10**9), 10**9, 1) if tag == "ol" else 1
        outer = out.indent
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and child.seen():
                out.end_line()
                mark = f"{number}. " if tag == "ol" else "- "
                out.first, out.indent = outer + mark, outer + " " * len(mark)
                for x in child.children:
                    render_child(x, out)
                out.end_line()
                out.first, out.indent = "", outer
                number += 1
            else:
                render_child(child, out)
        out.end_line()
    elif tag == "details" and node.get("open") is None:
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary" and child.seen():
                render(child, out)
    else:
        outer = out.indent
        if tag == "dd":
            out.indent += "  "
        elif tag == "blockquote":
            out.indent += "> "
        for child in node.children:
            render_child(child, out)
        if block:
            out.end_line()
        out.indent = outer
    if spaced and not (tag in ("ul", "ol") and out.indent):
        out.gap = 1


def find(node: Node, tag: str) -> Node | None:
    """The first element of that name, without recursion into its own text."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == tag:
            return x
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    return None


def extract(page: str) -> tuple[str | None, str, int]:
    """Title, visible text and number of lines with text."""
    root, depth = parse(page)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * depth))
    title = find(root, "title")
    out = Layout()
    for child in root.children:
        render_child(child, out)
    out.end_line()
    name = _WHITE.sub(" ", "".join(c for c in title.children if isinstance(c, str))).strip() if title else None
    return name, "\n".join(out.lines).strip("\n"), out.blocks


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text and n_blocks of each row of ``pages`` (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(text_bytes(batch.column(1))[0]):
                found = [(None, None, 0) if x is None else extract(x) for x in batch.column(1).slice(a, b - a).to_pylist()]
                titles, texts, blocks = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(blocks, pa.int64())], ["page_id", "title", "text", "n_blocks"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(run, SCHEMA)

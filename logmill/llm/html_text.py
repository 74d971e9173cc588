"""Visible text of HTML pages, laid out.

``tree_events`` reads markup into a tree, given as balanced (open, text, close) events:
end tags that authors leave out are implied (a block ends a paragraph, an item the item
before, a cell or row its neighbour), as are rows around bare cells; end tags without a
start are dropped, elements left open end with their parent. ``render`` walks the tree
with a stack, so depth doesn't matter, and writes all text that is visible: blocks on
lines of their own with one blank line around paragraphs, headings, lists and tables,
list items with markers and indentation, preformatted text as it is, the cells of table
columns aligned. Formulas are read inline, the text of drawings line by line.
Invisible are the head, scripts, styles, templates, comments, elements with an attribute
``hidden`` or a style that declares ``display:none`` or ``visibility:hidden``, the content
of media that is shown in its place, and of a closed list of options those not marked as
selected. Not shown, though a browser would: the content of ``textarea``, and the first
option where none is marked.

Cells longer than ``WIDEST`` characters are written whole but don't widen their column,
so a table's text stays in proportion to the page.

Edge cases: null and empty pages give an empty text; markup that never ends is read to
the end of the page; repeated rows are rendered one by one; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDEST = 200
MOST_SPAN = 100

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas datalist textarea "
    "annotation annotation-xml".split()
)
#: Elements whose text shows only inside some of their descendants.
PARTLY = frozenset(("svg", "select"))
SVG_SHOWN = frozenset(("text", "foreignobject"))
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
TABLE_PARTS = frozenset(("thead", "tbody", "tfoot"))
SCOPES = frozenset(("table", "td", "th", "caption", "html", "object", "template"))
#: A start tag ends the open elements of these names, up to one of the limits.
ENDS = {
    "li": (frozenset(("li",)), LISTS | SCOPES),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | SCOPES),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | SCOPES),
    "td": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("table", "tr"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    **{part: (TABLE_PARTS | {"tr", "td", "th", "caption"}, frozenset(("table",))) for part in TABLE_PARTS},
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist")) | SCOPES),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",)) | SCOPES),
    "body": (frozenset(("head",)), frozenset()),
}
IN_PARAGRAPH = frozenset(("p",))
#: An end tag closes its element through open ones of any name but these.
END_LIMITS = {"table": frozenset(), **dict.fromkeys(("tr", "td", "th", *TABLE_PARTS), frozenset(("table",)))}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|(\S*+)))?""")
MAY_HIDE = re.compile(r"hidden|style", re.I)
STYLE_VALUES = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*+"|'[^']*+'|\([^()]*+\)""", re.S)
SPAN = re.compile(r"""(col|row)span\s*=\s*["']?\s*(\d{1,6})""", re.I)
FIRST_NUMBER = re.compile(r"""(?:^|\s)start\s*=\s*["']?\s*(-?\d{1,9})""", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")


def tree_events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("text", text, "") and ("close", tag, "") events."""
    stack: list[str] = []
    at = 0

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > depth:
            yield "close", stack.pop(), ""

    def depth_of(names: frozenset, limits: frozenset) -> int | None:
        """Place of the outermost open element of the names, inside the limits."""
        found = None
        for place in range(len(stack) - 1, -1, -1):
            if stack[place] in names:
                found = place
            elif stack[place] in limits:
                break
        return found

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            yield "text", html.unescape(page[at:]), ""
            break
        if token.start() > at:
            yield "text", html.unescape(page[at : token.start()]), ""
        at = token.end()
        name = token[2]
        if name is None:
            continue
        tag = name.lower()
        if token[1]:
            if tag == "br":
                yield "open", "br", ""
                yield "close", "br", ""
            elif tag in stack:
                limits = END_LIMITS.get(tag, SCOPES)
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == tag or stack[i] in limits), -1)
                if place >= 0 and stack[place] == tag:
                    yield from close_to(place)
            continue
        if tag in BLOCKS:
            place = depth_of(IN_PARAGRAPH, SCOPES | {"button"})
            if place is not None:
                yield from close_to(place)
        if tag in ENDS:
            place = depth_of(*ENDS[tag])
            if place is not None:
                yield from close_to(place)
            if tag in ("td", "th") and stack and (stack[-1] == "table" or stack[-1] in TABLE_PARTS):
                stack.append("tr")
                yield "open", "tr", ""
        yield "open", tag, token[3]
        if tag in VOID or token[3].endswith("/") and tag not in BLOCKS | RAW:
            yield "close", tag, ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            raw = page[at : end.start()] if end else page[at:]
            at = end.end() if end else len(page)
            if raw:
                yield "text", raw, ""
            yield "close", tag, ""
        else:
            stack.append(tag)
    yield from close_to(0)


def _attributes(more: str) -> dict[str, str]:
    """Values by name; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(more):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _declared(style: str) -> dict[str, str]:
    """Values by property; the last counts, important ones before others."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in STYLE_VALUES.sub(" ", style).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, important, _ = value.partition("!")
        name = name.strip()
        if value.strip() and (important or not found.get(name, ("", ""))[0]):
            found[name] = (bool(important), value.strip())
    return {name: value for name, (_, value) in found.items()}


def _hides(more: str) -> bool:
    """Whether the attributes of an element hide it."""
    if not MAY_HIDE.search(more):
        return False
    attributes = _attributes(more)
    if "hidden" in attributes:
        return True
    style = _declared(attributes.get("style", ""))
    return style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")


SHOWN, HIDDEN = "", "hidden"


def _state(within: str, tag: str, more: str) -> str:
    """``SHOWN``, ``HIDDEN``, or the name of the partly shown element that the tag is in."""
    if within == HIDDEN or tag in UNSEEN or more and _hides(more):
        return HIDDEN
    if tag == "select":
        listed = _attributes(more)
        size = listed.get("size", "").strip()
        return SHOWN if "multiple" in listed or size.isdecimal() and int(size[:9]) > 1 else tag
    if tag in PARTLY:
        return tag
    if within == "svg":
        return SHOWN if tag in SVG_SHOWN else HIDDEN if tag in SVG_UNSEEN else within
    if within == "select":
        return SHOWN if tag == "option" and "selected" in _attributes(more) else within
    return SHOWN


class _Flow:
    """Lines of text: collapsed blanks, breaks and gaps between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.marker = ""
        self.gap = False
        self.blank = False

    def text(self, text: str) -> None:
        shown = BLANK.sub(" ", text)
        if shown[:1] == " ":
            self.blank = True
            shown = shown[1:]
        if not shown:
            return
        self._start()
        if self.blank and self.line[-1][-1:] not in ("", " ") and len(self.line) > 1:
            self.line.append(" ")
        self.blank = shown[-1] == " "
        self.line.append(shown[:-1] if self.blank else shown)

    def exact(self, text: str) -> None:
        for k, line in enumerate(text.split("\n")):
            if k:
                self.end(keep=True)
            if line:
                self._start()
                self.line.append(line)

    def _start(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            if self.marker:
                self.line.append(self.indent[: -len(self.marker)] + self.marker)
                self.marker = ""
            else:
                self.line.append(self.indent)

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if it is to be kept."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif keep and not self.gap and self.lines:
            self.lines.append("")
        self.blank = False

    def space(self) -> None:
        self.end()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            self._start()
            self.line.append(line)
            self.end(keep=True)

    def result(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table from rows of cells (lines, columns, rows that they span)."""
    grid, taken = [], {}
    for r, row in enumerate(rows):
        placed, column = [], 0
        for lines, columns, deep in row:
            while (r, column) in taken:
                column += 1
            placed.append((column, lines, columns))
            for down in range(1, min(deep, len(rows) - r)):
                for across in range(columns):
                    taken[(r + down, column + across)] = True
            column += columns
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for column, lines, columns in placed:
            longest = max((len(line) for line in lines), default=0)
            if columns == 1 and longest <= WIDEST:
                widths[column] = max(widths.get(column, 0), longest)
    starts, total = {}, 0
    for column in range(max((c + n for placed in grid for c, _, n in placed), default=0) + 1):
        starts[column] = total
        total += widths.get(column, 0) + 2
    out = []
    for placed in grid:
        for k in range(max((len(lines) for _, lines, _ in placed), default=0)):
            line = ""
            for column, lines, _ in placed:
                cell = lines[k] if k < len(lines) else ""
                if cell:
                    line = f"{line}  " if len(line) > starts[column] else line.ljust(starts[column])
                    line += cell
            out.append(line.rstrip())
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    flow, flows, tables, lists = _Flow(), [], [], []
    pre = 0
    states = [SHOWN]
    for kind, tag, more in tree_events(page or ""):
        if kind == "text":
            if states[-1] != SHOWN:
                continue
            if tables and len(tables) > len(flows):  # between the cells of a table
                if not tag.isspace():
                    tables[-1][1].text(tag)
            elif pre:
                flow.exact(tag)
            else:
                flow.text(tag)
        elif kind == "open":
            within = states[-1]
            states.append(_state(within, tag, more))
            if states[-1] != SHOWN:
                continue
            if within == "svg" or tag == "option" and within == SHOWN:
                flow.end()
            if tag == "br":
                flow.end(keep=True)
            elif tag == "table":
                tables.append(([], flow))
                flow.space()
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables:
                spans = {a.lower(): min(max(int(b), 1), MOST_SPAN) for a, b in SPAN.findall(more)}
                if not tables[-1][0]:
                    tables[-1][0].append([])
                flows.append((flow, spans.get("col", 1), spans.get("row", 1)))
                flow = _Flow()
            elif tag == "hr":
                flow.space()
                flow.block(["---"])
                flow.space()
            elif tag in LISTS:
                flow.end() if lists else flow.space()
                number = FIRST_NUMBER.search(more)
                lists.append([tag, int(number[1]) if number else 1, flow.indent])
            elif tag == "li":
                flow.end()
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent = (lists[-1][2] if lists else "") + " " * len(marker)
                flow.marker = marker
            elif tag == "dd":
                flow.end()
                flow.indent += "    "
            elif tag in SPACED:
                flow.end() if flow.marker else flow.space()
                pre += tag == "pre"
            elif tag in BLOCKS:
                flow.end()
        else:
            if states.pop() != SHOWN:
                continue
            if states[-1] == "svg" or tag == "option" and states[-1] == SHOWN:
                flow.end()
            if tag == "table" and tables:
                rows, outer = tables.pop()
                flow = outer
                flow.block(_aligned(rows))
                flow.space()
            elif tag in ("td", "th") and flows:
                lines = flow.result()
                flow, columns, deep = flows.pop()
                tables[-1][0][-1].append((lines, columns, deep))
            elif tag in LISTS and lists:
                flow.end()
                flow.indent, flow.marker = lists.pop()[2], ""
                if not lists:
                    flow.space()
            elif tag == "li":
                flow.end()
                flow.indent, flow.marker = (lists[-1][2] if lists else ""), ""
            elif tag == "dd":
                flow.end()
                flow.indent = flow.indent[:-4]
            elif tag in SPACED and tag != "hr":
                flow.space()
                pre -= tag == "pre"
            elif tag in BLOCKS:
                flow.end()
    return "\n".join(flow.result())


def visible_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text for each row of ``pages(page_id, url, html)``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render(p) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")

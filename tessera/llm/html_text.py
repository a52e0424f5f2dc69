"""Visible text of HTML pages, laid out as a reader would see it.

A tree builder turns tags into a stack of open elements: start tags close what they imply
(a block closes an open paragraph, an item the item before it, a cell the cell before it),
cells get the row they lack, end tags close up to their element but never out of a cell or
table. A renderer follows the stack. It drops what is not shown (head matter, scripts and
styles, comments, `hidden`, display:none and visibility:hidden, closed details, fallback
content), joins runs of white space except in preformatted text, sets blocks on lines of
their own with a blank line around paragraphs, headings, lists and tables, marks and indents
list items, and pads table cells so that columns line up (row and column spans included).

Time and text are in proportion to the page, however it nests: lines are indented by MOST_INDENT
places at most, a column is taken for MOST_WIDTH places wide at most and lined up within the
first MOST_LINE, a span counts for MOST_SPAN cells at most, and tables in more than MOST_NEST
others are laid out as blocks. Text itself is never cut.

Defined results: a null or empty page has an empty text; markup that never closes ends with the
page; a page of any length is rendered whole; repeated rows are rendered alike, each with its
row, and a null page_id stays null; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp meta link base param source track".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: Blocks with a blank line around them, and those on lines of their own.
SPACED = HEADINGS | LISTS | frozenset("p blockquote pre table dl figure hr xmp".split())
BLOCKS = SPACED | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav option optgroup section select summary tr tbody thead tfoot textarea".split()
)
CLOSE_P = (SPACED | frozenset("address article aside center details dialog div fieldset figcaption footer form header hgroup main nav section summary li dd dt".split())) - {"table"}
#: Start tag: what it closes, and the elements that this does not reach beyond.
IMPLIED = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
IMPLIED |= {k: IMPLIED["tbody"] for k in ("thead", "tfoot", "caption", "colgroup")} | {"rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"})}
IMPLIED |= {k: (HEADINGS, BLOCKS - HEADINGS) for k in HEADINGS}
WALLS = frozenset(("td", "th", "table", "caption"))
CLOSED_IN = WALLS | {"button"}
#: Whose end tags reach out of a cell, but not out of the table.
TABLE_PARTS = WALLS - {"table"} | frozenset("tr tbody thead tfoot html body".split())
MOST_SPAN, MOST_INDENT, MOST_WIDTH, MOST_LINE, MOST_NEST = 100, 40, 80, 400, 20


def _attributes(source: str) -> dict[str, str]:
    if not source.strip(" \t\n\r\f/"):
        return {}
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return int(m[1]) if m else default


class _Flow:
    """Lines of one stretch of layout: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.space = False
        self.indent = 0
        self.marker: str | None = None

    def text(self, s: str) -> None:
        words = _SPACES.split(s)
        if not words[0]:
            self.space = True
        for k, w in enumerate(words):
            if k:
                self.space = True
            if w:
                if self.space and self.now:
                    self.now.append(" ")
                self.now.append(w)
                self.space = False

    def _line(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker is not None:
            head, self.marker = " " * min(self.indent - len(self.marker), MOST_INDENT) + self.marker, None
        else:
            head = " " * min(self.indent, MOST_INDENT)
        self.lines.append((head + s).rstrip())

    def end_line(self, always: bool = False) -> None:
        if self.now or always:
            self._line("".join(self.now))
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def verbatim(self, lines: list[str]) -> None:
        for s in lines:
            self.now.append(s)
            self.end_line(True)


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        grid: list[dict[int, list[str]]] = []
        spans: dict[int, int] = {}  # column to rows that a cell above still takes
        single: dict[int, int] = {}
        wide: list[tuple[int, int, int]] = []
        for row in self.rows:
            here: dict[int, list[str]] = {}
            at, taken = 0, dict(spans)
            for lines, across, down in row:
                while taken.get(at, 0) > 0:
                    at += 1
                here[at] = lines
                need = max(map(len, lines), default=0)
                if across == 1:
                    single[at] = max(single.get(at, 0), need)
                else:
                    wide.append((at, across, need))
                for c in range(at, at + across):
                    spans[c] = down
                    taken[c] = down
                at += across
            spans = {c: n - 1 for c, n in spans.items() if n > 1}
            grid.append(here)
        columns = max((c + 1 for g in grid for c in g), default=0)
        width = [min(single.get(c, 0), MOST_WIDTH) for c in range(columns)]
        for at, across, need in wide:
            last = min(at + across, columns) - 1
            have = sum(width[at : last + 1]) + 2 * (last - at)
            if need > have:
                width[last] = max(width[last], min(width[last] + need - have, MOST_WIDTH))
        start = [min(x, MOST_LINE) for x in accumulate(width, lambda a, w: a + w + 2, initial=0)]
        out = []
        for here in grid:
            for k in range(max((len(x) for x in here.values()), default=0)):
                line = ""
                for c, cell in sorted(here.items()):
                    if k < len(cell) and cell[k]:
                        line = (line + "  " * bool(line)).ljust(start[c]) + cell[k]
                out.append(line)
        return out


class _Page:
    def __init__(self):
        self.open: list[tuple] = []  # (tag, hides, extra)
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag that is open, in `open`
        self.nested = 0  # tables beyond MOST_NEST
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.unseen = self.pre = 0
        self.lists: list[list] = []

    def text(self, s: str) -> None:
        if self.unseen and self.open[-1][0] == "head" and s.strip(" \t\n\r\f"):
            self.close_to(len(self.open) - 1)  # text implies the body
        if self.unseen or not s:
            return
        if "&" in s:
            s = unescape(s)
        top, _, extra = self.open[-1] if self.open else ("", False, None)
        if extra == "closed" or top in ("table", "tr", "tbody", "thead", "tfoot") and not s.strip(" \t\n\r\f"):
            return
        flow = self.flows[-1]
        if self.pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            flow.now.append(first)
            for x in rest:
                flow.end_line(True)
                flow.now.append(x)
            if not flow.now[-1]:
                flow.now.pop()
        else:
            flow.text(s)

    def close_to(self, index: int) -> None:
        while len(self.open) > index:
            self.places[self.open[-1][0]].pop()
            self._leave(self.open.pop())

    def last(self, tags: Iterable[str]) -> int:
        """Where the innermost open one of tags is, or -1."""
        return max((x[-1] for t in tags if (x := self.places.get(t))), default=-1)

    def start(self, tag: str, source: str) -> None:
        names = self.open
        if tag in ("html", "body") and self.places.get(tag):
            return
        if names and names[-1][0] == "head" and tag not in UNSEEN:
            self.close_to(len(names) - 1)
        if tag in CLOSE_P or tag in HEADINGS:
            at = self.last(("p",))
            if at > self.last(CLOSED_IN):
                self.close_to(at)
        if tag in IMPLIED:
            closes, walls = IMPLIED[tag]
            wall = self.last(walls)
            inside = [x[k] for t in closes if (x := self.places.get(t)) and (k := bisect_right(x, wall)) < len(x)]
            if inside:
                self.close_to(min(inside))
        if tag in ("td", "th") and self.tables and (not names or names[-1][0] != "tr") and self.last(("table",)) > self.last(("tr",)):
            self._enter("tr", {})
        self._enter(tag, _attributes(source))
        if tag in VOID:
            self.close_to(len(names) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        at = self.last(HEADINGS if tag in HEADINGS else (tag,))
        wall = self.last(() if tag == "table" else ("table",) if tag in TABLE_PARTS else WALLS)
        if at > wall:
            self.close_to(at)

    def _enter(self, tag: str, got: dict[str, str]) -> None:
        parent = self.open[-1][0] if self.open else ""
        hide = (
            tag in UNSEEN or "hidden" in got or tag == "dialog" and "open" not in got
            or "style" in got and bool(_UNSEEN_STYLE.search(got["style"]))
            or parent == "details" and self.open[-1][2] == "closed" and tag != "summary"
        )
        extra = None
        if hide:
            self.unseen += 1
        if tag == "details" and "open" not in got:
            extra = "closed"
        if not self.unseen:
            extra = self._show(tag, got) or extra
        self.places[tag].append(len(self.open))
        self.open.append((tag, hide, extra))

    def _show(self, tag: str, got: dict[str, str]):
        flow = self.flows[-1]
        if tag == "br":
            flow.end_line(True)
        elif tag in ("td", "th", "caption") and self.nested:
            flow.block(False)
        elif tag in ("td", "th", "caption") and self.tables:
            if tag != "caption" and not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.flows.append(_Flow())
            down = _number(got.get("rowspan"), 1)
            return ("cell", max(1, min(MOST_SPAN, _number(got.get("colspan"), 1))), max(1, min(MOST_SPAN, down)))
        elif tag == "table":
            flow.block(True)
            if len(self.tables) >= MOST_NEST:
                self.nested += 1
                return ("nested",)
            self.tables.append(_Table())
            return ("table",)
        elif tag == "tr" and self.tables and not self.nested:
            self.tables[-1].rows.append([])
        elif tag in BLOCKS:
            nested = tag in LISTS and bool(self.lists)
            flow.block(tag in SPACED and not nested)
            if tag in LISTS:
                self.lists.append([tag, _number(got.get("start"), 1)])
                return ("list", flow)
            if tag == "li":
                mark = "- "
                if self.lists and self.lists[-1][0] == "ol":
                    n = _number(got.get("value"), self.lists[-1][1])
                    self.lists[-1][1], mark = n + 1, f"{n}. "
                if flow.marker is not None:
                    flow.end_line(True)
                flow.marker = mark
                flow.indent += len(mark)
                return ("indent", flow, len(mark))
            if tag in ("dd", "blockquote"):
                flow.indent += 2
                return ("indent", flow, 2)
            if tag in ("pre", "xmp", "textarea"):
                self.pre += 1
                return ("pre",)
            if tag == "hr":
                flow.verbatim(["---"])
                flow.gap = True
        elif tag == "input" and got.get("type", "").lower() in ("submit", "button", "reset"):
            flow.text(" " + got.get("value", "") + " ")
        elif tag == "q":
            flow.text('"')
        return None

    def _leave(self, element: tuple) -> None:
        tag, hide, extra = element
        flow = self.flows[-1]
        if not self.unseen:
            what = extra[0] if isinstance(extra, tuple) else ""
            if what == "cell":
                flow.end_line()
                self.flows.pop()
                if tag == "caption":
                    self.flows[-1].verbatim(flow.lines)
                elif self.tables and self.tables[-1].rows:
                    self.tables[-1].rows[-1].append((flow.lines, extra[1], extra[2]))
            elif what == "table":
                flow.end_line()
                flow.verbatim(self.tables.pop().lines())
                flow.gap = True
            elif what == "nested":
                flow.block(True)
                self.nested -= 1
            elif tag == "q":
                flow.text('"')
            elif tag in BLOCKS:
                if what == "pre":
                    self.pre -= 1
                flow.block(tag in SPACED and not (tag in LISTS and len(self.lists) > 1))
                if what == "list":
                    self.lists.pop()
                if what == "indent":
                    if tag == "li" and flow.marker is not None:
                        flow.end_line(True)
                    extra[1].indent -= extra[2]
        if hide:
            self.unseen -= 1

    def render(self) -> str:
        self.close_to(0)
        self.flows[0].end_line()
        lines = self.flows[0].lines
        while lines and not lines[-1]:
            lines.pop()
        first = next((k for k, x in enumerate(lines) if x), 0)
        return "\n".join(lines[first:])


def visible_text(page: str) -> str:
    if not page:
        return ""
    page = page.replace("\x00", "")
    out, at, n = _Page(), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            out.text(page[at:])
            break
        if m.start() > at:
            out.text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, source = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            out.end(tag)
            continue
        out.start(tag, source)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            body, at = page[at : close.start() if close else n], close.start() if close else n
            out.text(body.removeprefix("\n"))
        elif tag == "pre" and page.startswith("\n", at):
            at += 1
        elif tag == "plaintext":
            out.text(page[at:].replace("&", "&amp;"))
            break
    return out.render()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of each row of pages."""
    modest_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x.as_py()) for x in b.column(1)], pa.string())], ["page_id", "text"])

    found = pages.select("page_id", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    return found.withColumns({"n_chars": F.length("text").cast("long"), "n_lines": lines.cast("long")})

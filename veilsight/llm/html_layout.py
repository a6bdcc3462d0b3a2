"""Visible text of HTML pages with their layout: blocks, lists, preformatted text, aligned tables."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)"""
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: HTML white space; a no-break space is none.
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes noscript xmp".split())
ESCAPABLE = frozenset("title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary ul table caption".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul dir".split())
UNSEEN = frozenset(
    "area base basefont datalist head iframe link meta noembed noframes noscript param rp script style template title audio video canvas object".split()
)
LISTS = ("ul", "ol", "menu", "dir")
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "caption", "legend", "summary"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes an open element of these kinds, unless one of the walls lies between.
IMPLIED_END = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
}
#: No end tag but their own reaches over these.
WALLS = frozenset("table td th caption template html".split())
P_WALLS = WALLS | {"button"}
#: End tags of a table's parts reach over what stands in them.
END_WALLS = {"table": frozenset()} | dict.fromkeys(("tr", "thead", "tbody", "tfoot", "td", "th", "caption"), frozenset(["table"]))
INLINE_IN_HEAD = frozenset("base link meta script style title template noscript html head".split())

#: Drawings and formulas: what is not rendered where it stands, whose content is HTML again, and of whose children only the first is rendered.
FOREIGN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
HTML_INSIDE = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mn mo ms mtext".split())}
FIRST_ONLY = frozenset("switch semantics maction".split())
#: HTML start tags that end a drawing or formula.
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
#: Inputs that show their value.
BUTTONS = frozenset("submit reset button".split())

#: Cells are padded to the widest of their column up to so many characters; longer ones stand as they are.
WIDEST_PADDING = 60
#: Blanks between two cells of a line, at most.
WIDEST_GAP = 240
#: Levels that are indented, and tables in tables that are laid out in columns; what lies deeper stands as deep as these.
DEEPEST = 32
INDENT = "  "


class Flow:
    """Lines of a block container. White space collapses; blank lines are kept between, not at the edges."""

    def __init__(self, above: int = 0):
        """`above`: levels around this container."""
        self.above = above
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0  # 1: a new line is due, 2: a blank line
        self.prefix: list[str] = []
        self.marker: str | None = None

    def text(self, data: str) -> None:
        if not data:
            return
        words = _SPACE.sub(" ", data)
        if words == " ":
            self.space = True
            return
        if words[0] == " ":
            self.space = True
        self._begin()
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words.strip(" "))

    def raw(self, data: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(data.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.new_line()
            if line:
                self._begin()
                if self.space and self.parts:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(line)

    def _begin(self) -> None:
        if self.gap:
            self._end_line()
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.parts:
            self.space = False

    def _end_line(self) -> None:
        if self.parts:
            self.lines.append(self._lead() + "".join(self.parts))
            self.parts = []
        self.space = False

    def _indent(self) -> str:
        return "".join(self.prefix[: max(0, DEEPEST - self.above)])

    def _lead(self) -> str:
        lead = self._indent()
        if self.marker is not None:
            if 0 < len(self.prefix) <= DEEPEST - self.above:
                lead = lead[: -len(self.marker)]
            lead += self.marker
            self.marker = None
        return lead

    def new_line(self) -> None:
        """A line break; an empty line if nothing stands in this one."""
        if self.gap:
            self._begin()
        if self.parts:
            self._end_line()
        else:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self._end_line()
        self.gap = max(self.gap, 2 if spaced else 1)
        self.space = False

    def add(self, lines: list[str]) -> None:
        """Finished lines, as a block."""
        if lines:
            self._begin()
            self._end_line()
            lead, rest = self._lead(), self._indent()
            self.lines += [(rest if k else lead) + line if line else "" for k, line in enumerate(lines)]

    def done(self) -> list[str]:
        self._end_line()
        first, last = 0, len(self.lines)
        while first < last and not self.lines[first].strip(" "):
            first += 1
        while last > first and not self.lines[last - 1].strip(" "):
            last -= 1
        return self.lines[first:last]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((lines, across, down))

    def _places(self) -> list[list[tuple[int, list[str]]]]:
        """Cells of each row with the columns they begin in."""
        rows = [row for row in self.rows if row]
        grid: list[list[tuple[int, list[str]]]] = []
        held: list[tuple[int, int, int]] = []  # columns from and to, and the row before which a cell ends
        for row in rows:
            held = [h for h in held if h[2] > len(grid)]
            out, begun, at, k = [], [], 0, 0
            for lines, across, down in row:
                while k < len(held) and held[k][0] <= at:
                    at = max(at, held[k][1])
                    k += 1
                out.append((at, lines))
                if down > 1:
                    begun.append((at, at + across, min(len(rows), len(grid) + down)))
                at += across
            if begun:
                held = sorted(held + begun)
            grid.append(out)
        return grid

    def lines(self) -> list[str]:
        """Columns side by side. Spanned places stay empty; a column in which no cell begins takes no room."""
        grid = self._places()
        widths: dict[int, int] = {}
        for row in grid:
            for column, lines in row:
                wide = max((len(x) for x in lines), default=0)
                widths[column] = max(widths.get(column, 0), wide if wide <= WIDEST_PADDING else 0)
        begins, at = {}, 0
        for column in sorted(widths):
            begins[column] = at
            at += widths[column] + 2
        out = list(self.caption)
        for row in grid:
            made: list[list[str]] = []
            ends: list[int] = []  # where the line ends if no cell is wider than its column
            for column, lines in row:
                for i, text in enumerate(lines):
                    if i == len(made):
                        made.append([])
                        ends.append(0)
                    if text:
                        made[i].append(" " * min(WIDEST_GAP, begins[column] - ends[i]) + text)
                        ends[i] = begins[column] + min(len(text), widths[column])
            out += ["".join(parts).rstrip(" ") for parts in made]
        return out


class Element:
    __slots__ = ("attributes", "count", "flow", "foreign", "hidden", "inner", "lit", "name", "pre", "shown", "step", "table")

    def __init__(self, name: str, attributes: dict, parent: Element | None):
        self.name, self.attributes = name, attributes
        self.hidden = parent is not None and parent.hidden  # not rendered
        self.shown = parent is None or parent.shown  # visibility, which children may change back
        self.pre = parent is not None and parent.pre
        self.flow = self.table = None
        self.count, self.step = 0, 1
        self.foreign = name if name in FOREIGN else parent.inner if parent is not None else ""  # svg, math or (HTML) empty
        html_inside = name in HTML_INSIDE.get(self.foreign, ()) or name == "annotation-xml" and "html" in attributes.get("encoding", "").lower()
        self.inner = "" if html_inside else self.foreign  # of the children
        # of a drawing, only what stands in its texts is rendered
        self.lit = self.foreign != "svg" or name in ("text", "foreignobject") or name != "svg" and parent is not None and parent.foreign == "svg" and parent.lit


def number(text: str | None, least: int, most: int, otherwise: int) -> int:
    try:
        return min(most, max(least, int((text or "").strip())))
    except ValueError:
        return otherwise


def _style(attributes: dict) -> dict:
    pairs = (x.split(":", 1) for x in attributes.get("style", "").lower().split(";") if ":" in x)
    return {k.strip(): v.replace("!important", "").strip() for k, v in pairs}


class Renderer:
    """Builds the tree as a browser would, and lays out each part as soon as it is closed."""

    def __init__(self):
        root = Element("#root", {}, None)
        root.flow = Flow()
        self.stack = [root]
        self.body = root.flow
        self.flows = [root.flow]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name

    # --- tree

    def flow(self) -> Flow:
        return self.flows[-1]

    def open_names(self, names, walls) -> int | None:
        """The innermost open element of these names, if none of the walls is nearer."""
        at = max((self.places[n][-1] for n in names if self.places[n]), default=None)
        if at is None or any(self.places[w] and self.places[w][-1] > at for w in walls):
            return None
        return at

    def start(self, name: str, attributes: dict, closed: bool = False) -> None:
        """`closed`: the tag ends in a slash, which counts in drawings and formulas."""
        if name in ("html", "#root"):
            return
        if name == "body" and self.open_names(("body",), ()) is not None:
            return
        if self.stack[-1].inner and (name in ENDS_FOREIGN or name == "font" and not {"color", "face", "size"}.isdisjoint(attributes)):
            while self.stack[-1].inner:
                self.close(len(self.stack) - 1)
        if name not in INLINE_IN_HEAD and (at := self.open_names(("head",), ())) is not None:
            self.close(at)
        if name in IMPLIED_END:
            names, walls = IMPLIED_END[name]
            while (at := self.open_names(names, walls)) is not None:
                self.close(at)
        if name in CLOSES_P and (at := self.open_names(("p",), P_WALLS)) is not None:
            self.close(at)
        if name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.close(len(self.stack) - 1)
        if name in ("td", "th") and self.open_names(("tr",), ("table",)) is None and self.open_names(("table",), ()) is not None:
            self.start("tr", {})
        if name == "tr" and self.open_names(("table",), ()) is not None:
            table = self.stack[self.open_names(("table",), ())].table
            if table is not None:  # an unrendered one has no rows
                table.rows.append([])
        element = Element(name, attributes, self.stack[-1])
        self.see(element)
        if not element.hidden:
            self.enter(element)
        if name in VOID:
            return
        self.places[name].append(len(self.stack))
        self.stack.append(element)
        if closed and element.foreign:
            self.close(len(self.stack) - 1)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", {})
        if name == "p" and self.open_names(("p",), WALLS) is None:
            self.start("p", {})
        names = tuple(HEADINGS) if name in HEADINGS else (name,)
        at = self.open_names(names, END_WALLS.get(name, WALLS))
        if at is not None and name not in ("html", "body"):
            self.close(at)

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            element = self.stack.pop()
            self.places[element.name].pop()
            if element.flow is not None:
                self.flows.pop()
            if not element.hidden:
                self.leave(element)

    # --- visibility

    def see(self, e: Element) -> None:
        style = _style(e.attributes) if "style" in e.attributes else {}
        if e.foreign:
            parent = self.stack[-1]
            if parent.foreign and parent.name in FIRST_ONLY:
                parent.count += 1
            if e.name in FOREIGN[e.foreign] or parent.foreign and parent.name in FIRST_ONLY and parent.count > 1:
                e.hidden = True
            if e.foreign == "svg":
                style = {k: e.attributes[k].lower().strip() for k in ("display", "visibility") if k in e.attributes} | style
        if e.name in UNSEEN or "hidden" in e.attributes or style.get("display") == "none":
            e.hidden = True
        elif e.name == "dialog" and "open" not in e.attributes or e.name == "input" and e.attributes.get("type", "").lower() == "hidden":
            e.hidden = True
        elif len(self.stack) > 1 and self.stack[-1].name == "details" and "open" not in self.stack[-1].attributes and e.name != "summary":
            e.hidden = True
        seen = style.get("visibility")
        if seen in ("hidden", "collapse"):
            e.shown = False
        elif seen == "visible":
            e.shown = True
        if e.name in ("pre", "listing", "textarea") or style.get("white-space", "").startswith("pre"):
            e.pre = True
        elif style.get("white-space") in ("normal", "nowrap"):
            e.pre = False

    # --- layout

    def enter(self, e: Element) -> None:
        flow, name = self.flow(), e.name
        if e.foreign:
            self.bound(e)
        if name == "br":
            flow.new_line()
        elif name == "img" and e.shown and e.attributes.get("alt", "").strip():
            flow.text(e.attributes["alt"])
        elif name == "input" and e.shown:
            kind = e.attributes.get("type", "").lower().strip()
            label = e.attributes.get("value", "") if kind in BUTTONS else e.attributes.get("alt", "") if kind == "image" else ""
            if label.strip():
                flow.space = True
                flow.text(label)
                flow.space = True
        elif name == "table":
            if len(self.places["table"]) < DEEPEST:
                e.table = Table()
            else:
                flow.block(True)
        elif name in ("td", "th", "caption"):
            at = self.open_names(("table",), ())
            if at is None or self.stack[at].table is not None:
                e.flow = Flow(flow.above + len(flow.prefix))
                self.flows.append(e.flow)
            else:
                flow.block(False)
        elif name in BLOCKS:
            flow.block(name in SPACED and not (name in LISTS and self.open_names(("li",), WALLS) is not None))
            if name in LISTS:
                e.step = -1 if "reversed" in e.attributes else 1
                e.count = number(e.attributes.get("start"), -(10**9), 10**9, 1)
            elif name == "li":
                at = self.open_names(LISTS, ())
                marker = "- "
                if at is not None and self.stack[at].name == "ol":
                    box = self.stack[at]
                    box.count = number(e.attributes.get("value"), -(10**9), 10**9, box.count)
                    marker = f"{box.count}. "
                    box.count += box.step
                flow.prefix.append(" " * len(marker))
                if e.shown:
                    flow.marker = marker
            elif name in ("blockquote", "dd"):
                flow.prefix.append(INDENT)

    def bound(self, e: Element) -> None:
        """Labels of a drawing, and parts of a formula that stand above one another or in columns, are words of their own."""
        name, flow = e.name, self.flow()
        if name == "foreignobject" or name == "math" and e.attributes.get("display", "").lower() == "block":
            flow.block(False)
        elif name in ("text", "mtr", "mtd", "mspace") or self.stack[-1].name == "mfrac" or name == "tspan" and not {"x", "y", "dy"}.isdisjoint(e.attributes):
            flow.space = True

    def leave(self, e: Element) -> None:
        name = e.name
        if e.foreign:
            self.bound(e)
        if e.table is not None:
            flow = self.flow()
            flow.block(True)
            flow.add(e.table.lines())
            flow.block(True)
        elif e.flow is not None:
            at = self.open_names(("table",), ())
            lines = e.flow.done()
            if at is None or self.stack[at].table is None:
                self.flow().block(False)
                self.flow().add(lines)
            elif name == "caption":
                self.stack[at].table.caption += lines
            else:
                table = self.stack[at].table
                table.cell(lines, number(e.attributes.get("colspan"), 1, 1000, 1), number(e.attributes.get("rowspan"), 1, 65534, 1))
        elif name in BLOCKS:
            flow = self.flow()
            if name in ("li", "blockquote", "dd") and flow.prefix:
                flow._end_line()
                flow.prefix.pop()
                flow.marker = None
            nested = name in LISTS and self.open_names(("li",), WALLS) is not None
            flow.block(name in SPACED and not nested)
        elif name in ("td", "th"):
            self.flow().block(False)

    def data(self, text: str) -> None:
        e = self.stack[-1]
        if e.hidden or not e.shown or not text:
            if e.name == "head" and text.strip():
                self.close(self.open_names(("head",), ()))
                self.data(text)
            return
        if e.name == "details" and "open" not in e.attributes:
            return
        if e.name in ("table", "tr", "tbody", "thead", "tfoot", "colgroup", "select") and not text.strip():
            return
        if e.foreign:
            if not e.lit or e.inner == "math" and not text.strip():
                return
            if e.name == "mn" and self.flow().parts and self.flow().parts[-1][-1].isdigit():
                self.flow().space = True  # an exponent is no further digit
            if e.foreign == "math" and e.name != "mtext":
                text = _SPACE.sub(" ", text).strip(" ")
        if e.pre:
            self.flow().raw(text)
        else:
            self.flow().text(text)


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    if not attributes.endswith("/"):
        return False
    cut = max(attributes.rfind(c) for c in "\"' \t\n\r\f") + 1
    return "=" not in attributes[cut:] and not attributes[:cut].rstrip().endswith("=")


def render(page: str | None) -> str:
    """Visible text of a page. Broken markup is read as far as it goes; null and empty pages give an empty text."""
    if not page:
        return ""
    r, at = Renderer(), 0
    after_pre = False
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            text = html.unescape(m["text"]) if m["text"] is not None else m["cdata"]
            r.data(text.removeprefix("\n") if after_pre else text)
        elif m["end"]:
            r.end(m["end"].lower())
        elif m["start"]:
            name = m["start"].lower()
            attributes: dict[str, str] = {}
            for k, a, b, c in _ATTRIBUTE.findall(m["attributes"]) if m["attributes"] else ():
                attributes.setdefault(k.lower(), html.unescape(a or b or c))
            r.start(name, attributes, self_closed(m["attributes"]))
            if (name in RAW or name in ESCAPABLE) and r.stack[-1].name == name:  # none that a slash has closed
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
                if name in ESCAPABLE:
                    r.data(html.unescape(page[at : close.start()]))
                elif name == "xmp":
                    r.data(page[at : close.start()])
                at = close.end()
                r.end(name)
        after_pre = bool(m["start"]) and m["start"].lower() in ("pre", "listing")
    r.close(1)
    return "\n".join(x.rstrip(" ") for x in r.body.done())


def visible_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, text.

    Start tags close what they imply (`<p>` before a block, `<li>`, `<td>`, `<tr>`, ...); end
    tags without a start are passed over. Unseen are scripts, styles, the head, `hidden`,
    display:none, visibility:hidden unless changed back below, closed details and dialogs.
    Blocks stand on lines of their own, with a blank line where browsers leave a margin;
    list items get a dash or number and an indent; cells of a table stand in columns. Beyond
    DEEPEST levels nothing is indented further, and cells of a table in so many tables stand
    one below another; at most WIDEST_GAP blanks stand between two cells. No text is dropped.

    Of drawings the texts and foreign objects are seen, not titles, descriptions, definitions
    (what <use> draws of them is not repeated) and metadata; of formulas all but annotations.
    Labels, stacked parts and cells in them are parted by a blank. Buttons made by `input`
    show their value, image buttons their alt text; a label that only the browser would give
    is none. What stands in other fields is the user's and not text of the page. Not rendered
    here are what stands in for frames, audio, video, canvas and objects.

    Null and empty pages give empty text. Repeated rows give a row each. Other columns are not
    read; very long pages go one at a time. An empty table gives no rows.
    """
    def make(part: pa.RecordBatch) -> dict:
        return {"page_id": part.column("page_id"), "text": pa.array([render(h) for h in part.column("html").to_pylist()], pa.string())}

    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"].cast("string").alias("html"))
    return map_rows(slim, make, "page_id long, text string", text="html")

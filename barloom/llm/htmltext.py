"""Visible text of web pages, laid out (operator 10).

A tree is built from the tags as a browser would, as far as text needs it: end tags that may be left out are implied (a
paragraph ends at the next block, an item at the next item, a cell at the next cell or row), the head ends at the first
thing that can't be in it, void elements have no content, stray end tags are passed over. The tree is then rendered:
elements that are never shown or not displayed are left out with all inside them, closed dialogs and details among them;
invisible ones leave nothing, not even a line's end, but for visible ones inside; formulas (MathML) and the labels of inline diagrams (SVG) are shown,
without their annotations and definitions, a label to a line; white space collapses but for preformatted text; blocks stand on
lines of their own, paragraphs and headings with an empty line around them; list items have markers or numbers and are
indented by depth; table cells are padded so that columns align, wide characters counting as two.

Of style sheets in the page, rules are read whose selectors consist of a tag, classes and an id of one element, at the top or
in a medium that is all or the screen; importance, specificity and order decide as in the standard. Others are passed over.

A null page has a null text, an empty page an empty one. Repeated rows are rendered each. Markup of any kind is rendered
somehow, never refused. Time and memory are in proportion to a page; nesting of any depth is walked without recursion.
Only the id and the page column are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never shown, whatever the style.
UNSHOWN = frozenset("head title script style template noscript noframes noembed iframe object video audio canvas datalist rp".split())
# SVG and MathML are shown but for these; SVG has text in its text elements only.
UNSHOWN_FOREIGN = frozenset("annotation annotation-xml defs desc metadata title symbol clippath mask pattern marker".split())
TEXT_IN_FOREIGN = frozenset("text foreignobject math".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())  # what they hold is HTML again
# Start tags that end SVG and MathML around them, as in the standard.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
IN_HEAD = frozenset("base link meta title style script template noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure".split())  # an empty line around them
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
# What a start tag ends, and what it doesn't look beyond.
ENDS = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir td th table".split())),
    "dt": (frozenset(("dt", "dd")), frozenset("dl td th table".split())),
    "tr": (frozenset("tr td th caption".split()), frozenset(("table",))),
    "td": (frozenset("td th caption".split()), frozenset(("table", "tr"))),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup"))),
    "p": (frozenset(("p",)), frozenset("td th table caption button".split())),
}
ENDS |= {"dd": ENDS["dt"], "th": ENDS["td"], "thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
SELECTOR = re.compile(r"(?P<tag>[a-z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+)*)", re.I)
ON_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)?", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
MAX_SPAN = 1000  # columns or rows that a cell may span, as in the standard


class Node:
    __slots__ = ("attrs", "children", "foreign", "mute", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.foreign = tag in ("svg", "math") or (parent is not None and parent.foreign and parent.tag not in INTEGRATION)
        self.mute = tag == "svg" or (parent is not None and parent.mute and tag not in TEXT_IN_FOREIGN)  # its characters aren't drawn

    def style(self, sheet: Sheet) -> tuple[str, str | None]:
        """What it is displayed as ("none" or else), and its own visibility, if it states one."""
        a = self.attrs
        if self.tag in UNSHOWN or (self.tag == "input" and (a.get("type") or "").lower() == "hidden"):
            return "none", None
        if self.foreign and (self.tag in UNSHOWN_FOREIGN or a.get("display") == "none"):
            return "none", None
        closed = "hidden" in a or (self.tag == "dialog" and "open" not in a)
        found = {"display": ((False, -1, 0), "none" if closed else ""), "visibility": ((False, -1, 0), a.get("visibility") if self.foreign else None)}
        own = declared(a["style"] or "") if "style" in a else ()
        for name, value, weight in (*sheet.of(self), *((n, v, (i, 1 << 30, k)) for k, (n, v, i) in enumerate(own))):
            found[name] = max(found[name], (weight, value), key=lambda x: x[0])
        return found["display"][1], found["visibility"][1]

    def displayed(self) -> list[Node | str]:
        """Its children, but for those of closed details that aren't their summary."""
        if self.tag != "details" or "open" in self.attrs:
            return self.children
        return [c for c in self.children if isinstance(c, Node) and c.tag == "summary"][:1]


def declared(text: str) -> list[tuple[str, str, bool]]:
    """The declarations that matter here, and whether each is important."""
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in DECLARED.finditer(COMMENT.sub("", text))]


class Sheet:
    """Rules of a page's style sheets, found by an id, a class or a tag of their selector."""

    def __init__(self, texts: list[str]):
        self.rules: dict[str, list] = {}
        for order, (selectors, body) in enumerate(r for text in texts for r in self._blocks(COMMENT.sub("", text))):
            for one in selectors.split(","):
                m = SELECTOR.fullmatch(one.strip())
                if m and one.strip() and (made := declared(body)):
                    names = re.findall(r"[.#][\w-]+", m["rest"])
                    tag = (m["tag"] or "*").lower()
                    weight = sum(10_000 if n[0] == "#" else 100 for n in names) + (tag != "*")
                    self.rules.setdefault(names[0] if names else tag, []).append((tag, frozenset(names), weight, order, made))

    @staticmethod
    def _blocks(text: str) -> Iterator[tuple[str, str]]:
        """(selectors, declarations) of the rules that hold on a screen; what is left open ends with the text."""
        open_, at = [], 0
        for m in re.finditer(r"[{}]", text + "}"):
            chunk, at = text[at : m.start()], m.end()
            if m[0] == "{":
                open_.append(chunk.rpartition(";")[2].strip())
            elif open_:
                head = open_.pop()
                media = [h[6:].split(",") for h in open_ if h[:6].lower() == "@media"]
                if not head.startswith("@") and len(media) == len(open_) and all(any(ON_SCREEN.fullmatch(x.strip()) for x in m) for m in media):
                    yield head, chunk

    def of(self, node: Node) -> Iterator[tuple[str, str, tuple[bool, int, int]]]:
        if not self.rules:
            return
        names = {f".{c}" for c in (node.attrs.get("class") or "").split()} | {f"#{i}" for i in (node.attrs.get("id") or "").split()[:1]}
        for key in (*names, node.tag, "*"):
            for tag, needed, weight, order, made in self.rules.get(key, ()):
                if tag in ("*", node.tag) and needed <= names:
                    for name, value, important in made:
                        yield name, value, (important, weight, order)


def columns(text: str) -> int:
    """How wide a text is: wide characters take two columns, those that combine with others none."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class TreeBuilder(HTMLParser):
    """The tree of a page; ``root`` holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.sheets: list[str] = []

    def _pop_to(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Closes the innermost open element of these tags with all inside it, unless one of ``stop`` comes first."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.count.subtract(n.tag for n in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def _break_out(self) -> None:
        """Closes the SVG or MathML that the next element can't be in."""
        while self.open[-1].foreign and self.open[-1].tag not in INTEGRATION:
            self.count[self.open.pop().tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BREAKOUT:
            self._break_out()
        if self.count["head"] and tag not in IN_HEAD:
            self._pop_to(frozenset(("head",)), frozenset())
        if tag in ENDS:
            # A row ends the row before it, a section every row of the one before.
            for _ in range(3 if tag in ("tr", "tbody", "thead", "tfoot") else 1):
                self._pop_to(*ENDS[tag])
        if tag in BLOCKS:
            self._pop_to(*ENDS["p"])
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop_to(frozenset((self.open[-1].tag,)), frozenset())
        node = Node(tag, dict(reversed(attrs)), self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but ends an element of SVG or MathML
        if self.open[-1].foreign and self.open[-1].tag == tag:
            self.count[self.open.pop().tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows still belongs to the page
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        inside = tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption")
        self._pop_to(frozenset((tag,)), frozenset(("table",)) if inside and tag != "table" else frozenset() if inside else frozenset(("td", "th", "table")))

    def handle_data(self, data: str) -> None:
        if self.count["head"] and self.open[-1].tag == "head" and data.strip():
            self._pop_to(frozenset(("head",)), frozenset())
        if self.open[-1].tag == "style" and any(ON_SCREEN.fullmatch(m.strip()) for m in (self.open[-1].attrs.get("media") or "").split(",")):
            self.sheets.append(data)
        if not self.open[-1].mute:
            self.open[-1].children.append(data)


class Box:
    """Lines of text under construction: the page, or one cell of a table."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = True  # the line has nothing on it yet, or ends in a space
        self.gap = 0  # line ends owed before the next text
        self.indent = ""
        self.marker = ""

    def _begin(self) -> None:
        if not self.parts:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker, self.blank = "", True

    def add(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if self.blank or not self.parts:
            text = text.lstrip(" ")
        if text:
            self._begin()
            self.parts.append(text)
            self.blank = text.endswith(" ")

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.line_break()
            if line:
                self._begin()
                self.parts.append(line)
                self.blank = False

    def end_line(self) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip(" "))
            self.parts, self.blank = [], True

    def line_break(self) -> None:
        if self.parts:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1) + 1

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def rows(self, lines: list[str]) -> None:
        """Finished lines, as they are."""
        for line in lines:
            self.end_line()
            self._begin()
            self.parts.append(line)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name) or ""
    return min(max(int(value), 1), MAX_SPAN) if value.isascii() and value.isdigit() and len(value) < 9 else 1


class Table:
    """Cells by row and column; ``taken`` holds the columns that cells of earlier rows reach down into."""

    def __init__(self):
        self.grid: list[dict[int, tuple[list[str], int]]] = []
        self.taken: dict[int, int] = {}
        self.at = 0

    def row(self) -> None:
        self.grid.append({})
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.at = 0

    def cell(self, lines: list[str], node: Node) -> None:
        if not self.grid:
            self.row()
        while self.at in self.taken:
            self.at += 1
        wide, tall = _span(node, "colspan"), _span(node, "rowspan")
        self.grid[-1][self.at] = (lines, wide)
        if tall > 1:
            # Counted from the next row on.
            self.taken |= dict.fromkeys(range(self.at, self.at + wide), tall)
        self.at += wide

    def laid_out(self) -> list[str]:
        width: Counter[int] = Counter()
        for row in self.grid:
            for c, (lines, wide) in row.items():
                if wide == 1:
                    width[c] = max([width[c], *map(columns, lines)])
        used = sorted({c for row in self.grid for c in row})
        start, x = {}, 0
        for c in used:
            start[c] = x
            x += width[c] + 2
        out = []
        for row in self.grid:
            for k in range(max((len(lines) for lines, _ in row.values()), default=0)):
                line = ""
                for c, (lines, _) in sorted(row.items()):
                    if k < len(lines) and lines[k]:
                        # A cell that spans columns may push what follows to the right.
                        line += " " * (start[c] - columns(line)) if columns(line) <= start[c] else "  "
                        line += lines[k]
                out.append(line)
        return out


def render(root: Node, sheet: Sheet) -> str:
    boxes, tables, lists, pre = [Box()], [], [], 0
    stack: list[tuple[Node | str, bool, bool]] = [(root, True, True)]
    while stack:
        node, enter, visible = stack.pop()
        box = boxes[-1]
        if isinstance(node, str):
            if visible:
                (box.verbatim if pre else box.add)(node)
            continue
        tag, step = node.tag, 1 if enter else -1
        if enter:
            display, visibility = node.style(sheet)
            if display == "none":
                continue
            # Visibility is inherited unless an element states its own.
            visible = visibility == "visible" if visibility in ("visible", "hidden", "collapse") else visible
            stack.append((node, False, visible))
            stack += [(c, True, visible) for c in reversed(node.displayed())]
        if visible and (tag in BLOCKS or (tag == "text" and node.foreign)):
            nested = tag in LISTS and len(lists) > (0 if enter else 1)
            box.block(tag in SPACED and not nested)
        if tag == "br":
            if enter:
                box.line_break()
        elif tag in ("pre", "textarea", "listing"):
            pre += step
        elif tag in LISTS:
            lists.append(1 if tag == "ol" else 0) if enter else lists.pop()
        elif tag == "li":
            if enter:
                mark = "- "
                if lists and lists[-1]:
                    mark, lists[-1] = f"{lists[-1]}. ", lists[-1] + 1
                box.marker, box.indent = mark, box.indent + " " * len(mark)
                node.attrs = {"mark": mark}
            else:
                box.marker, box.indent = "", box.indent[: len(box.indent) - len(node.attrs["mark"])]
        elif tag == "dd":
            box.indent = box.indent + "    " if enter else box.indent[:-4]
        elif tag == "table":
            if enter:
                tables.append(Table())
            else:
                box.rows(tables.pop().laid_out())
                box.block(True)
        elif tag == "tr" and tables and enter:
            tables[-1].row()
        elif tag in CELLS and tables:
            if enter:
                boxes.append(Box())
            else:
                tables[-1].cell(boxes.pop().finish(), node)
    return "\n".join(boxes[0].finish())


def visible_text(page: str) -> str:
    builder = TreeBuilder()
    try:
        builder.feed(page + "<!---->")  # ends a comment that is left open, which hides all the rest
        builder.close()
    except AssertionError:  # the parser's answer to some malformed declarations: what it hasn't read is taken as text
        builder.handle_data(builder.rawdata)
    return render(builder.root, Sheet(builder.sheets))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: the id and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible_text(h.as_py()) if h.is_valid else None for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(html_col).cast("string").alias(html_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")

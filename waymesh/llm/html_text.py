"""Operator 2: layout-aware rendering of HTML to text.

A page is cut into tags and text, a tree is built with the implied tags of HTML
(a list item, paragraph, cell or row ends where the next begins; a table row
implies its body; void elements have no content), invisible parts are left out,
and what is left is laid out.  Invisible are ``hidden``, ``display:none`` and
``visibility:hidden`` (but not what is ``visibility:visible`` inside it), all but the
summary of closed ``details``, the head, title, scripts, styles,
templates and ``datalist``; what only shows where something is not supported
(``noscript``, ``noembed``, ``noframes``, the content of ``iframe``, ``object``,
``audio``, ``video`` and ``canvas``); of diagrams all but labels and HTML inside
them (``defs``, ``symbol``, ``title``, ``desc`` and the like); of formulas
annotations and ``mphantom``; of a closed ``select`` the options not chosen.

* text flows with white space collapsed, but as it stands in ``pre`` and ``textarea``;
* blocks begin on a line of their own, and paragraphs, headings, lists, tables
  and the like are set off by an empty line;
* list items carry ``- `` or their number (``start``, ``value``, ``reversed``), nested ones are indented by two;
* table cells are padded to the width of their column and joined by `` | ``;
  a cell that spans columns is padded to them together, and below one that spans
  rows its columns are blank;
* each label of an ``svg`` is a line; a ``math`` formula flows, with blanks between
  the parts of fractions, powers and indices;
* a ``select`` flows as its chosen option; with ``multiple`` or a size above one
  it is a line for each option and group;
* ``br`` ends a line, ``hr`` is a line of dashes, images give their ``alt`` text.

All visible text is given, navigation and footers too.

Defined cases: null html gives null text, an empty page empty text; unclosed and
misnested tags, stray ends, and a page cut off inside a tag or comment are read
to the end; unknown tags flow with the text; repeated rows are rendered alike;
other columns are ignored.  Elements nested more than ``DEEPEST`` deep (browsers'
parsers themselves stop at 512) lie flat in
the last one above: their text stays, each block on a line of its own, and what is
invisible stays so; only their lists, tables and choices lose their layout.

Memory: a page's tree takes some 30 bytes for each of its characters at most,
while that page is rendered; pages are held an Arrow batch at a time.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

DEEPEST = 2000
#: Frames that a level of the tree takes at most while it is laid out.
_FRAMES = 6
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link datalist iframe object audio video canvas noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html li main menu nav ol p pre search section summary table ul".split()
)
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure article section form fieldset".split())
HIDDEN = frozenset(("hidden", "collapse"))
#: What holds no text to be seen in diagrams and formulas.
SVG_UNSEEN = frozenset("style script title desc metadata defs symbol clippath mask marker pattern".split())
MATH_UNSEEN = frozenset("annotation annotation-xml mphantom".split())
#: Parts of a formula that stand apart: numerator and denominator, base and index, cells.
MATH_APART = frozenset("mfrac msup msub msubsup mover munder munderover mroot mmultiscripts mtr mlabeledtr mtable".split())
#: Inside these, diagrams and formulas hold HTML again.
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: A diagram or formula that was left open ends where one of these begins.
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
#: A choice that was left open ends where one of these begins.
ENDS_SELECT = frozenset("input keygen textarea select caption table tbody tfoot thead tr td th".split())
#: A paragraph ends where one of these begins.
ENDS_P = BLOCKS | {"hr"}
#: Ends of these close no block that began after them.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var".split()
)
#: An open element that ends where the given tag begins, up to the element that bounds the search.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
_OPEN_VALUE = re.compile(r"=\s*[^\s\"']*/\s*\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element, its attributes and its content: nodes and strings."""

    __slots__ = ("tag", "given", "content")

    def __init__(self, tag: str, given: str = ""):
        self.tag, self.given, self.content = tag, given, []

    def attributes(self) -> dict[str, str]:
        if not self.given:
            return {}
        found: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(self.given):
            found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        return found

    def visibility(self) -> str:
        """What the element itself sets; empty if it inherits."""
        found = _VISIBILITY.findall(self.attributes().get("style", "")) if "isibility" in self.given.lower() else []
        return found[-1].lower() if found else ""

    def seen(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if self.given:
            a = self.attributes()
            if "hidden" in a and a["hidden"].lower() != "until-found" or _NONE.search(a.get("style", "")):
                return False
            if self.tag == "input" and a.get("type", "").lower() == "hidden":
                return False
        return True


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_: list[Node] = [root]
    names: list[str] = ["html"]

    # what is open below the deepest element of the tree: its name, and whether it is unseen
    flat: list[tuple[str, bool]] = []
    flat_names: Counter = Counter()

    def close(at: int) -> None:
        del open_[at:], names[at:]
        flat.clear()
        flat_names.clear()

    def told(text: str) -> None:
        if not (flat and flat[-1][1]):
            open_[-1].content.append(text)

    def close_flat(tag: str) -> None:
        while flat:
            name, _ = flat.pop()
            flat_names[name] -= 1
            if name == tag:
                return

    def push_flat(tag: str, given: str) -> None:
        """A start tag below the deepest element: nothing is opened there, but what is unseen is known."""
        node = Node(tag, given)
        inside = drawn and (flat_names["svg"] or flat_names["math"] or foreign())
        unseen = flat and flat[-1][1] or not node.seen() or node.visibility() in HIDDEN or inside and tag in SVG_UNSEEN | MATH_UNSEEN
        if tag in VOID:
            if not unseen:
                open_[-1].content.append(node)
            return
        if inside and given.rstrip().endswith("/") and not _OPEN_VALUE.search(given):
            return
        if not unseen and (tag in BLOCKS or tag in ("tr", "td", "th", "option", "textarea")):
            open_[-1].content.append(Node("div"))
        flat.append((tag, bool(unseen)))
        flat_names[tag] += 1

    def push(tag: str, given: str = "") -> None:
        node = Node(tag, given)
        open_[-1].content.append(node)
        if tag not in VOID:
            open_.append(node)
            names.append(tag)

    def foreign() -> bool:
        """Whether the open element is of a diagram or formula."""
        return next((n in ("svg", "math") for n in reversed(names) if n in HTML_AGAIN or n in ("svg", "math")), False)

    at, drawn = 0, False
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            told(page[at : m.start()])
        at = m.end()
        if page.startswith("<![CDATA[", m.start()) and foreign():
            end = page.find("]]>", m.start() + 9)
            end = end if end >= 0 else len(page)
            told(html.escape(page[m.start() + 9 : end]))
            at = min(end + 3, len(page))
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if flat_names[tag] and m[1]:
            close_flat(tag)
            continue
        drawn = drawn or not m[1] and tag in ("svg", "math")
        if not m[1] and len(open_) >= DEEPEST:
            push_flat(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                told(page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
                close_flat(tag)
            continue
        if m[1]:  # an end tag
            if tag == "br":
                push("br")
            elif tag == "p" and "p" not in names:
                if len(open_) < DEEPEST:
                    push("p")
                    close(len(open_) - 1)
            elif tag in names[1:]:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag in INLINE and any(n in BLOCKS for n in names[k + 1 :]):
                    continue
                # a cell or a table bounds what an end tag of something inside or outside it can close
                bound = max((i for i, n in enumerate(names) if n in ("td", "th", "caption", "table")), default=0)
                if k >= bound or tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                    close(max(k, 1))
            continue
        given = m[3]
        if drawn and tag in ENDS_FOREIGN:
            while foreign():
                close(len(open_) - 1)
        if drawn and (tag in ("svg", "math") or foreign()) and given.rstrip().endswith("/") and not _OPEN_VALUE.search(given):
            open_[-1].content.append(Node(tag, given.rstrip()[:-1]))
            continue
        if tag in ENDS_SELECT and "select" in names:
            close(len(names) - 1 - names[::-1].index("select"))
            if tag == "select":
                continue
        if tag in ("html", "body"):
            if tag == "body" and "head" in names:
                close(names.index("head"))
            continue
        if tag in ENDS_P and "p" in names:
            k = len(names) - 1 - names[::-1].index("p")
            if not any(n in ("table", "td", "th", "button", "caption") for n in names[k + 1 :]):
                close(k)
        if tag in IMPLIED_END:
            ends, bounds = IMPLIED_END[tag]
            k = len(names) - 1
            last = None
            while k > 0 and names[k] not in bounds:
                if names[k] in ends:
                    last = k
                k -= 1
            if last is not None:
                close(last)
        if tag == "tr" and names[-1] == "table":
            push("tbody")
        if tag in ("td", "th") and names[-1] in ("table", "tbody", "thead", "tfoot"):
            if names[-1] == "table":
                push("tbody")
            push("tr")
        push(tag, m[3])
        if tag in RAW and names[-1] == tag:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            open_[-1].content.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            close(len(open_) - 1)
    if at < len(page):
        told(page[at:])
    return root


class Layout:
    """Lines of text, with at most one empty line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space is due before the next text
        self.apart = False  # an empty line is due before the next line

    def text(self, value: str) -> None:
        parts = _SPACE.sub(" ", value)
        body = parts.strip(" ")
        if not body:
            self.space = self.space or bool(parts)
            return
        if self.line and (self.space or parts[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = parts[-1] == " "

    def end(self) -> None:
        """Ends the line if it has anything."""
        if self.line:
            self._add("".join(self.line))
        self.line, self.space = [], False

    def _add(self, line: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        self.lines.append(line)

    def stop(self) -> None:
        """A line break that was asked for."""
        self._add("".join(self.line))
        self.line, self.space = [], False

    def block(self, lines: list[str], apart: bool) -> None:
        self.end()
        self.apart = self.apart or apart
        for line in lines:
            self._add(line)
        self.apart = self.apart or (apart and bool(lines))

    def done(self) -> list[str]:
        self.end()
        return self.lines


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _FRAMES * DEEPEST + 1000))
    root = build(page)
    if "visibility" in page.lower():
        _settle(root)
    lines = _lines(root)
    return "\n".join(line.rstrip(" ") for line in lines).strip("\n")


def _settle(root: Node) -> None:
    """Takes out what is hidden by an element's own or inherited visibility, and elements of which nothing is left."""
    order, todo = [], [(root, False)]
    while todo:
        node, hidden = todo.pop()
        own = node.visibility()
        hidden = own in HIDDEN or hidden and own != "visible"
        order.append((node, hidden))
        todo += [(part, hidden) for part in node.content if isinstance(part, Node)]
    empty = set()
    for node, hidden in reversed(order):  # children before their parents
        if hidden:
            node.content = [part for part in node.content if isinstance(part, Node) and id(part) not in empty]
            if not node.content:
                empty.add(id(node))
        elif empty:
            node.content = [part for part in node.content if isinstance(part, str) or id(part) not in empty]


def _lines(node: Node) -> list[str]:
    out = Layout()
    _flow(node, out)
    return out.done()


def _flow(node: Node, out: Layout) -> None:
    """Lays out the content of a node that is seen."""
    for part in node.content:
        if isinstance(part, str):
            out.text(html.unescape(part) if "&" in part else part)
            continue
        tag = part.tag
        if tag == "br":
            out.stop()
        elif not part.seen():
            continue
        elif tag == "hr":
            out.block(["---"], False)
        elif tag == "img":
            out.text(part.attributes().get("alt", ""))
        elif tag == "input":
            out.text(part.attributes().get("value", ""))
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = node.tag == "li"
            out.block(_list(part), not nested)
        elif tag == "table":
            out.block(_table(part), True)
        elif tag in ("pre", "textarea"):
            out.block(_kept(part), True)
        elif tag == "select":
            _choice(part, out)
        elif tag == "svg":
            _diagram(part, out)
        elif tag == "math":
            if part.attributes().get("display", "").lower() == "block":
                own = Layout()
                _formula(part, own)
                out.block(own.done(), False)
            else:
                _formula(part, out)
        elif tag == "dd":
            out.block(["  " + line for line in _lines(part)], False)
        elif tag == "q":
            out.text('"')
            _flow(part, out)
            out.text('"')
        elif tag == "details" and "open" not in part.attributes():
            first = next((n for n in part.content if isinstance(n, Node) and n.tag == "summary" and n.seen()), None)
            if first:
                out.block(_lines(first), False)
        elif tag in BLOCKS or tag in ("tr", "tbody", "thead", "tfoot", "caption"):
            out.block(_lines(part), tag in SET_OFF)
        else:
            _flow(part, out)


def _options(node: Node) -> Iterator[Node]:
    """Groups that are labelled, and options, in their order."""
    for part in node.content:
        if isinstance(part, Node) and part.seen():
            if part.tag == "option":
                yield part
            else:
                if part.tag == "optgroup":
                    yield part
                yield from _options(part)


def _choice(node: Node, out: Layout) -> None:
    """A list to choose from shows all it has; a closed one the option chosen: the last selected, or else the first enabled."""
    given = node.attributes()
    shown = list(_options(node))
    whole = "multiple" in given or re.fullmatch(r"0*[2-9]|0*[1-9]\d+", given.get("size", "").strip())
    if not whole:
        own = [n for n in shown if n.tag == "option"]
        chosen = [n for n in own if "selected" in n.attributes()][-1:] or [n for n in own if "disabled" not in n.attributes()][:1]
        shown = chosen
    for part in shown:
        label = part.attributes().get("label", "")
        lines = [label] if label or part.tag == "optgroup" else _lines(part)
        if whole:
            out.block([line for line in lines if line], False)
        else:
            out.text(" " + " ".join(lines) + " ")


def _diagram(node: Node, out: Layout) -> None:
    """The labels of a diagram, each on a line of its own, and HTML inside it."""
    for part in node.content:
        if isinstance(part, str) or part.tag in SVG_UNSEEN or not part.seen():
            continue
        given = part.attributes()
        if given.get("display", "").strip().lower() == "none" or given.get("visibility", "").strip().lower() in ("hidden", "collapse"):
            continue
        if part.tag in ("text", "foreignobject"):
            own = Layout()
            _flow(part, own) if part.tag == "foreignobject" else _label(part, own)
            out.block(own.done(), False)
        else:
            _diagram(part, out)


def _label(node: Node, out: Layout) -> None:
    for part in node.content:
        if isinstance(part, str):
            out.text(html.unescape(part) if "&" in part else part)
        elif part.tag not in SVG_UNSEEN and part.seen():
            _label(part, out)


def _formula(node: Node, out: Layout) -> None:
    """The text of a formula in its order; blanks between its marks are none of it."""
    for part in node.content:
        if isinstance(part, str):
            if part.strip():
                out.text(html.unescape(part) if "&" in part else part)
            continue
        if part.tag in MATH_UNSEEN or not part.seen():
            continue
        if node.tag in MATH_APART:
            out.text(" ")
        if part.tag in ("mi", "mn", "mo", "ms", "mtext"):
            _flow(part, out)
        else:
            _formula(part, out)
    if node.tag in MATH_APART:
        out.text(" ")


def _kept(node: Node) -> list[str]:
    """The text of preformatted content, line by line as it stands."""
    parts: list[str] = []

    def walk(n: Node) -> None:
        for part in n.content:
            if isinstance(part, str):
                parts.append(html.unescape(part))
            elif part.tag == "br":
                parts.append("\n")
            elif part.seen():
                walk(part)

    walk(node)
    lines = "".join(parts).replace("\r\n", "\n").replace("\r", "\n").expandtabs(8).split("\n")
    if lines and not lines[0].strip():
        lines = lines[1:]
    if lines and not lines[-1].strip():
        lines = lines[:-1]
    return lines


def _list(node: Node) -> list[str]:
    """Items with their marks; what else a list holds flows between them."""
    out: list[str] = []
    given = node.attributes()
    whole = lambda text: int(text) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else None
    step = -1 if node.tag == "ol" and "reversed" in given else 1
    number = whole(given.get("start", ""))
    if number is None:
        number = 1 if step > 0 else sum(isinstance(n, Node) and n.tag == "li" and n.seen() for n in node.content)
    loose = Node("div")

    def flush() -> None:
        nonlocal loose
        out.extend("  " + line for line in _lines(loose))
        loose = Node("div")

    for part in node.content:
        if isinstance(part, Node) and part.tag == "li":
            flush()
            if not part.seen():
                continue
            own = whole(part.attributes().get("value", ""))
            number = number if own is None else own
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            lines = _lines(part)
            if lines:
                out.append(mark + lines[0])
                out.extend(("  " + line) if line else "" for line in lines[1:])
        else:
            loose.content.append(part)
    flush()
    return out


def _rows(node: Node, section: int = 0) -> Iterator[tuple[int, Node]]:
    """Rows with the number of their section (rows of the table itself: 0)."""
    for k, part in enumerate(node.content, 1):
        if isinstance(part, Node) and part.seen():
            if part.tag == "tr":
                yield section, part
            elif part.tag in ("tbody", "thead", "tfoot"):
                yield from _rows(part, section or k)


def _span(cell: Node, name: str, most: int, zero: int = 1) -> int:
    given = cell.attributes().get(name, "1").strip()
    return (min(int(given), most) or zero) if re.fullmatch(r"\d{1,9}", given) else 1


def _table(node: Node) -> list[str]:
    """Rows of aligned cells; captions above, and what stands between rows and cells before the table."""
    before: list[str] = []
    loose = Node("div")

    def stray(n: Node, cells: frozenset) -> None:
        for part in n.content:
            if isinstance(part, str):
                loose.content.append(part)
            elif part.tag == "caption" and part.seen():
                before.extend(_lines(part))
            elif part.tag in ("tbody", "thead", "tfoot"):
                stray(part, frozenset({"tr"}))
            elif part.tag == "tr":
                stray(part, frozenset({"td", "th"}))
            elif part.tag not in cells and part.tag not in ("colgroup", "col"):
                loose.content.append(part)

    stray(node, frozenset())
    before += _lines(loose)
    # a row's cells: (first column, columns, lines); cells from above that reach into the row have no lines
    grid: list[list[tuple[int, int, list[str]]]] = []
    carried: dict[int, tuple[int, int]] = {}  # first column -> columns, rows still to come
    last = None
    for section, row in _rows(node):
        if section != last:
            carried, last = {}, section
        cells = [(at, span, []) for at, (span, _) in carried.items()]
        taken = {c for at, span, _ in cells for c in range(at, at + span)}
        carried = {at: (span, more - 1) for at, (span, more) in carried.items() if more > 1}
        at, own = 0, False
        for part in row.content:
            if isinstance(part, Node) and part.tag in ("td", "th") and part.seen():
                own = True
                while at in taken:
                    at += 1
                span, rows = _span(part, "colspan", 1000), _span(part, "rowspan", 65534, 65534)
                cells.append((at, span, _lines(part) or [""]))
                taken.update(range(at, at + span))
                if rows > 1:
                    carried[at] = (span, rows - 1)
                at += span
        if own or cells:
            grid.append(sorted(cells, key=lambda c: c[0]))
    widths: list[int] = []
    for cells in grid:
        for at, span, lines in cells:
            widths += [0] * (at + 1 - len(widths))
            if span == 1:
                widths[at] = max(widths[at], *(len(x) for x in lines), 0)
    together = lambda at, span: sum(widths[at : at + span]) + 3 * (len(widths[at : at + span]) - 1)
    for cells in grid:
        for at, span, lines in cells:
            reach = min(span, len(widths) - at)
            if span > 1 and (short := max(map(len, lines), default=0) - together(at, reach)) > 0:
                widths[at + reach - 1] += short
    out = before
    for cells in grid:
        for k in range(max(1, *(len(lines) for *_, lines in cells))):
            at, parts = 0, []
            for first, span, lines in cells:
                parts += [" " * w for w in widths[at:first]]
                parts.append((lines[k] if k < len(lines) else "").ljust(together(first, span)))
                at = first + span
            out.append(" | ".join(parts).rstrip(" "))
    return out


def extract(pages: DataFrame, *, page: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns and ``text``: the visible text of each whole page."""
    source = pages.select(*keep, F.col(page).cast("string").alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["text string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [render(p) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(text, pa.string())], names=[*keep, "text"])

    return map_batches(source, work, schema)

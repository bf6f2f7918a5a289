"""Layout-aware text of HTML: a tree builder with implied tags, visibility rules and a renderer for blocks, lists and tables.

The tokenizer is one regular expression that never backtracks; at the first tag that nothing ends, the ends of all
others are found in one pass, so that time grows with the length of a page whatever it holds. The builder keeps a stack
of open elements, closes what HTML lets authors leave open (p, li, dt, dd, option, tr, td, th, thead, tbody, tfoot), drops end tags that match
nothing, and closes everything at the end. What isn't shown isn't rendered: head, scripts, styles, templates, comments,
objects and media, dialogs that aren't open, drawings but for their text, elements with ``hidden``, ``aria-hidden="true"`` or an inline ``display:none``;
nor what stands in an inline ``visibility:hidden``, but for elements in it that are ``visibility:visible``. Fields show their value or else
their placeholder, a password its dots.
Blocks begin lines; paragraphs, headings, lists and tables are set off by a blank line; list items get a bullet or
their number, indented by their depth; the cells of a table are padded to the width of their column, a cell over several
rows stands in its first; a select shows its chosen option, a list box all; ``pre`` keeps its white space. All other white space runs are one space.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not rendered, with all they hold.
UNSEEN = frozenset("head script style template noscript title iframe object canvas audio video datalist meta link annotation annotation-xml".split())
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noscript", "xmp"])
BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option section summary tbody thead tfoot tr ul".split())
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure".split())
_PARTS = frozenset(["tbody", "thead", "tfoot"])
#: What a tag closes when it begins, searching up to an element of SCOPE.
_CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["td", "th", "tr"]),
    **{part: _PARTS | {"td", "th", "tr"} for part in _PARTS},
}
_P_CLOSERS = (BLOCK | SPACED) - frozenset(["body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "option", "optgroup"])
_SCOPE = {"li": frozenset(["ul", "ol", "menu", "dl", "table"]), "dt": frozenset(["dl", "ul", "ol", "table"]), "dd": frozenset(["dl", "ul", "ol", "table"]), "option": frozenset(["select"]), "optgroup": frozenset(["select"]), "p": frozenset(["table", "td", "th", "button", "li"])}
_P, _TABLE = frozenset(["p"]), frozenset(["table"])
_HEAD_ONLY = frozenset("title meta link style script base noscript template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<", re.S)
_BEGIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)|<", re.S)
_QUOTES = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Up to which column the cells of a table are laid out by their spans, up to which width a column is padded, and up to which depth lists are indented: beyond, all text still stands, but unaligned, so that no page's text is longer than a multiple of the page.
COLUMNS, PADDED, DEEPEST = 1000, 100, 40
#: Inputs that show no text of their own.
_MUTE = frozenset("hidden checkbox radio file color range image".split())
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden", "veil", "drawn")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, hidden: bool = False):
        self.tag, self.attributes, self.children, self.hidden = tag, attributes or {}, [], hidden
        found = _VISIBILITY.findall(self.attributes["style"]) if "style" in self.attributes else None
        #: Whether its text is made invisible; None: as around it.
        self.veil: bool | None = found[-1].lower() != "visible" if found else None
        #: The lines of a table.
        self.drawn: list[str] = []


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def is_hidden(tag: str, attributes: dict[str, str]) -> bool:
    if tag in UNSEEN or (tag == "dialog" and "open" not in attributes) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return bool(_HIDES.search(attributes.get("style", "")))


class _Tokens:
    """(begin, end, tag or None, whether it ends an element, attributes) of what begins with ``<`` from a place on."""

    def __init__(self, source: str):
        self.source, self.ends = source, None

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        if self.ends is None:
            found = _TOKEN.search(self.source, at)
            if not found or found[0] != "<":
                return found and (found.start(), found.end(), found[2], bool(found[1]), found[3] or "")
            if not _BEGIN.match(self.source, found.start())[2]:
                return found.start(), found.end(), None, False, ""
            self._find_ends()
        found = _BEGIN.search(self.source, at)
        if not found or found[2] is None:
            return found and (found.start(), found.end(), None, False, "")
        place = bisect_left(self.marks, found.end())
        end = self.ends[place] if place < len(self.marks) else -1
        if end < 0:  # nothing ends it: a plain character
            return found.start(), found.start() + 1, None, False, ""
        return found.start(), end + 1, found[2], bool(found[1]), self.source[found.end() : end]

    def _find_ends(self) -> None:
        """For every > and quote: where a tag whose attributes reach it ends, -1 for nowhere; from the last one back."""
        self.marks = [m.start() for m in _QUOTES.finditer(self.source)]
        self.ends = [-1] * len(self.marks)
        later: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            sign = self.source[self.marks[i]]
            if sign == ">":
                self.ends[i] = self.marks[i]
            else:
                closing = later.get(sign, len(self.marks))
                self.ends[i] = self.ends[closing + 1] if closing + 1 < len(self.marks) else -1
                later[sign] = i


def parse(source: str) -> Node:
    """The tree of a document or of a fragment; never fails."""
    root = Node("#root")
    stack = [root]

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    places: dict[str, list[int]] = {}  # where in the stack the elements of each tag are

    def last(tags: frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def close(tags: frozenset[str], scope: frozenset[str] = frozenset(), every: bool = False) -> None:
        """Ends the last open element of these tags within the scope, or all of them."""
        floor = last(scope - tags)
        if every:
            found = min((p[bisect_right(p, floor)] for t in tags if (p := places.get(t)) and p[-1] > floor), default=0)
        else:
            found = last(tags)
        if found > floor:
            cut(found)

    at, end = 0, len(source)
    tokens = _Tokens(source)
    while at < end:
        found = tokens.after(at)
        if not found:
            text(source[at:])
            break
        begin, after, tag, closing, given = found
        text(source[at:begin])
        at = after
        if tag is None:
            if after == begin + 1:
                text("<")
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in VOID:
                close(frozenset([tag]), _TABLE if tag not in ("table", "body", "html") else frozenset())
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            cut(len(stack) - 1)  # the body is implied
        if tag in _P_CLOSERS:
            close(_P, _SCOPE["p"])
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPE.get(tag, _TABLE), every=True)
        attributes = attributes_of(given) if given and not given.isspace() else {}
        node = Node(tag, attributes, is_hidden(tag, attributes))
        stack[-1].children.append(node)
        if tag in VOID or given.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            finish = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            inside = source[at : finish.start() if finish else end]
            if tag in ("textarea", "title", "xmp"):
                node.children.append(html.unescape(inside) if tag != "xmp" else inside)
            at = (source.find(">", finish.end()) + 1 or end) if finish else end
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


class _Out:
    """Lines in the making: inline text gathers in a line; breaks ask for a number of newlines before the next text."""

    __slots__ = ("parts", "want", "space", "indent", "empty", "marker")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.want, self.space, self.indent, self.empty, self.marker = 0, False, "", True, ""

    def ask(self, lines: int) -> None:
        self.want = max(self.want, lines)
        self.space = False

    def line_break(self) -> None:
        self.want += 1
        self.space = False

    def begin(self) -> None:
        if self.empty:
            self.parts.append(self.indent)
        elif self.want:
            self.parts.append("\n" * self.want + self.indent)
        elif self.space:
            self.parts.append(" ")
        if self.marker:
            self.parts.append(self.marker)
            self.marker = ""
        self.want, self.space, self.empty = 0, False, False

    def inline(self, value: str) -> None:
        squeezed = _SPACES.sub(" ", value)
        if squeezed == " ":
            self.space = self.space or not self.want
            return
        if not squeezed:
            return
        if squeezed[0] == " ":
            self.space = self.space or not self.want
        self.begin()
        self.parts.append(squeezed.strip(" "))
        self.space = squeezed[-1] == " "

    def lines(self, lines: list[str]) -> None:
        for i, line in enumerate(lines):
            if i:
                self.line_break()
            if line:
                self.begin()
                self.parts.append(line)

    def text(self) -> str:
        return "".join(self.parts)


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _within(node: Node, tags: frozenset[str]) -> list[Node]:
    """The topmost visible elements of these tags in an element, in order."""
    out, work = [], list(reversed(node.children))
    while work:
        item = work.pop()
        if isinstance(item, str) or item.hidden or item.tag in ("defs", "symbol"):
            continue
        if item.tag in tags:
            out.append(item)
        else:
            work.extend(reversed(item.children))
    return out


def _shown_options(node: Node) -> list[Node]:
    """The options of a select that are seen: the chosen one, of a list box all."""
    options = _within(node, frozenset(["option"]))
    size = node.attributes.get("size", "")
    if "multiple" in node.attributes or (size.isdecimal() and size.strip("0") not in ("", "1")):
        return options
    chosen = [o for o in options if "selected" in o.attributes] or [o for o in options if "disabled" not in o.attributes][:1]
    return chosen[-1:]


def _rows(node: Node, part: Node | None = None) -> Iterator[tuple[Node, Node]]:
    """(part of the table, row) of all visible rows."""
    for child in node.children:
        if isinstance(child, Node) and not child.hidden:
            if child.tag == "tr":
                yield part or node, child
            elif child.tag in _PARTS:
                yield from _rows(child, child)


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attributes.get(name, "1").strip()
    return min(most, int(value)) if value.isdecimal() and len(value) < 6 else 1


def _draw_tables(top: Node) -> None:
    """Works out the lines of all tables, those in other tables first, however deep they nest."""
    order, work = [], [(top, False)]
    while work:
        node, veiled = work.pop()
        if node.hidden:
            continue
        veiled = veiled if node.veil is None else node.veil
        if node.tag == "table":
            order.append((node, veiled))
        work.extend((child, veiled) for child in node.children if isinstance(child, Node))
    for node, veiled in reversed(order):
        out = _Out()
        _table(node, out, veiled)
        node.drawn = out.text().split("\n")


def _veiled(node: Node, veiled: bool) -> bool:
    return veiled if node.veil is None else node.veil


def _misplaced(node: Node, out: _Out, veiled: bool) -> None:
    """What authors put between rows and cells is shown too, before the rows."""
    inside = ("td", "th") if node.tag == "tr" else ("caption", "colgroup", "col")
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and not veiled:
                out.inline(child)
        elif child.tag == "tr" or child.tag in _PARTS:
            if not child.hidden:
                _misplaced(child, out, _veiled(child, veiled))
        elif child.tag not in inside:
            _render([child], out, veiled)


def _table(node: Node, out: _Out, veiled: bool) -> None:
    for child in node.children:
        if isinstance(child, Node) and child.tag == "caption" and not child.hidden:
            out.ask(1)
            _render(child.children, out, _veiled(child, veiled))
            out.ask(1)
    rows = []
    taken: dict[int, int] = {}  # columns that cells of rows above still take, and for how many rows
    inside = None
    for part, row in _rows(node):
        if part is not inside:
            inside, taken = part, {}
        cells, at, new = [], 0, {}
        shade = _veiled(row, _veiled(part, veiled) if part is not node else veiled)
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and not cell.hidden:
                inner = _Out()
                _render(cell.children, inner, _veiled(cell, shade))
                while at in taken:
                    at += 1
                span = max(1, min(_span(cell, "colspan", COLUMNS), COLUMNS - at))
                cells.append((inner.text().split("\n"), at, span))
                down = (_span(cell, "rowspan", 65534) or 65534) if at < COLUMNS else 1  # 0 is the rest of the part
                if down > 1:
                    new.update((i, down) for i in range(at, at + span))
                at += span
        taken = {i: n - 1 for i, n in (taken | new).items() if n > 1}
        if cells:
            rows.append(cells)
    _misplaced(node, out, veiled)
    columns: list[int] = []
    for cells in rows:
        for lines, at, span in cells:
            columns.extend([0] * (at + span - len(columns)))
            if span == 1:
                columns[at] = max(columns[at], *[min(PADDED, width(line)) for line in lines])
    out.ask(1)
    for cells in rows:
        for i in range(max(len(lines) for lines, _, _ in cells)):
            line, long, reached, place = [], 0, 0, 0
            for lines, at, _ in cells:
                place += sum([w + 2 for w in columns[reached:at] if w])  # columns without text take no place
                reached = at
                part = lines[i] if i < len(lines) else ""
                if part:
                    gap = max(place - long, 2 if line else 0)
                    line += [" " * gap, part]
                    long += gap + width(part)
            out.ask(1)
            if line:
                out.begin()
                out.parts.extend(line)
    out.ask(2)


def _render(children: list, out: _Out, veiled: bool, listing: tuple[str, list[int]] | None = None, pre: bool = False) -> None:
    # A stack instead of recursion: documents may nest as deep as they like.
    work: list = [(child, veiled, listing, pre) for child in reversed(children)]
    while work:
        item, veiled, listing, pre = work.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if veiled:
                out.inline(" ")
            elif pre:
                out.lines(item.split("\n"))
            else:
                out.inline(item)
            continue
        if item.hidden:
            continue
        tag, veiled = item.tag, _veiled(item, veiled)
        if tag == "br":
            out.line_break()
            continue
        if tag == "hr":
            out.ask(2)
            continue
        if tag == "img":
            if item.attributes.get("alt", "").strip() and not veiled:
                out.inline(item.attributes["alt"])
            continue
        if tag == "input":
            kind, value = item.attributes.get("type", "").lower(), item.attributes.get("value", "")
            if kind not in _MUTE and not veiled:
                out.inline("•" * len(value) if kind == "password" and value else value if value.strip() else item.attributes.get("placeholder", ""))
            continue
        if tag == "select":
            options = _shown_options(item)
            for option in reversed(options):
                label = option.attributes.get("label", "").strip()
                shown = Node("option" if len(options) > 1 else "span")
                shown.children = [label] if label else option.children
                work.append((shown, veiled, listing, pre))
            continue
        if tag == "svg":
            for drawn in reversed(_within(item, frozenset(["text", "foreignobject"]))):
                work.append((drawn, veiled, listing, pre))
                work.append((" ", veiled, listing, pre))
            continue
        if tag == "table":
            out.ask(2)
            out.lines(item.drawn)
            out.ask(2)
            continue
        gap = (1 if listing and tag in ("ul", "ol") else 2) if tag in SPACED else 1 if tag in BLOCK else 0
        if gap:
            out.ask(gap)
            work.append(((lambda g=gap: out.ask(g)), veiled, listing, pre))
        inner, kept = listing, out.indent
        if tag in ("ul", "ol", "menu"):
            begin = item.attributes.get("start", "1")
            inner = ("ol" if tag == "ol" else "ul", [int(begin) - 1 if begin.isdecimal() and len(begin) < 9 else 0])
            if listing:
                out_indent = kept + "  " if len(kept) < 2 * DEEPEST else kept
                work.append(((lambda k=kept: setattr(out, "indent", k)), veiled, listing, pre))
                work.append(((lambda: None), veiled, listing, pre))
                out.indent = out_indent
        elif tag == "li" and listing:
            listing[1][0] += 1
            out.marker = f"{listing[1][0]}. " if listing[0] == "ol" else "- "
            work.append(((lambda: setattr(out, "marker", "")), veiled, listing, pre))
        elif tag in ("dd", "blockquote"):
            work.append(((lambda k=kept: setattr(out, "indent", k)), veiled, listing, pre))
            out.indent = kept + "  " if len(kept) < 2 * DEEPEST else kept
        elif tag in ("td", "th"):
            out.space = True
        pre_inside = pre or tag in ("pre", "textarea", "xmp")
        work.extend((child, veiled, inner, pre_inside) for child in reversed(item.children))


def render(source: str | None) -> str:
    """The visible text of a page; that of a null or empty one is empty."""
    if not source:
        return ""
    out, top = _Out(), parse(source)
    _draw_tables(top)
    _render(top.children, out, False)
    return "\n".join(line.rstrip() for line in out.text().split("\n")).strip("\n")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) per row of ``pages``, in one pass without a shuffle.

    A page is rendered whole, however long it is, in time that grows with its length.
    Null and empty html give an empty text, so do pages without visible text. Repeated rows give repeated rows, an
    empty table none; other columns are ignored, whatever their names. Malformed html is rendered as far as its tags can be told.
    """
    source = pages.select(pages[id_col].alias("page_id"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "text": pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())})

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, text string").withColumnRenamed("page_id", id_col)

"""HTML extraction by layout: a tree with implied tags, visibility rules, then rendering.

The tree builder closes elements that HTML lets authors leave open (paragraphs, list and
table items, options, ruby), ignores end tags that match nothing, and reads the content of
raw-text elements as text.  Rendering walks the tree as a page is laid out: hidden
elements are left out, blocks start new lines, paragraphs and headings stand apart by a
blank line, list items get a bullet or their number and are indented by depth, and the
cells of a table are padded to columns.  Runs of blanks collapse except in ``pre``.

Every visible text of the page is emitted, once, in document order.  Reading takes time in
proportion to the page, whatever its nesting: neither the tree nor the walk is recursive.

Defined results: a null page gives null, an empty one an empty text; broken markup is
read as far as it goes and never fails; a tag that the page's end cuts off is dropped with
what it swallowed, as browsers do.  Only layout has bounds, never text or visibility:
lines are indented by at most ``MAX_INDENT`` columns, tables nested in more than
``TABLE_DEPTH`` tables are laid out as blocks, and in a table that padding would make
many times larger, cells over ``WIDEST_CELL`` run over their column; spans are limited as
HTML limits them.  Visibility follows the ``hidden`` attribute, inline styles and rules of
``<style>`` elements with simple selectors (tag, classes, id): of ``display`` and
``visibility`` the most specific and last valid declaration holds, an important one first.
Rules inside at-rules (media queries), combinators and linked sheets aren't read.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventloom.llm.common import free_name, map_arrow

MAX_INDENT = 80
TABLE_DEPTH = 12
WIDEST_CELL = 80
#: Padding that a table may have for each character of it, and anyway.
PADDING, SOME_PADDING = 8, 20_000
#: What HTML limits spans of columns and rows to.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.I)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
#: The keywords of both properties; a declaration of another value counts for nothing.
_VALUES = {
    "visibility": frozenset("visible hidden collapse inherit initial unset revert".split()),
    "display": frozenset(
        "none contents block inline inline-block flow-root flex inline-flex grid inline-grid table inline-table table-row table-row-group table-header-group table-footer-group table-cell table-column table-column-group table-caption list-item ruby ruby-text inherit initial unset revert".split()
    ),
}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template iframe noembed noframes datalist rp object audio video canvas".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure fieldset hr".split())
BLOCK = APART | frozenset(
    "address article aside body center details dialog div dd dt figcaption footer form header hgroup html legend li main nav option optgroup search section summary tr caption".split()
)
#: Start tags that end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: For a start tag: the open elements it ends, and the elements beyond which none is ended.
_LIST_EDGE, _TABLE_EDGE = frozenset("ul ol menu".split()), frozenset(["table"])
_ENDS = {
    "li": (frozenset(["li"]), _LIST_EDGE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), _TABLE_EDGE),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    **{x: (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), _TABLE_EDGE) for x in ("thead", "tbody", "tfoot", "colgroup", "caption")},
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_P, _HEADINGS = frozenset(["p"]), frozenset("h1 h2 h3 h4 h5 h6".split())
_P_EDGE = frozenset("table td th caption button object template".split())
_CELL_EDGE = frozenset("table td th caption template".split())
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


class Open:
    """The open elements, with the places of each tag's, so that looking one up takes no search."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, ended, edge) -> None:
        """End the innermost open element of ``ended`` and all in it, unless one of ``edge`` is further in."""
        at = self.last(ended)
        if at and at >= self.last(edge):
            for node in self.nodes[at:]:
                self.places[node.tag].pop()
            del self.nodes[at:]


def build(page: str) -> Node:
    """The tree of ``page``; text nodes are strings."""
    root = Node("#root", {})
    stack = Open(root)
    at, end, text_from = 0, len(page), 0

    def add_text(text: str) -> None:
        if text:
            stack.nodes[-1].children.append(entities.unescape(text) if "&" in text else text)

    while (lt := page.find("<", at)) >= 0:
        mark = page[lt + 1 : lt + 2]
        if mark == "/":
            letter = page[lt + 2 : lt + 3]
            kind = "tag" if letter.isascii() and letter.isalpha() else "bogus" if letter else "text"
        else:
            kind = "tag" if mark.isascii() and mark.isalpha() else "bogus" if mark in ("!", "?") and mark else "text"
        if kind == "text":
            at = lt + 1
            continue
        add_text(page[text_from:lt])
        if kind == "bogus":
            if page.startswith("<!--", lt):
                short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, lt)), "")
                close = None if short else _COMMENT_END.search(page, lt + 4)
                at = lt + len(short) if short else close.end() if close else end
            else:
                gt = page.find(">", lt)
                at = gt + 1 if gt >= 0 else end
            text_from = at
            continue
        m = _TAG.match(page, lt)
        if m is None:  # the page ends in a tag
            return root
        at = text_from = m.end()
        tag, raw = m[2].lower(), m[3]
        if m[1]:
            _close(stack, tag)
            continue
        if tag in _ENDS_P:
            stack.end(_P, _P_EDGE)
        if tag in _ENDS:
            stack.end(*_ENDS[tag])
        node = Node(tag, _attributes(raw) if raw and not raw.isspace() else {})
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)[^>]*>?", re.I).search(page, at)
            text = page[at : close.start() if close else end]
            if text:
                node.children.append(entities.unescape(text) if tag == "textarea" else text)
            at = text_from = close.end() if close else end
        elif tag not in VOID:
            stack.push(node)
    add_text(page[text_from:])
    return root


def _close(stack: Open, tag: str) -> None:
    if tag == "br":
        stack.nodes[-1].children.append(Node("br", {}))
        return
    edge = _TABLE_EDGE if tag in _TABLE_PARTS and tag != "table" else frozenset() if tag in ("table", "body", "html") else _CELL_EDGE
    stack.end(_HEADINGS if tag in _HEADINGS else (tag,), edge)


def hidden(node: Node) -> bool:
    """Whether the element and all in it take no part in the layout."""
    a = node.attributes
    if node.tag in HIDDEN:
        return True
    if not a:
        return node.tag == "dialog"
    display = _declared(a["style"], "display") if "style" in a else None
    if display is not None and display != "revert":
        return display == "none"
    return "hidden" in a or node.tag == "dialog" and "open" not in a


def _seen(node: Node, seen: bool) -> bool:
    """Whether the element's own text shows, given whether its parent's does."""
    found = _declared(node.attributes["style"], "visibility") if "style" in node.attributes else None
    if found is None or found in ("inherit", "unset", "revert"):
        return seen
    return found not in ("hidden", "collapse")


def _declared(style: str, name: str) -> str | None:
    """The last valid value that ``style`` gives to a property, an important one before all others."""
    found, strong = None, False
    for m in _DECLARATION.finditer(style):
        value = m[2].lower()
        if m[1].lower() == name and value in _VALUES[name] and (m[3] or not strong):
            found, strong = value, bool(m[3])
    return found


def _unnested(sheet: str) -> str:
    """A style sheet without its at-rules, whose conditions are unknown here."""
    out, at, depth, skip = [], 0, 0, None
    for m in re.finditer(r"[@{};]", sheet):
        if skip is None and m[0] == "@":
            out.append(sheet[at : m.start()])
            skip, depth = m.start(), 0
        elif skip is not None:
            depth += (m[0] == "{") - (m[0] == "}")
            if depth <= 0 and m[0] in "};":
                skip, at = None, m.end()
    if skip is None:
        out.append(sheet[at:])
    return "".join(out)


def apply_sheets(root: Node) -> None:
    """Put the display and visibility rules of the page's style elements before the styles of the elements they match.

    Simple selectors count: a tag or ``*``, classes and ids, alone or together.
    """
    sheets, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and "media" not in node.attributes:
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    rules: dict[str, list] = {}  # by an id, a class or a tag that an element must have
    place = 0
    for selectors, body in _RULE.findall(_unnested(_CSS_COMMENT.sub("", "\n".join(sheets)))):
        if not _DECLARATION.search(body):
            continue
        for selector in selectors.split(","):
            m = _SELECTOR.fullmatch(selector.strip())
            if not m or not (m[1] or m[2]):
                continue
            tag, parts = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
            rank = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), int(tag != "*"), place)
            place += 1
            rules.setdefault(next((p for p in parts if p[0] == "#"), parts[0] if parts else tag), []).append((rank, tag, frozenset(parts), body))
    if not rules:
        return
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if not isinstance(c, str)]
        a = node.attributes
        own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
        hits = [r for k in (*own, node.tag, "*") for r in rules.get(k, ()) if r[1] in ("*", node.tag) and r[2] <= own]
        if hits:
            a["style"] = ";".join([*(r[3] for r in sorted(hits, key=lambda r: r[0])), a.get("style", "")])


class Page:
    """Lines under way: collapses blanks, keeps blocks apart, indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank waits to be written before the next text
        self.apart = 0  # blank lines due before the next line
        self.indent: list[int] = []
        self.head = ""
        self.mark: str | None = None  # an item's bullet, for its first line

    def text(self, s: str) -> None:
        for k, part in enumerate(_BLANKS.split(s)):
            if k:
                self.blank = True
            if part:
                if self.now and self.blank:
                    self.now.append(" ")
                self.now.append(part)
                self.blank = False

    def plain(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.line(always=True)
            if part:
                self.now.append(part)

    def line(self, always: bool = False) -> None:
        if self.now or always:
            if self.apart and self.lines:
                self.lines += [""] * self.apart
            self.apart = 0
            head = self.head[:MAX_INDENT]
            if self.mark is not None:
                head = head[: max(len(head) - len(self.mark), 0)] + self.mark
                self.mark = None
            self.lines.append((head + "".join(self.now)).rstrip())
        self.now, self.blank = [], False

    def block(self, space: int) -> None:
        self.line()
        self.apart = max(self.apart, space)

    def deeper(self, columns: int) -> None:
        self.indent.append(columns)
        if len(self.head) <= MAX_INDENT:
            self.head += " " * columns
            self.indent[-1] = -columns

    def back(self) -> None:
        columns = self.indent.pop()
        if columns < 0:
            self.head = self.head[:columns]


def _run(walk) -> None:
    """Run a walk that yields the walks of inner elements, without recursion."""
    stack = [walk]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _number(s: str, otherwise: int) -> int:
    return int(s) if re.fullmatch(r"\s*-?\d{1,9}\s*", s, re.A) else otherwise


def _walk(node: Node, page: Page, pre: bool, seen: bool, tables: int):
    number = _number(node.attributes.get("start", ""), 1) if node.tag == "ol" else 1
    summary_only = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if seen and not summary_only:
                (page.plain if pre else page.text)(child)
            continue
        tag = child.tag
        if hidden(child) or summary_only and tag != "summary":
            continue
        shown = _seen(child, seen)
        if tag == "br":
            page.line(always=True)
        elif tag == "table" and tables < TABLE_DEPTH:
            page.block(1)
            yield _table(child, page, shown, tables)
            page.block(1)
        elif tag == "li":
            if node.tag == "ol":
                number = _number(child.attributes.get("value", ""), number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.block(0)
            page.deeper(len(mark))
            page.mark = mark
            yield _walk(child, page, pre, shown, tables)
            page.line()
            page.mark = None
            page.back()
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dl") and bool(page.indent)
            space = 1 if tag in APART and not nested and page.mark is None else 0
            page.block(space)
            inset = 2 if tag in ("blockquote", "dd") or nested else 0
            if inset:
                page.deeper(inset)
            yield _walk(child, page, pre or tag == "pre", shown, tables)
            page.line()
            if inset:
                page.back()
            page.block(space)
        elif tag in ("td", "th"):  # a cell outside a table that is laid out
            page.blank = True
            yield _walk(child, page, pre, shown, tables)
            page.blank = True
        else:
            yield _walk(child, page, pre or tag in ("textarea", "xmp"), shown, tables)


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(cell: Node, name: str) -> int:
    """HTML's own limits; a row span of zero reaches to the table's end."""
    n = _number(cell.attributes.get(name, ""), 1)
    return min(max(n, 1), MOST_COLUMNS) if name == "colspan" else min(n, MOST_ROWS) if n > 0 else MOST_ROWS if n == 0 else 1


def _table(table: Node, page: Page, seen: bool, tables: int):
    rows: list[list[tuple[list[str], int, int]]] = []  # lines, column, columns
    loose = Node("div", {})
    covered: dict[int, int] = {}  # columns that a cell of a row above reaches into, and for how many rows
    todo = [(table, seen)]
    while todo:
        node, shown = todo.pop()
        if node is table or node.tag in ("thead", "tbody", "tfoot"):
            inner = []
            for child in node.children:
                if isinstance(child, str):
                    if not child.isspace():
                        loose.children.append(child)
                elif hidden(child):
                    continue
                elif child.tag in ("thead", "tbody", "tfoot", "tr", "td", "th"):
                    inner.append((child, _seen(child, shown)))
                elif child.tag not in ("col", "colgroup"):
                    loose.children.append(child)
            todo += reversed(inner)
            continue
        cells, column = [], 0
        for cell in node.children if node.tag == "tr" else [node]:  # a cell without a row is one
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if not (isinstance(cell, str) and cell.isspace()):
                    loose.children.append(cell)
                continue
            if hidden(cell):
                continue
            while covered.get(column, 0):
                column += 1
            own = Page()
            yield _walk(cell, own, False, _seen(cell, shown), tables + 1)
            own.line()
            span = _span(cell, "colspan")
            cells.append((own.lines, column, span))
            for c in range(column, column + span):
                covered[c] = max(covered.get(c, 0), _span(cell, "rowspan"))
            column += span
        covered = {c: k - 1 for c, k in covered.items() if k > 1}
        rows.append(cells)
    if loose.children:  # captions, and what stands in a table outside of its cells
        yield _walk(loose, page, False, seen, tables + 1)
        page.line()
    for line in _columns(rows):
        page.now = [line]
        page.line()


def _columns(rows: list[list[tuple[list[str], int, int]]]):
    """The lines of a table's rows, cells padded to columns."""
    wide: dict[int, list[int]] = {}
    total = sum(len(x) for cells in rows for lines, _, _ in cells for x in lines)
    for cells in rows:
        for lines, column, span in cells:
            if span == 1:
                wide.setdefault(column, []).extend(map(_width, lines))
    widths = {c: max(w, default=0) for c, w in wide.items()}
    height = sum(max((len(lines) for lines, _, _ in cells), default=0) for cells in rows)
    if height * sum(widths.values()) > PADDING * total + SOME_PADDING:
        widths = {c: max((x for x in w if x <= WIDEST_CELL), default=0) for c, w in wide.items()}
    for cells in rows:
        for k in range(max((len(lines) for lines, _, _ in cells), default=0)):
            out, goal, at, column = [], 0, 0, 0
            for lines, start, span in cells:
                goal += sum(widths.get(c, 0) + 2 for c in range(column, start))
                if k < len(lines) and lines[k]:
                    gap = max(goal - at, 2 if at else 0)
                    out.append(" " * gap + lines[k])
                    at += gap + _width(lines[k])
                goal += sum(widths.get(c, 0) + 2 for c in range(start, start + span))
                column = start + span
            if out:
                yield "".join(out)


def render(page: str | None) -> str | None:
    """The visible text of an HTML page, laid out in lines."""
    if page is None:
        return None
    out = Page()
    root = build(page)
    if "<style" in page.lower():
        apply_sheets(root)
    _run(_walk(root, out, False, True, 0))
    out.line()
    lines = out.lines
    first, last = 0, len(lines)
    while first < last and not lines[first]:
        first += 1
    while last > first and not lines[last - 1]:
        last -= 1
    return "\n".join(lines[first:last])


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, name: str = "text") -> DataFrame:
    """Columns ``keep`` (all but the page by default) and the rendered text as ``name``."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    name = free_name(keep, name)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(name, T.StringType())])
    inner = free_name(keep, "html_")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = pa.array([render(p) for p in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=schema.names)

    return map_arrow(pages.select(*(pages[c] for c in keep), pages[html_col].cast("string").alias(inner)), run, schema)

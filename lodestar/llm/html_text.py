"""Layout-aware text of HTML pages: a tree builder with implied tags, and a renderer with visibility rules.

All visible text is kept, navigation included. Blocks stand on lines of their own, paragraph-like ones with an empty
line around them; list items are marked and indented; table cells are laid out as blocks of their own and padded to
columns; preformatted text keeps its blanks. Hidden is what its element, an attribute or an inline style hides, or a
rule of a style sheet in the page whose selector is a tag, classes and ids; other selectors and conditional rules have no
say. Of drawings, text elements are shown, of formulas all but annotations. Neither builder nor renderer recurses, so
depth of nesting is no limit.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their end tag, and those of them in which character references count.
RAW, RCDATA = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset(("textarea", "title"))
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist desc defs metadata symbol annotation annotation-xml".split())
#: Elements with rules of their own, in which "/>" ends an element; tags that can't be in them end them.
FOREIGN = frozenset(("svg", "math"))
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = frozenset(("foreignobject", "desc", "title", "annotation-xml", "mtext", "mi", "mo", "mn", "ms"))
#: Set off by an empty line, and by a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form article section hr".split())
BLOCK = SPACED | frozenset("html body div header footer nav main aside address li dt dd figcaption details summary center legend caption option menu hgroup search tr".split())
#: An open element of the first kind is closed by a start tag of the second; the search for it stops at the third.
IMPLIED_END = {
    "li": (frozenset(("li",)), frozenset("ul ol menu table".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl", "table")))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset("tr td th".split()), frozenset(("table",))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset("table tr".split()))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(("table",)))),
}
CLOSES_P = SPACED | frozenset("address aside center details div dd dt fieldset figcaption footer header li main menu nav summary".split())
#: An end tag doesn't look for its element beyond these.
SCOPE = frozenset("table td th html template".split())
#: Lists and quotes nested deeper are indented no further.
INDENT = 80
#: Columns and rows that a cell spans, at most, as in browsers.
COLUMNS, ROWS = 1000, 65534
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_DISPLAY = re.compile(r"(?:display|visibility)\s*:", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), _html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def build(source: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets. Missing end tags, rows and bodies are supplied; stray end tags are dropped."""
    root = Node("html", {})
    stack, at, sheets = [root], 0, []
    opened: dict[str, int] = {}  # how many elements of a tag are open

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def cut(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def close(tags: frozenset, stops: frozenset) -> None:
        k = len(stack) - 1
        while k > 0 and any(opened.get(t) for t in tags):
            if stack[k].tag in tags:
                cut(k)  # and look on: a row in the way goes with its cell, a body with its rows
            elif stack[k].tag in stops:
                return
            k -= 1

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(_html.unescape(text) if "&" in text else text)

    def foreign() -> int:
        """The place of the drawing or formula that is being filled, 0 if it is HTML."""
        if not any(opened.get(t) for t in FOREIGN):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in FOREIGN:
                return k
            if stack[k].tag in HTML_INSIDE:
                return 0
        return 0

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in SCOPE and tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th"):
                    break
                if stack[k].tag == "table":
                    break
            continue
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                cut(len(stack) - 1)
            root.attrs = attributes(m[3]) | root.attrs
            continue
        inside = foreign()
        if inside and tag in BREAKOUT:
            cut(inside)
            inside = 0
        if stack[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            cut(len(stack) - 1)  # body is implied
        if not inside:
            if tag in CLOSES_P:
                close(frozenset(("p",)), SCOPE)
            if tag in IMPLIED_END:
                close(*IMPLIED_END[tag])
            if tag in ("td", "th") and stack[-1].tag != "tr" and opened.get("table"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                push(row)
        node = Node(tag, attributes(m[3]) if m[3] and not m[3].isspace() else {})
        stack[-1].children.append(node)
        if (inside or tag in FOREIGN) and m[3].endswith("/"):
            continue
        if tag in RAW or tag in RCDATA and not inside:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            at = end.end() if end else len(source)
            node.children.append(_html.unescape(inner) if tag in RCDATA else inner)
            if tag == "style":
                sheets.append(inner)
        elif tag not in VOID:
            push(node)
    return root, sheets


def hiding(sheets: list[str]) -> list[tuple[str, frozenset, frozenset]]:
    """``(tag, classes, ids)`` of the elements that style sheets hide; of rules with equal selectors the last counts."""
    found: dict[tuple[str, frozenset, frozenset], bool] = {}
    for sheet in sheets:
        flat, depth, at = [], 0, 0
        sheet = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", " ", sheet, flags=re.S)
        for m in re.finditer(r"[{}]", sheet):  # blocks within blocks belong to conditional rules
            if m[0] == "{":
                depth += 1
            elif depth:
                depth -= 1
                if not depth:
                    flat.append(sheet[at : m.end()])
                    at = m.end()
        for piece in flat:
            m = _RULE.fullmatch(piece)
            if m is None or "@" in m[1] or not _DISPLAY.search(m[2]):
                continue
            for selector in m[1].rpartition(";")[2].split(","):
                part = _SELECTOR.fullmatch(selector.strip())
                if part and part[0]:
                    names = re.findall(r"([.#])([\w-]+)", part[2])
                    found[(part[1] or "").lower(), frozenset(n for k, n in names if k == "."), frozenset(n for k, n in names if k == "#")] = bool(_HIDING.search(m[2]))
    return [k for k, hides in found.items() if hides]


def visible(node: Node, rules: list[tuple[str, frozenset, frozenset]] = ()) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs:
        return False
    if rules:
        classes, name = set(node.attrs.get("class", "").split()), node.attrs.get("id")
        if any((not tag or tag == node.tag) and cls <= classes and ids <= {name} for tag, cls, ids in rules):
            return False
    return not (style := node.attrs.get("style")) or not _HIDING.search(style)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines under construction: ``gap`` is 0 within a line's block, 1 for a line break, 2 for an empty line before the next."""

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.marks = [], [], 0, 0, ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in rest:
                self.flush(True)
                self._add(x)
            return
        text = _SPACES.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        self._add(text)

    def _add(self, text: str) -> None:
        if text:
            self.line.append(text)

    def flush(self, always: bool = False) -> None:
        text = "".join(self.line).rstrip(" \t\n")
        self.line = []
        if not text and not always:
            return
        if self.gap == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        marks, self.marks = self.marks, ""
        self.lines.append((" " * max(0, min(self.indent, INDENT) - len(marks)) + marks + text).rstrip())
        self.gap = 0

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    text = node.attrs.get(name, "1").strip()
    return min(int(text), most) if re.fullmatch(r"\d{1,9}", text) else 1


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns spanned, rows spanned) as lines of text.

    A row is as high as its highest cell. A column is as wide as its widest cell that spans no other; columns in which no
    cell begins have no width. A cell that spans rows stands in the first and leaves its place free in the others.
    """
    taken: list[int] = []  # rows for which a column is still taken
    placed: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        at, cells = 0, []
        for lines, columns, deep in row:
            while at < len(taken) and taken[at]:
                at += 1
            taken += [0] * (at + columns - len(taken))
            taken[at : at + columns] = [deep] * columns
            cells.append((at, columns, lines))
            at += columns
        placed.append(cells)
        taken = [max(0, n - 1) for n in taken]
    begins = sorted({at for cells in placed for at, _, _ in cells})
    slot = {at: k for k, at in enumerate(begins)}
    spans = [[(slot[at], sum(1 for k in range(at, at + n) if k in slot), lines) for at, n, lines in cells] for cells in placed]
    widths = [0] * len(begins)
    for cells in spans:
        for at, n, lines in cells:
            if n == 1:
                widths[at] = max([widths[at], *map(_width, lines)])
    out = []
    for cells in spans:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, at = [], 0
            for start, n, lines in cells:
                line += [" " * widths[c] for c in range(at, start)]
                text = lines[k] if k < len(lines) else ""
                line.append(text + " " * (sum(widths[start : start + n]) + 3 * (n - 1) - _width(text)))
                at = start + n
            while line and not line[-1].strip():
                line.pop()
            out.append(" | ".join(line).rstrip())
    return out


def render(root: Node, rules: list[tuple[str, frozenset, frozenset]] = ()) -> str:
    pages, tables, lists = [_Page()], [], [[]]  # lists: of each page
    todo: list = [(root, False, False, False)]  # node or text; preformatted; of a drawing, where only its text elements show; on the way out
    while todo:
        node, pre, drawn, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if node and not drawn and not (tables and tables[-1]["open"] is None and node.isspace()):
                page.text(node, pre)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node, rules):
                continue
            if tag == "br":
                page.flush(True)
                continue
            if tag in ("td", "th") and tables and tables[-1]["open"] is None:
                tables[-1]["open"] = tag
                pages.append(_Page())
                lists.append([])
                page = pages[-1]
            elif tag in BLOCK and not (tag == "tr" and tables):
                page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists[-1]) else 1)
            if tag == "table":
                tables.append({"rows": [], "open": None})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1").strip()
                lists[-1].append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                page.indent += 2 if len(lists[-1]) > 1 else 0
            elif tag == "li":
                kind = lists[-1][-1] if lists[-1] else ["ul", 1]
                page.marks = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.indent += len(page.marks)
            elif tag in ("dd", "blockquote"):
                page.indent += 2
            elif tag == "hr":
                page.text("---", False)
                page.block(2)
                continue
            pre = pre or tag in ("pre", "textarea", "xmp", "listing")
            drawn = tag == "svg" or drawn and tag not in ("text", "foreignobject")
            if drawn is False and tag in ("text", "foreignobject"):
                page.block(1)
            todo.append((node, pre, drawn, True))
            if tag == "li":
                node.attrs["\0"] = str(len(page.marks))
            todo += [(c, pre, drawn, False) for c in reversed(node.children)]
            continue
        if tag in ("td", "th") and tables and tables[-1]["open"] == tag and len(pages) > 1:
            lists.pop()
            if not tables[-1]["rows"]:
                tables[-1]["rows"].append([])
            lines = pages.pop().done()
            low = min((len(x) - len(x.lstrip(" ")) for x in lines if x), default=0)
            deep = _span(node, "rowspan", ROWS)
            tables[-1]["rows"][-1].append(([x[low:] for x in lines], max(1, _span(node, "colspan", COLUMNS)), deep or ROWS))
            tables[-1]["open"] = None
            continue
        if tag == "table":
            for line in _grid(tables.pop()["rows"]):
                page.line = [line]
                page.flush(True)
        elif tag in ("ul", "ol", "menu"):
            lists[-1].pop()
            page.block(1)
            page.indent -= 2 if lists[-1] else 0
        elif tag == "li":
            page.flush()
            page.indent -= int(node.attrs.pop("\0"))
            page.marks = ""
        elif tag in ("dd", "blockquote"):
            page.flush()
            page.indent -= 2
        elif tag == "text":
            page.block(1)
        if tag in BLOCK and not (tag == "tr" and tables):
            page.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists[-1]) else 1)
    return "\n".join(pages[0].done())


def visible_text(source: str | None) -> str:
    """The visible text of a page; empty for null and for a page that shows none."""
    if not source:
        return ""
    root, sheets = build(source)
    return render(root, hiding(sheets))


def text_column(html: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def made(pages: pa.Array) -> pa.Array:
        return pa.array([visible_text(p.as_py()) for p in pages], pa.string())

    return made(html.cast("string"))


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``(page_id, text)`` for every row, each decided alone.

    Null or empty html gives empty text. Repeated rows stay repeated; a null page_id is kept. Other columns play no
    part. An empty table gives no rows.
    """
    return pages.select(F.col(page_id).alias("page_id"), text_column(F.col(html)).alias("text"))

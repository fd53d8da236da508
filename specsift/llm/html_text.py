"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that knows void elements, raw-text elements
and implied end tags.  Visibility rules cut subtrees (``hidden``, inline
``display: none``, head and script content, closed dialogs, all but the summary
of closed details, options that are not chosen, fallbacks of elements that need
none) and text (``visibility: hidden``, which a descendant may lift).  The
renderer emits all visible text: blocks on their own lines, paragraphs apart,
lists with markers and indentation, tables with aligned cells that may span
columns and rows, preformatted text as it is; text areas, formulas, drawings and
the content of objects count as text.  Sections and rows of a table that the
markup leaves out are implied; what stands in a table outside its cells and
captions comes before the table.

Defined results: a null page gives null; an empty page gives an empty text;
broken markup never fails (stray end tags are ignored, open elements are
closed at the end, an unfinished tag is text).  Nothing recurses: tables are laid
out from the innermost, so pages of any depth are laid out alike.  Repeated rows
give equal texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = lambda s: frozenset(s.split())

VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title xmp iframe noembed noframes")
HIDDEN = _words("head script style template noscript iframe noembed noframes audio video canvas datalist title desc defs metadata annotation annotation-xml")
PARAGRAPH = _words("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset")
BLOCK = PARAGRAPH | _words(
    "html body address article aside center details dialog dd div dt figcaption footer form header legend li main nav optgroup option section summary tr caption thead tbody tfoot"
)
#: An element that opens closes these open ones first, up to the given scope.
CLOSES = {
    "li": (_words("li"), _words("ul ol menu")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "tr": (_words("tr td th caption colgroup"), _words("table")),
    "td": (_words("td th"), _words("tr table")),
    "th": (_words("td th"), _words("tr table")),
    "thead": (_words("tr td th thead tbody tfoot caption colgroup"), _words("table")),
    "tbody": (_words("tr td th thead tbody tfoot caption colgroup"), _words("table")),
    "tfoot": (_words("tr td th thead tbody tfoot caption colgroup"), _words("table")),
    "option": (_words("option"), _words("select datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "body": (_words("head"), _words("html")),
}
_SECTIONS = _words("thead tbody tfoot")
_CELLS = _words("td th")
#: Bounds of the spans of a cell, as browsers have them.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
_ENDS_P = BLOCK - _words("html body option optgroup legend caption tr thead tbody tfoot") | _words("menu")
_P_SCOPE = _words("table td th caption button object")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_SEEN = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.lines = tag, attrs, [], None


def parse(html: str) -> Node:
    """The element tree; text is str among the children."""
    root = Node("#root", {})
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            stack[-1].children.append(unescape(token))
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if name == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and name not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break  # an end tag does not reach out of its cell
            continue
        if name in _ENDS_P:
            _close(stack, _words("p"), _P_SCOPE)
        if name in CLOSES:
            _close(stack, *CLOSES[name])
        if name == "table":  # a table outside the cells of an open one ends that
            around = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in _P_SCOPE), 0)
            if stack[around].tag == "table":
                del stack[around:]
        elif name == "tr" or name in _CELLS:
            _imply(stack, name)
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(token[1 + len(name) : -1])} if " " in token or "\n" in token or "\t" in token else {}
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            stop = close.start() if close else end
            node.children.append(unescape(html[at:stop]) if name in ("textarea", "title") else html[at:stop])
            at = close.end() if close else end
        elif name not in VOID and not token.endswith("/>"):
            stack.append(node)
    return root


def _close(stack: list[Node], tags: frozenset, scope: frozenset) -> None:
    """Pop up to the outermost open element of ``tags`` inside ``scope``."""
    cut = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            cut = i
        elif stack[i].tag in scope:
            break
    if cut is not None:
        del stack[cut:]


def _imply(stack: list[Node], name: str) -> None:
    """Open the section and row that a row or cell in a table lacks."""
    at = len(stack) - 1
    while at and stack[at].tag not in ("table", "tr") and stack[at].tag not in _SECTIONS and stack[at].tag not in _P_SCOPE:
        at -= 1
    around = stack[at].tag
    missing = {"table": ["tbody", "tr"], "tr": []}.get(around, ["tr"] if around in _SECTIONS else None)
    if missing is None:
        return
    del stack[at + 1 :]
    for tag in missing if name in _CELLS else missing[:-1]:
        node = Node(tag, {})
        stack[-1].children.append(node)
        stack.append(node)


def _shown(node: Node) -> bool:
    """Whether an element takes part in the layout."""
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _GONE.search(a["style"]))


def _options(select: Node) -> set[int]:
    """The options that a closed select shows: the chosen ones, else the first."""
    found, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.tag == "option":
            found.append(x)
        else:
            todo.extend(reversed(x.children))
    chosen = [x for x in found if "selected" in x.attrs]
    if "multiple" in select.attrs or "size" in select.attrs and select.attrs["size"] not in ("", "0", "1"):
        return set(map(id, found))  # a list box shows all of them
    return set(map(id, chosen[-1:] or found[:1]))


def prune(root: Node) -> list[Node]:
    """Cuts what is not visible from the tree; gives its tables, outer ones first."""
    tables, todo = [], [(root, True, None)]
    while todo:
        node, seen, options = todo.pop()
        kept: list = []
        if node.tag == "table":
            tables.append(node)
        if node.tag == "select":
            options = _options(node)
        summary = node.tag == "details" and "open" not in node.attrs
        for x in node.children:
            if isinstance(x, str):
                if seen and not summary and not (node.tag in ("select", "optgroup") and options is not None):
                    kept.append(x)
            elif summary and x.tag != "summary":
                continue
            elif _shown(x) and not (x.tag == "option" and options is not None and id(x) not in options):
                own = seen
                if "style" in x.attrs and (m := _SEEN.findall(x.attrs["style"])):
                    own = m[-1].lower() == "visible"
                if x.tag == "img" and not own:
                    continue
                kept.append(x)
                todo.append((x, own, options))
                if summary:
                    summary = False
                    break  # the first summary alone
        node.children = kept
    return tables


class _Out:
    """Lines under construction; inline white space collapses."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.prefix = ""
        self.indent = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " " and (not self.line or self.line.endswith(" ")):
            return
        if not self.line:
            s = s.lstrip(" ")
        elif self.line.endswith(" ") and s.startswith(" "):
            s = s[1:]
        self.line += s

    def newline(self) -> None:
        s = self.line.rstrip(" ")
        self.line = ""
        if s:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append((self.prefix or self.indent) + s)
            self.gap, self.prefix = False, ""

    def paragraph(self) -> None:
        self.newline()
        self.gap = True

    def pre(self, s: str) -> None:
        self.newline()
        for x in s.split("\n"):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.prefix or self.indent) + x.rstrip())
            self.prefix = ""


def _flat(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        else:
            todo.extend(reversed(x.children))
    return "".join(out)


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(int(value), most) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def _table(node: Node) -> list[str]:
    """What stands outside cells and captions, then the captions, then the rows
    of the table: every cell in its column, padded to the column's width.
    Columns in which no cell begins are left out."""
    captions, rows = [], []
    loose = Node("#loose", {})
    below: dict[int, int] = {}  # column -> rows that a cell above still takes
    todo: list = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            loose.children.append(x)
        elif x.tag == "caption":
            loose.children.append(" ")
            captions.append(_SPACE.sub(" ", render(x)).strip())
        elif x.tag == "tr":
            loose.children.append(" ")
            cells: dict[int, str] = {}
            taken, below = below, {c: n - 1 for c, n in below.items() if n > 1}
            at = 0
            for c in x.children:
                if isinstance(c, str) or c.tag not in _CELLS:
                    loose.children.append(c)
                    continue
                loose.children.append(" ")
                while at in taken:
                    at += 1
                cells[at] = " ".join(render(c).split())
                down = _span(c, "rowspan", MAX_ROWS) or MAX_ROWS
                for column in range(at, at + max(1, _span(c, "colspan", MAX_COLUMNS))):
                    if down > 1:
                        below[column] = max(below.get(column, 0), down - 1)
                at = column + 1
            loose.children.append(" ")
            if any(cells.values()):
                rows.append(cells)
        elif x.tag in _SECTIONS:
            todo.extend([" ", "#end", *reversed(x.children), " "])
        else:
            loose.children.append(x)
        if x == "#end":  # spans end with their section
            loose.children.pop()
            below = {}
    columns = sorted({c for r in rows for c in r})
    width = {c: max(len(r.get(c, "")) for r in rows) for c in columns}
    out = [*render(loose).split("\n"), *[c for c in captions if c]]
    for r in rows:
        line = " | ".join(r.get(c, "").ljust(width[c]) for c in columns if c <= max(r))
        out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """Text below a node of a pruned tree whose inner tables are laid out."""
    out = _Out()
    lists: list[list] = []  # [tag, next number]
    todo: list = [(root, False)]
    while todo:
        x, leaving = todo.pop()
        if isinstance(x, str):
            out.text(x)
            continue
        if leaving:
            if x.tag in ("ul", "ol", "menu"):
                lists.pop()
                out.newline()
                out.indent = "  " * len(lists)
                out.gap = not lists
            elif x.tag in PARAGRAPH:
                out.paragraph()
            else:
                out.newline()
                if x.tag == "li":
                    out.prefix, out.indent = "", "  " * len(lists)
            continue
        tag = x.tag
        if tag == "br":
            out.newline()
            continue
        if tag == "img":
            out.text(x.attrs.get("alt", ""))
            continue
        if tag == "hr":
            out.paragraph()
            continue
        if x.lines is not None:
            out.paragraph()
            for line in x.lines:
                out.line = line
                out.newline()
            out.paragraph()
            continue
        if tag == "textarea":
            out.text(" ")
            out.text(_flat(x))
            out.text(" ")
            continue
        if tag == "option":
            out.text(" ")
        if tag == "pre":
            out.paragraph()
            out.pre(_flat(x).strip("\n"))
            out.paragraph()
            continue
        if tag in ("td", "th") and x is not root:
            out.text(" ")
        if tag in ("ul", "ol", "menu"):
            if lists:
                out.newline()
            else:
                out.paragraph()
            start = x.attrs.get("start", "1")
            lists.append([tag, int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1])
        elif tag == "li":
            out.newline()
            deep = "  " * max(len(lists) - 1, 0)
            value = x.attrs.get("value", "").strip()
            if lists and lists[-1][0] == "ol":
                if value.isascii() and value.isdigit() and len(value) < 10:
                    lists[-1][1] = int(value)
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                mark = "- "
            out.prefix, out.indent = deep + mark, deep + " " * len(mark)
        elif tag in PARAGRAPH:
            out.paragraph()
        elif tag in BLOCK:
            out.newline()
        if tag in BLOCK or tag == "menu":
            todo.append((x, True))
        todo.extend((c, False) for c in reversed(x.children))
    out.newline()
    return "\n".join(out.lines)


def page_text(html: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html)
    for table in reversed(prune(root)):  # inner tables first
        table.lines, table.children = _table(table), []
    return render(root)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [page_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) per row of ``pages``."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_extract, "page_id long, text string")

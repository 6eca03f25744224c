"""HTML to the text that a reader sees.

A tokenizer feeds a tree builder that knows implied end tags; the renderer walks the tree without
recursion over its depth, leaves hidden elements out, collapses white space, keeps blocks apart
as their margins ask, numbers and indents lists, and aligns the cells of tables in columns.

Null html renders to null, empty html to an empty text. Pages of any length and depth are rendered
whole. A visible element within one of hidden visibility is shown; drawings and formulas give their text. Repeated rows render alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import map_arrow

#: Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER_SHOWN = frozenset("script style title head template noscript iframe noembed noframes datalist link meta base param source track object audio video canvas desc metadata defs symbol clippath mask annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu dir hr".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup td th tr tbody thead tfoot caption".split())
#: start tag: (elements that it ends, where the search for them stops)
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
}
#: What a head may hold; another start tag, or text that isn't white space, ends it.
IN_HEAD = frozenset("base link meta title style script noscript noframes template".split())
SCOPE = frozenset("table td th caption html template button".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>?|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_SIGHT = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_MAY_HIDE = re.compile(r"hidden|style|type|open", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None):
        self.tag, self.attributes, self.children = tag, attributes, []
        #: within a drawing or formula, where a tag may end itself
        self.foreign = tag in ("svg", "math") or (parent is not None and parent.foreign and parent.tag != "foreignobject")


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def parse(source: str) -> Node:
    """The document's tree; end tags that the source leaves out are implied."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                text = unescape(text) if "&" in text else text
                if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                    stack.pop()
                stack[-1].children.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            _end(stack, tag)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in CLOSES_P:
            _end_in_scope(stack, ("p",), SCOPE)
        if (rule := IMPLIED_END.get(tag)) is not None:
            _end_in_scope(stack, *rule)
        node = Node(tag, _attributes(m[3]) if m[3] else {}, stack[-1])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW_TEXT:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            end = close.start() if close else n
            raw = source[at:end]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = close.end() if close else n
            continue
        if not (node.foreign and m[3] and m[3].endswith("/")):
            stack.append(node)
    return root


def _end(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    stops = ("table",) if tag not in ("table", "body", "html") else ()
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in stops:
            return


def _end_in_scope(stack: list[Node], ended: tuple[str, ...], stops) -> None:
    """Ends the outermost open one of these elements that lies within the scope."""
    found = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ended:
            found = k
        elif stack[k].tag in stops:
            break
    if found:
        del stack[found:]


def shown(node: Node) -> bool:
    """Visibility: never-shown elements, hidden ones, hidden inputs and closed dialogs don't count."""
    if node.tag in NEVER_SHOWN:
        return False
    a = node.attributes
    if not a:
        return node.tag != "dialog"
    if "hidden" in a or ("style" in a and _HIDING.search(a["style"])):
        return False
    return not (node.tag == "input" and a.get("type", "").lower() == "hidden") and not (node.tag == "dialog" and "open" not in a)


class _Out:
    """Lines of text: inline runs collapse white space, breaks ask for at least so many line ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.blank = True  # nothing, or white space, came last in the run
        self.gap = 0
        self.indent: list[str] = [""]
        self.marker = ""

    def text(self, s: str) -> None:
        lead = s[0] in " \t\n\r\f"
        words = _BLANKS.sub(" ", s).strip(" ")
        if not words:
            if lead and not self.blank:
                self.run.append(" ")
                self.blank = True
            return
        if lead and not self.blank:
            self.run.append(" ")
        self.run.append(words)
        self.blank = s[-1] in " \t\n\r\f"
        if self.blank:
            self.run.append(" ")

    def flush(self) -> bool:
        line = "".join(self.run).strip(" ")
        self.run, self.blank = [], True
        if line:
            self._put(line)
        return bool(line)

    def _put(self, line: str) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        self.gap = 0
        pre = self.indent[-1]
        if self.marker:
            pre = pre[: len(pre) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append(pre + line)

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        if not self.flush():
            self.gap = max(self.gap, 2) if self.lines else self.gap

    def verbatim(self, lines: list[str]) -> None:
        for line in lines:
            if line.strip():
                self._put(line)
            elif self.lines:
                self.gap = 2


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is seen."""
    found = _SIGHT.findall(node.attributes.get("style", "")) if node.attributes else ()
    return found[-1].lower() == "visible" if found else inherited


def run(walk: Generator) -> list[str]:
    """The result of a walk; walks yield the walks whose results they need, so nesting needs no recursion."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def render(node: Node, seen: bool = True) -> Generator:
    """Lines of the visible text below a node."""
    out = _Out()
    sight = [seen]
    lists: list[list] = []  # [kind, next number]
    todo: list = [("in", c) for c in reversed(node.children)]
    preserved = 0
    while todo:
        step, x = todo.pop()
        if step == "out":
            tag = x.tag
            sight.pop()
            if tag == "pre":
                preserved -= 1
                out.verbatim(["".join(out.run).rstrip()])
                out.run = []
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "blockquote", "dd"):
                out.block(1)
                out.marker = ""
                out.indent.pop()
            if tag in ("td", "th"):
                out.text(" ")
            elif tag in BLOCKS:
                out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            continue
        if isinstance(x, str):
            if not sight[-1]:
                continue
            if preserved:
                first, *rest = x.split("\n")
                out.run.append(first)
                for line in rest:
                    s = "".join(out.run).rstrip()
                    out.run = [line]
                    out.verbatim([s])
            elif x:
                out.text(x)
            continue
        tag = x.tag
        if not shown(x):
            continue
        if tag == "br":
            out.newline()
            continue
        here = visible(x, sight[-1])
        if tag == "table":
            out.block(2)
            out.verbatim((yield _table(x, here)))
            out.block(2)
            continue
        if tag == "q":
            sight.append(here)
            todo += [("out", x), ("in", "”")]
            todo += [("in", c) for c in reversed(x.children)]
            todo += [("in", "“")]
            continue
        if tag == "input":
            if here and x.attributes.get("type", "text").lower() in ("text", "submit", "button", "search", "reset", "email", "url", "tel", "number") and x.attributes.get("value"):
                out.text(x.attributes["value"])
            continue
        if tag in BLOCKS:
            out.block(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            start = x.attributes.get("start", "1")
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0] == "ol":
                value = x.attributes.get("value", "")
                if re.fullmatch(r"-?\d{1,9}", value):
                    lists[-1][1] = int(value)
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            out.indent.append(out.indent[-1] + " " * len(marker))
            out.marker = marker
        elif tag == "blockquote":
            out.indent.append(out.indent[-1] + "> ")
        elif tag == "dd":
            out.indent.append(out.indent[-1] + "  ")
        elif tag == "pre":
            preserved += 1
        sight.append(here)
        todo.append(("out", x))
        todo += [("in", c) for c in reversed(x.children)]
    out.flush()
    return out.lines


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1")
    return min(int(value), 1000) if re.fullmatch(r"[1-9]\d{0,6}", value) else 1


def _table(table: Node, seen: bool) -> Generator:
    """Rows with cells padded to the widths of their columns, two spaces apart."""
    captions, rows, todo = [], [], [(x, seen) for x in reversed(table.children)]
    while todo:
        x, sight = todo.pop()
        if isinstance(x, str):
            if sight and x.strip():
                captions.append([x.strip()])
        elif not shown(x):
            continue
        elif x.tag == "tr":
            rows.append((x, visible(x, sight)))
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo += [(c, visible(x, sight)) for c in reversed(x.children)]
        elif x.tag not in ("col", "colgroup"):
            captions.append((yield render(x, visible(x, sight))))
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines)
    busy: dict[int, int] = {}
    for row, sight in rows:
        cells, col = [], 0
        for x in row.children:
            if isinstance(x, str):
                if not x.strip():
                    continue
                x, loose = Node("td", {}), x
                x.children.append(loose)
            if not shown(x):
                continue
            if x.tag not in ("td", "th"):
                loose, x = x, Node("td", {})
                x.children.append(loose)
            while busy.get(col, 0):
                col += 1
            wide, high = _span(x, "colspan"), _span(x, "rowspan")
            cells.append((col, wide, (yield render(x, visible(x, sight)))))
            for c in range(col, col + wide):
                busy[c] = high
            col += wide
        busy = {c: k - 1 for c, k in busy.items() if k > 1}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for col, wide, lines in cells:
            if wide == 1:
                width[col] = max(width.get(col, 0), *(len(s) for s in lines), 0)
            else:
                for c in range(col, col + wide):
                    width.setdefault(c, 0)
    for cells in grid:
        for col, wide, lines in cells:
            if wide > 1 and (short := max((len(s) for s in lines), default=0) - sum(width[c] for c in range(col, col + wide)) - 2 * (wide - 1)) > 0:
                width[col + wide - 1] += short
    left, at = {}, 0
    for c in sorted(width):
        left[c] = at
        at += width[c] + 2 if width[c] else 0
    out = [line for lines in captions for line in lines]
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for col, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(left[col]) + lines[k]
            out.append(line.rstrip())
    return out


def html_text(source: str) -> str:
    return "\n".join(run(render(parse(source))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_lines."""

    def task(batch):
        for part in K.slices(batch, "html"):
            texts = [None if s is None else html_text(s) for s in part.column(2).to_pylist()]
            yield {
                "page_id": part.column(0),
                "url": part.column(1),
                "text": pa.array(texts, pa.string()),
                "n_chars": [None if t is None else len(t) for t in texts],
                "n_lines": [None if t is None else (t.count("\n") + 1 if t else 0) for t in texts],
            }

    return map_arrow(pages.select("page_id", "url", "html"), task, "page_id bigint, url string, text string, n_chars bigint, n_lines bigint")

"""Layout-aware rendering of HTML to plain text."""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Fixed values of the HTML standard: element categories and implied end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
HIDDEN = frozenset("head script style template noscript iframe noframes object embed applet audio video canvas datalist title meta link base param source track area meter progress rp".split())
#: Of a drawing only these show text; of a formula all but these do.
DRAWN, UNDRAWN = frozenset("text foreignobject".split()), frozenset("annotation annotation-xml".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre table figure fieldset hr".split())
#: An open element of the value ends when the key starts, up to the nearest scope element.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption", "colgroup"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "rp": {"rt", "rp"},
    "rt": {"rt", "rp"},
}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
ENDS_P = BLOCK - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"} | {"li", "dt", "dd"}
TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_ABSENT = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!important\s*)?(?:;|$)", re.I)
#: Lists, quotes and tables in each other of which each is set apart; deeper ones are printed flat.
NESTED = 24
#: White space that collapses; no-break spaces stay.
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(source: str) -> Node:
    """A tree of nodes and strings, with implied end tags; never fails."""
    root = Node("#root", {})
    stack = [root]
    open_: Counter = Counter()
    at = 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(s)

    def leave(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    def close(names, stop=()) -> None:
        if not any(open_[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                leave(k)
                return
            if stack[k].tag in stop:
                return

    while at < len(source):
        found = _TOKEN.search(source, at)
        if not found:
            text(unescape(source[at:]))
            break
        if found.start() > at:
            text(unescape(source[at : found.start()]))
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag == "p" and not open_["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                # formatting tags do not end the block or cell around them
                close({tag}, () if tag in BLOCK and tag not in TABLE_PARTS else {"table"} if tag in TABLE_PARTS else BLOCK)
            continue
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                text(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        rest = found[3] or ""
        attributes = {}
        if rest.strip(" /\n\t\r\f"):
            for m in _ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
        if tag in ("html", "body") and open_[tag]:
            continue
        if tag == "body":
            close({"head"})
        elif tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in CLOSES:
            stop = SCOPE.get(tag, {"table"})
            for _ in range(4):
                before = len(stack)
                close(CLOSES[tag], stop | {"table"})
                if len(stack) == before:
                    break
        if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            leave(len(stack) - 1)
        if tag == "a":
            close({"a"}, BLOCK)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            body = source[at : end.start() if end else len(source)]
            node.children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else len(source)
            continue
        if tag == "plaintext":
            node.children.append(source[at:])
            break
        if found[0].endswith("/>") and (open_["svg"] or open_["math"]):
            continue
        stack.append(node)
        open_[tag] += 1
    return root


def visible(node: Node) -> bool:
    """Whether an element is laid out at all."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _ABSENT.search(a["style"]))


def shows(node: Node, shown: bool) -> bool:
    """Whether the text of an element is painted: what it says itself, else as its parent."""
    found = _VISIBILITY.search(node.attributes["style"]) if "style" in node.attributes else None
    return found[1].lower() == "visible" if found else shown


def drawn(node: Node):
    """The parts of a drawing that hold text."""
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str) or not visible(n):
            continue
        if n.tag in DRAWN:
            yield n
        else:
            todo.extend(reversed(n.children))


class _Out:
    """Lines of text with collapsed white space and pending blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix = ""

    def text(self, s: str) -> None:
        flat = _WHITE.sub(" ", s)
        if flat == " ":
            self.space = self.space or bool(self.line)
            return
        if flat[0] == " ":
            self.space = self.space or bool(self.line)
            flat = flat[1:]
        trailing = flat[-1:] == " "
        self.put((" " if self.space and self.line else "") + (flat[:-1] if trailing else flat))
        self.space = trailing

    def put(self, s: str) -> None:
        if not self.line and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.line.append(s)

    def end(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append(self.prefix + "".join(self.line))
            self.line = []
        self.space = False
        if self.lines:
            self.gap = max(self.gap, gap)

    def verbatim(self, s: str) -> None:
        for i, x in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                if self.line:
                    self.end()
                elif self.lines:
                    self.gap += 1
            if x:
                self.put(x)

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _walk(node: Node, out: _Out, depth: int, pre: bool, shown: bool = True, nest: int = 0) -> None:
    for child in node.children:
        if isinstance(child, str):
            if not shown:
                continue
            if pre:
                out.verbatim(child)
            else:
                out.text(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        seen = shows(child, shown)
        if tag == "br":
            if out.line:
                out.end()
            elif out.lines:
                out.gap = min(out.gap + 1, 1)
        elif tag == "hr":
            out.end(1)
        elif tag == "img":
            if seen and child.attributes.get("alt", "").strip():
                out.text(child.attributes["alt"])
        elif tag == "input":
            kind, value = child.attributes.get("type", "text").lower(), child.attributes.get("value", "")
            if seen and value.strip() and kind not in ("hidden", "password", "checkbox", "radio", "file", "image", "color", "range"):
                out.text(f" {value} ")
        elif tag == "svg":
            for part in drawn(child):
                out.text(" ")
                _walk(part, out, depth, False, shows(part, seen), nest)
                out.text(" ")
        elif tag in UNDRAWN:
            continue
        elif tag in ("select", "option", "optgroup"):
            out.end()
            if seen and tag == "optgroup" and child.attributes.get("label", "").strip():
                out.text(child.attributes["label"])
                out.end()
            if seen and tag == "option" and not any(isinstance(c, str) and c.strip() for c in child.children) and child.attributes.get("label", "").strip():
                out.text(child.attributes["label"])
            _walk(child, out, depth, False, seen, nest)
            out.end()
        elif tag == "table" and nest < NESTED:
            out.end(1)
            for line in _table(child, seen, nest + 1):
                out.put(line)
                out.end()
            out.end(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            gap = 0 if depth else 1
            out.end(gap)
            _items(child, out, depth, pre, seen, nest)
            out.end(gap)
        elif tag in BLOCK:
            gap = 1 if tag in SPACED else 0
            out.end(gap)
            if tag == "blockquote":
                _indented(child, out, depth, pre, "> ", None, seen, nest)
            elif tag == "dd":
                _indented(child, out, depth, pre, "    ", None, seen, nest)
            else:
                _walk(child, out, depth, pre or tag == "pre", seen, nest)
            out.end(gap)
        else:
            _walk(child, out, depth, pre or tag == "textarea", seen, nest)


def _indented(node: Node, out: _Out, depth: int, pre: bool, prefix: str, first: str | None, shown: bool, nest: int) -> None:
    if nest >= NESTED:
        if first is not None and shown:
            out.put(first)
        _walk(node, out, depth, pre, shown, nest)
        out.end()
        return
    inner = _Out()
    _walk(node, inner, depth, pre, shown, nest + 1)
    body = inner.done()
    if first is not None and not shown:  # an unseen item has no mark, what is seen in it stays
        first = prefix if body else None
    for i, line in enumerate(body.split("\n") if body else [""] if first else []):
        lead = first if first is not None and i == 0 else prefix if line or prefix.strip() else ""
        if not line and not lead.strip():
            out.gap = 1
            continue
        out.put((lead + line).rstrip())
        out.end()


def _items(node: Node, out: _Out, depth: int, pre: bool, shown: bool, nest: int) -> None:
    try:
        number = int(node.attributes.get("start", "1"))
    except ValueError:
        number = 1
    for child in node.children:
        if isinstance(child, str):
            if shown and child.strip():
                out.text(child)
            continue
        if not visible(child):
            continue
        if child.tag == "li":
            out.end()
            try:
                number = int(child.attributes["value"]) if node.tag == "ol" and "value" in child.attributes else number
            except ValueError:
                pass
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            _indented(child, out, depth + 1, pre, " " * len(mark), mark, shows(child, shown), nest)
            out.end()
        else:
            holder = Node("#part", {})
            holder.children.append(child)
            _walk(holder, out, depth + (child.tag in ("ul", "ol", "menu", "dir")), pre, shown, nest)


def _span(node: Node, name: str) -> int:
    try:
        return max(1, min(100, int(node.attributes.get(name, "1"))))
    except ValueError:
        return 1


def _table(table: Node, shown: bool, nest: int) -> list[str]:
    """Rows of aligned cells joined by ' | '; captions come first."""
    captions, rows, loose = [], [], []

    def text(s: str, seen: bool) -> None:
        if seen and s.strip():
            loose.append(_WHITE.sub(" ", s).strip())

    def apart(child: Node, seen: bool) -> None:
        holder = Node("#part", {})
        holder.children.append(child)
        loose.append(render(holder, seen, nest))

    def visit(node: Node, seen: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                text(child, seen)
                continue
            if not visible(child):
                continue
            own = shows(child, seen)
            if child.tag == "caption":
                captions.append(render(child, own, nest))
            elif child.tag == "tr":
                rows.append([(c, shows(c, own)) for c in child.children if not isinstance(c, str) and c.tag in ("td", "th") and visible(c)])
                for c in child.children:
                    if isinstance(c, str):
                        text(c, own)
                    elif c.tag not in ("td", "th") and visible(c):
                        apart(c, own)
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                visit(child, own)
            elif child.tag in ("td", "th"):
                rows.append([(child, own)])
            else:
                apart(child, seen)

    visit(table, shown)
    grid: list[dict[int, list[str]]] = []
    taken: dict[tuple[int, int], bool] = {}
    for r, cells in enumerate(rows):
        line: dict[int, list[str]] = {}
        c = 0
        for cell, own in cells:
            while (r, c) in taken:
                c += 1
            line[c] = render(cell, own, nest).split("\n")
            for i in range(_span(cell, "rowspan")):
                for j in range(_span(cell, "colspan")):
                    taken[r + i, c + j] = True
            c += _span(cell, "colspan")
        grid.append(line)
    columns = 1 + max((c for line in grid for c in line), default=-1)
    widths = [max((len(x) for line in grid for x in line.get(c, [""])), default=0) for c in range(columns)]
    out = [x for block in (*captions, *(s for s in loose if s)) for x in block.split("\n") if x]
    for line in grid:
        for k in range(max((len(x) for x in line.values()), default=0)):
            parts = [(line.get(c, [])[k : k + 1] or [""])[0].ljust(widths[c]) for c in range(columns)]
            s = " | ".join(parts).rstrip() if columns > 1 else parts[0].rstrip()
            if s.strip(" |"):
                out.append(s)
    return out


def render(node: Node, shown: bool = True, nest: int = 0) -> str:
    out = _Out()
    _walk(node, out, 0, False, shown, nest)
    return out.done()


def _depth(root: Node) -> int:
    most, todo = 0, [(root, 1)]
    while todo:
        node, n = todo.pop()
        most = max(most, n)
        todo.extend((c, n + 1) for c in node.children if not isinstance(c, str))
    return most


def rendered(root: Node) -> str:
    """The text of a tree of any depth."""
    before = sys.getrecursionlimit()
    need = 4 * _depth(root) + 500
    if need <= before:
        return render(root)
    sys.setrecursionlimit(need)  # calls of Python functions take no native stack
    try:
        return render(root)
    finally:
        sys.setrecursionlimit(before)


def to_text(source: str | None) -> str | None:
    """The visible text of an HTML page; null for null."""
    return None if source is None else rendered(parse(source))


def title_of(root: Node) -> str | None:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "title":
            return _WHITE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return None


def _extract(batch: pa.RecordBatch):
    titles, texts = [], []
    for source in batch.column("html").to_pylist():
        root = parse(source) if source is not None else None
        titles.append(title_of(root) if root else None)
        texts.append(rendered(root) if root else None)
    yield batch.column("id"), titles, texts


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, title, text`` of every page.

    The tree builder closes paragraphs, list items, table parts and options as
    their start tags imply. What browsers with scripts on do not lay out gives
    nothing: the head, scripts, styles, ``hidden`` and ``display:none`` elements,
    closed dialogs, what stands in for media. Text of ``visibility:hidden``
    elements gives nothing either, unless an element inside is visible again. All
    else does, in document order: formulas, text in drawings, all options of a
    choice, values of buttons and fields, alternative texts of images; details
    count as opened. Style sheets are not read. Paragraph-like blocks are set off
    by an empty line, other blocks by a line break; list items carry a dash or
    their number and nest by indentation; cells of a table row are padded to
    their column's width and joined by `` | ``; ``pre`` keeps its white space.
    Elements may nest to any depth; beyond ``NESTED`` lists, quotes and tables in
    each other the text goes on without further indentation.

    Edge cases: null gives null text and title; an empty page gives an empty
    text; broken markup never fails, and an open comment hides the rest. Ids may
    be null or repeat, each row is rendered on its own. Other columns are
    ignored.
    """
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return arrow_map(source, _extract, "id long, title string, text string").withColumnRenamed("id", "page_id")

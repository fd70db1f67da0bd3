"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: Open elements at most; deeper ones become siblings, as in browsers.
DEPTH = 150
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag; of the last two it is seen, with character references.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title audio video canvas datalist rp area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend"
    " listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption xmp".split()
)
#: Blocks with an empty line above and below.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing ol p pre table ul menu dir xmp".split())
CLOSES_P = BLOCK - frozenset("body html li dt dd option optgroup legend tbody td tfoot th thead tr caption".split()) | frozenset(["plaintext"])
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ROWS = frozenset(["table", "tbody", "thead", "tfoot", "tr"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A start tag closes open elements of the first set, as far up as one of the second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset(["tr", "table"])),
    "th": (frozenset("td th caption colgroup".split()), frozenset(["tr", "table"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["caption"] = IMPLIED["colgroup"] = IMPLIED["tbody"]
TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]++))?""")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
NOTABLE = re.compile(r"hidden|style|span|start|value|type|open|reversed", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")
_ends: dict[str, re.Pattern] = {}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes(text: str) -> dict[str, str]:
    """Only of tags that have one which matters to layout or visibility; the first of equal names counts."""
    out: dict[str, str] = {}
    if NOTABLE.search(text):
        for name, value in ATTRIBUTE.findall(text):
            if value[:1] in ("'", '"'):
                value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
            out.setdefault(name.lower(), unescape(value))
    return out


def parse(html: str) -> Node:
    """The tree of a page. html and body tags are transparent; a head ends at the first thing that can't be in it."""
    root = Node("#root")
    stack = [root]
    at = 0

    def close(tags: frozenset, up_to: frozenset) -> None:
        """Pop to the outermost open element of `tags` that is inside the nearest of `up_to`."""
        last = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in up_to:
                break
            if stack[i].tag in tags:
                last = i
        if last:
            del stack[last:]

    def leave_head() -> None:
        for i in range(1, len(stack)):
            if stack[i].tag == "head":
                del stack[i:]
                return

    def place(child) -> None:
        """Append; what can't stand between a table's cells goes before the table."""
        if stack[-1].tag in ROWS and not (isinstance(child, Node) and child.tag in _IN_TABLE) and not (isinstance(child, str) and not child.strip()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "table":
                    siblings = stack[i - 1].children
                    siblings.insert(len(siblings) - 1 if siblings and siblings[-1] is stack[i] else len(siblings), child)
                    return
        stack[-1].children.append(child)

    def text(s: str) -> None:
        if s:
            if len(stack) > 1 and s.strip():
                if any(n.tag == "head" for n in stack[1:3]):
                    leave_head()
            place(unescape(s) if "&" in s else s)

    size = len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                place(Node("p"))
            elif tag == "br":
                place(Node("br"))
            elif tag not in ("html", "body"):
                wall = _NONE if tag in ROWS or tag in ("td", "th") else _CELLS
                for i in range(len(stack) - 1, 0, -1):
                    name = stack[i].tag
                    if name == tag or tag in HEADINGS and name in HEADINGS:
                        del stack[i:]
                        break
                    if name in wall or name == "table" and tag in ROWS:
                        break
            continue
        if tag in ("html", "body"):
            leave_head()
            continue
        if len(stack) > 1 and tag not in IN_HEAD and any(n.tag == "head" for n in stack[1:3]):
            leave_head()
        if tag in CLOSES_P:
            close(_P, _SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                stack.append(row)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        node = Node(tag, attributes(m[3]) if m[3] else None)
        place(node)
        if tag in RAW:
            if tag not in _ends:
                _ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
            e = _ends[tag].search(html, at)
            inner = html[at : e.start() if e else size]
            at = e.end() if e else size
            if tag in ("textarea", "xmp"):
                node.children.append(unescape(inner) if tag == "textarea" else inner)
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


_P, _NONE = frozenset(["p"]), frozenset()
_CELLS = frozenset(["td", "th", "caption"])
_SCOPE = frozenset("td th caption table button object template marquee".split())
_IN_TABLE = frozenset("tr td th tbody thead tfoot caption colgroup col script style template".split())


def visible(node: Node) -> bool:
    """Not by tag, not by the hidden attribute, not by an inline style."""
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if not a:
        return node.tag != "dialog"
    if "hidden" in a or "style" in a and UNSEEN.search(a["style"]):
        return False
    return not (node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden")


def _number(text: str | None, otherwise: int, most: int = 1000) -> int:
    try:
        return max(0, min(most, int(text)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return otherwise


class Page:
    """Lines so far, the line at hand, and empty lines due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space due before the next word of the line
        self.gap = 0
        self.prefix = ""  # of the next line, once
        self.indent = ""

    def words(self, s: str) -> None:
        parts = BLANK.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
            parts = parts[1:]
        trailing = parts[-1] == ""
        if trailing:
            parts.pop()
        if parts:
            joined = " ".join(parts)
            self.line.append(" " + joined if self.space and self.line else joined)
            self.space = trailing
        elif trailing:
            self.space = True

    def end_line(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            head = self.prefix or self.indent
            self.prefix = ""
            self.lines.append((head + "".join(self.line)).rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced:
            self.gap = 1

    def preformatted(self, s: str) -> None:
        rows = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, row in enumerate(rows):
            if row:
                self.line.append(row.expandtabs(8))
            if i + 1 < len(rows):
                self.end_line(even_empty=True)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(node: Node, page: Page, pre: bool = False, depth: int = 0) -> None:
    for child in node.children:
        if isinstance(child, str):
            page.preformatted(child) if pre else page.words(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            page.end_line(even_empty=True)
        elif tag == "hr":
            page.block(True)
        elif tag == "table":
            page.block(True)
            _table(child, page, depth)
            page.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(depth == 0)
            _list(child, page, depth)
            page.block(depth == 0)
        elif tag == "details" and "open" not in child.attributes:
            page.block(False)
            render(_only(child, "summary"), page, pre, depth)
            page.block(False)
        elif tag == "input":
            if child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                page.words(child.attributes.get("value", ""))
        elif tag in BLOCK:
            spaced = tag in SPACED
            page.block(spaced)
            before = page.indent
            if tag in ("blockquote", "dd"):
                page.indent += "  "
            own = tag in ("pre", "listing", "xmp")
            if own and child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
                child.children[0] = child.children[0][1:]
            render(child, page, pre or own, depth)
            page.block(spaced)
            page.indent = before
        else:
            render(child, page, pre or tag == "textarea", depth)


def _only(node: Node, tag: str) -> Node:
    out = Node("div")
    out.children = [c for c in node.children if isinstance(c, Node) and c.tag == tag][:1]
    return out


def _list(node: Node, page: Page, depth: int) -> None:
    items = [c for c in node.children if not isinstance(c, str) and c.tag == "li" and visible(c)]
    ordered, before = node.tag == "ol", page.indent
    down = -1 if "reversed" in node.attributes else 1
    n = _number(node.attributes.get("start"), len(items) if down < 0 else 1, 10**9)
    for c in node.children:
        if isinstance(c, str):
            page.words(c)
        elif c.tag == "li" and visible(c):
            page.end_line()
            n = _number(c.attributes.get("value"), n, 10**9)
            mark = f"{n}. " if ordered else "- "
            n += down
            page.prefix = before + mark
            page.indent = before + " " * len(mark)
            render(c, page, False, depth + 1)
            page.end_line(even_empty=bool(page.prefix))
            page.gap = 0
            page.indent = before
        elif visible(c):
            holder = Node("div")
            holder.children = [c]
            page.indent = before + "  "
            render(holder, page, False, depth + 1)
            page.end_line()
            page.indent = before


def _table(node: Node, page: Page, depth: int) -> None:
    """Captions, then rows of cells, every column as wide as its widest cell that spans no other."""
    rows: list[list[tuple[list[str], int, int]]] = []
    todo = [node]
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    for c in node.children:
        if not isinstance(c, str) and visible(c):
            if c.tag == "caption":
                render(c, page, False, depth)
                page.end_line()
            elif c.tag in parts:
                parts[c.tag] += [r for r in c.children if not isinstance(r, str) and r.tag == "tr" and visible(r)]
            elif c.tag == "tr":
                parts["tbody"].append(c)
    todo = parts["thead"] + parts["tbody"] + parts["tfoot"]
    busy: dict[int, int] = {}  # columns that a cell of a row above still fills
    for r in todo:
        row, at = [], 0
        for c in r.children:
            if isinstance(c, str) or c.tag not in ("td", "th") or not visible(c):
                continue
            while busy.get(at, 0) > 0:
                row.append(([], at, 1))
                at += 1
            inner = Page()
            render(c, inner, False, depth + 1)
            wide = max(1, _number(c.attributes.get("colspan"), 1))
            row.append((inner.done(), at, wide))
            down = _number(c.attributes.get("rowspan"), 1)
            for k in range(at, at + wide):
                busy[k] = max(busy.get(k, 0), down)
            at += wide
        busy = {k: v - 1 for k, v in busy.items() if v > 1}
        rows.append(row)
    widths: dict[int, int] = {}
    for row in rows:
        for lines, at, wide in row:
            if wide == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines)) if lines else widths.get(at, 0)
    for row in rows:
        for k in range(max((len(c[0]) for c in row), default=0)):
            line = ""
            for lines, at, wide in row:
                s = lines[k] if k < len(lines) else ""
                full = sum(widths.get(x, 0) for x in range(at, at + wide)) + 3 * (wide - 1)
                line += (" | " if at else "") + s.ljust(full)
            if line.strip(" |"):
                page.line = [line.rstrip()]
                page.end_line()
    page.end_line()


def extract(html: str) -> str:
    """All visible text of a page, with its layout."""
    page = Page()
    render(parse(html.replace("\0", "�")), page)
    return "\n".join(page.done())


def html_text(pages: DataFrame, doc_id: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, text, n_chars, n_lines) of every row. Null and empty pages have empty text and no lines.

    Other columns are ignored; repeated rows are extracted each. Broken markup never fails: it is read as browsers do, with
    tags implied, stray end tags dropped, and an unclosed quote or comment taking the rest of the page.
    """
    core.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in core.pieces(batch, "html"):
                text = [extract(t) if t else "" for t in x.column(x.num_columns - 1).to_pylist()]
                cols = [*x.columns[:-1], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())]
                yield pa.record_batch(cols, [*x.schema.names[:-1], "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(doc_id).cast("long").alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(html).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    done = rows.mapInArrow(run, f"{kinds}, text string, n_chars long, n_lines long")
    return done.select(F.col("id").alias(doc_id), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "text", "n_chars", "n_lines")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(core.table(spark, sf_dir, "pages"), carry=("url",))

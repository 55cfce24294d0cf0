"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder turns tags into well-nested elements: it supplies the end tags
and table rows that HTML lets authors omit, and knows which elements are not
shown. A layout pass over the opening and closing of elements writes text with
blank lines between paragraphs, indented lists and table cells in columns. The
builder keeps the path of open elements, not the whole tree, so depth and
length of a page cost no more than its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import column_array, query, read, text_or_empty

# Fixed values of HTML: element classes by their behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript datalist iframe noembed noframes object audio video canvas rp".split()
)
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl menu dir figure hr".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header "
    "hgroup legend li main nav optgroup option search section summary textarea xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body caption legend optgroup option textarea".split())
#: A start tag ends these open elements, unless one of the others stands between.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "td", "th", "caption")),
    "dt": (("dt", "dd"), ("dl", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "td", "th")),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption", "colgroup"), ("table", "tr")),
    "th": (("td", "th", "caption", "colgroup"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "caption": (("caption", "tr", "td", "th"), ("table",)),
}
#: An end tag of anything else does not reach beyond these.
FENCES = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())

#: A quote delimits a value right after "=" and white space only; one without a partner is part of an unquoted value.
ATTRIBUTES = r"""(?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+))?+)*+"""
TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|</?[a-zA-Z][^>]*+>?|</[^>]*+>?""",
    re.S,
)
ATTRIBUTE = re.compile(
    r"""([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]*+)))?"""
)
SPACE = re.compile(r"[ \t\n\r\f]+")
DISPLAY_NONE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Canvas:
    """Lines of text with pending breaks; ``indent`` stands before every new line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0
        self.indent = ""
        self.mark = ""

    def end_line(self) -> None:
        if self.line.strip(" "):
            self.lines.append(self.line.rstrip(" "))
        self.line = ""

    def space(self, lines: int) -> None:
        """At least so many line ends before what comes next."""
        self.end_line()
        self.gap = max(self.gap, lines)

    def begin(self) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line = self.indent + self.mark
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""

    def write(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        if not self.line or self.line[-1] == " ":
            text = text.lstrip(" ")
        if text:
            self.begin()
            self.line += text

    def write_pre(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                if self.line:
                    self.lines.append(self.line.rstrip(" "))
                elif self.lines and not self.gap:
                    self.lines.append("")
                self.line = ""
            if part:
                self.begin()
                self.line += part

    def new_line(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        self.space(2)
        for line in lines:
            self.begin()
            self.line = (self.line + line).rstrip(" ")
            self.lines.append(self.line)
            self.line = ""
        self.gap = 2

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of cells ``(lines, columns spanned)`` with every column as wide as its widest cell."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            while len(widths) < at + span:
                widths.append(0)
            if span == 1:
                widths[at] = max(widths[at], max(map(len, lines), default=0))
            at += span
    for row in rows:
        at = 0
        for lines, span in row:
            have = sum(widths[at : at + span]) + 2 * (span - 1)
            if span > 1:
                widths[at + span - 1] += max(0, max(map(len, lines), default=0) - have)
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                width = sum(widths[at : at + span]) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append("  ".join(parts).rstrip(" "))
    return out


class Element:
    __slots__ = ("tag", "shown", "visible", "pre", "state", "shut")

    def __init__(self, tag: str, above: Element | None) -> None:
        self.tag = tag
        self.shown = above.shown if above else True
        self.visible = above.visible if above else True
        self.pre = above.pre if above else False
        self.state = None
        self.shut = False


class Page:
    """Tree builder and layout of one page."""

    def __init__(self) -> None:
        self.path = [Element("", None)]
        self.canvas = Canvas()

    # -- tree ------------------------------------------------------------------------------

    def find(self, tags: tuple[str, ...], fences) -> int:
        """Place of the nearest open element of ``tags`` before one of ``fences``, or 0."""
        for i in range(len(self.path) - 1, 0, -1):
            tag = self.path[i].tag
            if tag in tags:
                return i
            if tag in fences:
                return 0
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            self.close_head()
            return
        if self.path[-1].tag == "head" and tag not in IN_HEAD:
            self.close_head()
        if tag in CLOSES_P and (i := self.find(("p",), FENCES)):
            self.pop_to(i)
        if tag in HEADINGS and self.path[-1].tag in HEADINGS:
            self.pop_to(len(self.path) - 1)
        if tag in IMPLIED_END:
            ends, fences = IMPLIED_END[tag]
            while i := self.find(ends, fences):
                self.pop_to(i)
        if tag in ("td", "th") and not self.find(("tr",), ("table",)) and self.find(("table",), ()):
            self.push("tr", "")
        self.push(tag, attributes)
        if tag in VOID:
            self.pop_to(len(self.path) - 1)

    def close_head(self) -> None:
        if i := self.find(("head",), ()):
            self.pop_to(i)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.find(("p",), FENCES):
            self.canvas.space(2)
        elif tag in HEADINGS:
            if i := self.find(tuple(HEADINGS), FENCES):
                self.pop_to(i)
        elif i := self.find((tag,), () if tag == "table" else ("table",) if tag in TABLE_PARTS else FENCES):
            self.pop_to(i)

    def push(self, tag: str, attributes: str) -> None:
        above = self.path[-1]
        el = Element(tag, above)
        if above.shut and tag != "summary":
            el.shown = False
        if tag in UNSEEN:
            el.shown = False
        span = 1
        number = None
        if attributes.strip(" /"):
            found = {
                m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(attributes)))
            }
            style = found.get("style", "")
            if "hidden" in found or DISPLAY_NONE.search(style):
                el.shown = False
            if look := VISIBILITY.findall(style):
                el.visible = look[-1].lower() == "visible"
            if found.get("colspan", "").isdecimal():
                span = min(max(1, int(found["colspan"])), 1000)
            if re.fullmatch(r"-?\d{1,9}", found.get("start", "")):
                number = int(found["start"])
        else:
            found = {}
        if tag == "details":
            el.shut = "open" not in found
        if tag == "dialog" and "open" not in found:
            el.shown = False
        if tag in ("pre", "textarea", "xmp"):
            el.pre = True
        self.path.append(el)
        if el.shown:
            self.open_layout(el, span, number)

    def pop_to(self, i: int) -> None:
        while len(self.path) > i:
            el = self.path.pop()
            if el.shown:
                self.close_layout(el)

    # -- layout ----------------------------------------------------------------------------

    def open_layout(self, el: Element, span: int, number: int | None) -> None:
        tag = el.tag
        if tag == "br":
            self.canvas.new_line()
            return
        if tag in BLOCKS:
            inside_list = tag in ("ul", "ol", "menu", "dir") and self.find(("li",), FENCES)
            self.canvas.space(2 if tag in PARAGRAPHS and not inside_list and not self.canvas.mark else 1)
        if tag in ("ol", "ul", "menu", "dir"):
            el.state = number if number is not None else 1
        elif tag in ("li", "blockquote", "dd"):
            el.state = self.canvas.indent
            if tag == "li":
                i = self.find(("ul", "ol", "menu", "dir"), FENCES)
                if i and self.path[i].tag == "ol":
                    self.canvas.mark = f"{self.path[i].state}. "
                    self.path[i].state += 1
                else:
                    self.canvas.mark = "- "
            else:
                self.canvas.indent += "  "
        elif tag == "table":
            el.state = []
        elif tag == "tr":
            if i := self.find(("table",), ()):
                self.path[i].state.append([]) if self.path[i].state is not None else None
        elif tag in ("td", "th"):
            el.state = (self.canvas, span)
            self.canvas = Canvas()

    def close_layout(self, el: Element) -> None:
        tag = el.tag
        if tag in ("td", "th"):
            lines, (self.canvas, span) = self.canvas.result(), el.state
            i = self.find(("table",), ())
            rows = self.path[i].state if i else None
            if rows:
                rows[-1].append((lines, span))
            else:
                self.canvas.block(lines)
        elif tag == "table":
            self.canvas.block(aligned(el.state))
        elif tag in BLOCKS:
            inside_list = tag in ("ul", "ol", "menu", "dir") and self.find(("li",), FENCES)
            if tag == "li":
                self.canvas.mark = ""
            self.canvas.space(2 if tag in PARAGRAPHS and not inside_list else 1)
            if tag in ("li", "blockquote", "dd"):
                self.canvas.indent = el.state

    def text(self, raw: str) -> None:
        el = self.path[-1]
        if el.tag == "head" and raw.strip(" \t\n\r\f"):
            self.close_head()
            el = self.path[-1]
        if el.shown and el.visible and not el.shut:
            text = html.unescape(raw).replace("\xa0", " ") if "&" in raw or "\xa0" in raw else raw
            if el.pre:
                self.canvas.write_pre(text.replace("\r\n", "\n").replace("\r", "\n"))
            else:
                self.canvas.write(text)


def render(page: str) -> str:
    """All visible text of ``page``."""
    tree, at = Page(), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            tree.text(page[at:])
            break
        if m.start() > at:
            tree.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue  # a comment, a declaration or a tag cut off by the end
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        tree.start(tag, m[3])
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else len(page)
            if stop > at and tag not in UNSEEN:
                body = page[at:stop]
                tree.text(body[1:] if body[0] == "\n" else body)
            at = stop
        elif tag == "pre" and page[at : at + 1] == "\n":
            at += 1
    tree.pop_to(1)
    return "\n".join(tree.canvas.result())


def extract(pages: DataFrame, body: str = "html", page_id: str = "page_id") -> DataFrame:
    """``(page_id, text)`` of every row; a null or empty page has the empty text, equal rows equal texts."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(p) for p in column_array(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(page_id).alias("page_id"), text_or_empty(body).alias("html")).mapInArrow(
        run, f"page_id {kind}, text string"
    )


@query("op6_layout_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    found = extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))

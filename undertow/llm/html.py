"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned tables.

A page becomes a tree: tags that authors leave out are implied (the end of a paragraph before a block, of a list item, table
row or cell before the next), unmatched ends are ignored, raw elements run to their own end tag. Visibility
rules then decide what is shown: elements that never are, hidden attributes, inline styles, display and
visibility in the page's own style sheets (type, class and id selectors), and closed details. What is left is
laid out line by line. Both steps are loops, so that depth doesn't matter, and take time in proportion to the page:
places of open elements are kept by tag, and once a tag is left open by a quote, the tags after it end at
the next ``>`` whatever quotes say.

Defined results: a null or empty page renders as an empty text; pages are read whole; text outside of any tag
counts as body text; equal pages give equal texts, and rows that repeat stay; an empty table gives no rows; ``<`` without
a ``>`` after it is text. Very long pages: list items are indented ``DEEPEST`` marks at most, and cells padded to
``WIDEST`` characters and lines of tables to ``FARTHEST`` at most, so that a text is not much longer than its page; all of their words stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from html import unescape

from pyspark.sql import DataFrame

from undertow.llm.arrow import map_rows

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template title meta link noscript iframe noembed noframes datalist object audio video canvas svg math area base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option optgroup select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup select li dd dt".split()) | {"hr"}
#: Which open elements a start tag ends, and the elements that such a search doesn't leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
BARRIER = frozenset("table td th caption html template button".split())
PLAIN = r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|[^<]+|<"
TOKEN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|""" + PLAIN, re.S)
#: Where a quote has no end: tags up to the next >, and where no > comes, text.
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>|" + PLAIN, re.S)
TEXT = re.compile(r"()()<!--.*?(?:-->|\Z)|()[^<]+|<", re.S)
OPENING = re.compile(r"</?[A-Za-z]")
DEEPEST, WIDEST, FARTHEST = 32, 200, 400
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"[ \t\n\f\r]+")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Open:
    """The open elements, outermost first, and the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """End all elements from a place on."""
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def end(self, tags: set[str], limits) -> None:
        """End the outermost open element of ``tags`` above the nearest of ``limits``."""
        if not any(self.places.get(t) for t in tags):
            return
        limit = self.nearest(limits)
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, limit)) < len(p)]
        if found:
            self.cut(min(found))


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and its style sheets."""
    root = Node("body", {})
    open_, styles, at = Open(root), [], 0
    tokens, last = TOKEN, page.rfind(">")
    while at < len(page):
        match = (tokens if at < last else TEXT).match(page, at)
        if tokens is TOKEN and match[0] == "<" and at < last and OPENING.match(page, at):
            tokens = LOOSE
            continue
        at = match.end()
        tag = match[2]
        if not tag:
            if match[0][0] != "<" or match[0] == "<":
                open_.stack[-1].children.append(unescape(match[0]) if "&" in match[0] else match[0])
            continue
        tag = tag.lower()
        if match[1]:
            place = open_.nearest((tag,))
            if place and (tag in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") or place >= open_.nearest(BARRIER)):
                open_.cut(place)
            continue
        if tag in CLOSES_P:
            open_.end({"p"}, BARRIER)
        if tag in ENDS:
            open_.end(*ENDS[tag])
        if tag in ("html", "body") and len(open_.stack) == 1:
            root.attrs = attributes(match[3]) | root.attrs
            continue
        node = Node(tag, attributes(match[3]) if match[3].strip(" /\t\r\n") else {})
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            if tag == "style":
                styles.append(inside)
            node.children.append(unescape(inside) if tag in ("textarea", "title") else inside)
            at = page.find(">", end.start()) + 1 if end and end.start() < last else len(page)
        elif tag not in VOID and not (match[3].endswith("/") and tag in ("svg", "path", "g")):
            open_.push(node)
    return root, styles


def hidden_selectors(styles: list[str]) -> set[str]:
    """Plain selectors (a type, .class or #id) that the page's style sheets hide."""
    out = set()
    for sheet in styles:
        for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if HIDES.search(body):
                out |= {s.strip() for s in selectors.split(",") if re.fullmatch(r"[.#]?[\w-]+", s.strip())}
    return out


def hidden(node: Node, selectors: set[str]) -> bool:
    a = node.attrs
    if node.tag in NEVER:
        return True
    if a and ("hidden" in a or HIDES.search(a.get("style", "")) or node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return True
    if selectors:
        return node.tag in selectors or "#" + a.get("id", "") in selectors or any("." + c in selectors for c in a.get("class", "").split())
    return False


class Lines:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.marks: list[list[str]] = []  # of each list item around: what starts its next line, what starts others

    def text(self, s: str, kept: bool = False) -> None:
        if kept:
            first, *more = s.split("\n")
            self.now.append(first)
            for line in more:
                self.end(True)
                self.now.append(line)
            return
        s = BLANKS.sub(" ", s)
        if s[0] == " " and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def end(self, forced: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if not line and not forced:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        shown = self.marks[-DEEPEST:]
        prefix = "".join(m[0] for m in shown)
        for m in shown:
            m[0] = m[1]
        self.lines.append((prefix + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)


def table_lines(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell, columns it spans) with columns aligned, two blanks apart; cells may have several lines. A line is
    padded where a next text follows, up to ``FARTHEST``."""
    width: list[int] = []
    for row in rows:
        at = 0
        for cell, span in row:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = min(WIDEST, max(width[at], *(len(x) for x in cell.split("\n"))))
            at += span
    begins = [0]
    for w in width:
        begins.append(begins[-1] + w + 2)
    out = []
    for row in rows:
        lines = [""] * max((cell.count("\n") + 1 for cell, _ in row), default=0)
        at = 0
        for cell, span in row:
            for k, line in enumerate(cell.split("\n")):
                if line:
                    lines[k] = (lines[k] + "  " if lines[k] else "").ljust(min(FARTHEST, begins[at])) + line
            at += span
        out += [line.rstrip() for line in lines]
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    root, styles = parse(page)
    selectors = hidden_selectors(styles)
    sink, sinks, tables, lists, kept = Lines(), [], [], [], 0
    todo: list[tuple] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if node:
                sink.text(node, kept > 0)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node, selectors):
                continue
            if tag == "br":
                sink.end(True)
                continue
            if tag == "img":
                continue
            if tag in ("td", "th") and tables:
                sinks.append(sink)
                sink = Lines()
            elif tag in BLOCK:
                sink.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
            if tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])
            elif tag == "li":
                mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
                sink.marks.append([mark, " " * len(mark)])
            elif tag == "dd":
                sink.marks.append(["  ", "  "])
            elif tag == "pre":
                kept += 1
            todo.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [(c, False) for c in reversed(children)]
            continue
        if tag in ("td", "th") and tables:
            sink.end()
            span = node.attrs.get("colspan", "1")
            cell = "\n".join(sink.lines), min(1000, max(1, int(span))) if span.isdigit() and len(span) < 5 else 1
            sink = sinks.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(cell)
        elif tag == "table":
            for line in table_lines([row for row in tables.pop() if any(cell for cell, _ in row)]):
                sink.now.append(line)
                sink.end()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "pre":
            kept -= 1
        if tag in BLOCK and tag not in ("td", "th"):
            sink.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
        if tag in ("li", "dd"):
            sink.marks.pop()
    sink.end()
    return "\n".join(sink.lines).replace("\xa0", " ").strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and text_sha256 of every page (columns page_id, url, html)."""

    def make():
        def row(i, url, page):
            text = render(page)
            return i, url, text, len(text), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()

        return row

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long, text_sha256 string", make)

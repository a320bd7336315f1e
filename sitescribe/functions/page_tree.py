"""A page as a tree of elements: one pass to build it, noise left out by subtree, and a Markdown writer.

Everything is linear in the page's length, and nothing recurs, so deeply nested pages are safe.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# Elements without content; elements whose text is not visible; elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template head".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that begins ends an open one of these, unless one of those is open in it.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("td", "th", "tr"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

# What is noise on a page, by tag, role, and parts of classes and ids.
NOISE_TAGS = frozenset(("nav", "footer", "header", "aside"))
NOISE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "dialog", "alert"))
NOISE_CLASSES = ("cookie", "consent", "gdpr", "nav", "menu", "site-header", "page-header", "main-header", "site-footer", "page-footer", "main-footer", "social", "popup", "modal", "banner", "overlay", "tooltip")
NOISE_IDS = ("cookie", "consent", "gdpr", "ad", "popup", "modal", "banner", "overlay")
UNWRITTEN_CLASSES = frozenset(("no-md", "hidden"))
IMAGES = frozenset(("img", "picture", "svg"))

AD = re.compile(r"\bad")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def noise(e: Element) -> bool:
    """By tag, role, a class or the id; an id with ``ad`` anywhere is noise, as is a class in which a word begins so."""
    classes, own = e.attributes.get("class", "").lower(), e.attributes.get("id", "").lower()
    return (
        e.tag in NOISE_TAGS or e.attributes.get("role", "").strip().lower() in NOISE_ROLES
        or bool(classes) and (any(x in classes for x in NOISE_CLASSES) or AD.search(classes) is not None) or bool(own) and any(x in own for x in NOISE_IDS)
    )


class TreeBuilder(HTMLParser):
    """Builds the tree; ``open`` has the places of open elements by tag, so an end tag is found at once."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.path, self.open = [self.root], {}

    def top(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close_to(self, place: int) -> None:
        while len(self.path) > place:
            self.open[self.path.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and (p := self.top("p")) > self.top("td", "th", "button", "object", "li"):
            self.close_to(p)
        if tag in ENDS:
            same, around = ENDS[tag]
            if (first := [x for t in same for x in self.open.get(t, ())[-1:] if x > self.top(*around)]):
                self.close_to(min(first))
        attributes = {}
        for name, value in attrs:
            attributes.setdefault(name, value or "")
        e = Element(tag, attributes)
        self.path[-1].children.append(e)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.path))
            self.path.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and "svg" in self.open and self.open["svg"]:  # a slash ends an element in svg only
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            self.close_to(self.open[tag][-1])

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def parsed(html: str | None) -> Element:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def events(root: Element, skip: Callable[[Element], bool] = lambda e: False) -> Iterator[tuple[str, Element | str]]:
    """("begin", e), ("end", e) and ("text", s) in page order, without the subtrees that ``skip`` names."""
    waiting: list = [iter(root.children)]
    within: list[Element] = []
    while waiting:
        node = next(waiting[-1], None)
        if node is None:
            waiting.pop()
            if within:
                yield "end", within.pop()
        elif isinstance(node, str):
            yield "text", node
        elif not skip(node):
            yield "begin", node
            within.append(node)
            waiting.append(iter(node.children))


def text_of(e: Element, skip: Callable[[Element], bool] = lambda x: False) -> str:
    return " ".join("".join(x for kind, x in events(e, skip) if kind == "text").split())


def first(root: Element, tag: str) -> Element | None:
    return next((e for kind, e in events(root) if kind == "begin" and e.tag == tag), None)


def link_label(e: Element, base: str) -> str:
    """The text of a link, or else the host that it leads to."""
    text = text_of(e, lambda x: x.tag in IMAGES)
    if text:
        return text
    try:
        host = urlsplit(urljoin(base, e.attributes.get("href", ""))).netloc.lower()
    except ValueError:
        host = ""
    return host.removeprefix("www.") or "link"


class MarkdownWriter:
    """Blocks of Markdown; ``line`` gathers what stands in the current block."""

    def __init__(self, base: str) -> None:
        self.base = base
        self.out: list[str] = []
        self.lines: list[str] = []
        self.line: list[str] = []
        self.prefix, self.quotes, self.listed = "", 0, False
        self.lists: list[list] = []  # [tag, number, marker that is due]
        self.rows: list[list[str]] = []
        self.tables = self.cells = 0

    def flush(self) -> None:
        """Ends the block; inside a cell a block is a space."""
        if self.cells:
            self.line.append(" ")
            return
        text = "\n".join(x for x in (*self.lines, " ".join("".join(self.line).split())) if x)
        self.lines, self.line = [], []
        if text:
            lead = self.prefix
            if self.lists:
                marker, self.lists[-1][2] = self.lists[-1][2], ""
                indent = "  " * (len(self.lists) - 1)
                lead = indent + (marker or "  ") + lead
                text = text.replace("\n", "\n" + indent + "  ")
            self.put((lead + text), tight=bool(self.lists))

    def put(self, block: str, tight: bool = False) -> None:
        quoted = "> " * self.quotes
        block = "\n".join(quoted + x for x in block.split("\n")) if quoted else block
        self.out.append(("\n" if tight and self.listed else "\n\n") + block)
        self.listed = tight

    def begin(self, e: Element) -> bool:
        """Writes what begins; true if the element is written whole."""
        tag = e.tag
        if tag == "a":
            href, label = e.attributes.get("href", "").strip(), link_label(e, self.base)
            self.line.append(f"[{label}]({href})" if href else label)
            return True
        if tag == "pre" and not self.cells:
            self.flush()
            text = "".join(x for kind, x in events(e) if kind == "text").strip("\n")
            if text.strip():
                self.put(f"```\n{text}\n```")
            return True
        if tag == "br":
            self.lines.append(" ".join("".join(self.line).split())) if not self.cells else None
            self.line = [] if not self.cells else [*self.line, " "]
        elif tag == "hr":
            self.flush()
            self.put("---") if not self.cells else None
        elif tag in MARKS:
            self.line.append(MARKS[tag])
        elif tag in BLOCKS:
            self.flush()
            if tag[0] == "h" and tag[1:].isdigit():
                self.prefix = "#" * int(tag[1]) + " "
            elif tag in ("ul", "ol"):
                self.lists.append([tag, 0, ""])
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                self.lists[-1][2] = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
            elif tag == "blockquote":
                self.quotes += 1
            elif tag == "table":
                self.tables += 1
            elif tag == "tr" and self.tables == 1:
                self.rows.append([])
            elif tag in ("td", "th") and self.tables == 1 and self.rows:
                self.cells = 1
        return False

    def end(self, e: Element) -> None:
        tag = e.tag
        if tag in MARKS:
            while self.line and self.line[-1].isspace():
                self.line.pop()
            if self.line and self.line[-1] == MARKS[tag]:
                self.line.pop()
            else:
                self.line.append(MARKS[tag])
        elif tag in ("td", "th") and self.tables == 1 and self.cells:
            self.cells = 0
            self.rows[-1].append(" ".join("".join(self.line).split()).replace("|", r"\|"))
            self.line = []
        elif tag in BLOCKS and tag != "hr":
            self.flush()
            if tag[0] == "h" and tag[1:].isdigit():
                self.prefix = ""
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                if not self.lists:
                    self.listed = False
            elif tag == "blockquote":
                self.quotes -= 1
            elif tag == "table":
                self.tables -= 1
                if not self.tables:
                    self.table()

    def table(self) -> None:
        rows, self.rows = [r for r in self.rows if any(r)], []
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.put("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))

    def text(self) -> str:
        self.flush()
        return "".join(self.out).strip("\n")


MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


def markdown(root: Element, base: str = "") -> str:
    """The body without noise, images and what is not to be written."""
    body = first(root, "body") or root
    unwritten = lambda e: e.tag in HIDDEN or e.tag in IMAGES or noise(e) or not UNWRITTEN_CLASSES.isdisjoint(e.attributes.get("class", "").split())
    writer, whole = MarkdownWriter(base), []
    for kind, x in events(body, lambda e: bool(whole) or unwritten(e)):
        if whole:
            if kind == "end" and x is whole[0]:
                whole.clear()
        elif kind == "begin":
            if writer.begin(x):
                whole.append(x)
        elif kind == "end":
            writer.end(x)
        else:
            writer.line.append(x)
    return writer.text()

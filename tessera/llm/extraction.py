"""Main text of web pages by composite text density.

A page becomes a tree of elements. What is no article by its element (menus, page headers, footers, asides,
forms, scripts and the like) or by a class, id or role that says so (adverts, notices, sidebars,
reader comments) is taken out first. Every remaining node gets its characters per tag, adjusted by links::

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

with C characters, T tags, LC characters and LT tags of links below the node, b the body, and 1 for a zero
divisor; a page without links has the plain C / T. A node's density sum adds up its children's densities. The
node of the largest sum is the centre of the page, and the least density on its path to the body is
the threshold: below every node at or above it, the node of the largest sum is content as well. The result is
the smallest subtree that holds all content, widened to the article (or main) element around it, with
all its text.

A text block ends where a block element starts or ends. White space inside a block is one space, blocks are
joined by an empty line.

Defined cases: null, empty and textless html, and pages of which nothing is left, give an empty text. Text
outside all elements belongs to the body. Unclosed elements end with their parent, paragraphs, list items
and cells also with the next one; an unmatched end tag is passed over; a cut tag at the end is dropped. Unknown character
references stay as they are. Equal sums go to the outer, then the earlier node. Rows are independent, so
repeated ones repeat. A task holds its longest page; depth of nesting has no limit.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER = frozenset(
    "head title script style noscript iframe noembed noframes object svg math template canvas audio video map textarea"
    " select button datalist dialog menu nav aside search".split()
)
#: Elements that hold no article unless an article or main element is inside.
OUTSIDE = frozenset("footer form fieldset".split())
#: Start tags that end an open element, up to the elements at which the search stops.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Blocks that do not end an open paragraph.
IN_PARAGRAPH = frozenset("option optgroup legend caption tbody thead tfoot tr td th body html head".split())
#: Words of class, id and role that mark what is no article.
MARKS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo"
    " promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert popup modal"
    " overlay newsletter subscribe subscription signup paywall sidebar aside menu submenu nav navbar navigation"
    " breadcrumb breadcrumbs masthead topbar toolbar header footer comment comments commentlist respond disqus replies"
    " related recommended share sharing social pagination pager skip widget widgets search login form"
    " contentinfo complementary dialog adsbygoogle".split()
)
COMMENTS = frozenset("comment comments commentlist respond disqus replies".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[A-Za-z](?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+(?:>|(?=<)|\Z)",
    re.DOTALL,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[A-Z]*[a-z0-9]+|[A-Z]+")
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}


class Node:
    __slots__ = (
        "name", "parent", "out", "children", "chars", "tags", "link_chars", "link_tags", "density", "sum",
        "best", "held",
    )

    def __init__(self, name: str, parent: Node | None, out: bool) -> None:
        self.name, self.parent, self.out = name, parent, out
        #: Nodes and strings, in page order.
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.held = 0
        self.density = self.sum = 0.0
        self.best: Node | None = None


def _marked(tag: str, name: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is no article."""
    for key, *values in _ATTRIBUTE.findall(tag[len(name) + 1 :]):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "style" and _HIDDEN.search(value.lower())):
            return True
        if key not in ("class", "id", "role"):
            continue
        for word in value.split():
            parts = [p.lower() for p in _PART.findall(word)]
            if not parts or parts[0] in ("has", "with", "no", "without"):
                continue
            # The first or the last part names the thing: ad-top, page-sidebar.
            for part in (parts[0], parts[-1]):
                if part in (COMMENTS if name == "article" else MARKS) and not (inside and part == "header"):
                    return True
    return False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The body node and all nodes, parents before children."""
    body = Node("body", None, False)
    nodes, stack, at = [body], [body], 0
    opened: dict[str, int] = {}

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    def close(names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        if not any(opened.get(name) for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                for ended in stack[k:]:
                    opened[ended.name] -= 1
                del stack[k:]
                return
            if stack[k].name in barrier:
                return

    while True:
        found = _TAG.search(page, at)
        if found is None:
            text(page[at:])
            return body, nodes
        text(page[at : found.start()])
        at, tag = found.end(), found.group()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name not in ("body", "html"):
                close((name,), ("table",) if name not in BLOCKS else ())
            continue
        if not tag.endswith(">") and at >= len(page):
            continue  # a tag that the end of the page cuts
        if name in ("html", "body"):
            continue
        if name in BLOCKS and name not in IN_PARAGRAPH:
            close(("p",), ("table", "td", "th", "button", "object"))
        if name in CLOSES:
            close(*CLOSES[name])
        inside = bool(opened.get("article") or opened.get("main"))
        out = name in NEVER or name in OUTSIDE or (name == "header" and not inside)
        if not out and name != "main" and (" " in tag or len(tag) > len(name) + 2):
            out = _marked(tag, name, inside)
        node = Node(name, stack[-1], out)
        stack[-1].children.append(node)
        nodes.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            node.out = True
            if end is None:
                continue  # else its end tag follows
        if name not in VOID and not tag.endswith("/>"):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1


def _prune(nodes: list[Node]) -> None:
    """Take out what is no article, but nothing around the page's largest article (or main) element."""
    for node in reversed(nodes):
        node.sum += sum(len(c) for c in node.children if isinstance(c, str))
        if node.parent is not None and not node.out:
            node.parent.sum += node.sum
    kept = next((k for k in ("article", "main") if any(n.name == k and not n.out for n in nodes)), None)
    around = max((n for n in nodes if n.name == kept and not n.out), key=lambda n: n.sum, default=None)
    while around is not None and around.name not in NEVER:
        around.out, around = False, around.parent
    for node in nodes:
        node.sum = 0.0
        node.out = node.out or (node.parent is not None and node.parent.out)


def measure(body: Node, nodes: list[Node]) -> None:
    """Densities and density sums of all nodes that are left."""
    left = [n for n in nodes if not n.out]
    for node in reversed(left):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.out:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if child.name == "a" else child.link_chars
                node.link_tags += child.link_tags + (child.name == "a")
    share = body.link_chars / max(body.chars, 1)
    for node in left:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if node.name == "a":
            lc, lt = c, max(lt, 1)
        node.density = c / t
        if share > 0 and c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density *= math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base)
        if node.parent is not None:
            node.parent.sum += node.density


def content(body: Node, nodes: list[Node]) -> Node:
    """The smallest subtree that holds all content nodes, widened to its article."""
    left = [n for n in nodes if not n.out and n.chars]
    if not left:
        return body
    for node in reversed(left):  # children first: the node of the largest sum below each
        node.best = node
        for child in node.children:
            if isinstance(child, Node) and child.best is not None and child.best.sum > node.best.sum:
                node.best = child.best
    around, threshold = body.best, math.inf
    while around is not None:
        threshold, around = min(threshold, around.density), around.parent
    for node in left:
        if node.density >= threshold:
            node.best.held = 1
    total = sum(node.held for node in left)
    root = body
    for node in reversed(left):
        if node.parent is not None:
            node.parent.held += node.held
    for node in left:  # parents first: the deepest that holds all
        if node.held == total:
            root = node
    for kind in ("article", "main"):
        around = root
        while around is not None and around.name != kind:
            around = around.parent
        if around is not None:
            return around
    return root


def blocks(root: Node) -> list[str]:
    """The texts of the blocks below ``root`` in page order."""
    out, piece = [], []

    def end() -> None:
        line = " ".join("".join(piece).split())
        if line:
            out.append(line)
        piece.clear()

    todo: list[Node | str | None] = [root]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            piece.append(item)
        elif item.name in ("br", "hr") or not item.out:
            block = item.name in BLOCKS
            if block:
                end()
                todo.append(None)
            elif item.name == "br":
                piece.append(" ")
            todo.extend(reversed(item.children))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body, nodes = parse(page)
    _prune(nodes)
    measure(body, nodes)
    return "\n\n".join(blocks(content(body, nodes)))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import e as E
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import give_back, small_batches

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button datalist head title".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of a text rather than a frame around blocks.
LEAVES = HEADINGS | frozenset("blockquote caption center dd details dir dl dt figcaption figure hr li menu ol p pre summary table tbody td tfoot th thead tr ul address".split())
#: A start tag ends an open element of these kinds, up to the nearest element of the second list.
CLOSES = {
    **{t: (("p",), ("button", "td", "th", "caption", "object")) for t in BLOCK},
    "li": (("li", "p"), ("ul", "ol", "menu", "td", "th")),
    **{t: (("dt", "dd", "p"), ("dl", "td", "th")) for t in ("dt", "dd")},
    "tr": (("tr", "td", "th", "p"), ("table",)),
    **{t: (("td", "th", "p"), ("tr", "table")) for t in ("td", "th")},
    **{t: (("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",)) for t in ("tbody", "thead", "tfoot")},
    "option": (("option",), ("select",)),
}
# Words of class, id and role tokens. A token of the first kind marks what is not the article, one of the third kind alone what is;
# words of the second kind go with either.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion reactions "
    "related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
NEUTRAL = frozenset("area bar block bottom box button buttons col container footer-links form global group header holder icons inner item items left level links list main menu module outer page panel reader readers right row section site slot text thread title top unit user users wrap wrapper".split())
OWN = frozenset("article articles blog body content entry post posts story".split())
#: Of these, words that mark an article element: readers' comments are articles within the article.
REMARKS = frozenset("comment comments disqus feedback reactions replies reply respond".split())
#: Names that a paragraph or box of the article may bear as well: within an article element they mark nothing.
EDITORIAL = frozenset("alert notice notices".split())
IN_ARTICLE = HINTS - EDITORIAL
#: A line of a page's foot that no element marks as such.
RIGHTS = re.compile(r"^\s*©|\ball rights reserved\b", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title|template|noscript|iframe|svg|select|button)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
GONE = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def hinted(attributes: str, hints: frozenset[str]) -> bool:
    """Is the element named as something other than the article? Each token of class, id and role is looked at whole: all its words must be known."""
    marked = own = False
    for m in NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = [w.lower() for w in PART.findall(token) if not w.isdigit()]
            if parts and all(w in OWN or w in NEUTRAL for w in parts) and any(w in OWN for w in parts):
                own = True
            elif any(w in hints for w in parts) and all(w in HINTS or w in NEUTRAL or w in OWN for w in parts):
                marked = True
    return marked and not own


class Node:
    __slots__ = ("tag", "hints", "gone", "inside", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.parent, self.items = tag, parent, []
        self.hints = self.gone = False
        #: The outermost article element around the node, itself included.
        self.inside = parent.inside if parent is not None and parent.inside else self if tag == "article" else None
        if attributes and len(attributes) > 3 and tag not in ("html", "body", "main"):
            self.gone = bool(GONE.search(attributes))
            self.hints = hinted(attributes, REMARKS if tag == "article" else IN_ARTICLE if self.inside else HINTS)


class Open:
    """The open elements, and for each tag where on the stack it is, so that the nearest one is found without a walk."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def close(self, place: int) -> None:
        """Ends the element at a place and all within it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()


def parse(html: str) -> Node:
    """A tree of elements and texts, with the end tags that HTML lets authors leave out."""
    root = Node("html", "", None)
    open_, at = Open(root), 0
    stack = open_.stack
    for m in TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].items.append(html[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        tag = name.lower()
        if m[2] or m[5]:
            k = open_.nearest((tag,))
            if k and (tag in BLOCK or k >= open_.nearest(("td", "th", "table", "article", "body"))):
                open_.close(k)
            continue
        if tag in ("html", "body") and open_.nearest((tag,)):
            continue
        if ends := CLOSES.get(tag):
            k = open_.nearest(ends[0])
            barrier = open_.blocks[-1] if ends[0] == ("p",) and open_.blocks else 0
            if k and k >= max(barrier, open_.nearest(ends[1])):
                open_.close(k)
        if tag in HIDDEN and tag not in ("head", "object", "audio", "video", "canvas", "math", "datalist"):
            continue
        attributes = m[4] if m[3] else m[7]
        node = Node(tag, attributes, stack[-1])
        stack[-1].items.append(node)
        if tag not in VOID and not attributes.endswith("/") or tag in BLOCK and tag not in VOID:
            open_.push(node)
    if at < len(html):
        stack[-1].items.append(html[at:])
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes, parents first; deep trees need no recursion."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.items) if type(x) is Node]
    return out


def measure(root: Node) -> list[Node]:
    """Characters and tags of each subtree, and those of links."""
    nodes = in_order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for x in n.items:
            if type(x) is Node:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.chars if x.tag == "a" else x.link_chars
                n.link_tags += x.link_tags + (x.tag == "a")
            else:
                n.chars += len(" ".join(x.split()))
    return nodes


def densities(nodes: list[Node]) -> None:
    """Composite text density of each node: characters a tag, less where links make up much of it, and the sum over its children."""
    body = nodes[0]
    page = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        other = max(c - n.link_chars, 1)
        base = log(c / other * n.link_chars + page * c + E)
        n.density = c / t * max(0.0, log(c / lc * t / lt)) / base if c else 0.0
    for n in nodes:
        n.total = sum(x.density for x in n.items if type(x) is Node)


def visible(root: Node) -> Node:
    """The body without elements that show no text, and without those that HTML itself sets apart from the content by their kind."""
    body = next((n for n in in_order(root) if n.tag == "body"), root)
    todo = [(body, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag == "article"
        n.items = [x for x in n.items if type(x) is str or not (x.tag in HIDDEN or x.tag in CHROME or x.gone or x.tag == "header" and not inside)]
        todo += [(x, inside) for x in n.items if type(x) is Node]
    return body


def enclosing(n: Node, *tags: str) -> Node | None:
    """The outermost element of these kinds around n, itself included."""
    found = None
    while n is not None:
        if n.tag in tags:
            found = n
        n = n.parent
    return found


def blocks(roots: list, apart: set[int]) -> list[str]:
    """Texts of blocks in page order, white space as one space, without empty ones. None among roots ends a block; nodes of apart are left out."""
    out, text = [], []

    def flush() -> None:
        if line := " ".join(unescape("".join(text)).split()):
            out.append(line)
        text.clear()

    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            text.append(x)
        elif id(x) in apart:
            continue
        elif x.tag in ("br", "td", "th"):
            text.append(" ")
            todo += reversed(x.items)
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.items)
        else:
            todo += reversed(x.items)
    flush()
    return out


def container(n: Node, body: Node) -> Node:
    """The element around n that holds blocks: a paragraph, a table cell, a heading or inline element stands for what it is part of."""
    while n is not body and (n.tag not in BLOCK or n.tag in LEAVES):
        n = n.parent
    return n


def set_apart(nodes: list[Node], body: Node) -> set[int]:
    """Nodes in an element that is named as something other than the article."""
    apart: set[int] = set()
    for n in nodes:
        if n.hints or (n is not body and id(n.parent) in apart):
            apart.add(id(n))
    return apart


def others(nodes: list[Node], region: Node, apart: set[int]) -> list[Node]:
    """The page's outermost articles in their order: region, and those that are no teaser of another page."""
    linked = {id(n.inside) for n in nodes if n.tag in HEADINGS and n.chars and n.link_chars * 2 >= n.chars and n.inside}
    outermost = (n for n in nodes if n.tag == "article" and not n.parent.inside)
    return [n for n in outermost if n is region or id(n) not in apart and id(n) not in linked and n.link_chars * 4 < n.chars]


def stays(n: Node, threshold: float, loose: bool) -> bool:
    """Does a node beside the core's path belong to the article? loose: nothing but the body is around it."""
    if n.tag in HEADINGS or n.density >= threshold and n.link_chars * 2 < n.chars:
        return True
    if n.link_chars or not loose:
        return not n.link_chars
    return any(x.tag in LEAVES for x in in_order(n)) and not any(RIGHTS.search(line) for line in blocks([n], set()))


def main_text(html: str | None) -> str:
    """Blocks of the article joined by a blank line; empty for null, for pages without text, and where all is boilerplate.

    Every node of the body gets a composite text density and the sum of its children's. The node of the largest sum is the core, or the element that
    holds the blocks around it; nodes named as something else (HINTS) come into question only if no other has text. The least density
    on the core's path to the body is the threshold. The core is taken whole. Of what lies beside its path stay, up to the article element
    around it, else the main element, else the body: headings, nodes that reach the threshold with less than half of their text in links, and nodes
    without links, however short (right under a body only those that hold an element of text, such as a paragraph, and no line of rights). Other
    articles of the page stay whole, but for those that lead to another page: with a heading for a link, or a quarter of the text in links. From all
    that is taken go frames under the threshold with half of their text in links or more, and nodes named as something else.
    """
    if not html:
        return ""
    body = visible(parse(html))
    nodes = measure(body)
    if not body.chars:
        return ""
    densities(nodes)
    apart = set_apart(nodes, body)
    core = max((n for n in nodes if id(n) not in apart), key=lambda n: n.total, default=body)
    if core.total <= 0:
        # Text without elements of its own: the node of most characters.
        core = max((n for n in nodes if id(n) not in apart), key=lambda n: n.density)
    core = container(core, body)
    if not any(own(core, apart)):
        apart, core = set(), container(max(nodes, key=lambda n: (n.total, n.density)), body)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    on_path = {id(n) for n in path}
    apart |= {id(n) for n in nodes if n.tag in BLOCK and n.tag not in LEAVES and id(n) not in on_path and n.density < threshold and 0 < n.chars <= n.link_chars * 2}
    region = core.inside or enclosing(core, "main") or body
    roots: list = []
    for part in others(nodes, region, apart) if region.tag == "article" else [region]:
        # None ends a block, so that roots of different elements are not read as one.
        roots.append(None)
        todo: list = [part]
        while todo:
            n = todo.pop()
            if n is None or type(n) is str or n is core or part is not region:
                roots.append(n)
            elif id(n) in on_path:
                todo += [None, *reversed(n.items), None]
            elif id(n) not in apart and stays(n, threshold, region is body):
                roots.append(n)
    return "\n\n".join(blocks(roots, apart))


def own(n: Node, apart: set[int]) -> Iterator[str]:
    """The texts in n that hold a character and lie in no node of apart."""
    for x in in_order(n):
        if id(x) not in apart:
            yield from (t for t in x.items if type(t) is str and t.strip())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All columns of pages but html_col, with the main text and its code points. Each page is worked on whole, in its own partition.

    Null or empty html gives empty text and 0. Broken markup is read as a browser would, an unfinished tag at the end is dropped.
    Columns named text_col or chars_col are replaced. Repeated rows are all kept. An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]
    schema = pages.select(*kept).schema.add(text_col, "string").add(chars_col, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            for i in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py()) for x in part.column(html_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, text_col, chars_col])

    return small_batches(pages.select(*kept, html_col)).mapInArrow(run, schema)

"""Main text of web pages by composite text density.

A light tree of block elements is built from the tags.  Every node gets its
link-adjusted characters per tag (composite text density) and the sum of its
children's densities.  The subtree with the largest sum is the article; the
smallest density on its path from the body is the threshold for further
blocks beside it.  What is furniture by element or by name (menus, headers,
footers, sidebars, notices, adverts, forms, comments) never counts.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from forja.llm.common import table
from forja.llm.registry import register

# Element names of HTML and the usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset(
    "script style title textarea noscript template iframe xmp noembed noframes head nav header footer aside form button "
    "select option dialog menu svg math object audio video canvas fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]),
}
BARRIER = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
           "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "tbody": frozenset(["table"])}
MAIN = frozenset(["article", "main"])
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
FURNITURE_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav "
    "navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related "
    "recommended share sharing social toolbar masthead header footer copyright legal comment comments commentlist "
    "disqus respond replies reply feedback search skip hidden").split())
#: Furniture that never holds the article, even if most of the page's text or an article element is in it.
BESIDE = frozenset("comment comments commentlist disqus respond replies reply feedback related recommended".split())
#: Names that are ordinary words too, so a section of an article may be called by them and a word of its own (related-work).
ORDINARY = frozenset("notice notices alert legal related recommended share sharing social search feedback menu menus navigation promotion".split())
#: Words that say nothing of a section's subject.
STRUCTURAL = frozenset((
    "site page main top bottom left right inner outer box block bar area slot list item items link links post posts article articles "
    "story stories news wrapper wrap container section content panel button buttons icon icons form text message msg info primary "
    "secondary global mobile desktop wp js media more also reader user by").split())
#: A section with an ordinary name stays if it has so many characters (spaces apart) outside links, and twice as much as inside them.
READS = 60
#: Names that say what a wrapper has, lacks or stands beside, not what it is.
ABOUT = re.compile(r"^(?:has|have|with|without|no|not|hide|show)[_-]|[_-](?:has|with|without|no)[_-]")
#: Elements of furniture that may stand around a whole page.
WRAPPERS = frozenset(["form", "fieldset", "header"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """Block element with its own counts; ``items`` holds text pieces, breaks and child nodes in page order."""

    __slots__ = ("name", "parent", "items", "chars", "links", "tags", "link_tags", "out", "main", "kind", "index", "inside", "density", "total")

    def __init__(self, name: str, parent: Node | None, out: bool, kind: int = 0, index: int = -1):
        self.name, self.parent, self.out, self.kind, self.index = name, parent, out, kind, index
        self.main = name in MAIN or parent is not None and parent.main
        self.items: list = []
        self.chars = self.links = self.tags = self.link_tags = self.inside = 0
        self.density = self.total = 0.0


def _furniture(name: str, attributes: str, main: bool = False) -> int:
    """0: none; 1: unless it holds the article; 2: furniture; -1: if it does not read as a section of the article.

    ``main``: inside an article, whose headers belong to it.
    """
    kind, perhaps = 0, False
    if name in SKIPPED and not (main and name == "header"):
        if name not in WRAPPERS:
            return 2
        kind = 1
    if "=" not in attributes and "hidden" not in attributes:
        return kind
    block = name not in INLINE
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and not (main and name in HEADINGS):
            for token in value.split():
                parts = re.split("[_-]", token)
                found = FURNITURE_NAMES.intersection(parts) if not ABOUT.search(token) else frozenset()
                if main and block and found and found <= ORDINARY and any(
                        w.isalpha() and len(w) > 1 and w not in STRUCTURAL and w not in FURNITURE_NAMES for w in parts):
                    perhaps = True
                elif found and not (main and found == {"header"}):
                    kind = max(kind, 2 if found & BESIDE else 1)
        elif key == "role" and value.strip() in FURNITURE_ROLES:
            kind = max(kind, 1 if value.strip() == "form" else 2)
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return 2
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return kind or -perhaps


def parse(page: str) -> Node:
    """Tree of the block elements of a page; what looks like furniture but holds the article is none."""
    root, held = _parse(page, frozenset())
    if held:
        root, _ = _parse(page, held)
    return root


def _parse(page: str, spared: frozenset[int]) -> tuple[Node, frozenset[int]]:
    """(tree, numbers of the wrappers that look like furniture but hold the article); unclosed and crossed tags are mended.

    A wrapper holds it if it holds the only article or main element that the
    page has, or more than half of its text outside links.  ``spared``: numbers
    of elements that are not furniture.
    """
    root = Node("html", None, False)
    wrappers: list[Node] = []
    named: list[Node] = []  # sections of an article with ordinary names
    around: set[int] = set()
    count = plain = 0
    shown = False  # an article or main element outside all furniture
    node, link, position, size = root, 0, 0, len(page)
    hidden: list[str] = []  # inline elements of furniture that are open

    def text(piece: str) -> None:
        nonlocal plain
        if not piece or hidden:
            return
        if node.out and node.kind == 2:
            return
        if not link:
            n = len("".join(piece.split()))
            plain += n
            node.inside += n
        if node.out:
            return
        piece = entities.unescape(piece) if "&" in piece else piece
        node.items.append(piece)
        n = len("".join(piece.split()))
        node.chars += n
        if link:
            node.links += n

    while position < size:
        m = TAG.search(page, position)
        if m is None:
            text(page[position:])
            break
        text(page[position : m.start()])
        position = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link = 0
            if name in INLINE:
                if hidden and name in hidden:
                    del hidden[hidden.index(name) :]
                continue
            if name in ("p", "br"):
                node.items.append(None)
            at = node
            while at is not root and at.name != name:
                at = at.parent
            if at is not root:
                node, hidden = at.parent, []
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if not node.out:
            node.tags += 1
        if name in INLINE:
            if name == "a":
                link = 1
                node.link_tags += not node.out
            if hidden or _furniture(name, m[3], node.main):
                hidden.append(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                node.items.append(None)
            continue
        if name in ("html", "body"):
            continue
        closing, barrier = CLOSES.get(name), BARRIER.get(name, ())
        if closing:
            at = node
            while at is not root and at.name not in closing and at.name not in barrier:
                at = at.parent
            if at is not root and at.name in closing:
                node = at.parent
        elif node.name == "p":
            node = node.parent
        count += 1
        own = 0 if count in spared else _furniture(name, m[3], node.main)
        perhaps, own = own < 0, max(own, 0)
        child = Node(name, node, node.out or own > 0, 2 if 2 in (own, node.kind) else own or node.kind, count)
        node.items.append(child)
        if perhaps and not child.out:
            named.append(child)
        if own == 1 and child.kind == 1:
            wrappers.append(child)
        if name in MAIN and child.kind < 2:
            shown = shown or not child.out
            up = child
            while up is not None and up.out:
                around.add(up.index)
                up = up.parent
        node, hidden = child, []
    for n in named:
        chars, links = _below(n, "chars"), _below(n, "links")
        n.out = chars - links < max(READS, 2 * links)
    if not wrappers or spared or shown:
        return root, frozenset()
    held = {w.index for w in wrappers if w.index in around}
    if not held:
        for w in wrappers:
            if 2 * _below(w, "inside") > plain:
                held.add(w.index)
    return root, frozenset(held)


def _below(node: Node, count: str) -> int:
    """Sum of a node's own count and those of all nodes below it, before ``_measure``."""
    total, stack = 0, [node]
    while stack:
        x = stack.pop()
        total += getattr(x, count)
        stack += [y for y in x.items if isinstance(y, Node)]
    return total


def _measure(root: Node) -> list[Node]:
    """All nodes, children before parents, with the counts of their subtrees and their densities."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.out]
    order.reverse()
    for node in order:
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags
            up.link_tags += node.link_tags
    share = root.links / max(root.chars, 1)
    for node in order:
        c, lc, t, lt = node.chars, node.links, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(1 + c / max(lc, 1) * t / lt) / max(math.log(1 + base), 1e-3)
        if node.parent is not None:
            node.parent.total += node.density
    for node in order:
        if not any(isinstance(x, Node) and not x.out for x in node.items):
            node.total = 0.0
    return order


def _blocks(root: Node, keep: set[int] | None) -> list[str]:
    """Texts of the blocks in page order; ``keep``: only below these nodes."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        piece = " ".join("".join(run).split())
        if piece:
            out.append(piece)
        run.clear()

    stack: list = [(root, keep is None or id(root) in keep)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if inside:
                run.append(item)
        elif not item.out:
            inside = inside or id(item) in keep
            close()
            stack.append((None, inside))
            stack += [(x, inside) for x in reversed(item.items)]
    close()
    return out


def main_text(page: str | None) -> str:
    """Article of one page as a single line of blocks; '' if there is none (null, empty or furniture only)."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    if not root.chars:
        return ""
    best = max(order, key=lambda n: n.total)
    if best.total <= 0:
        best = root
    body_path = [best]
    while body_path[-1].parent is not None:
        body_path.append(body_path[-1].parent)
    threshold = min(n.density for n in body_path)
    top = best
    for node in body_path:  # the whole article, when its densest part is only a section of it
        if node.name in MAIN:
            top = node
    keep = {id(top)}
    if not any(n.name in MAIN for n in body_path):
        keep |= {id(n) for n in order if n.density >= threshold and n.chars > n.links * 2 and n.name not in ("ul", "ol", "html")}
    elif top.name == "article":
        keep |= {id(n) for n in order if n.name == "article" and n.density >= threshold}
    return " ".join(_blocks(root, keep))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html`` and with its main text and the text's length in code points.

    Null or empty pages, and pages of furniture only, give ''.  Each row is
    worked alone, so repeated rows and ties change nothing; other columns
    (null or not) are passed on, and columns called ``text`` or ``n_chars``
    are replaced.
    """
    fields = [f for f in pages.schema if f.name not in (html, text, n_chars)]
    schema = T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html))
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [main_text(x.as_py()) for x in source.slice(start, 256)]
                columns = [part.column(part.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                    names=[*(f.name for f in fields), text, n_chars])

    return pages.select(*[f"`{f.name}`" for f in fields], f"`{html}`").mapInArrow(work, schema)


@register()
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")

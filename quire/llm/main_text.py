"""Main text of web pages by composite text density.

Spark deals pages to tasks; inside a task each page becomes a small tree, whose nodes get characters, tags, link characters
and link tags of their subtrees. A node's density is characters per tag, weighed by how little of it is links; the node whose
children's densities add up to most holds the main text. Parts that name themselves as something else (menus, notices,
comments, adverts ...) are cut off before, and what belongs to the chosen node is decided by the page's own marks
(``article``, ``main``) or else by the least density on the path from it to the body.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations and tags. A quote counts in a tag only after an equals sign.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOLD = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Tags of HTML by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = set("base basefont bgsound link meta title style script noscript template noframes head".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CELLS = set("td th".split())
#: What an opening tag ends, and the tags that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, BLOCK | CELLS),
}
NEVER_TEXT = set("script style textarea title xmp iframe noembed noframes noscript template head nav aside footer menu dialog search button select option input object applet canvas svg math audio video datalist output".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist tooltip status".split())
#: Words in the names (class, id) of parts that are not the article.
NAMES = set(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay lightbox "
    "newsletter subscribe subscription signup ad ads adv advert adverts advertisement advertisements advertising adsbygoogle adsense sponsor sponsors sponsored promo promos promoted promotion share sharing social related recommended recommendations "
    "comment comments commentlist respond disqus reply replies discussion login search form taboola outbrain skip".split()
)
#: Names that say where a part stands rather than that it is one.
DENIED = set("no has with without hide hidden not is".split())
OF_ARTICLE = set("article entry post content story".split())


class Node:
    __slots__ = ("attrs", "chars", "density", "gone", "kids", "link_chars", "link_tags", "sum", "tag", "tags", "up")

    def __init__(self, tag: str, up: Node | None, attrs: dict[str, str]):
        self.tag, self.up, self.attrs = tag, up, attrs
        self.kids: list[Node | str] = []
        self.gone = False


def _attrs(raw: str) -> dict[str, str]:
    if not raw or not _TOLD.search(raw):
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    """The page as a tree: tags that need no end end where HTML says, ends of nothing open are passed over."""
    root = Node("html", None, {})
    at, here, size = 0, root, len(page)

    def text(s: str) -> None:
        if s:
            here.kids.append(html.unescape(s) if "&" in s else s)

    def close(names: set[str], beyond: set[str]) -> bool:
        """Goes to above the nearest open node of these names, unless one of ``beyond`` is nearer."""
        nonlocal here
        x: Node | None = here
        while x is not None and x is not root:
            if x.tag in names:
                here = x.up or root
                return True
            if x.tag in beyond:
                return False
            x = x.up
        return False

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag in CELLS:
                close({tag}, set() if tag in ("body", "table") else {"td", "th", "table"} - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"table"})
            elif tag != "br":
                close({tag}, BLOCK | CELLS)
            else:
                here.kids.append(" ")
            continue
        if tag == "html":
            root.attrs |= _attrs(m[3])
            continue
        if tag == "body" or (tag not in IN_HEAD and here.tag == "head"):
            close({"head"}, set())
        if tag in BLOCK:
            close({"p"}, {"td", "th", "caption", "button", "object", "table"})
            if tag in HEADINGS and here.tag in HEADINGS:
                here = here.up or root
        if tag in ENDS:
            close(*ENDS[tag])
        node = Node(tag, here, _attrs(m[3]))
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            here = node
    return root


def _named(node: Node) -> bool:
    """Whether class or id name the node as something beside the article."""
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or parts[0] in DENIED:
            continue
        if not NAMES.isdisjoint(parts) or "".join(parts) in NAMES:
            return True
        if "header" in parts and OF_ARTICLE.isdisjoint(parts):
            return True
    return False


def _holds(node: Node, tags: set[str]) -> bool:
    """Whether a node of these tags is below, but for articles that are named as something else."""
    rest = [node]
    while rest:
        for k in rest.pop().kids:
            if isinstance(k, Node):
                if k.tag in tags and not (k.tag == "article" and _named(k)):
                    return True
                rest.append(k)
    return False


def _is_gone(node: Node, inside: bool) -> bool:
    """Whether a node's subtree is no part of an article; ``inside``: it stands in one."""
    a, tag = node.attrs, node.tag
    if tag in NEVER_TEXT:
        return True
    if "hidden" in a or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("body", "main", "html") or a.get("role") == "main" or "articlebody" in a.get("itemprop", "").lower():
        return False
    if tag == "header":
        return not inside and not _holds(node, {"article", "main"})
    if tag == "form" or a.get("role", "").lower() in ROLES or _named(node):
        return inside or tag == "article" or not (_holds(node, {"article", "main"}) or (tag == "form" and _holds(node, {"h1"})))
    return False


def _cut(root: Node) -> list[Node]:
    """Marks what goes; returns the nodes that stay, parents first."""
    out, rest = [], [(root, False)]
    while rest:
        node, inside = rest.pop()
        out.append(node)
        inside = inside or node.tag in ("article", "main")
        for k in reversed(node.kids):
            if isinstance(k, Node):
                k.gone = _is_gone(k, inside)
                if not k.gone:
                    rest.append((k, inside))
    # An article inside an article that has paragraphs of its own is what readers said of it.
    for node in out:
        if node.tag == "article" and _holds(node, {"article"}):
            own = [k for k in node.kids if isinstance(k, Node) and not k.gone and k.tag != "article"]
            if any(k.tag == "p" for k in own) or any(_plain(k) for k in own):
                _drop_articles(node)
    return [x for x in out if not _under_gone(x)]


def _plain(node: Node) -> bool:
    return node.tag != "article" and not _holds(node, {"article"}) and _holds(node, {"p"})


def _drop_articles(node: Node) -> None:
    for k in node.kids:
        if isinstance(k, Node):
            if k.tag == "article":
                k.gone = True
            else:
                _drop_articles(k)


def _under_gone(node: Node | None) -> bool:
    while node is not None:
        if node.gone:
            return True
        node = node.up
    return False


def _measure(nodes: list[Node]) -> None:
    """Counts of subtrees and composite densities; ``nodes`` has parents first, the body or root at the head."""
    for x in nodes:
        x.chars = x.link_chars = x.tags = x.link_tags = 0
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += sum(map(len, k.split()))
            elif not k.gone:
                x.chars, x.tags = x.chars + k.chars, x.tags + k.tags + 1
                x.link_chars, x.link_tags = x.link_chars + k.link_chars, x.link_tags + k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    whole = nodes[0].link_chars / max(nodes[0].chars, 1)
    for x in nodes:
        c, lc, t, lt = x.chars, max(x.link_chars, 1), max(x.tags, 1), max(x.link_tags, 1)
        if not c:
            x.density = 0.0
            continue
        base = math.log(c / max(c - x.link_chars, 1) * lc + whole * c + math.e)
        x.density = c / t * max(0.0, math.log(c / lc * t / lt) / math.log(base)) if base > 1 else c / t
    for x in nodes:
        x.sum = sum(k.density for k in x.kids if isinstance(k, Node) and not k.gone)


def _above(node: Node, tag: str) -> Node | None:
    """The outermost node of this tag that is the node or holds it."""
    found, x = None, node
    while x is not None:
        if x.tag == tag:
            found = x
        x = x.up
    return found


def choose(page: str) -> list[Node]:
    """The nodes whose text is the main text, in page order."""
    root = parse(page)
    nodes = _cut(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    _measure([x for x in nodes if x is body or x is not root] if body is not root else nodes)
    inside = [x for x in nodes if x is not root] or nodes
    marked = [x for x in inside if x.tag in ("article", "main") or x.attrs.get("role") == "main"]
    if marked:
        regions = {id(x) for x in marked if x.chars}
        held = [x for x in inside if _in(x, regions)] or inside
    else:
        held = inside
    best = max(held, key=lambda x: (x.sum, x.density))
    if not best.sum:  # text without tags
        best = max(held, key=lambda x: x.density)
    whole = _above(best, "article") or _above(best, "main") or next((x for x in _path(best) if x.attrs.get("role") == "main" or "articlebody" in x.attrs.get("itemprop", "").lower()), None)
    if whole is not None:
        return [whole]
    return _by_threshold(best, body)


def _in(x: Node | None, regions: set[int]) -> bool:
    while x is not None:
        if id(x) in regions:
            return True
        x = x.up
    return False


def _path(node: Node) -> list[Node]:
    out, x = [], node
    while x is not None:
        out.append(x)
        x = x.up
    return out


def _by_threshold(best: Node, body: Node) -> list[Node]:
    """The best node and what stands beside its path to the body that is as dense as the thinnest node of the path, or a heading or paragraph beside it."""
    path = _path(best)
    if body in path:
        path = path[: path.index(body) + 1]
    least = min((x.density for x in path if x.density), default=0.0)
    keep, spine = {id(best)}, {id(x) for x in path}
    for up, x in zip(path[1:], path[:-1], strict=True):
        for k in up.kids:
            if isinstance(k, str) or k.gone or k is x or not k.chars:
                continue
            if k.link_chars < 0.5 * k.chars and (k.density >= least or k.tag in HEADINGS or (up is not body and k.tag in BLOCK - {"div", "section"})):
                keep.add(id(k))
    out, rest = [], [path[-1]]
    while rest:
        x = rest.pop()
        if id(x) in keep:
            out.append(x)
        elif id(x) in spine:
            rest += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, one a line; white space inside a block is one space."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if s := " ".join("".join(held).split()):
                blocks.append(s)
            held.clear()

    for node in nodes:
        rest: list[Node | str | None] = [node]
        while rest:
            x = rest.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.gone:
                continue
            elif x.tag in BLOCK:
                flush()
                rest.append(None)
                rest += reversed(x.kids)
            elif x.tag == "br" or x.tag in CELLS:
                held.append(" ")
                rest += reversed(x.kids)
            else:
                rest += reversed(x.kids)
        flush()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    """The main text of one page; empty for null, for an empty page and for one without text."""
    return text_of(choose(page)) if page and not page.isspace() else ""


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text``, the main text: one row for each row of ``pages``, repeated rows and null ids and urls too.

    Null, empty and textless pages have an empty text; an empty table gives no rows. Markup that is not well-formed is read as
    far as it goes. Other columns are not read, so no name can clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([extract(x) for x in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select(pages[f"`{id_col}`"].alias("page_id"), pages[f"`{url_col}`"].alias("url"), pages[f"`{html_col}`"].cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string")


def digest(pages: DataFrame) -> DataFrame:
    """Per page: the main text and its code points."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))

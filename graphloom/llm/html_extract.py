"""Main text of web pages by scoring their element tree.

A small tolerant parser builds the tree. Structural furniture (menus, page
headers, forms, scripts, hidden elements) goes by element and role. Each
paragraph then passes points for its length and its commas to its ancestors,
less at each step up, and a container's total is discounted by its link density.
The best container, widened to the article around it, is kept with the siblings
that score like it, up to a surrounding main.

Names (class and id) weigh as follows. A name made of furniture words and plain
layout words alone (``ad``, ``site-header``, ``comment-list``) takes its element
out before the scoring, unless the page's title, main element or article is in
it (reader comments may be articles themselves), or nothing would be left. In
any other name (``related-work``, ``has-sidebar``) a furniture word halves the
element's points, and drops it from the kept text only if most of it is links.

Defined results: null or empty html gives an empty text; html without tags is
text; unclosed tags, comments and cut-off references end with the page; text is
never cut; depth and unmatched tags cost linear time; repeated rows and ties
(the earlier element wins) behave alike; clashing input columns are ignored, as
only the named ones are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

from pyspark.sql import DataFrame

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+|[0-9]+", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset(
    "script style noscript template iframe head title nav footer aside form button select textarea option svg canvas object embed menu dialog"
    " fieldset input label audio video map xmp noembed noframes search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark furniture.
FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination paywall"
    " popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say where or how large something is, not what.
LAYOUT = frozenset(
    "site page global main top bottom left right upper lower first last primary secondary sticky fixed mobile desktop small large inner outer wrap wrapper"
    " container box block list item items area region section slot bar row col column grid group panel unit link links button buttons btn icon icons form area text"
    " title widget widgets module component js id the".split()
)
#: Furniture words of what readers write.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Share of links from which an element with a furniture word in its name is dropped.
LINKED = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
#: Open elements that a start tag ends, up to the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}),
}


class Node:
    __slots__ = ("tag", "up", "kids", "drop", "named", "holds", "inside", "points", "chars", "linked", "depth")

    def __init__(self, tag: str, up: Node | None, drop: bool = False, named: str = ""):
        self.tag, self.up, self.kids, self.drop, self.named = tag, up, [], drop, named
        self.points, self.chars, self.linked, self.holds = 0.0, 0, 0, ""
        self.depth = up.depth + 1 if up else 0
        self.inside = bool(up) and (up.inside or up.tag in ("article", "main"))


def _named(value: str) -> str:
    """What a class or id says: ``readers`` or ``furniture`` (and nothing else), ``partly`` or nothing."""
    found = ""
    for name in value.split():
        words = [w.lower() for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        marks = [w for w in words if w in FURNITURE]
        if marks and all(w in FURNITURE or w in LAYOUT or w.isdigit() for w in words):
            return "readers" if any(w in READERS for w in marks) else "furniture"
        if marks:
            found = "partly"
    return found


def _kind(tag: str, attrs: str, inside: bool) -> tuple[bool, str]:
    """(structural furniture, what the element's names say)."""
    if tag in DROPPED or tag == "header" and not inside:
        return True, ""
    named = ""
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name in ("class", "id"):
            said = _named(value)
            named = min((named, said), key=("readers", "furniture", "partly", "").index)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, named
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, "" if tag in ("html", "body", "main") else named


class _Open:
    """The open elements, and those of each tag; every element is opened and closed once."""

    def __init__(self, root: Node):
        self.top, self.by_tag, self.blocks = root, {}, []

    def push(self, node: Node) -> None:
        self.top = node
        self.by_tag.setdefault(node.tag, []).append(node)
        if node.tag in BLOCK:
            self.blocks.append(node)

    def close(self, node: Node) -> None:
        """Close the element and all within it."""
        while self.top.depth >= node.depth:
            n = self.top
            self.by_tag[n.tag].pop()
            if n.tag in BLOCK:
                self.blocks.pop()
            self.top = n.up

    def last(self, tag: str) -> Node | None:
        nodes = self.by_tag.get(tag)
        return nodes[-1] if nodes else None

    def outermost(self, ends: set, bounds: set) -> Node | None:
        """The outermost open element of ``ends`` within the innermost of ``bounds``."""
        floor = max((n.depth for n in map(self.last, bounds) if n), default=-1)
        found = [nodes[i] for t in ends if (nodes := self.by_tag.get(t)) and (i := bisect_right(nodes, floor, key=lambda n: n.depth)) < len(nodes)]
        return min(found, key=lambda n: n.depth, default=None)


def parse(page: str) -> Node:
    """The page as a tree; kids are nodes or decoded strings. Furniture is marked, not removed."""
    root = Node("html", None)
    opened = _Open(root)
    at, lower = 0, None
    while True:
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        top = opened.top
        if end > at:
            stray = page[at:end]
            if m is None:  # a reference cut off by the end of the page still counts as text
                top.kids.append(html.unescape(stray if not re.match(r"<[/a-zA-Z!?]", stray) else ""))
            else:
                top.kids.append(html.unescape(stray))
        if m is None:
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            node = opened.last(tag)
            if node:
                opened.close(node)
            elif tag == "p":
                top.kids.append(Node("p", top))
            continue
        if tag in BLOCK and tag != "body" and tag != "html" and opened.blocks and opened.blocks[-1].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in CLOSES:
            found = opened.outermost(*CLOSES[tag])
            if found:
                opened.close(found)
        top = opened.top
        drop, named = _kind(tag, m[3] or "", top.inside or top.tag in ("article", "main"))
        new = Node(tag, top, drop, named)
        top.kids.append(new)
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                return root
            at = (page.find(">", stop) + 1) or len(page)
            continue
        opened.push(new)


def _drop_named(root: Node) -> list[Node]:
    """Mark elements that their names alone make furniture; returns them, so that the marks can be taken back."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        n.holds = n.tag if n.tag in ("article", "main", "h1") and not n.drop and n.named != "readers" else ""
        stack.extend(k for k in n.kids if isinstance(k, Node) and not k.drop)
    holds: dict[Node, set] = {}
    dropped = []
    for n in reversed(order):
        within = holds.pop(n, set())
        if n.named in ("readers", "furniture") and not within & ({"main", "h1"} if n.named == "readers" else {"main", "h1", "article"}) and not (n.tag == "article" and n.named == "furniture"):
            n.drop = True
            dropped.append(n)
            continue
        if n.holds:
            within.add(n.holds)
        if n.up and within:
            holds.setdefault(n.up, set()).update(within)
    return dropped


def _measure(root: Node) -> list[Node]:
    """Set each node's text length, linked length and points; returns the kept nodes in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.drop:
            continue
        order.append(n)
        n.chars = n.linked = 0
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    commas = {}
    for n in reversed(order):  # children before their parents
        texts = [k for k in n.kids if isinstance(k, str)]
        n.chars += sum(len(SPACE.sub(" ", t).strip()) for t in texts)
        commas[n] = commas.get(n, 0) + sum(t.count(",") + t.count("、") + t.count("，") for t in texts)
        if n.tag == "a":
            n.linked = n.chars
        if n.up:
            n.up.chars += n.chars
            n.up.linked += n.linked
            if n.tag not in BLOCK:
                commas[n.up] = commas.get(n.up, 0) + commas[n]
    # points on their way up, by how many levels they have come: full, a half, a sixth, a ninth, a twelfth from there on
    coming: dict[Node, list[float]] = {}
    for n in reversed(order):
        got = coming.pop(n, [0.0] * 5)
        direct = n.tag == "div" and any(isinstance(k, str) and k.strip() for k in n.kids)
        own = 0.0
        if (n.tag in PARAGRAPHS or direct) and n.chars >= 25:
            own = (1 + commas[n] + min(n.chars // 100, 3)) * (1 - n.linked / n.chars)
        if direct:
            got[0] += own
            own = 0.0
        n.points = got[0] + got[1] / 2 + got[2] / 6 + got[3] / 9 + got[4] / 12
        if n.named:
            n.points /= 2
        if n.up:
            on = coming.setdefault(n.up, [0.0] * 5)
            for i, x in enumerate((own, got[0], got[1], got[2], got[3] + got[4])):
                on[i] += x
    return order


def _blocks(nodes: list[Node]) -> list[str]:
    out, run = [], []

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text:
            out.append(text)

    for start in nodes:
        stack: list = [start]
        while stack:
            k = stack.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                run.append(k)
            elif k.drop or k.named and k is not start and k.chars and k.linked >= LINKED * k.chars:
                if k.tag in BLOCK:
                    flush()
                else:
                    run.append(" ")
            elif k.tag == "br":
                run.append(" ")
            else:
                if k.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(k.kids))
        flush()
    return out


def _total(n: Node) -> float:
    return n.points * (1 - (n.linked / n.chars if n.chars else 0))


def _with_siblings(best: Node) -> list[Node]:
    """An element and the siblings that score like it, in page order."""
    least = max(10.0, 0.2 * _total(best))
    kept = []
    for k in best.up.kids:
        if not isinstance(k, Node) or k.drop:
            continue
        density = k.linked / k.chars if k.chars else 1.0
        if k is best or _total(k) >= least or k.tag in HEADINGS and density < 0.3:
            kept.append(k)
        elif k.tag == "p" and (k.chars > 80 and density < 0.25 or 0 < k.chars <= 80 and density == 0):
            kept.append(k)
    return kept


def _main_blocks(root: Node) -> list[str]:
    order = _measure(root)
    best = max(order, key=lambda n: (_total(n), n.chars if n.tag in ("article", "main") else 0), default=root)
    if _total(best) <= 0:
        named = [n for n in order if n.tag in ("article", "main") and n.chars]
        best = max(named, key=lambda n: n.chars) if named else next((n for n in order if n.tag == "body" and n.chars), root)
    article = main = None
    node: Node | None = best
    while node:
        if node.tag == "article" and article is None and main is None:
            article = node
        if node.tag == "main":
            main = node
        node = node.up
    if main is not None:
        # every level between the best container and main adds the siblings that score like it
        kept, node = [article or best], article or best
        while node is not main:
            around = _with_siblings(node)
            i = around.index(node)
            kept = [*around[:i], *kept, *around[i + 1 :]]
            node = node.up
        return _blocks(kept)
    if article is not None:
        return _blocks([article])
    if best.up is None:
        return _blocks([best])
    return _blocks(_with_siblings(best))


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    root = parse(page)
    dropped = _drop_named(root)
    blocks = _main_blocks(root)
    if not blocks and dropped:  # the names were wrong about this page
        for n in dropped:
            n.drop = False
        blocks = _main_blocks(root)
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    from pyspark.sql import functions as F

    return pages.select(page_id, url, F.col(source).cast("string")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")

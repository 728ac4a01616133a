"""Main text of pages by wrapper induction.

A page's block elements make a tree, in which text blocks of one name beside each other and
runs of LIST or more alike blocks count as one node. The distinct trees of a host are
aligned by simple tree matching and merged, FAN at a time and the results again, into one
tree that holds every layout of the host. Each page's tree is then aligned with its host's,
and texts are counted at the nodes they fall on: a text that is the same in most articles
which have the node is template, the rarely repeated others are slots; copies of an article
count once. A block's weight is its slot text (a text counted once) times the square of the
articles that have it, so that what only some pages have, such as comments, weighs less.

The text of a page is what its blocks with the most weight hold: from the first to the last
text that is not template, with the main heading above. Where a page marks articles itself,
these are taken whole, but for such as hold template on all pages. Inside, nothing goes
but elements that HTML itself or a name for an advert, a comment list, a notice, a menu
or a sidebar sets apart.

Only trees and counts are gathered by host, summed up before they meet, so a host may have
any share of the pages; a host's tree grows with the variety of its layouts alone. Trees
and wrappers are broadcast where their measured size allows and joined by host and salt else.

Cases: null and empty html give an empty text; null and odd urls share one nameless host;
repeated rows are repeated; unclosed tags are closed as browsers do; deep, wide and long
pages are read like others; an empty table gives an empty result; columns beside page_id,
url and html are not read.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import spread, staged

#: Bytes of wrappers that are broadcast at most.
BROADCAST_BYTES, SALTS = 8_000_000, 64
#: Articles that a template text is in at least, and their share of those with its path; characters of a text that tells articles apart.
LEAST, SHARE, LONG = 3, 0.8, 40
#: Alike blocks in a row that make a list; trees of a host that one task merges; weight beside the best block's that makes its namesakes parts of one text.
LIST, FAN, PART = 4, 64, 0.2

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES = {
    "li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SKIPPED = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg object canvas dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TEXTUAL = frozenset("p li dt dd tr td th tbody thead tfoot caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address option hr".split())
#: Names, whole ones of the class or id, of what is no text of an article wherever it stands.
NOISE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor(?:s|ed)?|comments?|disqus|cookies?|newsletter|sidebar|breadcrumbs?|popup|modal)(?:[-_]\w[\w-]*)?|promos?|banner|replies|respond|consent|gdpr|menu|navbar|pagination|pager|related|(?:share|sharing|social)(?:[-_](?:bar|box|buttons?|icons?|links?|media|tools?))?",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element; noise: it holds no text of the article."""

    __slots__ = ("tag", "mark", "children", "parent", "noise", "named", "main")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.main, self.noise, self.named = tag in ("article", "main"), tag in SKIPPED, False
        self.mark = tag + "*" * self.main
        if attributes and not attributes.isspace():
            self.describe(attributes)

    def describe(self, attributes: str) -> None:
        tag = self.tag
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = found.get("class", "").split()
        role = found.get("role", "").lower()
        self.main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
        plain = sorted(x for x in names if not any(c.isdigit() for c in x))  # numbers in names tell pages apart, not layouts
        self.mark = ".".join([tag, *plain]) + "*" * self.main
        self.noise = tag in SKIPPED or role in ROLES or "hidden" in found
        self.named = not self.main and tag not in ("body", "html") and any(NOISE.fullmatch(x) for x in [*names, *found.get("id", "").split()])


def parse(source: str) -> Node:
    """The DOM; children are nodes and strings (character references not yet decoded)."""
    root = at = Node("#", "", None)
    place, lowered = 0, None
    while m := TAG.search(source, place):
        if m.start() > place:
            at.children.append(source[place : m.start()])
        place = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            elif tag == "p":
                at.children.append(" ")
            continue
        if tag in CLOSES or tag in ENDS_P:
            ends, stops = CLOSES.get(tag, ("p", ()))
            ends, up = ends.split(), at
            while up is not None and up.tag not in ends and up.tag not in stops and (tag in CLOSES or up.tag in INLINE or up.tag == "p"):
                up = up.parent
            if up is not None and up.tag in ends:
                at = up.parent
        node = Node(tag, attributes, at)
        at.children.append(node)
        if tag in RAW:
            lowered = lowered or source.lower()
            end = lowered.find(f"</{tag}", place)
            end = len(source) if end < 0 else end
            node.children.append(source[place:end])
            close = source.find(">", end)
            place = len(source) if close < 0 else close + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            at = node
    if place < len(source):
        at.children.append(source[place:])
    for x in nodes(root):  # from the top
        if x.tag == "form" or x.named:
            x.noise = not frames(x)
        elif x.tag == "header":
            x.noise = not (frames(x) or any(y.main for y in ancestors(x)))
    return root


def frames(node: Node) -> bool:
    """Whether what looks like noise holds the article, or a main heading with paragraphs: it frames the page then."""
    below = [x.tag for x in nodes(node)]
    return any(x.main for x in nodes(node)) or "h1" in below and below.count("p") >= 3


def nodes(top: Node) -> Iterator[Node]:
    stack = [top]
    while stack:
        at = stack.pop()
        yield at
        stack += [x for x in reversed(at.children) if isinstance(x, Node)]


def ancestors(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def content(top: Node, mute: frozenset[int] = frozenset()) -> str:
    """Text below top without noise and without the own texts of the blocks in mute."""
    out: list[str] = []
    stack: list = [(top, False)]
    while stack:
        at, silent = stack.pop()
        if isinstance(at, str):
            if not silent:
                out.append(at)
            continue
        if at.noise and at is not top:
            continue
        if at.tag not in INLINE:
            out.append(" ")
            silent = id(at) in mute
            stack.append((" ", False))
        stack += [(x, silent) for x in reversed(at.children)]
    return squeezed("".join(out))


class Block:
    """A block element with its own text, that of the inline elements in it included, and its characters without links."""

    __slots__ = ("node", "parent", "kids", "pieces", "linked", "text", "size", "at")

    def __init__(self, node: Node, parent: Block | None):
        self.node, self.parent, self.kids, self.pieces, self.linked = node, parent, [], [], []

    def settle(self) -> None:
        self.text = squeezed("".join(self.pieces))
        self.size = max(0, len(self.text) - len(squeezed(" ".join(self.linked)))) if self.linked else len(self.text)


def blocks(root: Node) -> list[Block]:
    """The blocks of a page, in its order, without noise."""
    out, stack = [Block(root, None)], []

    def push(node: Node, block: Block, linked: bool) -> None:
        stack.extend((x, block, linked) for x in reversed(node.children))

    push(root, out[0], False)
    while stack:
        at, block, linked = stack.pop()
        if isinstance(at, str):
            block.pieces.append(at)
            if linked:
                block.linked.append(at)
        elif not at.noise:
            if at.tag == "br":
                block.pieces.append(" ")
            elif at.tag in INLINE:
                push(at, block, linked or at.tag == "a")
            else:
                block.pieces.append(" ")
                made = Block(at, block)
                block.kids.append(made)
                out.append(made)
                push(at, made, False)
    for x in out:
        x.settle()
    return out


class Tree:
    """A node of aligned blocks. shape: a hash of the tree below; size: its nodes."""

    __slots__ = ("mark", "kids", "blocks", "shape", "size")

    def __init__(self, mark: str, kids: list[Tree], found: list[Block]):
        self.mark, self.kids, self.blocks = mark, kids, found
        self.settle()

    @property
    def tag(self) -> str:
        return self.mark.partition(".")[0].rstrip("*")

    def settle(self) -> None:
        self.shape = hash((self.mark, *[x.shape for x in self.kids]))
        self.size = 1 + sum(x.size for x in self.kids)


def preorder(top: Tree) -> list[Tree]:
    out, stack = [], [top]
    while stack:
        at = stack.pop()
        out.append(at)
        stack += reversed(at.kids)
    return out


def tree_of(found: list[Block]) -> Tree:
    """The tree of a page's blocks, with lists as one node."""
    made: dict[int, Tree] = {}
    for block in reversed(found):  # children before parents
        kids: list[Tree] = []
        texts: dict[str, Tree] = {}
        for x in (made.pop(id(y)) for y in block.kids):
            if x.tag in TEXTUAL and x.mark in texts:
                unite(texts[x.mark], x)
                continue
            if x.tag in TEXTUAL:
                texts[x.mark] = x
            kids.append(x)
        made[id(block)] = Tree(block.node.mark, listed(kids), [block])
    return made[id(found[0])]


def listed(kids: list[Tree]) -> list[Tree]:
    """Runs of LIST or more alike trees as one."""
    out: list[Tree] = []
    at = 0
    while at < len(kids):
        end = at
        while end < len(kids) and kids[end].shape == kids[at].shape:
            end += 1
        if end - at >= LIST:
            for x in kids[at + 1 : end]:
                unite(kids[at], x)
            out.append(kids[at])
        else:
            out += kids[at:end]
        at = end
    return out


_weights: dict[tuple[int, int], int] = {}


def ends_alike(p: list[Tree], q: list[Tree]) -> tuple[int, int]:
    """How many children are alike from the front and, of the rest, from the back: some best matching pairs these."""
    most = min(len(p), len(q))
    front = 0
    while front < most and p[front].shape == q[front].shape:
        front += 1
    back = 0
    while back < most - front and p[-1 - back].shape == q[-1 - back].shape:
        back += 1
    return front, back


def weight(x: Tree, y: Tree) -> int:
    """Nodes that simple tree matching pairs in two trees with one mark. No recursion: pages may be deep."""
    stack = [(x, y)]
    while stack:
        a, b = stack[-1]
        key = (a.shape, b.shape)
        if key in _weights:
            stack.pop()
        elif a.shape == b.shape:
            _weights[key] = a.size
        else:
            front, back = ends_alike(a.kids, b.kids)
            p, q = a.kids[front : len(a.kids) - back], b.kids[front : len(b.kids) - back]
            open_ = [(u, v) for u in p for v in q if u.mark == v.mark and (u.shape, v.shape) not in _weights]
            if open_:
                stack += open_
            else:
                _weights[key] = 1 + sum(u.size for u in [*a.kids[:front], *a.kids[len(a.kids) - back :]]) + table(p, q)[-1][-1]
    return _weights[x.shape, y.shape]


def table(p: list[Tree], q: list[Tree]) -> list[list[int]]:
    """Most nodes paired in the first i and j children, in their order. The pairs' own weights are known."""
    m = [[0] * (len(q) + 1)]
    for u in p:
        last, row = m[-1], [0]
        for j, v in enumerate(q):
            w = last[j] + _weights[u.shape, v.shape] if u.mark == v.mark else 0
            row.append(max(last[j + 1], row[j], w))
        m.append(row)
    return m


def matching(a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
    """Pairs of nodes that simple tree matching aligns, a and b themselves first."""
    if len(_weights) > 200_000:
        _weights.clear()
    weight(a, b)
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            stack += zip(x.kids, y.kids, strict=True)
            continue
        front, back = ends_alike(x.kids, y.kids)
        i, j = len(x.kids) - back, len(y.kids) - back
        stack += zip(x.kids[:front] + x.kids[i:], y.kids[:front] + y.kids[j:], strict=True)
        p, q = x.kids[front:i], y.kids[front:j]
        for u in p:
            for v in q:
                if u.mark == v.mark:
                    weight(u, v)  # known unless trees of one shape were met
        m, i, j = table(p, q), len(p), len(q)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                stack.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
    return pairs


def unite(a: Tree, b: Tree) -> None:
    """Merges b into a: aligned nodes become one, the others are put in where they stand."""
    if a.shape == b.shape:
        for x, y in zip(preorder(a), preorder(b), strict=True):
            x.blocks += y.blocks
        return
    pairs = matching(a, b)
    to = {id(y): x for x, y in pairs}
    for x, y in pairs:
        x.blocks = x.blocks + y.blocks
        place = 0
        kids = list(x.kids)
        for v in y.kids:
            if id(v) in to:
                place = next(i for i, u in enumerate(kids) if u is to[id(v)]) + 1
            else:
                kids.insert(place, v)
                place += 1
        x.kids = kids
    for x in reversed(preorder(a)):
        x.settle()


def written(top: Tree) -> str:
    """A tree as text: depth and mark of its nodes from the top."""
    out, stack = [], [(top, 0)]
    while stack:
        at, deep = stack.pop()
        out.append([deep, at.mark])
        stack += [(x, deep + 1) for x in reversed(at.kids)]
    return json.dumps(out, separators=(",", ":"))


def read(text: str) -> Tree:
    rows = json.loads(text)
    kids: dict[int, list[Tree]] = {}
    for deep, mark in reversed(rows):  # children before parents
        kids.setdefault(deep, []).append(Tree(mark, kids.pop(deep + 1, [])[::-1], []))
    return kids[0][0]


def merged(trees: list[str]) -> str:
    """One tree that holds all the trees, aligned."""
    out = read(trees[0])
    for text in trees[1:]:
        unite(out, read(text))
    return written(out)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def wrapped(n: int) -> int:
    """n as a signed number of 64 bits."""
    return (n + 2**63) % 2**64 - 2**63


class Aligned:
    """A host's tree, and where the nodes of pages fall on it."""

    def __init__(self, text: str):
        self.top = read(text)
        self.nodes = preorder(self.top)
        self.place = {id(x): i for i, x in enumerate(self.nodes)}
        self.known: dict[int, list[int]] = {}

    def of(self, page: Tree) -> Iterator[tuple[int, Tree]]:
        """The host's node (-1: none) of each of the page's."""
        mine = preorder(page)
        if page.shape not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            to = {id(y): self.place[id(x)] for x, y in matching(self.top, page)} if page.mark == self.top.mark else {}
            self.known[page.shape] = [to.get(id(y), -1) for y in mine]
        return zip(self.known[page.shape], mine, strict=True)


def boxes(nodes: list[Tree], value: dict[int, float]) -> dict[int, float]:
    """Values of texts at nodes, by the block that holds them.

    Text blocks count for the element around them, and so do two or more blocks of one name
    beside each other that hold nothing but text, as those of pages that use them for paragraphs.
    """
    place = {id(x): i for i, x in enumerate(nodes)}
    up = {place[id(y)]: i for i, x in enumerate(nodes) for y in x.kids}
    plain = Counter((up[i], nodes[i].mark) for i, v in value.items() if v and i in up and not nodes[i].kids)
    out: Counter[int] = Counter()
    for i, v in value.items():
        if i in up and plain[up[i], nodes[i].mark] > 1 and not nodes[i].kids and nodes[up[i]].tag not in ("body", "html", "#"):
            i = up[i]
        while nodes[i].tag in TEXTUAL and i in up:
            i = up[i]
        out[i] += v
    return out


def gathered(source: str, host: Aligned) -> Iterator[tuple[int, int, int, int]]:
    """(node of the host, text, article, size) of every text of a page; text 0 stands for the node itself.

    Two pages are the same article for a text where the other long texts of their largest
    blocks are equal: menus, dates and adverts make no new article.
    """
    top = tree_of(blocks(parse(source)))
    mine = preorder(top)
    sizes = boxes(mine, {i: float(sum(b.size for b in x.blocks)) for i, x in enumerate(mine)})
    best = max(sizes, key=lambda i: (sizes[i], -i), default=0)
    texts = {b.text for x in preorder(mine[best]) for b in x.blocks if b.text}
    telling = {t: digest(t) for t in texts if len(t) >= LONG} or {t: digest(t) for t in texts}
    whole = sum(telling.values())
    for node, x in host.of(top):
        if node >= 0:
            yield node, 0, wrapped(whole), 0
            for b in x.blocks:
                if b.text:
                    yield node, digest(b.text), wrapped(whole - telling.get(b.text, 0)), b.size


def constant(same: int, there: int) -> bool:
    """Whether a text in so many articles, of those that have its node, is template."""
    return same >= LEAST and same >= SHARE * there


class Wrapper:
    """How to take the text from a host's pages. Without a description every page is its own host."""

    def __init__(self, text: str | None):
        self.spec = json.loads(text) if text else None
        if self.spec:
            self.host = Aligned(self.spec["tree"])
            self.template = {tuple(x) for x in self.spec["template"]}
            there = {n: a for n, a, _ in self.spec["nodes"]}
            self.learn({n: float(c) * there[n] ** 2 for n, _, c in self.spec["nodes"]})

    def learn(self, value: dict[int, float]) -> None:
        nodes = self.host.nodes
        self.value = boxes(nodes, value)
        self.below: list[float] = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            self.below[i] = self.value.get(i, 0.0) + sum(self.below[self.host.place[id(y)]] for y in nodes[i].kids)
        self.up = {self.host.place[id(y)]: i for i, x in enumerate(nodes) for y in x.kids}

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        found = blocks(parse(source))
        top = tree_of(found)
        if self.spec:
            text = self.text(found, top)
            if text is not None:
                return text
        own = Wrapper(None)
        own.host, own.template = Aligned(written(top)), set()
        own.learn({i: float(sum(b.size for b in x.blocks)) for i, x in enumerate(preorder(top))})
        text = own.text(found, top)
        return content(found[0].node) if text is None else text

    def text(self, found: list[Block], top: Tree) -> str | None:
        """The text of a page; None where it has none of the host's content blocks."""
        there: dict[int, list[Block]] = {}
        for node, x in self.host.of(top):
            if node >= 0:
                there.setdefault(node, []).extend(x.blocks)
        marked = [i for i in there if self.host.nodes[i].mark.endswith("*")]
        for kind in ("article", None):
            some = [i for i in marked if kind is None or self.host.nodes[i].tag == kind]
            inner = {i for i in some if any(j in some for j in self.above(i))}
            some = [i for i in some if i not in inner]
            some = [i for i in some if self.below[i]] or some
            if some:
                return " ".join(filter(None, (content(x) for x in outermost(b.node for i in some for b in there[i]))))
        best = max((i for i in there if self.value.get(i)), key=lambda i: (self.value[i], -i), default=None)
        if best is None:
            return None
        parts = {best}
        if best in self.up and (self.host.nodes[best].tag == "section" or "." in self.host.nodes[best].mark):  # parts of one text
            beside = [self.host.place[id(y)] for y in self.host.nodes[self.up[best]].kids if y.mark == self.host.nodes[best].mark]
            parts |= {i for i in beside if i in there and self.value.get(i, 0) >= PART * self.value[best]}
        if not any(y.tag == "h1" for i in parts for y in preorder(self.host.nodes[i])):  # its heading stands above
            for i in self.above(best):
                titles = [self.host.place[id(y)] for y in self.host.nodes[i].kids if y.tag == "h1"]
                titles = [j for j in titles if j in there and any(b.text and (j, digest(b.text)) not in self.template for b in there[j])]
                if titles:
                    parts |= set(titles)
                    break
        tops = outermost(b.node for i in parts for b in there[i])
        return " ".join(filter(None, (content(x, self.framing(found, tops, there)) for x in tops)))

    def above(self, i: int) -> Iterator[int]:
        while i in self.up:
            i = self.up[i]
            yield i

    def framing(self, found: list[Block], tops: list[Node], there: dict[int, list[Block]]) -> frozenset[int]:
        """Blocks with template before the first and after the last text that is none; of a page's body, also blocks without a slot text of any page."""
        node = {id(b): i for i, some in there.items() for b in some}
        whole = {id(x) for x in tops}
        inside: dict[int, bool] = {}
        lines: list[tuple[Block, bool]] = []
        gone: set[int] = set()
        for b in found:  # parents before children
            inside[id(b)] = id(b.node) in whole or b.parent is not None and inside[id(b.parent)]
            if inside[id(b)] and b.text:
                lines.append((b, (node.get(id(b), -1), digest(b.text)) in self.template))
        for run in (lines, lines[::-1]):
            for b, fixed in run:
                if not fixed:
                    break
                gone.add(id(b.node))
        if any(x.tag in ("body", "html", "#") for x in tops):
            for b, _ in lines:
                if id(b.node) not in whole and self.empty(node.get(id(b), -1)):
                    gone.add(id(b.node))
        return frozenset(gone)

    def empty(self, i: int) -> bool:
        """Whether the block around a node holds no slot text."""
        while i in self.up and self.host.nodes[i].tag in TEXTUAL:
            i = self.up[i]
        return i >= 0 and not self.value.get(i)


def outermost(found: Iterator[Node]) -> list[Node]:
    """The nodes that are in none of the others, in the order given, which is that of the page within a node of the tree."""
    every = list(found)
    ids = {id(x) for x in every}
    kept = [x for x in every if not any(id(y) in ids for y in ancestors(x))]
    return in_order(kept)


def in_order(kept: list[Node]) -> list[Node]:
    """Nodes of one page in its order."""
    if len(kept) < 2:
        return kept
    top = [kept[0], *ancestors(kept[0])][-1]
    ids = {id(x) for x in kept}
    return [x for x in nodes(top) if id(x) in ids]


def induce(pages: list[str]) -> str:
    """The wrapper of a few pages, as wrappers() makes it."""
    pages = list(dict.fromkeys(pages))
    counted = Counter(written(tree_of(blocks(parse(x)))) for x in pages)
    tree = merged(sorted(counted, key=lambda x: (-counted[x], x)))
    host = Aligned(tree)
    rows: dict[tuple[int, int, int], int] = {}
    for page in pages:
        for node, text, article, size in gathered(page, host):
            rows[node, text, article] = max(size, rows.get((node, text, article), 0))
    same, most = Counter(x[:2] for x in rows), Counter()
    for (node, text, _), size in rows.items():
        most[node, text] = max(most[node, text], size)
    template = sorted([node, text] for (node, text), n in same.items() if text and constant(n, same[node, 0]))
    slots = Counter()
    for (node, text), n in same.items():
        if text and n < LEAST:
            slots[node] += most[node, text]
    return json.dumps({"tree": tree, "template": template, "nodes": sorted([node, n, slots[node]] for (node, text), n in same.items() if not text)})


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _by_host(pages: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The columns of pages with the column of found that holds for their host."""
    told = next(c for c in found.columns if c != "host")
    size = found.agg(F.coalesce(F.sum(F.length(told) + F.length("host")), F.lit(0))).first()[0]
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    mine = pages.select(*columns, host.alias("host"))
    if size <= BROADCAST_BYTES:
        return mine.join(F.broadcast(found), "host", "left")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return mine.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def trees(pages: DataFrame) -> DataFrame:
    """host and tree: the aligned trees of all pages of each host."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter((host, written(tree_of(blocks(parse(source.as_py()))))) for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "tree", "pages"])

    def merge(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["pages", "tree"], ascending=[False, True])
        return pd.DataFrame({"host": [key[0]], "tree": [merged(found["tree"].tolist())], "pages": [int(found["pages"].sum())]})

    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    source = pages.select(host.alias("host"), "html").filter("html IS NOT NULL AND html != ''")
    out = staged(source.mapInArrow(shapes, "host string, tree string, pages long").groupBy("host", "tree").agg(F.sum("pages").alias("pages")), "trees")
    while True:  # each round leaves a host one tree for every FAN
        many = out.groupBy("host").agg(F.count("*").alias("n"))
        most = many.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return out.select("host", "tree")
        lots = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN))
        dealt = out.join(many, "host").withColumn("lot", F.pmod(F.xxhash64("tree"), lots))
        out = staged(dealt.drop("n").groupBy("host", "lot").applyInPandas(merge, "host string, tree string, pages long"), "trees", 4)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, one row a host; wrapper: its tree, template as (node, text), and articles and slot characters of its nodes."""
    found = trees(pages)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Aligned] = {}
        for batch in batches:
            rows: set = set()
            for host, source, tree in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Aligned(tree)
                rows.update((host, *x) for x in gathered(source.as_py(), known[host]))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i else pa.string()) for i, x in enumerate(columns)], ["host", "node", "text", "article", "size"])

    told = _by_host(pages.filter("html IS NOT NULL AND html != ''"), found, "html").select("host", "html", "tree")
    rows = told.mapInArrow(gather, "host string, node long, text long, article long, size long")
    once = rows.groupBy("host", "node", "text", "article").agg(F.max("size").alias("size"))
    counts = staged(once.groupBy("host", "node", "text").agg(F.count("*").alias("same"), F.max("size").alias("size")), "texts")
    there = counts.filter("text = 0").select("host", "node", F.col("same").alias("there"))
    slots = counts.filter((F.col("text") != 0) & (F.col("same") < LEAST)).groupBy("host", "node").agg(F.sum("size").alias("chars"))
    nodes_ = there.join(slots, ["host", "node"], "left").groupBy("host").agg(F.sort_array(F.collect_list(F.array("node", "there", F.coalesce("chars", F.lit(0))))).alias("nodes"))
    fixed = counts.filter((F.col("text") != 0) & (F.col("same") >= LEAST)).join(there, ["host", "node"]).filter(F.col("same") >= SHARE * F.col("there"))
    template = fixed.groupBy("host").agg(F.sort_array(F.collect_list(F.array("node", "text"))).alias("template"))
    made = found.join(nodes_, "host").join(template, "host", "left")
    none = F.array().cast("array<array<bigint>>")
    return made.select("host", F.to_json(F.struct("tree", F.coalesce("template", none).alias("template"), "nodes")).alias("wrapper"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    joined = _by_host(pages, staged(wrappers(pages), "wrappers", 4), "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Wrapper] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = Wrapper(wrapper)
                texts.append(known[wrapper].extract(source.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")

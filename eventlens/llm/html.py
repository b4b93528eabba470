"""Main-text extraction from web pages by wrapper induction.

Pages of one host come from one template. A bounded sample of a host's different pages, of any length and depth,
is parsed, and their whole trees, menus and footers too, are aligned by simple tree matching (the largest
order-preserving matching of equal labels). Equal subtrees are matched as such; siblings too many for a table
are matched by their unique equal subtrees, and between these by label in order, so long pages take linear
time. Nodes that hold the same text in nearly all pages at a marked place of their own, or on every page of a whole sample, are template; the
others are slots. Names of classes and ids say that an element is a menu, sidebar, advert and so on only where it does not hold most of the
slots' text; inside the content, names that articles use too say so only of what does not vary. The wrapper of a layout is the path of the lowest element that holds all remaining slots, and the hashes of template
texts inside it; a host's sampled pages are first put together by layout. Every page is then cut with its
layout's wrapper: the element at that path without template texts and without menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. Pages without a wrapper that fits use
their article or main element, or else their body.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .urlfilter import host_and_path

#: Different pages of a layout that its wrapper is made from, and groups of a host's pages, by tags and classes, that are sampled each.
SAMPLE, KINDS = 8, 32
#: Cells of a table of siblings, and of all tables of two pages, beyond which siblings are matched in linear time.
CELLS, ALL_CELLS = 1024, 400_000
#: Share of the other pages in which a template text stands; pages needed; share of the text it may be at most.
CONSTANT, LEAST, MOST = 0.9, 4, 0.3
#: A named element that holds more than this share of the slots' text in most pages that have it is kept; articles that hold as much are the content.
HOLDS = 0.5
#: Share of places that pages of one layout have in common.
ALIKE = 0.3
#: Wrappers of at most so many hosts and characters are broadcast.
BROADCAST_HOSTS, BROADCAST_CHARS = 50_000, 32_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that can be a page's content element.
HOLDERS = frozenset("#root html body main article section div center td".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: What a new element ends, if it is open inside the given bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold no visible text.
UNSEEN = frozenset("script style noscript template iframe svg math head title object canvas audio video".split())
NOT_TEXT = frozenset("nav header footer aside form script style noscript template iframe svg math button select textarea input dialog menu head title object canvas audio video search".split())
NOT_NAMES = frozenset(
    "nav navbar navigation menu topbar header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notification alert banner comment comments commentlist respond replies disqus discussion share sharing social related"
    " recommended breadcrumb breadcrumbs popup modal overlay subscribe subscription newsletter signup login form search pagination pager toolbar widget".split()
)
#: Of these, names that articles use for parts of their own: inside the content they do not say that an element is left out, unless its text is the same on all pages.
SOFT_NAMES = frozenset("discussion related recommended alert notice notification banner social widget search form header masthead topbar footer aside respond".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "names", "hard", "named", "soft", "out", "kids", "size")

    def __init__(self, tag: str, names: str = "", hard: bool = False, named: str = "", soft: bool = False):
        self.tag, self.names, self.hard, self.named, self.soft, self.out, self.kids, self.size = tag, names, hard, named, soft, hard, [], 0

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def _make(tag: str, raw: str) -> Node:
    """An element: whether its tag or role says that it is no main text (hard), or its class or id, which are kept in `named`."""
    names, out, named, soft = "", tag in NOT_TEXT, "", True
    if raw and not raw.isspace():
        for key, *values, hidden in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id"):
                words = {w.lower() for w in _NAME.findall(value)}
                if words & NOT_NAMES and tag not in ("html", "body"):
                    named += f"{key}={value} "
                    soft &= words & NOT_NAMES <= SOFT_NAMES
                if key == "class":
                    names = ".".join(value.split())
            elif key == "role":
                out |= value.lower() in NOT_ROLES
            elif hidden or (key == "aria-hidden" and value == "true"):
                out = True
    return Node(tag, names, out, named, soft and bool(named))


class _Open:
    """The elements that are open, and for each tag, and for blocks, where they stand: each step takes a time that does not grow with the depth."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all in it."""
        for node in self.nodes[at:]:
            self.places[node.tag].pop()
        del self.nodes[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: of the nearest such element, if there is one, but not through a block if it is none itself."""
        places = self.places.get(tag)
        if places and (tag in BLOCK or not self.blocks or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """What a new block ends: an open paragraph, and of list items and cells those of the same list or row."""
        if tag not in ENDS:
            if self.blocks and self.nodes[self.blocks[-1]].tag == "p":
                self.cut(self.blocks[-1])
            return
        ends, bounds = ENDS[tag]
        bound = max((self.places[t][-1] for t in bounds if self.places.get(t)), default=0)
        first = [places[i] for t in {*ends, "p"} if (places := self.places.get(t)) and (i := bisect_right(places, bound)) < len(places)]
        if first:
            self.cut(min(first))


def parse(html: str) -> Node:
    """A page's tree: elements, and its texts as strings. Open and crossing elements are closed as browsers do, roughly."""
    root = Node("#root")
    stack, at, n = _Open(root), 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        close, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack.nodes[-1].kids.append(text)
            continue
        tag = tag.lower()
        if close:
            stack.close(tag)
            continue
        if tag in BLOCK:
            stack.make_room(tag)
        node = _make(tag, raw)
        if tag == "header" and stack.places.get("article"):  # an article's own heading
            node.hard = node.out = False
        stack.nodes[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
            node.kids.append(html[at : end.start()])
            at = end.end()
        elif tag not in VOID and not raw.endswith("/"):
            stack.push(node)
    return root


def keep_articles(root: Node) -> None:
    """An element that holds a main element or an article that is text itself is not left out as a whole."""
    work, order = [root], []
    while work:
        node = work.pop()
        order.append(node)
        work += [k for k in node.kids if isinstance(k, Node)]
    holds = set()
    for node in reversed(order):
        if any(isinstance(k, Node) and (id(k) in holds or (k.tag in ("article", "main") and not k.out)) for k in node.kids):
            holds.add(id(node))
            if node.tag not in ("article", "main") or node.tag == "main":
                node.out = False


def _placed(root: Node) -> list[tuple[Node, int]]:
    """All elements, parents before children, each with a number for its path of labels."""
    out, at = [(root, 0)], 0
    while at < len(out):
        node, place = out[at]
        out += [(k, zlib.crc32(k.label.encode("utf-8", "replace"), place)) for k in node.kids if isinstance(k, Node)]
        at += 1
    return out


def _name_key(node: Node, place: int) -> int:
    return zlib.crc32(node.named.encode("utf-8", "replace"), place)


def _most(placed: list[tuple[Node, int]], sizes: dict[int, int] | None = None) -> dict[int, bool]:
    """For each kind of named element: whether its elements together hold most of the page's text (sizes: characters of each element's own)."""
    holds: set[int] = set()  # elements that hold an article are not left out by tag
    for node, _ in reversed(placed):
        kids = [k for k in node.kids if isinstance(k, Node)]
        if any(id(k) in holds or (k.tag in ("article", "main") and not k.hard) for k in kids):
            holds.add(id(node))
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) if sizes is None else sizes.get(id(node), 0)
        node.size = own + sum(k.size for k in kids) if sizes is not None or not node.hard or id(node) in holds else 0
    held: Counter = Counter()
    inside: dict[int, frozenset[int]] = {}
    for node, place in placed:  # an element inside one of its own kind is counted with that
        kinds = inside.get(id(node), frozenset())
        if node.named:
            key = _name_key(node, place)
            if key not in kinds:
                held[key] += node.size
            kinds = kinds | {key}
        if kinds:
            inside.update((id(k), kinds) for k in node.kids if isinstance(k, Node))
    return {key: n > HOLDS * placed[0][0].size for key, n in held.items()}


def _decide(root: Node, kept: dict[int, bool], placed: list[tuple[Node, int]]) -> None:
    """Marks what is left out: by tag and role, and by name unless kept says otherwise or, for names not in it, the page's own text does.

    Inside an article or main element soft names leave nothing out, unless kept says so.
    """
    if any(node.named for node, _ in placed):
        most = _most(placed) | kept
        inside: set[int] = set()
        for node, place in placed:
            within = id(node) in inside
            key = _name_key(node, place) if node.named else 0
            stays = kept.get(key, True) if within and node.soft else node.named and most[key]
            node.out = node.hard or (bool(node.named) and not stays)
            if within or (node.tag in ("article", "main") and not node.hard):
                inside.update(id(k) for k in node.kids if isinstance(k, Node))
    keep_articles(root)


def _layout(placed: list[tuple[Node, int]]) -> set[int]:
    """Numbers of the places of a page's blocks, without digits of class names and without what tags, roles and names leave out."""
    places, out = {id(placed[0][0]): 0}, set()
    for node, _ in placed:
        if id(node) not in places:
            continue
        if node.tag in BLOCK and node.tag not in ("html", "body"):
            out.add(places[id(node)])
        for k in node.kids:
            if isinstance(k, Node) and not k.hard:
                places[id(k)] = zlib.crc32(_DIGITS.sub("", k.label).encode("utf-8", "replace"), places[id(node)])
    return out


def _alike(a: set[int], b: set[int]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def blocks(node: Node, skip: frozenset[int] = frozenset()) -> list[str]:
    """The texts of node's blocks, in page order, white space made one space, empty ones and those of skip left out."""
    out: list[str] = []
    run: list[str] = []

    def end():
        text = " ".join(unescape("".join(run)).split())
        run.clear()
        if text and (not skip or _key(text) not in skip):
            out.append(text)

    work: list = [node]
    while work:
        x = work.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.out or x is node:
            if x.tag == "br":
                run.append(" ")
            if x.tag in BLOCK:
                end()
                work.append(None)
            work += reversed(x.kids)
    end()
    return out


def _key(text: str) -> int:
    """A number for a text, the same in every process."""
    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


class _Tree:
    """A node of the trees that are aligned: an element, or a leaf for a text."""

    __slots__ = ("label", "kids", "node", "text", "whole", "full")

    def __init__(self, label: str, node: Node | None = None, text: str | None = None):
        self.label, self.node, self.text, self.kids = label, node, text, []


def _tree(root: Node) -> _Tree:
    """The tree of all that may be seen, with a hash of each subtree and the weight of its matching with itself."""
    top = _Tree(root.label, root)
    order = [top]
    for tree in order:
        if tree.node is None:
            continue
        for k in tree.node.kids:
            if isinstance(k, str):
                text = " ".join(unescape(k).split())
                if text:
                    tree.kids.append(_Tree("#text", text=text))
            elif k.tag not in UNSEEN:
                tree.kids.append(_Tree(k.label, k))
        order += tree.kids
    for tree in reversed(order):
        tree.whole = hash((tree.label, tree.text, tuple([k.whole for k in tree.kids])))
        tree.full = 2.0 if tree.node is None else 1.0 + sum(k.full for k in tree.kids)
    return top


class _Matching:
    """Simple tree matching of two trees: weights of pairs of nodes and the pairs of children that give them; equal texts weigh double."""

    def __init__(self, a: _Tree, b: _Tree):
        self.known: dict[tuple[int, int], tuple[float, list[tuple[_Tree, _Tree]]]] = {}
        self.cells = 0
        self.a, self.b = a, b
        self._solve(a, b)

    def _weight(self, x: _Tree, y: _Tree) -> float:
        if x.whole == y.whole:
            return x.full
        if x.label != y.label:
            return 0.0
        return 1.0 if x.node is None else self.known[id(x), id(y)][0]

    def _solve(self, a: _Tree, b: _Tree) -> None:
        """Fills `known` for a and b and all pairs below that matter, children before parents, without recursion."""
        work: list[tuple] = [(a, b, None)]
        while work:
            x, y, plan = work.pop()
            if (id(x), id(y)) in self.known or x.whole == y.whole:
                continue
            if plan is None:
                plan = self._plan(x.kids, y.kids)
                work.append((x, y, plan))
                fixed, tables = plan
                pairs = fixed + [(p, q) for xs, ys in tables for p in xs for q in ys]
                work += [(p, q, None) for p, q in pairs if p.node is not None and p.label == q.label]
            else:
                fixed, tables = plan
                matched = list(fixed)
                for xs, ys in tables:
                    matched += self._table(xs, ys)
                self.known[id(x), id(y)] = 1.0 + sum(self._weight(p, q) for p, q in matched), matched

    def _plan(self, xs: list[_Tree], ys: list[_Tree]) -> tuple[list, list]:
        """Pairs of children that are matched in any case, and stretches of children that a table decides."""
        lo, n, m = 0, len(xs), len(ys)
        while lo < min(n, m) and xs[lo].whole == ys[lo].whole:
            lo += 1
        while min(n, m) > lo and xs[n - 1].whole == ys[m - 1].whole:
            n, m = n - 1, m - 1
        fixed = [*zip(xs[:lo], ys[:lo], strict=True), *zip(xs[n:], ys[m:], strict=True)]
        xs, ys = xs[lo:n], ys[lo:m]
        if self._fits(len(xs) * len(ys)):
            return fixed, [(xs, ys)] if xs and ys else []
        tables, i, j = [], 0, 0
        for p, q in [*_anchors(xs, ys), (len(xs), len(ys))]:
            part, other = xs[i:p], ys[j:q]
            if part and other:
                if self._fits(len(part) * len(other)):
                    tables.append((part, other))
                else:
                    fixed += _in_order(part, other)
            if p < len(xs):
                fixed.append((xs[p], ys[q]))
            i, j = p + 1, q + 1
        return fixed, tables

    def _fits(self, cells: int) -> bool:
        if cells > CELLS or self.cells + cells > ALL_CELLS:
            return False
        self.cells += cells
        return True

    def _table(self, xs: list[_Tree], ys: list[_Tree]) -> list[tuple[_Tree, _Tree]]:
        m = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            row, above = m[i], m[i - 1]
            for j, y in enumerate(ys, 1):
                row[j] = max(row[j - 1], above[j], above[j - 1] + self._weight(x, y))
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out

    def equal_texts(self) -> Iterator[tuple[_Tree, _Tree]]:
        """Matched leaves that hold the same text."""
        work = [(self.a, self.b)]
        while work:
            x, y = work.pop()
            if x.whole == y.whole:
                if x.node is None:
                    yield x, y
                work += zip(x.kids, y.kids, strict=True)
            elif x.node is not None and y.node is not None:
                work += self.known[id(x), id(y)][1]


def _anchors(xs: list[_Tree], ys: list[_Tree]) -> list[tuple[int, int]]:
    """Places of subtrees that both lists hold once, as many as stand in one order in both."""
    a, b = Counter(x.whole for x in xs), Counter(y.whole for y in ys)
    place = {y.whole: j for j, y in enumerate(ys)}
    both = [(i, place[x.whole]) for i, x in enumerate(xs) if a[x.whole] == 1 and b[x.whole] == 1]
    ends: list[int] = []
    at: list[int] = []
    before: list[int | None] = []
    for k, (_, j) in enumerate(both):
        n = bisect_left(ends, j)
        before.append(at[n - 1] if n else None)
        ends[n:], at[n:] = [j, *ends[n + 1 :]], [k, *at[n + 1 :]]
    out, k = [], at[-1] if at else None
    while k is not None:
        out.append(both[k])
        k = before[k]
    return out[::-1]


def _in_order(xs: list[_Tree], ys: list[_Tree]) -> list[tuple[_Tree, _Tree]]:
    """Children of one label each, in order: every x takes the next free y of its label, if that is not far ahead."""
    out, j = [], 0
    for i, x in enumerate(xs):
        # As many may be skipped as the lists differ in length, so one stray label does not use up the rest.
        for k in range(j, min(len(ys), max(j, i) + 1 + min(abs(len(ys) - len(xs)), 16))):
            if ys[k].label == x.label:
                out.append((x, ys[k]))
                j = k + 1
                break
    return out


def induce(pages: list[str]) -> dict | None:
    """A wrapper from a host's pages: the content element's path of labels, keys of template texts in it, and of names whether they are kept.

    Pages of several layouts give a wrapper for each layout of two pages or more: the first, and the others in its `more`.
    """
    groups: list[list[tuple[Node, list, set[int]]]] = []
    for html in pages:
        root = parse(html)
        placed = _placed(root)
        page = (root, placed, _layout(placed))
        near = max(groups, key=lambda g: _alike(g[0][2], page[2]), default=None)
        if near is None or _alike(near[0][2], page[2]) < ALIKE:
            groups.append([page])
        elif len(near) < SAMPLE:
            near.append(page)
    made = [w for w in map(_induce, sorted(groups, key=len, reverse=True)) if w]
    if len(groups) > 1:  # one layout needs no choice
        for w in made[:1]:
            w["more"] = made[1:]
    else:
        for w in made:
            w.pop("layout")
    return made[0] if made else None


def _induce(group: list[tuple[Node, list, set[int]]]) -> dict | None:
    """The wrapper of pages of one layout."""
    if len(group) < 2:
        return None
    trees = []
    for root, _, _ in group:
        keep_articles(root)  # names leave nothing out yet
        trees.append(_tree(root))
    same: Counter = Counter()
    for ref, other in combinations(trees, 2):
        for x, y in _Matching(ref, other).equal_texts():
            same[id(x)] += 1
            same[id(y)] += 1
    others = len(trees) - 1
    have, most = Counter(), Counter()
    for (_, placed, _), ref in zip(group, trees, strict=True):
        sizes: Counter = Counter()
        for path, leaf, parent in _leaves(ref):
            if same[id(leaf)] < CONSTANT * others:
                sizes[id(parent)] += len(leaf.text)
        if sizes:
            for key, yes in _most(placed, sizes).items():
                have[key] += 1
                most[key] += yes
    kept = {key: 2 * most[key] > n for key, n in have.items()}
    best: tuple = ()
    for step in range(2):
        if step:  # inside the content element what varies stays, whatever soft names say
            kept |= _varying_names(group, trees, best, same, others)
        for root, placed, _ in group:
            _decide(root, kept, placed)
        constant: list[tuple[tuple, str, bool]] = []
        varying: Counter = Counter()
        slots: Counter = Counter()
        for ref in trees:
            for path, leaf, _ in _leaves(ref):
                if same[id(leaf)] >= max(LEAST, CONSTANT * others):
                    constant.append((path, leaf.text, same[id(leaf)] == others))
                else:
                    varying[path] += len(leaf.text)
                    if same[id(leaf)] < CONSTANT * others:
                        slots[path] += len(leaf.text)
        slots = slots or varying
        if not slots:
            return None
        within = {p: n for p, n in slots.items() if _article(p)}
        if sum(within.values()) >= HOLDS * sum(slots.values()):
            slots = within
        best = _common(list(slots))
        if _article(best):  # all of the article
            best = best[: _article(best)]
        while best[-1].split(".")[0] not in HOLDERS and len(best) > 1:  # blocks of text: what holds them
            best = best[:-1]
    held = sum(n for path, n in varying.items() if path[: len(best)] == best)
    inside = [text for path, text, _ in constant if path[: len(best)] == best]
    few = sum(map(len, inside)) <= MOST * (held + sum(map(len, inside)))
    # A text that repeats on most pages among others of its kind (a paragraph of the article) is content, unless it stands on every page
    # of a whole sample; a template text has a marked place of its own.
    own = [
        text for path, text, always in constant
        if path[: len(best)] == best and ((always and others >= SAMPLE - 1) or (path not in varying and any("." in x for x in path[len(best) :])))
    ]
    seen = Counter(k for _, _, layout in group for k in layout)
    return {
        "path": list(best), "template": sorted({_key(t) for t in own}) if few else [], "kept": sorted(k for k, yes in kept.items() if yes), "dropped": sorted(k for k, yes in kept.items() if not yes),
        "layout": sorted(k for k, n in seen.items() if 2 * n >= len(group)),
    }


def _varying_names(group: list, trees: list[_Tree], best: tuple, same: Counter, others: int) -> dict[int, bool]:
    """For each soft name inside the content element: whether most of its text, on all pages together, is a slot's."""
    slots, every = Counter(), Counter()
    for (_, placed, _), ref in zip(group, trees, strict=True):
        keys = {id(node): _name_key(node, place) for node, place in placed if node.soft and node.named}
        work: list[tuple[_Tree, tuple, frozenset[int]]] = [(ref, (ref.label,), frozenset())]
        while work:
            tree, path, names = work.pop()
            for k in tree.kids:
                if k.node is None:
                    for key in names:
                        every[key] += len(k.text)
                        slots[key] += len(k.text) * (same[id(k)] < CONSTANT * others)
                elif not k.node.hard:
                    own = (*path, k.label)
                    inner = keys.get(id(k.node)) if len(own) > len(best) and own[: len(best)] == best else None
                    work.append((k, own, names | {inner} if inner else names))
    return {key: 2 * slots[key] >= n for key, n in every.items()}


def _leaves(tree: _Tree) -> Iterator[tuple]:
    """(path of labels, leaf, its element) of a tree's texts that are not left out."""
    work = [(tree, (tree.label,))]
    while work:
        tree, path = work.pop()
        for k in tree.kids:
            if k.node is None:
                yield path, k, tree.node
            elif not k.node.out:
                work.append((k, (*path, k.label)))


def _article(path: tuple) -> int:
    """The length of the path to the innermost article or main element; 0 if there is none."""
    return max((i for i, label in enumerate(path, 1) if label.split(".")[0] in ("article", "main")), default=0)


def _common(paths: list[tuple]) -> tuple:
    low, high = min(paths), max(paths)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return low[:n]


def _fitting(wrapper: dict, placed: list[tuple[Node, int]]) -> dict | None:
    """The wrapper whose layout a page is most like; None if it is like none."""
    if "more" not in wrapper:
        return wrapper
    own = _layout(placed)
    score, at = max((_alike(own, set(w["layout"])), -i) for i, w in enumerate([wrapper, *wrapper["more"]]))
    return [wrapper, *wrapper["more"]][-at] if score >= ALIKE else None


def _at(root: Node, path: list[str]) -> list[Node]:
    """The elements at a path of labels from the root, in page order; the path's first label is the root's."""
    level = [root]
    for label in path[1:]:
        level = [k for node in level for k in node.kids if isinstance(k, Node) and k.label == label and not k.out]
    return level


def extract(html: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page: its blocks joined by empty lines; empty for null."""
    if not html:
        return ""
    root = parse(html)
    placed = _placed(root)
    wrapper = _fitting(wrapper, placed) if wrapper else None
    _decide(root, dict.fromkeys(wrapper["kept"], True) | dict.fromkeys(wrapper["dropped"], False) if wrapper else {}, placed)
    found = _at(root, wrapper["path"]) if wrapper else []
    skip = frozenset(wrapper["template"]) if wrapper and found else frozenset()
    if not found or found == [root]:
        work, found = [root], []
        while work:  # the outermost articles or main elements
            node = work.pop()
            if node.tag in ("article", "main") and not node.out:
                found.append(node)
            else:
                work += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.out]
    return "\n\n".join(t for node in found or [root] for t in blocks(node, skip))


def _wrappers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    made = induce(sorted(set(pdf["html"])))
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(made) if made else None]})


def _kind(html: Column) -> Column:
    """A number that pages of one layout mostly share: the smallest hash of their tags and classes, in KINDS groups."""
    names = F.concat(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), F.regexp_extract_all(html, F.lit(r"\bclass\s*=\s*[\"']?([^\"'>]*)"), 1))
    hashes = F.transform(F.array_distinct(names), lambda x: F.xxhash64(F.lower(F.regexp_replace(x, r"\d+", ""))))
    return F.pmod(F.coalesce(F.array_min(hashes), F.lit(0)), F.lit(KINDS)).cast("int")


def wrappers(pages: DataFrame, host: Column, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper as JSON or null) from a bounded sample: for each host and kind one page for each of `sample` hash groups of page texts."""
    html = F.col("html").cast("string")
    rows = pages.where(html.isNotNull()).select(host.alias("host"), html.alias("html"), F.xxhash64(html).alias("h"), _kind(html).alias("kind"))
    few = rows.groupBy("host", "kind", F.pmod("h", F.lit(sample)).alias("g")).agg(F.min_by("html", "h").alias("html"))
    return few.select("host", "html").groupBy("host").applyInPandas(_wrappers, "host string, wrapper string")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    A null or empty html has an empty text; pages with a null url share the empty host. Rows that repeat are
    cut each. An empty table gives an empty result; other columns are ignored. Pages are read whole.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    small_batches(pages.sparkSession)
    host = host_and_path(F.col("url"))[0]
    made = materialize(wrappers(pages, host, sample), "html-wrappers").where("wrapper IS NOT NULL")
    hosts, chars = made.agg(F.count(F.lit(1)), F.sum(F.length("wrapper"))).first()
    light = hosts <= BROADCAST_HOSTS and (chars or 0) <= BROADCAST_CHARS
    rows = pages.withColumn("host", host).join(F.broadcast(made) if light else made, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for pdf in batches:
            texts = []
            for html, own in zip(pdf["html"], pdf["wrapper"], strict=True):
                if own and own not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[own] = json.loads(own)
                texts.append(extract(html, known[own] if own else None))
            if len(pdf):
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")

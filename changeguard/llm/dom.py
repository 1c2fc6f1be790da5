"""A forgiving reader of HTML into block trees, and the alignment of two trees by simple tree matching."""

from __future__ import annotations

import html
import re
from functools import lru_cache
from math import isqrt

import numpy as np
import xxhash

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas audio video textarea title select head".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body button caption html legend summary tbody td tfoot th thead tr".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NEVER_CONTENT = frozenset("nav footer aside form dialog menu button search".split())
# Words within class, id and role that mark what is around an article.
MARKS = frozenset("""nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar complementary ad ads advert adverts
    advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup
    share sharing social related recommended recommendations comment comments disqus reply replies respond widget pagination pager toolbar login
    search skip copyright disclaimer paywall dialog alert form""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: Elements nested deeper than this end their blocks as others do, but have no node of their own.
DEPTH = 200


class Node:
    __slots__ = ("around", "children", "label", "links", "parent", "tag", "text")

    def __init__(self, tag: str, label: str, around: bool, parent: Node | None):
        self.tag, self.label, self.around, self.parent = tag, label, around, parent
        self.children: list[Node] = []
        self.text, self.links = "", 0  # of a text leaf: its text, and how many of its characters are links


@lru_cache(maxsize=4096)
def _described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label of an element, whether it is around the article, the same but for an article's own header)."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    marks = words & MARKS
    own = tag in NEVER_CONTENT or hidden or bool(marks - {"header"})
    label = tag + "".join("." + w for w in sorted(set(re.sub(r"\d+", "0", found.get("class", "")).lower().split())))
    return label, own or tag == "header" or "header" in marks, own


def parse(page: str) -> Node:
    """The tree of a page's block elements; the text between their borders are leaves labelled ``#``.

    Inline elements only lend their text, a line break is white space. Unclosed and wrongly nested elements are
    repaired as far as they decide where a block ends.
    """
    root = Node("", "", False, None)
    here, inline, at, lower = root, [], 0, None
    stack: list[tuple[str, Node | None]] = []  # open elements; inline ones have no node
    links = linked = 0

    def flush():
        nonlocal inline, linked
        if inline:
            text = " ".join(html.unescape("".join(inline)).split())
            if text:
                leaf = Node("#", "#", False, here)
                leaf.text, leaf.links = text, linked
                here.children.append(leaf)
        inline, linked = [], 0

    def close(upto: int):
        nonlocal here, links
        while len(stack) > upto:
            name, node = stack.pop()
            if node is not None:
                flush()
                here = node.parent
            elif name in BLOCK:
                flush()
            elif name == "a":
                links = max(0, links - 1)

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            inline.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        if m.group(1) or m.group(4):  # end tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name not in BLOCK and stack[i][1] is not None:
                    break  # an inline end tag does not close blocks
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name in RAW and not attributes.endswith("/"):
            if lower is None:
                lower = page.lower()
            end = lower.find("</" + name, at)
            if end < 0:
                at = len(page) if name != "head" else at
            else:
                stop = page.find(">", end)
                at = len(page) if stop < 0 else stop + 1
            if name in ("head", "title", "select", "textarea", "template"):
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            inline.append(" ")
            continue
        if name not in BLOCK:
            if not attributes.endswith("/"):
                stack.append((name, None))
                links += name == "a"
            continue
        if name in CLOSES_P or name in SELF_CLOSING:
            ends, walls = SELF_CLOSING.get(name, (set(), set()))
            for i in range(len(stack) - 1, -1, -1):
                tag = stack[i][0]
                if tag in walls:
                    break
                if tag in ends or (tag == "p" and name in CLOSES_P):
                    close(i)
                    if tag != "p" and not (name == "tr" and tag != "tr"):
                        break
                elif stack[i][1] is not None and tag != "p" and not ends:
                    break
        flush()
        if len(stack) >= DEPTH:
            stack.append((name, None))
            continue
        label, around, own = _described(name, attributes)
        if around and not own:  # a header: that of an article is its own
            up = here
            while up is not None and up.tag not in ("article", "main"):
                up = up.parent
            around = up is None
        node = Node(name, label, around, here)
        here.children.append(node)
        stack.append((name, node))
        here = node
    if at < len(page):
        inline.append(page[at:])
        if links:
            linked += len(page) - at
    flush()
    return root


def leaves(node: Node):
    if node.tag == "#":
        yield node
    for child in node.children:
        yield from leaves(child)


Outline = tuple  # (label, length and digest of the text, children)


def outline(node: Node, order: list | None = None) -> Outline:
    """The tree as nested tuples, where neighbours of one label that hold only text are one repeated node.

    ``order`` receives the nodes behind each part of the outline, in the order of their numbers (preorder).
    """
    if order is None:
        order = []
    order.append([node])
    return (node.label, "", _outlined(node.children, order))


def _outlined(children: list[Node], order: list) -> tuple:
    out, i = [], 0
    while i < len(children):
        child, j = children[i], i + 1
        if child.tag == "#" or all(x.tag == "#" for x in child.children):
            while j < len(children) and children[j].label == child.label and all(x.tag == "#" for x in children[j].children):
                j += 1
            group = children[i:j]
            order.append(group)
            texts = "\n".join(leaf.text for n in group for leaf in leaves(n))
            out.append((child.label, f"{len(texts)}.{xxhash.xxh3_64_hexdigest(texts)}" if texts else "", ()))
        else:
            order.append([child])
            out.append((child.label, "", _outlined(child.children, order)))
        i = j
    return tuple(out)


def _further(row: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The next row of the table of best matches of two lists, from the gain of each of its pairs."""
    out = np.zeros_like(row)
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain), out=out[1:])
    return out


def _matched(rows: int, columns: int, gain) -> list[tuple[int, int]]:
    """Pairs of the best match of two lists; ``gain(i)`` holds what i gains with each of the other list.

    Only every so many rows of the table are kept and those between are made again on the way back, so memory grows
    with the root of its length, and lists of any length are matched alike.
    """
    step = isqrt(rows) + 1
    row = np.zeros(columns + 1, np.int64)
    kept = [row]
    for i in range(rows):
        row = _further(row, gain(i))
        if (i + 1) % step == 0:
            kept.append(row)
    out, j = [], columns
    for start in range((rows - 1) // step * step, -1, -step):
        gains = [gain(i) for i in range(start, min(rows, start + step))]
        table = [kept[start // step]]
        for g in gains:
            table.append(_further(table[-1], g))
        i = len(gains)
        while i and j:
            g = gains[i - 1][j - 1]
            if g and table[i][j] == table[i - 1][j - 1] + g:
                out.append((start + i - 1, j - 1))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out[::-1]


def align(a: Outline, b: Outline) -> list[tuple[int, int]]:
    """Pairs of preorder numbers that simple tree matching maps to each other; none if the roots differ.

    Of the matches with the most nodes, one with the most nodes in subtrees of the same text is taken.
    """
    shapes: dict[tuple, int] = {}
    trees: dict[tuple, int] = {}
    kinds: list[tuple[str, tuple, int]] = []  # of each shape: label, shapes of the children, nodes
    known: dict[tuple[int, int], int] = {}

    def numbered(tree: Outline) -> list[tuple[int, int, list[int]]]:
        """By preorder number: shape, tree with its texts, numbers of the children."""
        out: list = []

        def add(t: Outline) -> int:
            n = len(out)
            out.append(None)
            children = [add(c) for c in t[2]]
            key = (t[0], tuple(out[c][0] for c in children))
            shape = shapes.setdefault(key, len(shapes))
            if shape == len(kinds):
                kinds.append((*key, 1 + sum(kinds[s][2] for s in key[1])))
            out[n] = (shape, trees.setdefault((t[0], t[1], tuple(out[c][1] for c in children)), len(trees)), children)
            return n

        add(tree)
        return out

    def gains(shape: int, others: tuple | list) -> np.ndarray:
        of = {t: score(shape, t) for t in set(others)}
        return np.fromiter((of[t] for t in others), np.int64, len(others))

    def score(s: int, t: int) -> int:
        """Most nodes of two shapes that match."""
        (label, x, size), (other, y, _) = kinds[s], kinds[t]
        if label != other:
            return 0
        if s == t:
            return size
        if not x or not y:
            return 1
        if (s, t) not in known:
            of = {p: gains(p, y) for p in set(x)}
            row = np.zeros(len(y) + 1, np.int64)
            for p in x:
                row = _further(row, of[p])
            known[s, t] = 1 + int(row[-1])
        return known[s, t]

    left, right = numbered(a), numbered(b)
    most = len(left) + 1
    out: list[tuple[int, int]] = []

    def walk(n: int, m: int) -> None:
        if left[n][1] == right[m][1]:
            out.extend((n + k, m + k) for k in range(kinds[left[n][0]][2]))
            return
        out.append((n, m))
        x, y = left[n][2], right[m][2]
        start, end, shorter = 0, 0, min(len(x), len(y))
        while start < shorter and left[x[start]][1] == right[y[start]][1]:
            start += 1
        while end < shorter - start and left[x[-1 - end]][1] == right[y[-1 - end]][1]:
            end += 1
        inner, other = x[start : len(x) - end], y[start : len(y) - end]
        pairs = [(0, 0)] if len(inner) == len(other) == 1 and kinds[left[inner[0]][0]][0] == kinds[right[other[0]][0]][0] else []
        if inner and other and not pairs:
            same, forms = np.array([right[c][1] for c in other]), [right[c][0] for c in other]
            of = {s: gains(s, forms) * most for s in {left[c][0] for c in inner}}
            pairs = _matched(len(inner), len(other), lambda i: of[left[inner[i]][0]] + (same == left[inner[i]][1]) * kinds[left[inner[i]][0]][2])
        for c, d in [*zip(x[:start], y[:start]), *((inner[i], other[j]) for i, j in pairs), *zip(x[len(x) - end :], y[len(y) - end :])]:
            walk(c, d)

    if a[0] == b[0]:
        walk(0, 0)
    return out

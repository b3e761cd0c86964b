"""Main text of web pages by wrappers inferred per host (operator 8).

A wrapper is a union-free regular expression over a host's token streams. Tags with their classes are tokens, text is a
slot. Streams of all of a host's pages are aligned: tokens that follow each other alike become a repeated group, tokens that
one stream lacks an optional group, texts fall together in slots. Streams are balanced first (implied end tags), so groups
nest and are aligned level by level.

The wrapper's slots decide what is text. A slot with one text on several pages is the template's; of the others, the
text outside of links is what a part of the page is worth. From the whole page on, the main part is the group that is
worth more than all beside it, as long as there is one (elements that say what they are, such as article or comments,
weigh in). Each page is then laid on its host's wrapper, and each of its texts is kept or left out as its slot is. A page
that is laid on the wrapper otherwise than it went into it (as it doesn't conform) gets one of its own, too, which counts if
the host's slots hold less than half as much text.

Plan: a page's own repeats give its form, the wrapper of that page alone; pages of one form differ in their texts only. A
task passes on one row for each host and form, with counts of its slots (pages, the text if it is one on all of them,
characters), so that a host with a third of all pages sends a few rows a task. Forms of a host are aligned in
buckets of some FORMS, in rounds until one is left. Wrappers are joined back to all pages: broadcast if they are small, else
by a shuffle join, whose skew Spark splits. Extraction maps over whole pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

FORMS = 64  # of a host that one task aligns
HELD_BYTES = 8 << 20  # of forms that a task holds before it passes them on
BROADCAST_BYTES = 16 << 20
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>|<[^<>]*>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
# fixed values: HTML's element kinds
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "object", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "semantics", "annotation",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
    "nav", "ol", "p", "pre", "section", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "aside", "nav", "footer", "header", "form"}
HEADINGS = {"h1", "h2", "h3"}
# fixed values: elements and roles that are not main text, words in class or id of what isn't, and of what isn't unless it varies as text does
OUT_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
OUT_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "promo", "sponsor", "sponsored", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "cookie",
    "cookies", "consent", "popup", "modal", "newsletter", "subscribe", "comment", "comments", "footer", "masthead", "topbar", "toolbar", "pagination", "pager", "login", "signup",
}
DOUBTFUL_WORDS = {"banner", "notice", "notices", "share", "sharing", "social", "related", "recommended", "discussion", "replies", "widget"}
OUT_ARTICLES = {"comment", "comments", "ad", "advert", "advertisement", "promo", "sponsored", "teaser"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
MAIN_WEIGHT, WORD_WEIGHT, DOUBTFUL_WEIGHT = 8, 2, 0.05
LEVELS, ALIKE = 4, 0.5  # neighbours of one key are alike if they share half of their keys in so many levels


def key_of(tag: str, attributes: str) -> str:
    """A token: the tag, its role, and the words of its class and id."""
    if not attributes.strip():
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    marks = re.sub(r"\b(?:has|with|no|without)[-_][\w-]+", " ", f"{found.get('class', '')} {found.get('id', '')}".lower())  # says what stands beside
    words = sorted({re.sub(r"\d+", "0", w) for w in re.split(r"[^a-zA-Z0-9]+", marks) if w})
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    return tag + "".join(f".{w}" for w in words) + (f"@{role}" if role else "") + ("!" if hidden else "")


def _split(key: str):
    """(tag, words, role, hidden) of a token."""
    names, _, role = key.rstrip("!").partition("@")
    tag, *words = names.split(".")
    return tag, words, role, key.endswith("!")


def is_out(key: str) -> bool:
    tag, words, role, hidden = _split(key)
    bad = set() if tag in ("html", "body", "main") else OUT_ARTICLES if tag == "article" else OUT_WORDS
    return tag in OUT_TAGS or role in OUT_ROLES or hidden or not bad.isdisjoint(words)


def is_doubtful(key: str) -> bool:
    tag, words, _, _ = _split(key)
    return tag not in ("html", "body", "main", "article") and not DOUBTFUL_WORDS.isdisjoint(words)


def weight_of(key: str) -> float:
    """By how much a group's elements speak for it."""
    tag, words, role, _ = _split(key)
    if tag in ("article", "main") or role == "main":
        return MAIN_WEIGHT
    return WORD_WEIGHT if tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words) else 1


def parse(page: str):
    """Balanced stream of a page: (text, in_link, block) for each text, and the tree of tokens, [key, children] or the number
    of a text. ``block`` is a number that changes wherever a block starts or ends."""
    stack: list[list] = [["", []]]  # key, children
    links, block, texts, skip = 0, 0, [], None
    at, n = 0, len(page)
    names: list[str] = [""]

    def close(k: int):
        nonlocal block
        del stack[k:], names[k:]
        block += 1

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                text = m[0]
                if text.strip():
                    stack[-1][1].append(len(texts))
                    texts.append((text, links > 0, block))
                elif texts and texts[-1][2] == block:
                    texts[-1] = (texts[-1][0] + " ", *texts[-1][1:])
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE:
                continue
            elif tag in names:
                close(len(names) - 1 - names[::-1].index(tag))
            elif tag == "p":
                block += 1
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "a":
            links += 1
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                block += 1
            continue
        if tag in CLOSES_P and "p" in names:
            close(len(names) - 1 - names[::-1].index("p"))
        if tag in SIBLINGS:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in SIBLINGS[tag]:
                    close(k)
                    break
                if names[k] in BARRIER:
                    break
        block += 1
        node = [key_of(tag, m[3]), []]
        stack[-1][1].append(node)
        stack.append(node)
        names.append(tag)
    return texts, stack[0][1]


# ---- wrappers --------------------------------------------------------------------------------------------------
# A wrapper node is [key, repeated, optional, children]; "#" stands for a slot, whose children are what it holds. In the form of
# a page these are the numbers of its texts; in wrappers, by part of the host's pages, {part: [hash of the text or None if
# it varies, characters outside of links, characters in links, pages]}. Pages of one form all have its slots. Pages can nest to any depth, so functions over levels
# are generators that yield the calls of the next level, for ``unnested``.


def unnested(call):
    """The result of a generator that yields calls of its like and is sent their results."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as done:
            calls.pop()
            value = done.value
    return value


def _together(a, b):
    """What two slots hold. A part's text is one on all its pages if either slot's is, and the same pages have both."""
    if isinstance(a, list):
        return a + b
    out = dict(a)
    for part, (text, plain, linked, pages) in b.items():
        x = out.get(part)
        same = x and x[0] is not None and text is not None and x[3] == pages
        out[part] = [_hash(f"{x[0]} {text}") if same else None, x[1] + plain, x[2] + linked, max(x[3], pages)] if x else [text, plain, linked, pages]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def generalise(children: list):
    """A stream's own repeats: neighbours of one key and of like content are aligned with each other and become a repeated
    group."""
    out: list = []
    for c in children:
        node = ["#", False, False, [c]] if isinstance(c, int) else [c[0], False, False, (yield generalise(c[1]))]
        if out and alike(out[-1], node):
            out[-1] = yield joined(out[-1], node, True)
        else:
            out.append(node)
    return out


def shape(children: list, inside) -> set[str]:
    """Keys in LEVELS levels; inside(child) gives (key, its children)."""
    found: set[str] = set()
    for _ in range(LEVELS):
        pairs = [inside(c) for c in children]
        found.update(k for k, _ in pairs)
        children = [c for _, own in pairs for c in own]
    return found


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 1.0


def _inside(node: list):
    return node[0], [] if node[0] == "#" else node[3]


def alike(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] == "#" or likeness(shape(a[3], _inside), shape(b[3], _inside)) >= ALIKE)


def matched(a: list[set], b: list[set]) -> list[tuple[int, int]]:
    """Places (i, j), in order, of neighbours of one key in two streams that are most alike in sum. The likeness of a row is
    made from postings of keys when it is needed, and only every k-th row of sums is kept, so that memory is that of some
    sqrt(len(a)) rows for streams of any length."""
    n, m = len(a), len(b)
    if n == m == 1:
        return [(0, 0)]
    kinds: dict[frozenset, int] = {}
    of = np.array([kinds.setdefault(frozenset(y), len(kinds)) for y in b], int)
    sizes = np.array([len(y) for y in kinds], float)
    found: dict[str, list[int]] = {}
    for y, k in kinds.items():
        for key in y:
            found.setdefault(key, []).append(k)
    postings = {key: np.array(ks) for key, ks in found.items()}

    def likenesses(x: set) -> np.ndarray:
        both = np.zeros(len(sizes))
        for key in x:
            if key in postings:
                both[postings[key]] += 1
        own = np.where((sizes > 0) & bool(x), both / np.maximum(len(x) + sizes - both, 1), 1.0)
        return np.where(own >= ALIKE, own, 0.0)[of]

    def above(below: np.ndarray, x: set) -> np.ndarray:
        best = np.maximum(below[:-1], below[1:] + likenesses(x))
        return np.append(np.maximum.accumulate(best[::-1])[::-1], 0.0)

    step = max(1, int(n**0.5))
    sums = np.zeros(m + 1)
    kept = {n: sums}
    for i in range(n - 1, -1, -1):
        sums = above(sums, a[i])
        if i % step == 0:
            kept[i] = sums
    out, i, j = [], 0, 0
    for start in range(0, n, step):
        end = min(n, start + step)
        rows = [kept[end]]
        for k in range(end - 1, start - 1, -1):
            rows.append(above(rows[-1], a[k]))
        while i < end and j < m:
            here, below, own = rows[end - i], rows[end - i - 1], likenesses(a[i])
            while j < m and here[j] != below[j] and not (own[j] and here[j] == below[j + 1] + own[j]):
                j += 1
            if j < m and own[j] and here[j] == below[j + 1] + own[j]:
                out.append((i, j))
                j += 1
            i += 1
    return out


def joined(a: list, b: list, beside: bool):
    """Two nodes of one key as one; those that stand beside each other are repeated."""
    if a[0] == "#":
        return ["#", False, a[2] and b[2] if beside else a[2] or b[2], _together(a[3], b[3])]
    return [a[0], beside or a[1] or b[1], a[2] and b[2] if beside else a[2] or b[2], (yield align(a[3], b[3]))]


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, by one row of bits per item of ``a``. Only every k-th row is kept, the
    rows between are made again on the way back, so that memory is that of some sqrt(len(a)) rows."""
    n, m = len(a), len(b)
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << m) - 1
    step = max(1, int(n**0.5))

    def rows(v: int, start: int, end: int):
        for i in range(start, end):
            hit = at.get(a[i], 0)
            v = ((v + (v & hit)) | (v & ~hit)) & full
            yield v

    kept, v = [full], full
    for start in range(0, n, step):
        for v in rows(v, start, min(n, start + step)):
            pass
        kept.append(v)
    out, j = [], m
    for part in range(len(kept) - 2, -1, -1):
        start = part * step
        own = list(rows(kept[part], start, min(n, start + step)))
        i = len(own)
        while i and j:
            if a[start + i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((start + i, j))
            elif own[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return out[::-1]


def _runs(items: list, key) -> list[tuple[str, list]]:
    """Neighbours of one key together."""
    out: list[tuple[str, list]] = []
    for c in items:
        if out and out[-1][0] == key(c):
            out[-1][1].append(c)
        else:
            out.append((key(c), [c]))
    return out


def _met(left: list, right: list) -> list[tuple[int, int]]:
    return list(zip(range(len(left)), range(len(left)))) if left == right else common(left, right)


def align(a: list, b: list):
    """Two lists of nodes as one: the longest common sequence of keys is kept, what one side lacks becomes optional."""
    left, right = (_runs(x, lambda node: node[0]) for x in (a, b))
    merged: list = []

    def add(node):
        if merged and alike(merged[-1], node):  # an optional group beside its like: repeated
            merged[-1] = yield joined(merged[-1], node, True)
        else:
            merged.append(node)

    def both(x: list, y: list, pairs: list, join):
        i = j = 0
        for p, q in [*pairs, (len(x), len(y))]:
            for one in (*x[i:p], *y[j:q]):
                yield from join(one, None)
            if p < len(x):
                yield from join(x[p], y[q])
            i, j = p + 1, q + 1

    def nodes(x, y):
        yield from add([*x[:2], True, x[3]] if y is None else (yield joined(x, y, False)))

    def runs(x, y):
        if y is None:
            for node in x[1]:
                yield from nodes(node, None)
        else:
            shapes = [[shape(node[3], _inside) if x[0] != "#" else set() for node in side] for side in (x[1], y[1])]
            yield from both(x[1], y[1], matched(*shapes), nodes)

    yield from both(left, right, _met([k for k, _ in left], [k for k, _ in right]), runs)
    return merged


def expression(nodes: list) -> str:
    """The wrapper as it reads: <li>#</li> repeated is (<li>#</li>)+, optional (...)?, both (...)*."""
    out, todo = [], nodes[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        key, repeated, optional, children = node
        sign = "*" if repeated and optional else "+" if repeated else "?" if optional else ""
        end = f"){sign}" if sign else ""
        out.append("(" if sign else "")
        if key == "#":
            out.append(f"#{end}")
        else:
            out.append(f"<{key}>")
            todo += [f"</{key.split('.')[0].split('@')[0].rstrip('!')}>{end}", *reversed(children)]
    return "".join(out)


OUTSIDE, MAIN, LEFT_OUT = 0, 1, 2


def flat(nodes: list) -> list:
    """The nodes of all levels in page order: [key, repeated, optional, how many of the next are inside, what a slot holds]."""
    out: list = []
    todo = nodes[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out[node][3] = len(out) - node - 1
        elif node[0] == "#":
            out.append([*node[:3], 0, node[3]])
        else:
            todo += [len(out), *reversed(node[3])]
            out.append([*node[:3], 0, None])
    return out


def _kids(nodes: list, at: int):
    """Places of a node's own children; -1 stands for the page."""
    k, end = at + 1, len(nodes) if at < 0 else at + 1 + nodes[at][3]
    while k < end:
        yield k
        k += 1 + nodes[k][3]


def _pages(held: dict) -> int:
    return sum(x[3] for x in held.values())


def _fixed(held: dict) -> bool:
    """Whether a slot has one text on several pages."""
    return _pages(held) > 1 and not _varies(held)


def _varies(held: dict) -> bool:
    texts = {x[0] for x in held.values()}
    return None in texts or len(texts) > 1


def _worth(nodes: list) -> list[float]:
    """Of each node: characters outside of links in slots that aren't of the template."""
    worth = [0.0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        key, held = nodes[k][0], nodes[k][4]
        if key == "#":
            worth[k] = 0 if _fixed(held) else sum(x[1] for x in held.values())
        elif not is_out(key):
            worth[k] = sum(worth[c] for c in _kids(nodes, k)) * (DOUBTFUL_WEIGHT if is_doubtful(key) else 1)
    return worth


def main_part(nodes: list) -> int:
    """The place of the main part, -1 for the whole page: down from it, the group that is worth more than all beside it. The
    way ends in an article, in a group of nothing but text, and where a heading that varies stands beside the group."""
    worth, at = _worth(nodes), -1
    while at < 0 or weight_of(nodes[at][0]) < MAIN_WEIGHT:
        kids = list(_kids(nodes, at))
        groups = [k for k in kids if nodes[k][0] != "#" and worth[k] > 0]
        if not groups:
            break
        best = max(groups, key=lambda k: (worth[k] * weight_of(nodes[k][0]), -k))
        weight = weight_of(nodes[best][0])
        if worth[best] * weight <= sum(worth[k] for k in kids) - worth[best]:
            break
        if weight < MAIN_WEIGHT:
            headed = any(k != best and _split(nodes[k][0])[0] in HEADINGS for k in groups)
            if headed or all(nodes[k][0] == "#" for k in _kids(nodes, best)):
                break
        at = best
    return at


def _flags(nodes: list) -> tuple[list[int], int]:
    """OUTSIDE, MAIN or LEFT_OUT of each node, and of what stands beside the outermost ones."""
    root = main_part(nodes)
    low, high = (0, len(nodes)) if root < 0 else (root, root + 1 + nodes[root][3])
    flags = [MAIN if low <= k < high else OUTSIDE for k in range(len(nodes))]
    whole = root < 0 or _split(nodes[root][0])[0] in ("html", "body")
    k = low
    while k < high:
        key, _, _, inside, held = nodes[k]
        if key == "#":
            if whole and _fixed(held) and _pages(held) > 2:  # nothing but the template's text tells its parts from the others
                flags[k] = LEFT_OUT
            k += 1
            continue
        out = k != root and (is_out(key) or whole and _split(key)[0] == "header")
        if not out and k != root and is_doubtful(key):
            slots = [x[4] for x in nodes[k : k + 1 + inside] if x[0] == "#"]
            plain, linked = (sum(x[n] for held in slots for x in held.values()) for n in (1, 2))
            out = linked > plain or not any(map(_varies, slots))
        if out:
            flags[k : k + 1 + inside] = [LEFT_OUT] * (1 + inside)
            k += 1 + inside
        else:
            k += 1
    return flags, MAIN if root < 0 else OUTSIDE


def nested(rows: list) -> list:
    """The nodes that ``flat`` made these rows of."""
    out: list = []
    inside = [(out, len(rows))]
    for k, (key, repeated, optional, n, held) in enumerate(rows):
        while inside[-1][1] <= k:
            inside.pop()
        node = [key, repeated, optional, held if key == "#" else []]
        inside[-1][0].append(node)
        if key != "#":
            inside.append((node[3], k + 1 + n))
    return out


class Forms:
    """Forms of pages, and what their slots hold on some page. Trees that are alike to the last token have one form, which is
    made once as long as it is held."""

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.bytes = 0

    def of(self, tree: list) -> tuple[str, list[list[int]]]:
        """(the form as JSON, the texts in each of its slots)."""
        marks, todo = [], tree[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, int):
                marks.append("#")
            elif c is None:
                marks.append("/")
            else:
                marks.append(c[0])
                todo += [None, *reversed(c[1])]
        key = " ".join(marks)
        if key not in self.known:
            rows = flat(unnested(generalise(tree)))
            found = json.dumps([r[:4] for r in rows]), [sorted(r[4]) for r in rows if r[0] == "#"]
            if self.bytes > HELD_BYTES:
                self.known, self.bytes = {}, 0
            self.known[key] = found
            self.bytes += 2 * len(key) + len(found[0])
        return self.known[key]

    def page(self, texts: list, tree: list) -> tuple[str, int, list]:
        """A part of one page: (form, pages, [text, characters outside of links, characters in links, pages] of each slot)."""
        form, slots = self.of(tree)
        plain = [" ".join(t.split()) for t, _, _ in texts]
        out = []
        for slot in slots:
            sums = [0, 0]
            for k in slot:
                sums[texts[k][1]] += len(plain[k])
            out.append([_hash("\n".join([plain[k] for k in slot])), *sums, 1])
        return form, 1, out


def _added(parts: dict, key, form: str, pages: int, slots: list) -> None:
    """Adds pages to those of the same form, slot by slot."""
    if key not in parts:
        parts[key] = [form, pages, [list(x) for x in slots]]
        return
    old = parts[key]
    old[1] += pages
    for x, y in zip(old[2], slots):
        x[0] = x[0] if x[0] == y[0] else None
        x[1], x[2], x[3] = x[1] + y[1], x[2] + y[2], x[3] + y[3]


def _aligned(parts: list) -> list:
    """Parts (form, pages, slots) as one list of nodes, those of most pages first, whatever order they come in."""
    found: dict = {}
    for form, pages, slots in parts:
        _added(found, form, form, pages, slots)
    nodes: list = []
    for k, (form, _, slots) in enumerate(sorted(found.values(), key=lambda x: (-x[1], x[0]))):
        held = iter(slots)
        own = nested([[*r, {k: next(held)} if r[0] == "#" else None] for r in json.loads(form)])
        nodes = own if k == 0 else unnested(align(nodes, own))
    return nodes


def merged(parts: list) -> tuple[str, int, list]:
    """Parts as one."""
    rows = flat(_aligned(parts))
    slots = []
    for r in rows:
        if r[0] == "#":
            held = list(r[4].values())
            slots.append([None if _varies(r[4]) else held[0][0], sum(x[1] for x in held), sum(x[2] for x in held), _pages(r[4])])
    return json.dumps([r[:4] for r in rows]), sum(pages for _, pages, _ in parts), slots


def _inferred(parts: list) -> tuple[list, dict]:
    nodes = _aligned(parts)
    rows = flat(nodes)
    flags, page = _flags(rows)
    return nodes, {"nodes": [[*r[:4], f] for r, f in zip(rows, flags)], "page": page}


def _wrapper(parts: list) -> str:
    nodes, wrapper = _inferred(parts)
    return json.dumps(wrapper | {"expression": expression(nodes)})


def infer(pages: list[str]) -> str:
    """A host's wrapper as JSON."""
    forms = Forms()
    return _wrapper([forms.page(*parse(p)) for p in pages])


def _assigned(members: list, groups: list[int], nodes: list) -> list[int]:
    """For neighbours of one key on a page the wrapper's groups of that key, in order: the one that is most alike, a group that
    isn't repeated only once if another follows."""
    if len(groups) == 1:
        return groups * len(members)
    inside = lambda c: ("#", []) if isinstance(c, int) else c
    of_group = [shape(list(_kids(nodes, g)), lambda k: (nodes[k][0], list(_kids(nodes, k)))) for g in groups]
    out, at, taken = [], 0, False
    for c in members:
        own = shape(c[1], inside)
        first = at + 1 if taken and not nodes[groups[at]][1] and at + 1 < len(groups) else at
        best = max(range(first, len(groups)), key=lambda g: (likeness(own, of_group[g]), -g))
        out.append(groups[best])
        at, taken = best, True
    return out


def laid_on(wrapper: dict, tree: list, texts: list) -> tuple[list[int], bool, int]:
    """The flags of a page's texts as its host's wrapper has them, whether the page is one that the wrapper describes, and how
    many characters its main slots hold. Elements without their like in the wrapper have the flag of the group around them,
    unless they say that they are out."""
    nodes, flags, fits, held = wrapper["nodes"], [OUTSIDE] * len(texts), True, 0
    todo: list = [(tree, -1, wrapper["page"])]  # children, the wrapper's node, or None with a flag of its own
    while todo:
        children, at, flag = todo.pop()
        if at is None:
            for c in children:
                if isinstance(c, int):
                    flags[c] = flag
                else:
                    todo.append((c[1], None, LEFT_OUT if flag == MAIN and (is_out(c[0]) or is_doubtful(c[0])) else flag))
            continue
        runs = _runs(children, lambda c: "#" if isinstance(c, int) else c[0])
        groups = _runs(list(_kids(nodes, at)), lambda g: nodes[g][0])
        met = dict(_met([k for k, _ in runs], [k for k, _ in groups]))
        used = set()
        for i, (key, members) in enumerate(runs):
            if i not in met:
                fits = False
                todo.append((members, None, flag))
                continue
            own = _assigned(members, groups[met[i]][1], nodes) if key != "#" else groups[met[i]][1][:1] * len(members)
            for c, k in zip(members, own):
                if key == "#":
                    flags[c] = nodes[k][4]
                    held += len(texts[c][0]) if flags[c] == MAIN else 0
                else:
                    fits = fits and (nodes[k][1] or k not in used)
                    todo.append((c[1], k, nodes[k][4]))
                used.add(k)
        fits = fits and all(g in used or nodes[g][2] or nodes[g][0] == "#" for _, own in groups for g in own)
    return flags, fits, held


def main_text(page: str, wrapper: dict | None) -> tuple[str, bool]:
    """(main text, whether the page conforms to the wrapper); without a wrapper the page gets one of its own."""
    texts, tree = parse(page)
    flags, fits, _ = laid_on(wrapper or _inferred([Forms().page(texts, tree)])[1], tree, texts)
    return _blocks(texts, flags), fits


def _blocks(texts: list, flags: list[int]) -> str:
    kept: list[list] = []
    for (text, _, block), flag in zip(texts, flags):
        if flag == MAIN:
            if kept and kept[-1][0] == block:
                kept[-1][1].append(text)
            else:
                kept.append([block, [text]])
    blocks = (" ".join(html.unescape("".join(t)).split()) for _, t in kept)
    return "\n".join(b for b in blocks if b)


def page_text(page: str, wrapper: dict) -> tuple[str, bool]:
    """main_text by the host's wrapper, or by one of the page's own, if the page isn't one that the host's describes, or
    nothing of it is in the host's main slots, and its own hold more than twice as much text."""
    texts, tree = parse(page)
    flags, fits, held = laid_on(wrapper, tree, texts)
    if not (fits and held):
        own, _, own_held = laid_on(_inferred([Forms().page(texts, tree)])[1], tree, texts)
        if own_held > 2 * held:
            flags = own
    return _blocks(texts, flags), fits


PART = "host string, form string, pages long, slots array<struct<same:long,plain:long,linked:long,pages:long>>"
SLOTS = pa.list_(pa.struct([(n, pa.int64()) for n in ("same", "plain", "linked", "pages")]))


def _rows(parts: list) -> list[pa.Array]:
    """Columns form, pages and slots."""
    names = [f.name for f in SLOTS.value_type]
    slots = pa.array([[dict(zip(names, x)) for x in own] for _, _, own in parts], SLOTS)
    return [pa.array([f for f, _, _ in parts], pa.string()), pa.array([n for _, n, _ in parts], pa.int64()), slots]


def _parts(part: pa.Table) -> list:
    columns = [part.column(n).to_pylist() for n in ("form", "pages", "slots")]
    return [(form, pages, [list(x.values()) for x in slots]) for form, pages, slots in zip(*columns)]


def _page_forms(batches):
    """For mapInArrow: columns (host, html) to PART."""
    forms, held, size = Forms(), {}, 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.string()), *_rows(list(held.values()))], names=["host", "form", "pages", "slots"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            form, pages, slots = forms.page(*parse(page.as_py() or ""))
            if (host, form) not in held:
                size += len(form)
            _added(held, (host, form), form, pages, slots)
            if size > HELD_BYTES:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def wrappers(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """(host, wrapper) as JSON, from all pages of each host. Null urls make up a host of their own, ''."""
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts, turn = written(keyed.mapInArrow(_page_forms, PART), "forms"), 0

    def one_bucket(part: pa.Table) -> pa.Table:
        return pa.table([part.column("host").slice(0, 1), *_rows([merged(_parts(part))])], names=["host", "form", "pages", "slots"])

    def one_host(part: pa.Table) -> pa.Table:
        return pa.table([part.column("host").slice(0, 1), pa.array([_wrapper(_parts(part))])], names=["host", "wrapper"])

    while True:
        counts = parts.groupBy("host").agg(F.count_distinct("form").alias("n")).filter(F.col("n") > FORMS)
        counts = written(counts.select("host", F.ceil(F.col("n") / FORMS).alias("n")), "counts")
        if counts.isEmpty():
            return parts.groupBy("host").applyInArrow(one_host, "host string, wrapper string")
        turn += 1
        many = parts.join(counts, "host").withColumn("bucket", F.pmod(F.xxhash64("form", F.lit(turn)), F.col("n")))
        few = parts.join(counts, "host", "left_anti")
        parts = written(many.drop("n").groupBy("host", "bucket").applyInArrow(one_bucket, PART).unionByName(few), "forms")


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(id, url, text, conforms) per row of ``pages``: blocks of main text in page order, one a line; white space in a
    block is one space, character references are decoded.

    Null or empty html gives an empty text, as does a page without main text. Unclosed tags end where HTML ends them or
    with the page; pages may be of any length and nest to any depth. A page alone on its host has a wrapper without
    repeats over pages, so all its slots count as varying. ids and urls may be null or repeated; equal rows give equal
    results. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    found = written(wrappers(pages, url_col, html_col), "wrappers")
    size = found.select(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left").select("id", "url", "html", "wrapper")

    def read(batches):
        known: dict[str, dict] = {}
        for b in batches:
            texts, fits = [], []
            for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 500:
                        known.clear()
                    known[w] = json.loads(w)
                t, ok = page_text(page or "", known[w])
                texts.append(t)
                fits.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(fits, pa.bool_())], names=["id", "url", "text", "conforms"])

    return joined.mapInArrow(read, f"id {kind}, url string, text string, conforms boolean")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "conforms")

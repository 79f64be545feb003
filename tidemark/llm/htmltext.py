"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

#: Comments, declarations and tags; a tag that the page cuts off is dropped with what follows.  A quote opens a value only
#: after the equals sign.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
TOKEN = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?=[\s/]|\Z))""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")

#: Element kinds.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
                    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"))
AWAY = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"))
PROSE = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "dd", "li", "td"))
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|"
                 r"foot|masthead|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|login|signup|search|pagination|"
                 r"pager|copyright|legal|toolbar|skip|hidden|tags?|meta|byline|rating)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|story|post|entry|main|body|text)(?:$|[\s_-])", re.I)


class Element:
    """An element of the page: its parent and depth, the evidence of its own tag and attributes for content, the part of
    that which fades where most of the page is below it, and the characters below it."""

    __slots__ = ("parent", "depth", "name", "firm", "fading", "unseen", "size", "evidence")

    def __init__(self, parent, name, attributes):
        self.parent, self.depth, self.name, self.size = parent, parent.depth + 1 if parent else 1, name, 0
        self.firm, self.fading, self.unseen = _evidence(name, attributes) if parent else (0.0, 0.0, False)
        self.unseen = self.unseen or bool(parent) and parent.unseen
        above = parent
        if name == "header":  # of an article: its title; of a page: the site's
            while above and above.name not in ("article", "main"):
                above = above.parent
            self.firm -= 0.5 if above else 6.0


class Block:
    __slots__ = ("text", "element", "linked", "cost")

    def __init__(self, text, element, linked):
        self.text, self.element, self.linked, self.cost = text, element, linked, 0.0


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order with their element, the share of linked characters and the classifier's cost.

    Raw-text elements and hidden ones hide their content; an unclosed p or li ends where the next block begins.  What an
    attribute says of an element counts the less, the more of the page's text is below it: a page is no sidebar.
    """
    out: list[Block] = []
    elements = [Element(None, "", "")]
    stack, open_ = elements[:], Counter()
    text: list[str] = []
    # A link holds until it is closed, or the element that it stands in is.
    linked, total, link, at, size = 0, 0, 0, 0, len(page)

    def flush():
        nonlocal text, linked, total
        if text:
            words = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if words and not stack[-1].unseen:
                stack[-1].size += len(words)
                out.append(Block(words, stack[-1], linked / max(1, total)))
            text, linked, total = [], 0, 0

    def add(piece: str):
        nonlocal linked, total
        text.append(piece)
        n = len(piece.strip())
        total += n
        linked += n if link else 0

    def close(depth: int):
        nonlocal link
        for x in stack[depth:]:
            open_[x.name] -= 1
        del stack[depth:]
        link = link if link <= depth else 0

    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not m[1]:
            if name in ("svg", "math") and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if name != "object" or end:
                at = end.end() if end else size
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                link = 0 if m[1] else len(stack)
            continue
        flush()
        if name in VOID or name in RAW:
            continue
        if m[1]:
            if open_[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in PROSE:  # p inside p, li inside li: the open one ends
            if stack[-1].name == "p" or stack[-1].name == name:
                close(len(stack) - 1)
        elif stack[-1].name == "p":
            close(len(stack) - 1)
        elements.append(Element(stack[-1], name, m[3]))
        stack.append(elements[-1])
        open_[name] += 1
    flush()
    for x in reversed(elements[1:]):
        x.parent.size += x.size
    whole = max(1, elements[0].size)
    for x in elements:
        part = min(1.0, max(0.0, (0.95 - x.size / whole) / 0.45))
        x.evidence = x.firm + part * x.fading + (x.parent.evidence if x.parent else 0.0)
    for b in out:
        b.cost = _cost(b.text, b.element.name, b.element.evidence, b.linked)
    return out


def _evidence(name: str, attributes: str) -> tuple[float, float, bool]:
    """For content, firm and fading, and whether the element is hidden.  The page's own two elements say nothing."""
    firm, fading, unseen = 0.0, 0.0, False
    if name in ("html", "body"):
        return firm, fading, unseen
    if name == "form":  # some pages are one form
        fading -= 6.0
    elif name in AWAY:
        firm -= 6.0
    elif name in ("article", "main"):
        firm += 3.0
    for key, *values in TOKEN.findall(attributes) if attributes else ():
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "hidden":
            unseen = value.lower() != "until-found"
        elif key == "style":
            unseen = unseen or bool(UNSEEN.search(value))
        else:
            bad = BAD.search(value) or value.lower() in ("navigation", "complementary", "contentinfo", "banner", "search", "alert")
            good = any(GOOD.search(word) and not BAD.search(word) for word in value.split())
            fading -= (3.0 if good else 6.0) if bad else 0.0
            firm += 1.5 if good else 0.0
    return firm, fading, unseen


def _cost(text: str, name: str, evidence: float, linked: float) -> float:
    """Log-odds for content: positive is content."""
    words = text.count(" ") + 1
    score = evidence + 0.8 * math.log(1 + words) - 1.6 - 4.0 * linked
    if name in ("p", "blockquote", "pre"):
        score += 1.5
    elif name in ("h1", "h2", "h3"):
        score += 1.0
    if text[-1] in ".!?…:\"”":
        score += 0.5
    if text.startswith("©"):
        score -= 4.0
    return score


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; edges hold both ways.  Dinic's algorithm."""
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a, b, there, back):
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        if source[i] > 0:
            link(s, i, source[i], 0.0)
        if sink[i] > 0:
            link(i, t, sink[i], 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque((s,))
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        at = s
        while True:
            if at == t:
                flow = min(room[e] for e in path)
                for i, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while place[at] < len(heads[at]):
                e = heads[at][place[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                place[at] += 1
            else:
                if at == s:
                    break
                level[at] = -1
                at = to[path.pop() ^ 1]
                continue
            path.append(e)
            at = to[e]


NEXT, NEAR = 0.6, 0.8


def main_text(page: str | None) -> str:
    """The blocks that a minimum cut leaves with content, in page order, joined by two line ends.

    Each block is a node: log-odds for content are its capacity from the source, for boilerplate its capacity to the
    sink.  Neighbours on the page are linked, more strongly the more of their ancestors they share; blocks of one
    parent are linked along the page.  Neighbours below different sections (one in nav, footer and the like) share
    little and are cut cheaply.
    """
    if not page:
        return ""
    found = blocks_of(page)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            x, y = found[i - 1].element, b.element
            deepest = max(x.depth, y.depth)
            while x is not y:
                x, y = (x.parent, y) if x.depth > y.depth else (x, y.parent) if y.depth > x.depth else (x.parent, y.parent)
            edges.append((i - 1, i, NEXT * x.depth / deepest))
        parent = id(b.element.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, NEAR))
        elif parent in last:
            edges[-1] = (i - 1, i, edges[-1][2] + NEAR)
        last[parent] = i
    kept = minimum_cut([max(0.0, b.cost) for b in found], [max(0.0, -b.cost) for b in found], edges)
    return "\n\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; no shuffle, one page at a time in each task.

    NULL or empty html gives an empty text; NULL ids and urls are kept; repeated pages are extracted each; cut-off
    tags and entities are read as far as they go; an empty table gives an empty result.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")

"""HTML extraction by minimum cut.

A page becomes blocks of text. Each gets a classifier's odds of being content, from its length,
links and the names of the elements around it; the odds are the capacities to the two terminals.
Blocks that follow each other, and blocks of one parent, are joined by edges that are dearer the
closer the blocks lie in the tree. The minimum cut (maximum flow) is the cheapest labelling: it
pays a block's odds for calling it the other thing and an edge for parting its two blocks. Two
neighbours outweigh a block whose own odds are small: a short line between paragraphs stays, a
sentence among links goes.

Odds add up an element's kind (``ELEMENT``) and its names. Of a name such as ``article-comments``
the last word says what it is and counts in full, the words before it say less; words for boxes
(``GENERIC``) are passed over.

Defined results: null and empty pages, and pages without a content block, give the empty text;
an empty table gives no row. Markup that is never closed ends with its parent. Elements marked
``hidden``, ``aria-hidden`` or by a style that shows nothing are no text. A block whose odds tie
with its edges is no content. Repeated pages give repeated texts; other columns pass by, as the
answer is one column. Time and memory grow with the page, however deep its elements nest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sharewise.llm.text import decoded, raw

#: HTML's own classes of elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN = frozenset(
    "button canvas datalist head iframe math noscript object optgroup option script select style "
    "svg template textarea title".split()
)
RAW = frozenset("script style textarea title iframe noscript template".split())
#: An element of the key's kind ends when one of the value's kinds begins.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
}
#: The classifier's weights, in log odds. Elements and words of ``class``, ``id`` and ``role``.
ELEMENT = {
    "article": 3.0, "main": 2.5, "p": 0.8, "pre": 0.8, "blockquote": 0.6, "h1": 0.8, "h2": 0.5,
    "h3": 0.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "header": -4.0,
    "menu": -6.0, "dialog": -6.0, "fieldset": -4.0, "figure": -0.3, "li": -0.4, "address": -1.0,
}
WORDS = dict.fromkeys(
    "article body content entry main post story text".split(), 1.5
) | dict.fromkeys(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary contentinfo cookie cookies consent copyright disclaimer disqus footer gdpr "
    "header legal login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification outbrain paywall pager pagination popup promo promoted promotion recommended "
    "related replies reply respond rss search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription taboola tags teaser toc toolbar topbar widget".split(),
    -6.0,
)
GENERIC = frozenset(
    "area bar block body box col column container group holder inner item items list module outer "
    "panel row section wrap wrapper zone".split()
)
#: What the words of a name before its last one count, as a share.
BEFORE = 0.3
BIAS, PER_WORD, MOST_WORDS, PER_LINK, SENTENCE = -1.0, 0.35, 3.0, -4.0, 0.5
NEXT_TO, SIBLING, DISTANCE = 2.0, 0.5, 0.6

#: A quotation mark opens a value only behind an equals sign.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<rest>(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"(?:^|(?<=[\s\"'/]))(?P<name>class|id|role|hidden|aria-hidden|style)"
    r"(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?(?=[\s/\"']|$)",
    re.IGNORECASE,
)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


class Element(NamedTuple):
    tag: str
    block: int
    """Number of the block element that it is or lies in."""
    odds: float
    """Its own and those of all elements around it."""
    hidden: bool
    linked: bool


class Block(NamedTuple):
    text: str
    element: int
    odds: float


class Page(NamedTuple):
    """Blocks with a visible sign in page order, and parent and depth of each block element."""

    blocks: list[Block]
    parent: list[int]
    depth: list[int]


def _name_odds(name: str) -> float:
    """Odds of one word of a class, an id or a role."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    while len(words) > 1 and words[-1] in GENERIC:
        words.pop()
    before = sum(WORDS.get(w, 0.0) for w in words[:-1])
    return WORDS.get(words[-1], 0.0) + BEFORE * before if words else 0.0


def _element_odds(tag: str, rest: str) -> tuple[float, bool]:
    """What an element says about the text inside it, and whether that text is hidden."""
    odds, hidden = ELEMENT.get(tag, 0.0), False
    for found in _ATTRIBUTE.finditer(rest):
        name = found["name"].lower()
        value = found["a"] or found["b"] or found["c"] or ""
        if name == "hidden":
            hidden |= value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(_NOT_SHOWN.search(value))
        elif tag not in ("html", "body"):
            own = [_name_odds(n) for n in value.lower().split()]
            odds += min((x for x in own if x), default=0.0)
    return odds, hidden


def blocks(page: str) -> Page:
    """The page's blocks of text, with the tree of block elements."""
    out: list[Block] = []
    parent, depth = [0], [0]
    stack: list[Element] = [Element("", 0, 0.0, False, False)]
    open_: Counter[str] = Counter()
    words: list[str] = []
    linked = total = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked, total
        text = " ".join("".join(words).split())
        if text:
            odds = _text_odds(text, linked / max(1, total)) + stack[-1].odds
            out.append(Block(text, stack[-1].block, odds))
        words.clear()
        linked = total = 0

    def pop() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at and not stack[-1].hidden:
            piece = html.unescape(page[at:stop])
            words.append(piece)
            total += len(piece)
            if stack[-1].linked:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_[tag] > 0:
                if tag in BLOCKS:
                    close()
                while pop() != tag:
                    pass
            elif tag in BLOCKS:
                close()
            continue
        if tag in BLOCKS:
            close()
            for _ in range(_implied_ends(stack, tag)):
                pop()
        elif tag in ("br", "wbr"):
            words.append("\n" if tag == "br" else "")
        if tag in VOID or _CLOSED.search(m["rest"]) and tag not in BLOCKS:
            continue
        if tag in RAW:
            # Its contents are not markup; they end with its own end mark.
            last = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = last.end() if last else end
            continue
        above = stack[-1]
        odds, hidden = _element_odds(tag, m["rest"])
        number = above.block
        if tag in BLOCKS:
            number = len(parent)
            parent.append(above.block)
            depth.append(depth[above.block] + 1)
        open_[tag] += 1
        hidden |= tag in UNSEEN or above.hidden
        stack.append(Element(tag, number, above.odds + odds, hidden, above.linked or tag == "a"))
        if tag == "body" and open_["head"] > 0:  # ends a head that was left open
            open_["head"] = 0
            stack[:] = [e._replace(hidden=False) for e in stack if e.tag != "head"]
    close()
    return Page(out, parent, depth)


def _implied_ends(stack: list[Element], tag: str) -> int:
    """How many elements the beginning of ``tag`` ends: one, and the inline ones inside it."""
    for at in range(len(stack) - 1, 0, -1):
        if tag in CLOSED_BY.get(stack[at].tag, ()):
            return len(stack) - at
        if stack[at].tag in BLOCKS:
            return 0
    return 0


def _text_odds(text: str, link_share: float) -> float:
    n = text.count(" ") + 1
    odds = BIAS + min(MOST_WORDS, PER_WORD * math.sqrt(n)) + PER_LINK * link_share
    return odds + (SENTENCE if text[-1] in ".!?:;…\"'" else 0.0)


def edges(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order, and the next block under the same parent."""
    out, last = [], {}
    for i, block in enumerate(page.blocks):
        if i:
            apart = _apart(page, page.blocks[i - 1].element, block.element)
            out.append((i - 1, i, NEXT_TO * math.exp(-DISTANCE * apart / 2)))
        above = page.parent[block.element]
        if above in last and last[above] != i - 1:
            out.append((last[above], i, SIBLING))
        last[above] = i
    return out


def _apart(page: Page, a: int, b: int) -> int:
    """Steps from one block element to another over the nearest one around both."""
    steps = 0
    while a != b:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        steps += 1
    return steps


def minimum_cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut.

    Positive odds are a capacity from the source, negative ones a capacity to the sink, and a
    link has its weight both ways. Maximum flow by blocking flows over levels.
    """
    n = len(odds)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, x in enumerate(odds):
        if x > 0:
            join(source, i, x, 0.0)
        elif x < 0:
            join(i, sink, -x, 0.0)
    for a, b, weight in links:
        join(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        after = [0] * (n + 2)
        while True:
            path: list[int] = []
            node = source
            while node != sink:
                while after[node] < len(head[node]):
                    e = head[node][after[node]]
                    if room[e] > tiny and level[to[e]] == level[node] + 1:
                        break
                    after[node] += 1
                if after[node] == len(head[node]):
                    if node == source:
                        break
                    e = path.pop()
                    node = to[e ^ 1]
                    after[node] += 1
                else:
                    path.append(head[node][after[node]])
                    node = to[path[-1]]
            if node != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def main_text(page: str) -> str:
    """The content blocks of a whole page, joined by an empty line."""
    found = blocks(page)
    kept = minimum_cut([b.odds for b in found.blocks], edges(found))
    return "\n\n".join(b.text for b, keep in zip(found.blocks, kept, strict=True) if keep)


def extract(column: Column | str) -> Column:
    """The main text of each page."""

    @F.arrow_udf("string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(decoded(x.as_py())) for x in batch], pa.string())

    return answer(raw(column))

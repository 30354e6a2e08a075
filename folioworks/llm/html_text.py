"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text at block-level tags.  A linear classifier
over a block's surroundings (elements, names in class, id and role) and its own
text (length, closing punctuation, share of link text) gives its log-odds of
being content; they become the capacities from the source (content) or to the
sink (boilerplate).  A name counts by its last telling word ("post-comments" are
comments, "banner-article" is an article), names that tell opposite things cancel
each other, and a name or form around most of a page's plain text is its layout:
it only costs ``LAYOUT``, which the blocks' own capacities and the cut overrule.  Neighbouring blocks, and following blocks of the same
parent, are joined by edges that weigh more the closer they are in the DOM.
The maximum flow's minimum cut then labels all blocks of the page together, so
a doubtful block goes with the blocks around it.

Null, empty and unfinished pages are taken as they are: open elements end with
the page, a tag that never ends is dropped, a page without content blocks gives
an empty text.  Rows are independent; repeated rows give the same text.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element groups.
RAW = "script|style|textarea|title|iframe"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul"
    " audio button canvas math noscript object select svg template video".split()
)
#: A start tag ends an open element of these names.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Elements that such an implied end does not reach beyond.
FENCES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
# The classifier.
ELEMENT = {"article": 3.0, "main": 2.0, "nav": -7.0, "footer": -7.0, "aside": -6.0, "header": -6.0, "form": -6.0, "dialog": -6.0, "menu": -6.0, "head": -9.0}
ELEMENT |= dict.fromkeys("audio button canvas math noscript object select svg template video".split(), -9.0)
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu leftmenu breadcrumb breadcrumbs"
    " sidebar footer copyright legal cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login signin register"
    " social share sharing related recommended recommendations trending widget widgets pagination pager paging"
    " toolbar search skip hidden form masthead toc tags".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
WEAK_HINTS = frozenset(["header", "top", "bottom", "meta", "aside"])
GOOD_HINTS = frozenset("article content post entry story text body main".split())
#: Words that make whatever they stand before no part of the article.
ASIDES = frozenset("related recommended recommendations trending sponsor sponsored promoted".split())
#: Words of a name that only say what is there or how it looks; words for its box.
STATES = frozenset("with has no not without free enabled disabled fixed on off open closed active of for is".split())
BOXES = frozenset("slot list inner outer box wrap wrapper wall container block item items area section group row col link links button buttons bar panel unit zone area holder".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEGATIVE, DOUBTFUL, GOOD, LAYOUT = -6.0, -1.5, 1.0, -0.25
#: Share of the page's plain text from which a name or form is its layout: with the first heading inside, and without.
MOST, NEARLY_ALL = 0.5, 0.7
PLAIN = frozenset(["html", "body", "main", "article"])

#: What stands between a tag's name and its end; a quote that does not begin a value, or is never closed, is plain.
REST = r"(?>=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){REST}>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{REST})(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SENTENCE_END = (".", "!", "?", "…", ":", "”", '"', "。")


def name_evidence(name: str) -> tuple[float, bool]:
    """What one name of a class or id tells, and whether it speaks of comments."""
    parts = [p.lower() for p in PART.findall(name)]
    if not STATES.isdisjoint(parts):
        return 0.0, False
    telling = [p for p in parts if p not in BOXES and not p.isdigit()]
    if not telling:
        return 0.0, False
    head, known = telling[-1], HINTS | COMMENTS
    if head in known or not ASIDES.isdisjoint(telling):
        return NEGATIVE, head in COMMENTS
    if head in GOOD_HINTS:
        return GOOD, False
    return (DOUBTFUL, False) if not known.isdisjoint(telling) and GOOD_HINTS.isdisjoint(telling) else (0.0, False)


def element_weight(name: str, rest: str, in_article: bool) -> tuple[float, float, bool]:
    """What an element adds to the log-odds of the blocks inside it; the part of that which is left if it is the page's layout; whether it speaks of comments."""
    own = 0.0 if name == "header" and in_article else ELEMENT.get(name, 0.0)
    sure = 0.0 if name == "form" else own
    if not rest or name in PLAIN:
        return own, sure, False
    told: list[tuple[float, bool]] = []
    weak = False
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return min(own, NEGATIVE), min(own, NEGATIVE), False
        if key == "role" and value.lower() in ROLES:
            own = min(own, NEGATIVE)
            sure = sure if value.lower() in ("form", "search") else min(sure, NEGATIVE)
        if key in ("class", "id"):
            told += [name_evidence(n) for n in value.split()]
            weak = weak or any(p.lower() in WEAK_HINTS for n in value.split() for p in PART.findall(n)[-1:])
    good, bad = any(w > 0 for w, _ in told), min((w for w, _ in told), default=0.0)
    if bad < 0:
        return (min(own, bad), sure, any(c for _, c in told)) if not good else (own, sure, False)
    if good:
        return own + GOOD, sure + GOOD, False
    return (min(own, NEGATIVE), sure, False) if weak and not in_article else (own, sure, False)


class Block:
    __slots__ = ("element", "links", "odds", "parents", "tag", "text")

    def __init__(self, text: str, links: int, tag: str, element: int, parents: tuple[int, ...]) -> None:
        self.text, self.links, self.tag, self.element, self.parents = text, links, tag, element, parents
        self.odds = self.own_odds()

    def own_odds(self) -> float:
        """The block's own part: words, closing punctuation, link text, leading copyright sign."""
        words, share = self.text.count(" ") + 1, min(1.0, self.links / max(1, len(self.text)))
        z = min(2.0, words / 20) * (1 - share) - 3.0 * share
        z += 1.0 if self.tag in ("p", "h1") else 0.3 if self.tag in ("h2", "h3", "blockquote", "pre") else 0.0
        z += 0.5 if words > 3 and self.text.endswith(SENTENCE_END) else 0.0
        return z - (3.0 if self.text[0] == "©" else 0.0)


class Element:
    """An open element: its number, what its blocks inherit, and where the nearest fence stands in the stack."""

    __slots__ = ("fence", "in_article", "name", "number", "parents", "tag")

    def __init__(self, name: str, number: int, in_article: bool, fence: int, tag: str, parents: tuple[int, ...]) -> None:
        self.name, self.number, self.in_article, self.fence, self.tag, self.parents = name, number, in_article, fence, tag, parents


def surroundings(above: list[int], weights: list[tuple[float, float, bool]], blocks: list[Block]) -> list[float]:
    """The log-odds that each element hands on, from its own weight and the element above it (numbers rise inwards)."""
    plain, heading = [0] * len(above), [False] * len(above)
    marked = [w[1] >= ELEMENT["main"] for w in weights]  # elements that say they hold the article
    outside = [False] * len(above)  # in what is boilerplate by its element
    for i in range(1, len(above)):
        outside[i] = outside[above[i]] or weights[i][1] <= NEGATIVE
    for b in blocks:
        if not outside[b.element]:
            plain[b.element] += max(0, len(b.text) - 2 * b.links)
            heading[b.element] = heading[b.element] or b.tag == "h1"
    for i in range(len(above) - 1, 0, -1):
        plain[above[i]] += plain[i]
        heading[above[i]] = heading[above[i]] or heading[i]
        marked[above[i]] = marked[above[i]] or marked[i]
    # of the outermost doubtful elements, comments and those with less text do not count beside one
    top = [0] * len(above)
    for i in range(1, len(above)):
        top[i] = top[above[i]] or (i if weights[i][0] < weights[i][1] else 0)
    by_size = sorted(((plain[i], i) for i in range(1, len(above)) if top[i] == i and not weights[i][2]))
    beside, smaller = {}, sum(plain[i] for i in range(1, len(above)) if top[i] == i and weights[i][2])
    for size, i in by_size:
        beside[i] = smaller
        smaller += size
    out = [0.0] * len(above)
    for i in range(1, len(above)):
        weight, sure, comments = weights[i]
        if weight < sure and plain[0] and marked[i] == marked[0]:
            share = plain[i] / max(1, plain[0] - beside.get(top[i], 0))
            if heading[i] and share >= MOST or not comments and share >= NEARLY_ALL:
                weight = sure + LAYOUT
        holder = out[above[i]]
        # what is boilerplate stays so inside, whatever stands around it
        out[i] = holder + weight if weight >= 0 and holder > DOUBTFUL else min(holder, 0.0) + min(weight, 0.0)
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty text blocks in order, in time linear in the page."""
    out: list[Block] = []
    stack = [Element("", 0, False, -1, "", (0,))]
    above, weights = [0], [(0.0, 0.0, False)]
    places: dict[str, list[int]] = {}
    pieces: list[str] = []
    links = open_links = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, links, stack[-1].tag, stack[-1].number, stack[-1].parents))
            pieces.clear()
        links = 0

    def close(names: list[str], beyond_fences: bool) -> None:
        """Closes the innermost element of these names, and all inside it, unless a fence stands between."""
        at = max((places[x][-1] for x in names if places.get(x)), default=0)
        if at and (beyond_fences or at >= stack[-1].fence):
            for e in stack[at:]:
                places[e.name].pop()
            del stack[at:]

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            text = html.unescape(m["text"])
            pieces.append(text)
            if open_links:
                links += len(text.strip())
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m["end"]:
            if name == "a":
                open_links = 0
            close([name], name in FENCES)
            continue
        if name in ENDS:
            close(ENDS[name].split(), False)
        if name == "a":
            open_links = 1
        holder = stack[-1]
        weights.append(element_weight(name, m["rest"], holder.in_article))
        above.append(holder.number)
        number = len(weights) - 1
        if not m["rest"].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            tag, parents = (name, (*holder.parents, number)[-4:]) if name in BLOCK else (holder.tag, holder.parents)
            stack.append(Element(name, number, holder.in_article or name == "article", len(stack) if name in FENCES else holder.fence, tag, parents))
    flush()
    inherited = surroundings(above, weights, out)
    for b in out:
        b.odds += inherited[b.element]
    return out


def nearness(a: Block, b: Block) -> float:
    """Capacity of the edge between two blocks by their nearest common element."""
    if a.parents[:-1] == b.parents[:-1]:
        return 1.0
    shared = sum(1 for x in a.parents if x in b.parents)
    return 0.5 if shared >= 2 and a.parents[-2:-1] == b.parents[-2:-1] else 0.2 if shared >= 2 else 0.05


def source_side(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a maximum flow leaves on the source's side (Dinic's levels and blocking flows)."""
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    leaving: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        leaving[a].append(len(to))
        leaving[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, z in enumerate(odds):
        if z > 0:
            join(source, i, z, 0.0)
        elif z < 0:
            join(i, sink, -z, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in leaving[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                here = to[path[cut] ^ 1]
                del path[cut:]
            while at[here] < len(leaving[here]):
                e = leaving[here][at[here]]
                if room[e] > 1e-9 and level[to[e]] == level[here] + 1:
                    break
                at[here] += 1
            else:
                if here == source:
                    break
                level[here] = -1
                here = to[path.pop() ^ 1]
                continue
            path.append(e)
            here = to[e]


def content_blocks(page: str) -> list[str]:
    """The texts of the blocks that the minimum cut leaves with the content."""
    blocks = blocks_of(page)
    edges = [(i, i + 1, nearness(a, b)) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = b.parents[-2] if len(b.parents) > 1 else 0
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 0.5))
        last[parent] = i
    return [b.text for b, kept in zip(blocks, source_side([b.odds for b in blocks], edges), strict=True) if kept]


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page; empty if it has none."""
    if out_col in pages.columns:
        raise ValueError(f"column {out_col} is already there")

    @F.arrow_udf("string")
    def main_text(texts: pa.Array) -> pa.Array:
        return pa.array([" ".join(content_blocks(x.as_py() or "")) for x in texts], pa.string())

    return pages.withColumn(out_col, main_text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))

"""Main text of web pages by a minimum cut over their text blocks.

A page becomes a sequence of blocks, the texts between borders of block-level elements. A logistic classifier of a block's
length, links, punctuation, element, place, wording and ancestors gives it the odds of being content; the negative log
likelihoods of both labels are its capacities to the sink and the source. Neighbours in page order and next blocks of one
container are tied by the log odds that they share a label, which fall with their distance in the DOM and where the kind of
container changes. Both are in one unit, so a block with weak evidence follows its neighbours. The source side of a minimum
cut is the content. Before the flow, blocks whose terminal outweighs all their ties are merged into that terminal, which
keeps the cut minimal and leaves most pages with little to augment; the rest is solved by blocking flows.

Parsing is linear in the page: elements know their parent and depth, open elements are found by name, and each scan of the
page goes on where the one before it ended.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import tokens

#: Elements by what they do to the text.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("noscript template svg math canvas audio video object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("option optgroup caption tbody td tfoot th thead tr body html".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that only hold items: their items are as near to what is around them as paragraphs are.
WRAPPERS = frozenset("ul ol dl menu table thead tbody tfoot tr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select label fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids. A main element cancels the layout words around it, but not the others.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion reader share sharing social "
    "related recommended recommendations trending breadcrumb breadcrumbs pagination pager copyright disclaimer banner alert toolbar widget widgets".split()
)
LAYOUT_WORDS = frozenset("nav navbar navigation menu menus header masthead footer foot sidebar sidebars side aside topbar bottombar rail".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story body text prose".split())

#: Elements that name other resources, and the attribute that does.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "form": "action"}
#: What notices, forms and lists of links say.
NOTICES = (
    "cookies? subscribe newsletter sign.up sign.in log.in register privacy.policy terms.of.use terms.of.service all.rights.reserved copyright share.this share.on "
    "tweet follow.us advertisement sponsored read.more related.articles related.posts related.stories leave.a.comment leave.a.reply post.a.comment comments? "
    "reply replies skip.to.content back.to.top contact.us about.us"
).split()

_MARKUP = re.compile(r"<(?:(!--)|([!?])|/([^a-zA-Z])|(/?)([a-zA-Z][^\s/>]*))")
#: Attributes up to the end of a tag; a quote counts after an equals sign only, and one that is never closed is a character.
_INSIDE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL, _WORDS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[a-z]+")
_NOTICE = re.compile(r"\b(?:" + "|".join(n.replace(".", r"\s+") for n in NOTICES) + r")\b|©|\(c\)\s*\d{4}", re.I)
_CLAIMED = re.compile(r"^\W*(?:©|\(c\)\s*\d{4}|copyright\b)", re.I)
_ENDS = re.compile(r"[.!?…。:][\"'”’)\]]*$")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_PLAIN, _MAIN, _LAYOUT, _BOILER = 0, 1, 2, 3
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Log odds of content for what a block shows, and for the containers it is in.
BIAS, PER_DOUBLING, LINKED, SENTENCE, COMMA, NOTICE, REPEATED, UNDER_NOTICE, BEFORE_TITLE, CLAIMED, ODD = -1.09, 0.55, -4.5, 0.8, 0.4, -12.0, -1.0, -3.0, -0.7, -4.0, -1.5
ELEMENT = {"p": 0.7, "h1": 1.5, "h2": 0.6, "h3": 0.6, "h4": 0.6, "h5": 0.6, "h6": 0.6, "pre": 0.7, "blockquote": 0.7, "li": -0.3, "td": -0.2, "th": -0.2, "address": -1.0}
CONTAINER = {_PLAIN: 0.0, _MAIN: 2.5, _LAYOUT: -4.0, _BOILER: -5.0}
#: Words from which on a block is too long to be a notice.
BRIEF = 40
#: Log odds that siblings side by side share a label, what each further step in the DOM leaves of it, what a change of the
#: kind of container leaves, and the same for next blocks of one container with others in between.
TIE, STEP, CHANGE, NEXT = 3.0, 0.25, 0.15, 1.5


@lru_cache(20_000)
def _kind(tag: str, attributes: str) -> tuple[int, bool, bool]:
    """What an element says about the texts in it, whether it is hidden, and whether it is named as the main part."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = tag in HIDDEN or "hidden" in found or "display:none" in style or "visibility:hidden" in style
    names = set(_WORDS.findall(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower())) if tag not in ("html", "body") else set()
    role, main = found.get("role", "").lower(), bool(MAIN_WORDS & names) or found.get("itemprop", "").lower() == "articlebody"
    if tag in BOILER_TAGS or role in BOILER_ROLES or BOILER_WORDS & names:
        return _BOILER, hidden, main
    if tag in ("article", "main") or role in ("main", "article"):
        return _MAIN, hidden, main
    if tag == "header" or LAYOUT_WORDS & names:
        return _LAYOUT, hidden, main
    return (_MAIN if main else _PLAIN), hidden, main


def _within(state: int, tag: str, attributes: str) -> tuple[int, bool]:
    """What an element's texts are taken for, given what those around it are, and whether it hides them."""
    kind, hides, main = _kind(tag, attributes)
    if _BOILER in (kind, state):
        return _BOILER, hides
    if kind == _MAIN:
        return (_MAIN if tag in ("article", "main") or state != _LAYOUT else state), hides
    if kind == _LAYOUT and (state != _MAIN or (tag != "header" and not main)):
        return _LAYOUT, hides
    return state, hides


@dataclass
class Block:
    """A text with its element's number and name, the kind of its container, and the characters of it in links."""

    node: int
    tag: str
    state: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks in page order, and for each block-level element its parent's number, its depth, and whether it is a step in the DOM.

    Besides, the start tags that can name other resources, and what the first title element holds.
    """

    blocks: list[Block] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    title: str | None = None
    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    steps: list[int] = field(default_factory=lambda: [0])


class _Open:
    """An open element: its name, the block-level element it belongs to, and what its texts are."""

    __slots__ = ("hidden", "home", "home_tag", "links", "state", "tag")

    def __init__(self, tag: str, state: int, hidden: bool, links: int, home: int, home_tag: str):
        self.tag, self.state, self.hidden, self.links, self.home, self.home_tag = tag, state, hidden, links, home, home_tag


class _Builder:
    """Takes a page's tags and texts in order and makes its blocks."""

    def __init__(self) -> None:
        self.page, self.stack, self.places = Page(), [_Open("", _PLAIN, False, 0, 0, "")], defaultdict(list)
        self.block = Block(0, "", _PLAIN)

    def flush(self) -> None:
        block, top = self.block, self.stack[-1]
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            block.parts = []
            if block.text:
                self.page.blocks.append(block)
        self.block = Block(top.home, top.home_tag, top.state)

    def text(self, raw: str) -> None:
        top, block = self.stack[-1], self.block
        if not raw or top.hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not block.parts:
            block.node, block.tag, block.state = top.home, top.home_tag, top.state
        elif top.state > block.state and text.strip():
            block.state = top.state
        block.parts.append(text)
        if top.links:
            block.linked += len(text.strip())

    def _last(self, names: tuple[str, ...]) -> int:
        at = 0
        for name in names:
            if (open_ := self.places.get(name)) and open_[-1] > at:
                at = open_[-1]
        return at

    def _close(self, to: int) -> None:
        if to == len(self.stack) - 1:
            tag = self.stack[to].tag
            if tag in BLOCK:
                self.flush()
            self.stack.pop()
            self.places[tag].pop()
            return
        if any(e.tag in BLOCK for e in self.stack[to:]):
            self.flush()
        for e in self.stack[to:]:
            self.places[e.tag].pop()
        del self.stack[to:]

    def _close_within(self, names: tuple[str, ...], scopes: tuple[str, ...]) -> None:
        at = self._last(names)
        if at > self._last(scopes):
            self._close(at)

    def end(self, tag: str) -> None:
        if open_ := self.places.get(tag):
            self._close(open_[-1])

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img"):
                self.text(" ")
            return
        if tag in ENDS_P and self.places.get("p"):
            self._close_within(("p",), ("td", "th", "button", "table", "object", "caption"))
        if tag in CLOSES:
            other, scopes = CLOSES[tag]
            self._close_within((tag, other), scopes)
        if tag in BLOCK:
            self.flush()
        elif attributes.endswith("/"):
            return
        top = self.stack[-1]
        state, hides = _within(top.state, tag, attributes)
        home, home_tag = top.home, top.home_tag
        if tag in BLOCK:
            home, home_tag = len(self.page.parents), tag
            self.page.parents.append(top.home)
            self.page.depths.append(self.page.depths[top.home] + 1)
            self.page.steps.append(int(tag not in WRAPPERS))
        self.places[tag].append(len(self.stack))
        self.stack.append(_Open(tag, state, top.hidden or hides, top.links + (tag == "a"), home, home_tag))


def parsed(page: str) -> Page:
    """The text blocks of a page, in one pass over its characters."""
    made, at, scanned, strict = _Builder(), 0, 0, True
    while found := _MARKUP.search(page, scanned):
        comment, bogus, odd_end, closing, tag = found.groups()
        if comment:
            done = page.startswith((">", "->"), found.end())
            end = _COMMENT_END.search(page, found.end()) if not done else None
            stop = page.index(">", found.end()) + 1 if done else end.end() if end else len(page)
        elif bogus or odd_end:
            stop = page.find(">", found.end() - bool(odd_end)) + 1 or len(page)
        else:
            inside = _INSIDE.match(page, found.end()) if strict else None
            if not inside:  # from the first tag that no quote or bracket ends, tags end at the first bracket
                strict = False
                stop = page.find(">", found.end()) + 1
                if not stop:
                    break
            else:
                stop = inside.end()
        made.text(page[at : found.start()])
        at = scanned = stop
        if tag:
            name, attributes = tag.lower(), page[found.end() : stop - 1]
            if not closing and name in LINKS:
                made.page.links.append((name, attributes))
            if closing:
                made.end(name)
            elif name in RAW:
                end = _RAW_END[name].search(page, at)
                scanned = end.start() if end else len(page)
                if name == "title" and made.page.title is None:
                    made.page.title = " ".join(html.unescape(page[at:scanned]).split())
                at = scanned
            else:
                made.start(name, attributes)
    made.text(page[at:])
    made.flush()
    return made.page


def attribute(attributes: str, name: str) -> str | None:
    """The decoded value of an attribute in the inside of a tag, if it is there."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def log_odds(page: Page) -> list[float]:
    """The log odds of content for each block, from itself and the headings before it."""
    texts = Counter(b.text for b in page.blocks)
    by_tag = Counter[str]()
    for b in page.blocks:
        by_tag[b.tag] += max(0, len(b.text) - b.linked)
    whole = by_tag.total()
    title = next((i for i, b in enumerate(page.blocks) if b.tag == "h1"), 0)
    out, under = [], False
    for i, b in enumerate(page.blocks):
        linked = min(1.0, b.linked / len(b.text))
        n = b.text.count(" ") + 1
        notices = len(_NOTICE.findall(b.text)) if n < BRIEF else 0
        if b.tag in _HEADINGS:
            under = notices > 0 and n <= 6 and b.tag != "h1"
        z = BIAS + PER_DOUBLING * math.log2(1 + n * (1 - linked)) + LINKED * linked + ELEMENT.get(b.tag, 0.0) + CONTAINER[b.state]
        z += SENTENCE * bool(_ENDS.search(b.text)) + COMMA * ("," in b.text) + max(-4.0, NOTICE * notices / (n + 2)) * (0.5 if b.state == _MAIN else 1.0)
        z += REPEATED * (texts[b.text] > 1 and n < 20) + UNDER_NOTICE * under + BEFORE_TITLE * (i < title)
        z += CLAIMED * bool(_CLAIMED.match(b.text)) + ODD * (b.tag not in ELEMENT and 10 * by_tag[b.tag] < whole)
        out.append(z)
    return out


def _terminals(page: Page) -> list[tuple[float, float]]:
    """The costs of calling each block boilerplate and of calling it content: negative log likelihoods."""
    cost = lambda z: max(z, 0.0) + math.log1p(math.exp(-abs(z)))
    return [(cost(z), cost(-z)) for z in log_odds(page)]


def _apart(page: Page, a: int, b: int) -> int:
    """Steps between two elements in the tree; along a page's blocks these add up to its number of elements at most twice."""
    steps = 0
    while a != b:
        if page.depths[a] < page.depths[b]:
            a, b = b, a
        a, steps = page.parents[a], steps + page.steps[a]
    return steps


def _ties(page: Page) -> dict[tuple[int, int], float]:
    """Capacities between neighbours in page order, and between a block and the next one of its container."""
    ties: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(page.blocks):
        if i:
            before = page.blocks[i - 1]
            change = CHANGE if before.state != b.state else 1.0
            ties[i - 1, i] = TIE * change * STEP ** max(0, _apart(page, before.node, b.node) - 2)
        home = page.parents[b.node]
        if home in last and last[home] != i - 1:
            ties[last[home], i] = NEXT * (CHANGE if page.blocks[last[home]].state != b.state else 1.0)
        last[home] = i
    return ties


class _Flow:
    """Maximum flow by blocking flows over level graphs (Dinic); nothing recurs, so depth is no limit."""

    def __init__(self, n: int):
        self.n, self.out, self.to, self.left = n, [[] for _ in range(n)], [], []

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def _levels(self, source: int) -> list[int]:
        level, queue = [-1] * self.n, deque([source])
        level[source] = 0
        while queue:
            v = queue.popleft()
            for e in self.out[v]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        while (level := self._levels(source))[sink] >= 0:
            arc, path, v = [0] * self.n, [], source
            while True:
                if v == sink:
                    least = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= least
                        self.left[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if self.left[e] <= 1e-9)
                    v = self.to[path[cut] ^ 1]
                    del path[cut:]
                elif arc[v] < len(self.out[v]):
                    e = self.out[v][arc[v]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        v = self.to[e]
                    else:
                        arc[v] += 1
                elif v == source:
                    break
                else:
                    v = self.to[path.pop() ^ 1]
                    arc[v] += 1
        return [x >= 0 for x in level]


def source_side(terminals: list[tuple[float, float]], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source; (from the source, to the sink) for each node, ties both ways."""
    n = len(terminals)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in ties.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    balance = [s - t for s, t in terminals]
    decided: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # a node that outweighs its ties is merged into its terminal; that shifts its neighbours' balance
        v = queue.popleft()
        if decided[v] is None and abs(balance[v]) >= sum(near[v].values()):
            decided[v] = balance[v] > 0
            for u, c in near[v].items():
                balance[u] += c if decided[v] else -c
                del near[u][v]
                queue.append(u)
            near[v] = {}
    rest = [v for v in range(n) if decided[v] is None]
    if rest:
        number, flow = {v: i for i, v in enumerate(rest)}, _Flow(len(rest) + 2)
        source, sink = len(rest), len(rest) + 1
        for v in rest:
            flow.edge(source, number[v], max(balance[v], 0.0), 0.0)
            flow.edge(number[v], sink, max(-balance[v], 0.0), 0.0)
            for u, c in near[v].items():
                if u > v:
                    flow.edge(number[v], number[u], c, c)
        side = flow.source_side(source, sink)
        for v in rest:
            decided[v] = side[number[v]]
    return [bool(x) for x in decided]


def main_text(page: str | None) -> str:
    found = parsed(page or "")
    keep = source_side(_terminals(found), _ties(found))
    return "\n".join(b.text for b, k in zip(found.blocks, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); n_chars counts code points.

    A null or empty html gives an empty text. Rows are neither merged nor dropped, whatever their page_id; other columns
    are ignored. A page is parsed whole, in one pass over its characters; tags that never end are text to the end of the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.slices(batch, "html", 8 << 20):
                texts = [main_text(page) for page in piece.column(2).to_pylist()]
                columns = [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    needed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return needed.mapInArrow(run, "page_id long, url string, text string, n_chars long")

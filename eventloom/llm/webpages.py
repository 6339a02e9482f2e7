"""Main text of web pages by minimum cut.

A page becomes blocks of text with their place in the document tree. A classifier of
fixed weights gives each block a cost of being called content or boilerplate, which
are its capacities to the two terminals. Blocks that follow each other are joined by
an edge, and so are neighbours below a common ancestor, the weaker the farther apart
in the tree. The minimum cut, found by maximum flow, is the labelling of least total
cost. Pages are independent; a page is worked on in one task, as it is one row.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# elements whose content is never text of the page
_SILENT = frozenset("script style noscript template title textarea select button svg math iframe object canvas audio video".split())
_CLOSED = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _SILENT}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ANGLE = re.compile("[<>]")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|itemprop|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: an opening tag ends these open elements, up to an enclosing one
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}

_ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_ASIDE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"nav|navbar|navigation|menus?|breadcrumbs?|pagination|pager|sidebars?|widgets?|footers?|copyright|legal|masthead|topbar|toolbar|share|sharing|social|related|recommended|"
    r"comments?|commentlist|respond|replies|disqus|search|forms?|skip|hidden|tags|teaser)(?:$|[^a-z])"
)
_COMMENT_NAMES = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|respond|replies|disqus)(?:$|[^a-z])")
_MAIN_NAMES = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|body|main|text|articlebody)(?:$|[^a-z])")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Element:
    tag: str
    aside: int  # enclosing elements, itself included, that hold boilerplate
    comment: bool
    main: bool
    header: bool


@dataclass(slots=True)
class Block:
    """``depth`` counts the open elements around the block, ``shared`` those that were
    open without a break since the block before."""

    text: str
    tag: str
    depth: int
    shared: int
    link_share: float
    aside: int
    main: bool
    header: bool


class _Finder:
    """Next places of a pattern in a page, asked for at growing positions: a stretch
    without the pattern is searched once."""

    def __init__(self, page: str, pattern: str):
        self.page, self.search = page, re.compile(pattern).search
        self.begin, self.at = 0, -1

    def after(self, pos: int) -> int:
        """First place at ``pos`` or later, or the length of the page."""
        if not self.begin <= pos <= self.at:
            found = self.search(self.page, pos)
            self.begin, self.at = pos, found.start() if found else len(self.page)
        return self.at


class _Tags:
    """Ends of tags, with quoted attributes. Where a scan has failed, none goes again,
    so the time is linear in the page whatever it holds."""

    def __init__(self, page: str):
        self.page = page
        # a silent element's tag may hold an angle bracket, another's not
        self.marks = {True: _Finder(page, "[>\"']"), False: _Finder(page, "[<>\"']")}
        self.quotes = {q: _Finder(page, q) for q in "\"'"}
        self.dead: dict[bool, set[int]] = {True: set(), False: set()}

    def end(self, pos: int, silent: bool) -> int:
        """Place of the tag's closing bracket, -1 if it is not closed."""
        page, marks, dead, seen = self.page, self.marks[silent], self.dead[silent], []
        while True:
            at = marks.after(pos)
            if at == len(page) or at in dead or page[at] == "<":
                break
            if page[at] == ">":
                return at
            seen.append(at)
            close = self.quotes[page[at]].after(at + 1)
            if close == len(page):
                break
            pos = close + 1
        dead.update(seen)
        return -1


def _tokens(page: str):
    """``(text, tag, closing, attributes)``: texts have no tag; comments, silent
    elements and other markup are passed over. A bracket that opens nothing is text."""
    tags, pos, n = _Tags(page), 0, len(page)
    while pos < n:
        if page[pos] != "<":
            end = page.find("<", pos)
            end = n if end < 0 else end
            yield page[pos:end], None, False, ""
            pos = end
            continue
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, pos)
        if name:
            tag, closing = name[2].lower(), bool(name[1])
            if tag in _SILENT and not closing:
                end = tags.end(name.end(), True)
                if end >= 0:
                    over = _CLOSED[tag].search(page, end + 1)
                    pos = over.end() if over else n
                    continue
            end = tags.end(name.end(), False)
            if end >= 0:
                yield "", tag, closing, page[name.end() : end]
                pos = end + 1
                continue
        following = page[pos + 1 : pos + 2]
        if following in ("!", "?", "/") or (following.isascii() and following.isalpha()):
            end = _ANGLE.search(page, pos + 1)
            if end and end.group() == ">":
                pos = end.end()
                continue
        yield "<", None, False, ""
        pos += 1


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    aside = parent.aside if parent else 0
    comment, main, header = (parent.comment, parent.main, parent.header) if parent else (False, False, False)
    names, own = "", 0
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "itemprop"):
                names += " " + _CAMEL.sub(" ", value).lower()
            elif name == "role":
                own += value.lower() in _ASIDE_ROLES
                main = main or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "style" and _HIDDEN_STYLE.search(value.lower())) or (name == "aria-hidden" and value.lower() == "true"):
                own += 1
    if tag in ("article", "main"):
        # the article is not a part of what is named for a neighbour of it
        aside, main, header = (aside if comment else 0), True, False
    if names:
        own += bool(_ASIDE_NAMES.search(names))
        comment = comment or bool(_COMMENT_NAMES.search(names))
        main = main or bool(_MAIN_NAMES.search(names))
    own += tag in _ASIDE_TAGS
    return Element(tag, aside + bool(own), comment, main, header or tag == "header")


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order. Missing end tags are supplied where the next tag
    shows the end; unknown and inline elements do not end a block."""
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # of the open elements of a tag in the stack
    out: list[Block] = []
    parts: list[str] = []
    links, in_link, shared = 0, False, 0

    def close() -> None:
        nonlocal links, shared
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1] if stack else None
                tag, aside, main, header = (top.tag, top.aside, top.main, top.header) if top else ("", 0, False, False)
                out.append(Block(text, tag, len(stack), min(shared, len(stack)), min(1.0, links / len(text)), aside, main, header))
                shared = len(stack)
        links = 0

    def pop_to(k: int) -> None:
        nonlocal shared
        while len(stack) > k:
            places[stack.pop().tag].pop()
        shared = min(shared, k)

    def innermost(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for text, tag, closing, attributes in _tokens(page):
        if tag is None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(text.strip())
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in _BLOCK:
            close()
            in_link = False
            if closing:
                if places.get(tag):
                    pop_to(places[tag][-1])
                continue
            if stack and stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            if tag in _ENDS:
                ends, within = _ENDS[tag]
                k = innermost(ends)
                if k > innermost(within):
                    pop_to(k)
            if tag not in _VOID and not attributes.endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(_opened(tag, attributes, stack[-1] if stack else None))
    close()
    return out


def content_cost(b: Block) -> float:
    """Log odds of being content: fixed weights of the block's size, marks, links and
    surroundings."""
    n = len(b.text)
    z = -1.2 + min(n / 80, 3.0) - 4.0 * b.link_share
    z += 0.6 if b.text[-1] in ".!?…:;\"”»)" or ". " in b.text else 0.0
    z += 0.8 if b.tag in ("p", "blockquote", "pre") or b.tag in _HEADING else 0.0
    z += 3.0 if b.main else 0.0
    z -= 3.0 if b.header and b.tag not in _HEADING else 2.0 if b.header else 0.0
    return z - 9.0 * min(b.aside, 2)


#: weight of the edge between blocks that follow each other, and of tree neighbours
ADJACENT, NEAR, FADE = 0.5, 0.9, 0.6


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of the graph. Below the innermost element that holds a block and an earlier
    one, the nearest earlier block is the one before, as elements hold stretches of the
    page; so the two kinds of edges join the same pairs."""
    out = []
    for j in range(1, len(blocks)):
        a, b = blocks[j - 1], blocks[j]
        w = ADJACENT
        if b.shared:
            w += NEAR * FADE ** (a.depth - b.shared + b.depth - b.shared)
        out.append((j - 1, j, w))
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the side of its positive cost. A node whose own cost
    exceeds all of its edges is decided; its edges become capacities of the others.
    For the rest the flow grows along shortest open paths until there is none."""
    n = len(costs)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    cost, side = list(costs), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(cost[i]) > sum(around[i].values()):
            side[i] = cost[i] > 0
            for j, w in around[i].items():
                del around[j][i]
                cost[j] += w if side[i] else -w
                todo.append(j)
            around[i] = {}
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return side
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in free}
    room[source], room[sink] = {}, {}
    for i in free:
        if cost[i] > 0:
            room[source][i], room[i][source] = cost[i], 0.0
        else:
            room[i][sink], room[sink][i] = -cost[i], 0.0
    while True:
        came: dict[int, int] = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            x = queue.popleft()
            for y, r in room[x].items():
                if r > 1e-9 and y not in came:
                    came[y] = x
                    queue.append(y)
        if sink not in came:
            break
        y, least = sink, float("inf")
        while y != source:
            least = min(least, room[came[y]][y])
            y = came[y]
        y = sink
        while y != source:
            room[came[y]][y] -= least
            room[y][came[y]] = room[y].get(came[y], 0.0) + least
            y = came[y]
    for i in free:
        side[i] = i in came
    return side


def main_text(page: str | None) -> str:
    """Content blocks in page order, one per line; empty if there are none."""
    blocks = blocks_of(page or "")
    keep = minimum_cut([content_cost(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extracted(df: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``df`` but ``html_col``, with ``_x_text`` and ``_x_chars`` (code
    points). Null and empty pages have an empty text; repeated rows are extracted each;
    an empty table gives an empty result. Time and memory are in proportion to a page,
    also where its markup never closes. Of labellings of equal cost the one with the
    fewest content blocks counts."""
    names = [c for c in df.columns if c != html_col]

    def run(batches):
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            texts = [main_text(p) for p in batch.column(at[html_col]).to_pylist()]
            cols = [batch.column(at[n]) for n in names] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "_x_text", "_x_chars"])

    schema = df.drop(html_col).withColumn("_x_text", F.lit("")).withColumn("_x_chars", F.lit(0).cast("long")).schema
    return df.mapInArrow(run, schema)

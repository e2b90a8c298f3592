"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks, each at an element of the tree. A logistic classifier, fitted on the hand-marked
pages of `html_examples`, gives each block the log-odds that it's main text: from its own length, links, marks and tag, the
elements and names above it and its place. What stands beside it is for the edges. The log-odds are the capacities to the two terminals.
Smoothness edges join each block to the next one and to the next in the same parent: stronger the fewer steps
of the tree lie between. The minimum cut, by max-flow (Dinic's), is the labelling of least total cost: a short paragraph
or heading, unclear by itself, goes with what stands around it, and so does a prose-like teaser in a list of links.
Blocks whose own cost outweighs all their edges keep their label in every minimum cut and are settled first.

Text: character references decoded, white space within a block one space, trimmed, blocks in page order joined by LF.
What the page hides (hidden, aria-hidden, display:none) and what is no text (scripts, styles, controls) is no block.

Edge cases: a null or empty html and a page without content give an empty text; unclosed and stray tags are closed as
browsers do for paragraphs, list items and table cells, else by the next enclosing end; an unfinished tag ends the page,
an open quote is a character like others; a page's time is linear in its length, however its tags nest; repeated rows
are pages of their own; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import read
from lexloom.llm.html_examples import MARK, PAGES

RAW = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video".split())
_TAG = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id\s*=|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAME = re.compile(r"[a-z]+")
_END = re.compile(r"[.!?:;…。][\"')”’»]?$")

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes open elements of its set, up to the nearest element of the second set.
_CLOSES = {t: (("p",), ("button", "td", "th", "table")) for t in BLOCK - {"button", "option", "caption"}} | {
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements that HTML gives to other things than main text, and those it gives to it.
APART = frozenset("nav aside footer form menu dialog button fieldset option".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id and role that name such parts.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo "
    "complementary cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "rating recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar tracking widget widgets alert toc legal privacy popular trending".split()
)
MAIN_NAMES = frozenset("article articlebody content document entry main post prose story text body blog recipe".split())

#: Smoothness between neighbours in one parent; what each step between parents leaves of it, another tag, other flags above.
NEAR, STEP, OTHER, FLAGS = 1.0, 0.45, 0.8, 0.2
#: Blocks of one connected part beyond which it's reduced before the flow.
LONG = 256
#: Penalty on the classifier's squared weights.
RIDGE = 0.3


class Block:
    __slots__ = ("node", "tag", "parts", "linked", "text", "words")

    def __init__(self, node: int, tag: str):
        self.node, self.tag = node, tag
        self.parts: list[str] = []
        self.linked = 0


class Page:
    """A page's blocks in order and its elements by number: parent, depth and what stands above (flags include the element)."""

    def __init__(self, page: str):
        self.parent, self.depth = [0], [0]
        self.apart, self.main, self.header, self.named, self.praised, self.unseen = ([0] for _ in range(6))
        self.blocks: list[Block] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open: dict[str, list[int]] = {}
        self._parse(page)
        kept = []
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
            b.words = b.text.count(" ") + 1
            if b.text and not self.unseen[b.node]:
                kept.append(b)
        self.blocks = kept

    def _start(self, tag: str, names: set[str], unseen: bool) -> None:
        above = self._stack[-1][1]
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        main = self.main[above] or tag in MAIN
        self.apart.append(self.apart[above] or tag in APART)
        self.main.append(main)
        self.header.append(self.header[above] or (not main and (tag == "header" or "header" in names)))
        self.named.append(self.named[above] + bool(names & APART_NAMES))
        self.praised.append(self.praised[above] or bool(names & MAIN_NAMES and not names & APART_NAMES))
        self.unseen.append(self.unseen[above] or unseen)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, len(self.parent) - 1))

    def _end(self, at: int) -> None:
        """Close the elements from place `at` of the stack on."""
        while len(self._stack) > at:
            self._open[self._stack.pop()[0]].pop()

    @staticmethod
    def _names(attrs: str) -> tuple[set[str], bool]:
        names: set[str] = set()
        unseen = False
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                names.update(_NAME.findall(value))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _UNSEEN.search(value)):
                unseen = True
        return names, unseen

    def _parse(self, page: str) -> None:
        current: Block | None = None
        link = 0  # the stack's height where the open link began
        at, size, quoted = 0, len(page), True
        last = {q: page.rfind(q) for q in "\"'"}
        while at < size:
            if page[at] != "<" or at + 1 == size or not (page[at + 1].isascii() and (page[at + 1].isalpha() or page[at + 1] in "/!?")):
                to = page.find("<", at + 1)
                to = size if to < 0 else to
                if current is None:
                    current = Block(self._stack[-1][1], self._stack[-1][0])
                    self.blocks.append(current)
                text = html.unescape(page[at:to])
                current.parts.append(text)
                if link:
                    current.linked += len(text.strip())
                at = to
                continue
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                at = size if to < 0 else to + 3
                continue
            m = _TAG.match(page, at + 1)
            if m is None:  # a declaration, or an end without a name
                to = page.find(">", at)
                at = size if to < 0 else to + 1
                continue
            # the tag's end; quotes hide it
            to = page.find(">", m.end())
            if quoted and to >= 0 and (page.find('"', m.end(), to) >= 0 or page.find("'", m.end(), to) >= 0):
                i = m.end()
                while (s := _STOP.search(page, i)) and s[0] != ">":
                    i = s.end() if s.start() >= last[s[0]] else page.find(s[0], s.end()) + 1
                if s:
                    to = s.start()
                else:  # no end outside quotes: from here on, quotes don't count
                    quoted = False
            if to < 0:
                return
            name, attrs, at = m[0].lower(), page[m.end() : to], to + 1
            end = name[0] == "/"
            tag = name[1:] if end else name
            if tag == "br":
                if current is not None:
                    current.parts.append(" ")
            elif tag in RAW:
                if not end and not attrs.endswith("/"):
                    close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                    at = close.end() if close else size
            elif tag == "a":
                link = 0 if end else len(self._stack)
            elif end:
                if tag in BLOCK or self._open.get(tag):
                    current = None
                    if self._open.get(tag):
                        self._end(self._open[tag][-1])
            elif tag in BLOCK:
                current = None
                shut, limits = _CLOSES.get(tag, ((), ()))
                limit = max((self._open[t][-1] for t in limits if self._open.get(t)), default=0)
                first = [o[bisect_right(o, limit)] for t in shut if (o := self._open.get(t)) and o[-1] > limit]
                if first:
                    self._end(min(first))
                if tag != "hr":
                    self._start(tag, *(self._names(attrs) if attrs else (set(), False)))
            elif attrs and _TELLING.search(attrs):
                # an inline element of a telling name stands for itself: its text is a block of its own
                names, unseen = self._names(attrs)
                if (unseen or names & APART_NAMES) and not attrs.endswith("/"):
                    current = None
                    self._start(tag, names, unseen)
            if link > len(self._stack):
                link = 0

    def features(self) -> np.ndarray:
        """A row for each block."""
        found = self.blocks
        words = np.array([b.words for b in found], float)
        chars = np.array([max(1, len(b.text)) for b in found], float)
        links = np.minimum(1.0, np.array([b.linked for b in found]) / chars)
        node = np.array([b.node for b in found])
        flag = lambda values: np.array(values, float)[node]
        tag = lambda *tags: np.array([b.tag in tags for b in found], float)
        main = np.maximum(flag(self.main), flag(self.praised))
        ends = np.cumsum(chars)
        middle = (ends - chars / 2) / ends[-1]
        return np.stack(
            [
                np.ones(len(found)),
                np.log1p(words),
                np.array([bool(_END.search(b.text)) for b in found], float),
                links,
                tag("p", "pre", "blockquote"),
                tag("h1", "h2", "h3", "h4", "h5", "h6"),
                tag("li", "td", "th", "dt", "dd"),
                flag(self.apart),
                flag(self.main),
                flag(self.header),
                np.minimum(flag(self.named), 2),
                flag(self.praised),
                (1 - main) * float(main.any()),
                np.abs(middle - 0.5) * 2,
                np.array(["©" in b.text for b in found], float),
            ],
            1,
        )

    def links(self) -> list[tuple[int, int, float]]:
        """The smoothness edges."""
        out = []
        found, parent, depth = self.blocks, self.parent, self.depth
        last: dict[int, int] = {}
        kind = [(bool(self.apart[b.node]), bool(self.header[b.node]), self.named[b.node]) for b in found]
        share = [min(1.0, b.linked / len(b.text)) for b in found]

        def alike(i: int, j: int) -> float:
            """Links and plain text don't pull at each other, nor do parts of different flags, much."""
            return (1 - abs(share[i] - share[j])) * (1 if kind[i] == kind[j] else FLAGS)

        for i, b in enumerate(found):
            up = parent[b.node]
            if i:
                x, y, steps = parent[found[i - 1].node], up, 0
                while x != y:  # in page order these walks see each element twice at most
                    if depth[x] >= depth[y]:
                        x = parent[x]
                    else:
                        y = parent[y]
                    steps += 1
                if steps < 20:
                    out.append((i - 1, i, NEAR * STEP**steps * (1 if found[i - 1].tag == b.tag else OTHER) * alike(i - 1, i)))
            j = last.get(up)
            if j is not None and j < i - 1:
                out.append((j, i, NEAR * STEP * alike(j, i)))
            last[up] = i
        return out


def fit(pages: tuple[str, ...] = PAGES, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the logistic classifier, by Newton's method."""
    x, y = [], []
    for p in pages:
        page = Page(p)
        y += [b.text.startswith(MARK) for b in page.blocks]
        for b in page.blocks:
            b.text = b.text.lstrip(MARK)
        x.append(page.features())
    x, y = np.concatenate(x), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    return fit()


def minimum_cut(n: int, terminal: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: the source's side) of a minimum cut; terminal[i] above zero is the capacity from the source, below to the sink."""
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        around[i][j] = around[i].get(j, 0.0) + w
        around[j][i] = around[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    left = list(terminal)
    todo = deque(range(n))
    while todo:  # who outweighs all edges is settled, and pulls at its neighbours
        i = todo.popleft()
        if label[i] is None and abs(left[i]) >= sum(around[i].values()):
            label[i] = left[i] > 0
            for j, w in around[i].items():
                del around[j][i]
                left[j] += w if label[i] else -w
                todo.append(j)
            around[i] = {}
    # what is left falls into parts that share no edge; each is cut by itself
    for first in range(n):
        if label[first] is None:
            part, seen = [first], {first}
            for i in part:
                for j in around[i]:
                    if j not in seen:
                        seen.add(j)
                        part.append(j)
            if len(part) <= LONG:
                for i, side in zip(part, _flow(part, left, around)):
                    label[i] = side
                continue
            # a long chain would take a phase for each length of path: its blocks of one or two edges go first, exactly
            gone, rest = _reduce(part, left, around)
            for i, side in zip(rest, _flow(rest, left, around) if rest else ()):
                label[i] = side
            for i, u, ends in reversed(gone):
                label[i] = u + sum(w if label[j] else -w for j, w in ends) > 0
    return [bool(x) for x in label]


def _reduce(part: list[int], left: list[float], around: list[dict[int, float]]) -> tuple[list[tuple], list[int]]:
    """Take blocks of two edges or fewer out one by one, each replaced by what its best label costs its neighbours: log-odds
    and an edge between them. Returns those in order (block, its log-odds and edges then) and those that remain."""
    gone: list[tuple] = []
    out: set[int] = set()
    todo = deque(i for i in part if len(around[i]) <= 2)
    while todo:
        i = todo.popleft()
        if i in out or len(around[i]) > 2:
            continue
        u, ends = left[i], list(around[i].items())
        out.add(i)
        gone.append((i, u, ends))
        (a, v), (b, w) = (*ends, (-1, 0.0), (-1, 0.0))[:2]
        both = v + w
        f00, f11, f01, f10 = min(0.0, both - u), min(both, -u), min(w, v - u), min(v, w - u)
        edge = (f01 + f10 - f00 - f11) / 2
        for j, f in ((a, f10), (b, f01)):
            if j >= 0:
                del around[j][i]
                left[j] -= f - f00 - edge
                todo.append(j)
        if b >= 0 and edge > 0:
            around[a][b] = around[b][a] = around[a].get(b, 0.0) + edge
        around[i] = {}
    return gone, [i for i in part if i not in out]


def _flow(part: list[int], left: list[float], around: list[dict[int, float]]) -> list[bool]:
    """Dinic's max-flow over one connected part: phases of shortest paths, each saturated at once."""
    place = {i: k for k, i in enumerate(part)}
    s, t = len(part), len(part) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def link(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, back))

    for i in part:
        if left[i] > 0:
            link(s, place[i], left[i], 0.0)
        elif left[i] < 0:
            link(place[i], t, -left[i], 0.0)
        for j, w in around[i].items():
            if j > i:
                link(place[i], place[j], w, w)
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(part))]
        turn = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                # back to where the first edge is full
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def labelled(page: Page, w: np.ndarray | None = None) -> tuple[list[bool], list[float]]:
    """(which blocks are main text, their log-odds before the cut)."""
    odds = (page.features() @ (weights() if w is None else w)).tolist()
    return minimum_cut(len(odds), odds, page.links()), odds


def main_text(page: str | None) -> str:
    found = Page(page or "")
    if not found.blocks:
        return ""
    return "\n".join(b.text for b, content in zip(found.blocks, labelled(found)[0]) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))

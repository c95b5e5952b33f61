"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text, each with the elements it stands in. A block's marks (the
tags and class words around it, its length, the share of links in it) add up to a
score, the log-odds that it is content; that score is the capacity of the block's edge to
the source or to the sink. Neighbours in page order and neighbours under one parent are
joined by smoothness edges. The maximum flow splits the blocks into content and boilerplate with
the least sum of overruled scores and cut edges, so a short line between paragraphs stays
and a long line between menus goes.

Defined cases: a null or empty html, and a page without content blocks, give an empty text. Unclosed
and stray tags are read as browsers do for paragraphs and list items, and otherwise ignored; text
after a cut-off tag is lost with the tag. White space is that of Unicode; a line break
element is white space. Nothing is capped. Rows are independent, so ties, repeated rows
and other columns have no effect.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelode.llm.common import portions, whole_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title svg math iframe object canvas audio video select textarea button datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
#: Elements that end when one of the listed starts beside them.
ENDS = {
    "p": BLOCK - {"body", "html", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option"}), "head": frozenset({"body"}),
}
#: Elements an implied end does not reach beyond.
WALLS = frozenset("table ul ol dl menu div section article aside nav header footer main form body html".split())

#: Score of the innermost element that says what it holds.
TAG_MARKS = {
    "article": 3.0, "main": 3.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -4.0, "menu": -6.0, "form": -3.0,
    "dialog": -6.0, "fieldset": -4.0,
}
GOOD_WORDS = frozenset("article articlebody content post entry story main body-text maintext".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead toolbar widget related "
    "recommended share sharing social newsletter subscribe subscription signup login search pagination pager copyright legal "
    "disclaimer skip contentinfo complementary form".split()
)
#: Readers' comments, whatever stands inside them.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: The open elements that a start tag ends, by the start tag.
ENDED_BY = {tag: [inner for inner, enders in ENDS.items() if tag in enders] for tag in set().union(*ENDS.values())}
SECTION = re.compile(r"<!\[\s*(cdata|temp|ignore|include|rcdata)\s*\[", re.IGNORECASE)
GOOD, BAD, COMMENT = 3.0, -6.0, -8.0
BASE, PARAGRAPH, HEADING, LINKS, SENTENCE = -1.0, 1.5, 1.0, -5.0, 0.5
#: Words that count fully toward a block's length, and what they are worth.
LONG, LENGTH = 25, 2.0
ADJACENT, SIBLINGS = 0.4, 0.8


@dataclass
class Element:
    """``mark`` and ``verdict`` (comment or head) are those of the nearest element that has one, itself first."""

    tag: str
    mark: float | None
    verdict: float | None
    parent: int


@dataclass
class Block:
    text: str
    linked: int
    element: int


def _marks(tag: str, attributes: dict[str, str | None]) -> tuple[float | None, bool]:
    if tag in ("html", "body"):
        return None, False
    named = " ".join(attributes.get(name) or "" for name in ("class", "id", "role", "itemprop", "aria-label"))
    words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()))
    if words & COMMENT_WORDS:
        return COMMENT, True
    if words & BAD_WORDS:
        return BAD, False
    if tag in TAG_MARKS:
        return TAG_MARKS[tag], False
    return (GOOD, False) if words & GOOD_WORDS else (None, False)


class PageReader(HTMLParser):
    """Blocks of a page in order, and the elements they stand in. No page raises, and no step walks the
    open elements: their places are kept by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", None, None, -1)]
        self.blocks: list[Block] = []
        self._open = [0]
        self._places: dict[str, list[int]] = {}
        self._open_blocks = [0]
        self._parts: list[str] = []
        self._linked = 0
        self._comment_end = (-1, -1)

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append(Block(text, self._linked, self._open_blocks[-1]))
        self._parts, self._linked = [], 0

    def _place(self, tag: str) -> int:
        """Depth of the innermost open element of a tag; 0 without one."""
        places = self._places.get(tag)
        return places[-1] if places else 0

    def _wall(self) -> int:
        return max(map(self._place, WALLS), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._flush()
            while True:
                depth, inner = max(((self._place(t), t) for t in ENDED_BY.get(tag, ())), default=(0, ""))
                if not depth or self._wall() > depth:
                    break
                self._close(depth)
                if inner not in ("td", "th"):
                    break
        if tag in VOID:
            self._parts.append(" " if tag in ("br", "img", "wbr", "input") and tag != "wbr" else "")
            return
        mark, comment = _marks(tag, dict(attrs))
        outer = self.elements[self._open[-1]]
        verdict = COMMENT if comment else BAD if tag == "head" else outer.verdict
        self.elements.append(Element(tag, outer.mark if mark is None else mark, verdict, self._open[-1]))
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.elements) - 1)
        if tag in BLOCK:
            self._open_blocks.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)

    def _close(self, depth: int) -> None:
        for at in reversed(self._open[depth:]):
            tag = self.elements[at].tag
            self._places[tag].pop()
            if tag in BLOCK:
                self._open_blocks.pop()
        del self._open[depth:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        depth = self._place(tag)
        if depth and (tag in BLOCK or depth >= self._wall()):
            self._close(depth)

    def handle_data(self, data: str) -> None:
        if not any(map(self._place, SILENT)):
            self._parts.append(data)
            if self._place("a"):
                self._linked += len("".join(data.split()))

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Without an end further on, a comment is not looked through again for every start."""
        size, last = self._comment_end
        if size != len(self.rawdata):
            last = max(self.rawdata.rfind("-->"), self.rawdata.rfind("--!>"), self.rawdata.rfind("<!-->"), self.rawdata.rfind("<!--->"))
            self._comment_end = (len(self.rawdata), last)
        return super().parse_comment(i, report) if i <= last else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        """A section ``<![name[...]]>`` is dropped up to its end, any other ``<![`` up to the next ``>``."""
        known = SECTION.match(self.rawdata, i)
        end = self.rawdata.find("]]>", i) + 3 if known else 2
        if end < 3:
            end = self.rawdata.find(">", i) + 1
        return end or -1

    def finish(self) -> list[Block]:
        self.close()
        self._flush()
        return self.blocks


def block_score(block: Block, elements: list[Element]) -> float:
    """Log-odds that the block is content."""
    words = block.text.split(" ")
    letters = sum(map(len, words))
    score = BASE + LENGTH * min(1.0, len(words) / LONG) + LINKS * min(1.0, block.linked / max(1, letters))
    score += SENTENCE if block.text[-1] in ".!?:;\"'”»…" else 0.0
    element = elements[block.element]
    score += PARAGRAPH if element.tag in ("p", "pre", "blockquote") else HEADING if element.tag in ("h1", "h2", "h3") else 0.0
    return score + ((element.mark or 0.0) if element.verdict is None else element.verdict)


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of the minimum cut: which blocks are content.

    Flow is sent along shortest paths of the residual graph, all of one length in a phase."""
    n = len(scores)
    source, sink = n, n + 1
    heads: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(heads))
        heads.append(b)
        room.append(there)
        out[b].append(len(heads))
        heads.append(a)
        room.append(back)

    for at, score in enumerate(scores):
        if score > 0:
            join(source, at, score, 0.0)
        elif score < 0:
            join(at, sink, -score, 0.0)
    for a, b, weight in edges:
        join(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for edge in out[at]:
                if room[edge] > 1e-9 and level[heads[edge]] < 0:
                    level[heads[edge]] = level[at] + 1
                    queue.append(heads[edge])
        if level[sink] < 0:
            return [level[at] >= 0 for at in range(n)]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[edge] for edge in path)
                for edge in path:
                    room[edge] -= flow
                    room[edge ^ 1] += flow
                cut = next(i for i, edge in enumerate(path) if room[edge] <= 1e-9)
                at = heads[path[cut] ^ 1]
                del path[cut:]
            elif next_edge[at] < len(out[at]):
                edge = out[at][next_edge[at]]
                if room[edge] > 1e-9 and level[heads[edge]] == level[at] + 1:
                    path.append(edge)
                    at = heads[edge]
                else:
                    next_edge[at] += 1
            elif path:
                at = heads[path.pop() ^ 1]
                next_edge[at] += 1
            else:
                break


def smoothness(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and between neighbours under one parent."""
    edges = [(at - 1, at, ADJACENT) for at in range(1, len(blocks))]
    last: dict[int, int] = {}
    for at, block in enumerate(blocks):
        parent = elements[block.element].parent
        if parent in last:
            edges.append((last[parent], at, SIBLINGS))
        last[parent] = at
    return edges


def extract(html: str) -> str:
    reader = PageReader()
    reader.feed(html)
    blocks = reader.finish()
    scores = [block_score(block, reader.elements) for block in blocks]
    content = content_side(scores, smoothness(blocks, reader.elements))
    return "\n".join(block.text for block, keep in zip(blocks, content, strict=True) if keep)


@F.arrow_udf(T.StringType())
def extract_all(pages: pa.Array) -> pa.Array:
    out: list[str] = []
    for start, end in portions(pages):
        out += [extract(page) for page in pages.slice(start, end - start).to_pylist()]
    return pa.array(out, type=pa.string())


def main_text(pages: DataFrame, html: str = "html") -> Column:
    """Column with the main text of each page of ``pages``."""
    return extract_all(whole_text(html))

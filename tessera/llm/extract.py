"""HTML extraction: blocks of a page labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pagemaker
from tessera.llm.mincut import source_side
from tessera.llm.portions import slices

# Element names of HTML by their role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video datalist textarea select noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button search fieldset".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where an open element of CLOSED_BY is not looked for any further.
SCOPE = frozenset("ul ol dl table select menu body html article section div".split())
# Words of class, id and role attributes, words that make of such a name the state of a page or a wrapper,
# headings above reader comments, and what notices speak of.
BAD_WORD = re.compile(r"^(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|side(?:bar)?|widget|footer|foot|masthead|cookies?|consent|gdpr|notices?|notification|newsletter|subscri\w*|signup|share|sharing|social|related|recommend\w*|comments?|disqus|repl(?:y|ies)|respond|popup|modal|overlay|login|search\w*|toolbar|pagination|pager|copyright|legal|skip|alert|disclaimer|contentinfo|complementary|navigation|outbrain|taboola|tags?|hidden|toc)$")
GOOD_WORD = re.compile(r"^(?:article\w*|post|entry|content|story|main|body|text|blog|page)$")
STATE_WORD = re.compile(
    r"^(?:has|have|no|not|non|with|without|is|are|js|enabled|disabled|open|opened|closed|collapsed|active|overflow|layout|ready)$"
)
REPLIES = re.compile(
    r"\W*(?:\d+\s+)?(?:comments?|replies|responses|reactions|kommentare|antworten|commentaires|comentarios|respuestas)(?:\s*\(?\d+\)?)?\W*",
    re.IGNORECASE
)
CUES = re.compile(
    r"\b(?:cookies?|consent|gdpr|privacy policy|datenschutz\w*|newsletter|subscribe|sign (?:up|in)|log in|advertisement|sponsored|accept all|accept|akzeptieren|accepter|aceptar|terms of (?:use|service)|all rights reserved)\b",
    re.IGNORECASE
)
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
SENTENCE = re.compile(r"[.!?…](?:\s|$)")
#: Capacity of the edge between neighbours in the page, by half for each step of DOM distance beyond 2; of the edge to the next block of the same container.
NEAR, SAME = 1.2, 0.4
#: An element of a bad class that has this share of a page without article tags, and its main heading, is a wrapper.
WRAPS = 0.6
#: What an element says of the text in it.
BAD_TAG, BAD_CLASS, UNSHOWN, GOOD, MAIN, HEADER, HEADING = (1 << i for i in range(7))
#: What the classifier sees of a block, in the order of its weights.
FEATURES = (
    "bias", "words", "sentences", "links", "main", "good", "bad_tag", "bad_class", "unshown", "header", "heading", "mark", "cues", "replies",
    "outside"
)


@dataclass(slots=True)
class Block:
    """A run of text between block borders, the element it lies in, that element's nearest container, and what the
    elements around it say."""

    text: str
    links: int
    depth: int
    element: int
    container: int
    says: int = 0
    replies: bool = False
    outside: bool = False


@dataclass(slots=True)
class Element:
    """An element's parent, what it says by itself, and the characters of text in it."""

    parent: int
    tag: str
    says: int
    size: int = 0


def class_says(marks: dict[str, str | None]) -> int:
    """What class, id and role say. A name that holds a state word (``has-sidebar``) tells of the page, not of the text."""
    out = 0
    for name in " ".join(marks.get(k) or "" for k in ("class", "id", "role")).split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        if not any(map(STATE_WORD.match, words)):
            out |= BAD_CLASS * any(map(BAD_WORD.match, words)) | GOOD * any(map(GOOD_WORD.match, words))
    return out


class _Reader(HTMLParser):
    """Splits a page into blocks and notes the elements they lie in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.elements = [Element(0, "", 0)]
        # name, element, unseen, link, container, depth
        self.open: list[tuple[str, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0)]
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, element, _, _, container, depth = self.open[-1]
                self.blocks.append(Block(text, self.linked, depth, element, container))
                self.elements[element].size += len(text)
            self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for name, *_ in self.open[to:]:
            self.names[name] -= 1
        del self.open[to:]

    def _close_implied(self, tag: str) -> None:
        if self.names["p"]:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name == "p":
                    self._pop(i)
                    break
                if name in BLOCK:
                    break
        ends = CLOSED_BY.get(tag, frozenset())
        if any(self.names[x] for x in ends):
            lowest = 0
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name in ends:
                    lowest = i
                elif name in SCOPE:
                    break
            if lowest:
                self._pop(lowest)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "input"):
            self.parts.append(" ")
        if tag in BLOCK:
            self.flush()
            self._close_implied(tag)
        if tag in ("body", "article", "main") and self.names["head"]:
            # an open head ends where the body starts
            self._pop(next(i for i, x in enumerate(self.open) if x[0] == "head"))
        if tag in VOID:
            return
        _, parent, unseen, link, container, depth = self.open[-1]
        marks = dict(attrs)
        says = BAD_TAG * (tag in BOILERPLATE) | MAIN * (tag in ("article", "main")) | HEADER * (tag == "header")
        says |= HEADING * (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        if tag not in ("body", "html"):
            says |= class_says(marks) & (~BAD_CLASS if tag in ("article", "main") else -1)
        if "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in (marks.get("style") or "").replace(" ", ""):
            says |= UNSHOWN
        here = len(self.elements)
        self.elements.append(Element(parent, tag, says))
        if tag in BLOCK and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"):
            container = here
        self.names[tag] += 1
        self.open.append((tag, here, unseen + (tag in UNSEEN), link + (tag == "a"), container, depth + (tag in BLOCK)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in BLOCK:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.names[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._pop(i)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.parts.append(data)
            if self.open[-1][3]:
                self.linked += len(data.strip())


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, each with what the elements around it say.

    What wraps the article says nothing about it: elements around the ``main`` with the most text, without one around
    the ``article`` with the most, and without both those of a bad class that hold the first heading and most of the
    text. The cost is that of the elements and blocks alone, at any depth.
    """
    page = _Reader()
    page.feed(html)
    page.close()
    page.flush()
    all_, found = page.elements, page.blocks
    last = list(range(len(all_)))  # an element's last descendant: elements are numbered as they open
    for i in range(len(all_) - 1, 0, -1):
        up = all_[i].parent
        all_[up].size += all_[i].size
        last[up] = max(last[up], last[i])
    main = next((max(xs, key=lambda i: all_[i].size) for tag in ("main", "article") if (xs := [i for i, e in enumerate(all_) if e.tag == tag and e.size])), 0)
    title = main or next((i for i, e in enumerate(all_) if e.tag == "h1"), 0)
    around, at = {0}, title
    while at:
        at = all_[at].parent
        if main or all_[at].size >= WRAPS * all_[0].size:
            around.add(at)
    says = [0] * len(all_)
    for i, e in enumerate(all_[1:], 1):
        own = e.says & ~(BAD_TAG | BAD_CLASS | UNSHOWN | HEADER) if i in around and (main or not e.says & BAD_TAG) else e.says
        before = says[e.parent]
        if own & MAIN and not (before | own) & (BAD_TAG | BAD_CLASS):
            before &= ~HEADER
        elif own & HEADER and before & MAIN:
            own &= ~HEADER
        says[i] = before | own
    below = -1  # where the region under a heading of reader comments ends
    for b in found:
        b.says, b.outside = says[b.element], bool(main) and not main <= b.element <= last[main]
        b.replies = b.element <= below
        if b.says & HEADING and REPLIES.fullmatch(b.text):
            b.replies, below = True, max(below, last[all_[b.element].parent if all_[b.element].says & HEADING else b.container])
    return found


def seen(b: Block) -> list[float]:
    """The values of FEATURES for a block."""
    words = b.text.count(" ") + 1
    flag = lambda x: float(b.says & x > 0)
    mark = float(words < 12 and ("©" in b.text or "|" in b.text))
    return [
        1.0, min(1.0, words / 25), min(2, len(SENTENCE.findall(b.text))) / 2, min(1.0, b.links / len(b.text)), flag(MAIN), flag(GOOD), flag(BAD_TAG),
        flag(BAD_CLASS), flag(UNSHOWN), flag(HEADER), flag(HEADING), mark, min(2, len(CUES.findall(b.text))) / 2, float(b.replies), float(b.outside)
    ]


def train(rows: np.ndarray, labels: np.ndarray, keep: float = 2e-4, steps: int = 25) -> list[float]:
    """Logistic regression by Newton's method; ``keep`` times the squared weights keeps them finite."""
    w, pull = np.zeros(rows.shape[1]), keep * len(rows) * np.eye(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) + pull @ w
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + pull, slope)
    return w.tolist()


@functools.lru_cache(1)
def fitted() -> tuple[float, ...]:
    """The classifier's weights, learnt from the made-up pages of ``tessera.llm.pagemaker``, whose blocks are known."""
    rows, labels = [], []
    for html, content in pagemaker.pages():
        for b in blocks(html):
            rows.append(seen(b))
            labels.append(b.text in content)
    return tuple(train(np.array(rows), np.array(labels, float)))


def odds(b: Block, weights: Sequence[float]) -> float:
    """The classifier: log-odds that a block is content."""
    return sum(map(mul, weights, seen(b)))


def label(found: list[Block], weights: Sequence[float] | None = None) -> list[bool]:
    """Which blocks are content: the cut of least cost.

    A block pays the classifier's cost of its label, ``log(1 + exp(-odds))`` for content and ``log(1 + exp(odds))`` for
    boilerplate; neighbours that get different labels pay their edge, unless only one of them lies in a marked part.
    """
    weights = weights or fitted()
    scores = [odds(b, weights) for b in found]
    soft = lambda x: math.log1p(math.exp(-abs(x))) + max(0.0, x)
    marked = [(b.says & (BAD_TAG | BAD_CLASS | UNSHOWN | HEADER | MAIN), b.replies, b.outside) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            apart = 2 if a.container == b.container else 2 + abs(a.depth - b.depth) + 2
            if marked[i - 1] == marked[i]:
                edges.append((i - 1, i, NEAR * 0.5 ** (apart - 2)))
        before = last.get(b.container)
        if before is not None and before < i - 1 and marked[before] == marked[i]:
            edges.append((before, i, SAME))
        last[b.container] = i
    return source_side([soft(x) for x in scores], [soft(-x) for x in scores], edges)


def main_text(html: str | None, weights: Sequence[float] | None = None) -> str:
    """The page's content blocks in page order, a line each; white space inside a block is one space."""
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` per page, from its whole html, however long or nested.

    A null or empty page has the empty text, as has one without content; where keeping and dropping cost the same a
    block is dropped; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    weights = fitted()  # learnt here, once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [main_text(h, weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)

"""Main text of web pages: flat blocks of text, classified by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words, the share of them
in links, the same of its neighbours, and where it stands (inside containers that are no content,
inside the article, heading). The tree is trained on a small labelled table of such blocks.

A keyword in a container's class, id or role puts its text outside, unless the container is a wrapper: it
has half of the page's words by itself, and holds the article or nearly all that is left. Elements whose
text is dropped end at their close tag, at the close of an element around them, or where HTML ends them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by role.
_RAW = "script|style|title|textarea|iframe"
_DROPPED = frozenset("noscript template select option svg object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul button label input""".split())
_CONTAINERS = frozenset("""article aside blockquote body details dialog div dl fieldset figure footer form header
main menu nav ol section table ul button label""".split())
_OUTSIDE = frozenset("aside button dialog fieldset footer form header label menu nav".split())
#: Inside these, the tags that cannot stand in them, and so end them.
_ENDED_BY = {"option": _BLOCKS | {"option", "optgroup", "main"}, "select": _BLOCKS - {"hr", "button", "div", "legend", "label"},
             "svg": _BLOCKS | {"span", "b", "i", "em", "strong", "img"}}
_FOREIGN = frozenset(("foreignobject", "desc"))
WRAPPER_WORDS, WRAPPER_REST = 50, 10
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|menu|nav\w*|"
    r"newsletter|notice|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|"
    r"subscribe|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)
#: What a tag holds after its name: a value in quotes may hold < and >. A quote that nothing but white
#: space, / or > follows ends a value; one that no such quote follows is a character like others.
_ATTRIBUTES = (r"(?:(?:[^<>\x22\x27=]++|=\s*+(?:\x22[^\x22]*+\x22(?=[\s/>])|\x27[^\x27]*+\x27(?=[\s/>]))?+|[\x22\x27])*+(?=>)"
               r"|[^<>]*)")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?!\s*/>|[^<>]*[\s\x22\x27]/>){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/<>]*)({_ATTRIBUTES})>|<[/!?][^<>]*>",
    re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: words, share in links, the same of the block before and of the block after, outside, article,
#: heading; 1 for content. Chosen by hand after common page layouts.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "article", "heading")
LABELLED = (
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), 0),
    ((9, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), 0), ((14, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((40, 0.0, 5, 0.0, 90, 0.0, 1, 0, 0), 0), ((6, 0.5, 80, 0.0, 4, 1.0, 1, 1, 0), 0),
    ((30, 0.0, 70, 0.0, 20, 0.0, 1, 1, 0), 0), ((3, 0.0, 0, 0.0, 90, 0.0, 1, 0, 1), 0),
    ((120, 0.1, 10, 0.0, 40, 0.0, 1, 0, 0), 0), ((25, 0.0, 30, 0.0, 30, 0.0, 1, 1, 0), 0),
    ((10, 0.0, 8, 0.0, 120, 0.0, 0, 1, 1), 1), ((150, 0.0, 10, 0.0, 80, 0.0, 0, 1, 0), 1),
    ((1, 0.0, 90, 0.0, 110, 0.0, 0, 1, 0), 1), ((2, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((35, 0.3, 60, 0.0, 20, 0.0, 0, 1, 0), 1), ((5, 1.0, 60, 0.0, 50, 0.0, 0, 1, 0), 1),
    ((70, 0.05, 2, 0.0, 9, 0.0, 0, 1, 0), 1), ((4, 0.0, 9, 0.0, 9, 0.0, 0, 1, 1), 1),
    ((3, 0.0, 1, 1.0, 90, 0.0, 0, 1, 1), 1), ((2, 0.0, 4, 1.0, 2, 1.0, 0, 1, 0), 1),
    ((1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), 1), ((6, 0.9, 3, 1.0, 6, 1.0, 0, 1, 0), 1),
    ((5, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0), 1), ((4, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0), 1),
    ((1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0), ((2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), 0),
    ((12, 0.9, 3, 1.0, 6, 1.0, 0, 0, 0), 0), ((5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((4, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0), ((60, 0.8, 5, 1.0, 4, 1.0, 0, 0, 0), 0),
    ((7, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), 0), ((6, 0.0, 2, 0.8, 5, 0.9, 0, 0, 0), 0),
    ((60, 0.0, 6, 0.0, 45, 0.1, 0, 0, 0), 1), ((25, 0.1, 80, 0.0, 60, 0.0, 0, 0, 0), 1),
    ((8, 0.0, 1, 1.0, 90, 0.0, 0, 0, 1), 1), ((6, 0.0, 70, 0.0, 85, 0.0, 0, 0, 0), 1),
    ((110, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((18, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0), 1),
    ((9, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1), 1), ((45, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0), 1),
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: bool
    article: bool
    heading: bool
    marks: tuple = ()

    @property
    def links(self) -> float:
        return self.linked / self.words


@dataclass
class _Open:
    tag: str
    outside: bool
    article: bool
    marks: tuple = ()


@dataclass
class _Mark:
    """A container with a keyword; it is a wrapper if it is, or has inside, what has the article."""

    wrapper: bool


@dataclass
class _Page:
    """The state while a page is cut."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False)])
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    heading: bool = False
    marked: bool = False
    head: bool = False
    #: Names of open elements; those in an element whose text is dropped, itself first.
    open: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    def add(self, text: str) -> None:
        if self.dropped:
            return
        self.parts.append(text)
        if self.in_link:
            self.linked.append(text)

    def close_block(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text and not self.head:
            top = self.stack[-1]
            linked = len(html.unescape(" ".join(self.linked)).split())
            words = text.count(" ") + 1
            self.blocks.append(Block(text, words, min(linked, words), top.outside or self.marked, top.article, self.heading,
                                     top.marks))
        self.parts, self.linked = [], []

    def drop(self, closing: bool, name: str, attributes: str) -> bool:
        """Whether a tag belongs to an element whose text is dropped; keeps the names of open elements."""
        bare = attributes.strip() == "/" or attributes.endswith(("\"/", "'/", " /", "\t/", "\n/"))
        if self.dropped:
            if closing:
                if name in self.dropped:
                    del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(name):]
                    return True
                if name not in self.open:
                    return True
                self.dropped.clear()
            else:
                while self.dropped:
                    inner = next((x for x in reversed(self.dropped) if x in _ENDED_BY or x in _FOREIGN), "")
                    if name not in _ENDED_BY.get(inner, ()):
                        break
                    del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(inner):]
        if closing:
            if name in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(name):]
        elif name not in _VOID and not bare:
            if self.dropped or name in _DROPPED:
                self.dropped.append(name)
            elif name not in ("p", "li") or self.open[-1:] != [name]:
                self.open.append(name)
        return bool(self.dropped) or name in _DROPPED

    def tag(self, closing: bool, name: str, attributes: str) -> None:
        if self.drop(closing, name, attributes):
            return
        if name == "a":
            self.in_link = not closing
            return
        named = not closing and bool(attributes) and any(
            _MARKED.search(a or b or c) for a, b, c in _NAMED.findall(attributes))
        if name not in _BLOCKS and not (name == "span" and named):
            return
        self.close_block()
        self.marked, self.heading = False, False
        if name in ("html", "head", "body"):
            self.head = name == "head" and not closing
            return
        self.head = False
        if name not in _CONTAINERS:
            self.marked = named
            if name == "h1" and not closing and self.stack[-1].marks:
                self.stack[-1].marks[-1].wrapper = True
            self.heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        elif not closing:
            top = self.stack[-1]
            article = top.article or name in ("article", "main")
            outside = name in _OUTSIDE and not (name == "header" and top.article)
            marks = (*top.marks, _Mark(False)) if named else top.marks
            if name in ("article", "main") and marks:
                marks[-1].wrapper = True
            self.stack.append(_Open(name, top.outside or outside, article, marks))
        elif any(x.tag == name for x in self.stack):
            while self.stack.pop().tag != name:
                pass


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text in them, in order."""
    state, at = _Page(), 0
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            state.add(page[at:found.start()])
        at = found.end()
        if found.group(3):
            state.tag(bool(found.group(2)), found.group(3).lower(), found.group(4))
    state.add(page[at:])
    state.close_block()
    settle_marks(state.blocks)
    return state.blocks


def settle_marks(of: list[Block]) -> None:
    """Takes the marks of wrappers off, the inner ones first; the text of all other marked containers is outside."""
    inside = [b for b in of if not b.outside]
    total = sum(b.words - b.linked for b in inside)
    while True:
        own: dict[int, int] = {}
        marks = {id(b.marks[-1]): b.marks[-1] for b in inside if b.marks}
        for b in inside:
            key = id(b.marks[-1]) if b.marks else 0
            own[key] = own.get(key, 0) + b.words - b.linked
        lifted = {k for k, m in marks.items() if own[k] > 0 and 2 * own[k] >= total and (
            m.wrapper or (own[k] >= WRAPPER_WORDS and WRAPPER_REST * own.get(0, 0) < own[k]))}
        if not lifted:
            break
        for b in inside:
            if b.marks and id(b.marks[-1]) in lifted:
                if marks[id(b.marks[-1])].wrapper and len(b.marks) > 1:
                    b.marks[-2].wrapper = True
                b.marks = b.marks[:-1]
    for b in inside:
        b.outside = bool(b.marks)


def features(of: list[Block]) -> list[tuple]:
    around = [Block("", 1, 0, False, False, False), *of, Block("", 1, 0, False, False, False)]
    around[0].words = around[-1].words = 1
    rows = []
    for k in range(1, len(around) - 1):
        before, own, after = around[k - 1], around[k], around[k + 1]
        rows.append((own.words, own.links, before.words if before.text else 0, before.links,
                     after.words if after.text else 0, after.links, int(own.outside), int(own.article), int(own.heading)))
    return rows


def grow(rows: list[tuple[tuple, int]], depth: int = 6) -> tuple:
    """A tree of (feature, limit, up to the limit, above) by Gini impurity; leaves are (label,)."""
    ones = sum(y for _, y in rows)
    majority = (int(2 * ones >= len(rows)),)
    if depth == 0 or ones in (0, len(rows)):
        return majority

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            left, right = [r for r in rows if r[0][f] <= limit], [r for r in rows if r[0][f] > limit]
            score = impurity(left) + impurity(right)
            if best is None or score < best[0]:
                best = (score, f, limit, left, right)
    if best is None:
        return majority
    _, f, limit, left, right = best
    return f, limit, grow(left, depth - 1), grow(right, depth - 1)


@cache
def tree() -> tuple:
    return grow(list(LABELLED))


def is_content(row: tuple) -> bool:
    node = tree()
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node[0])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, features(found)) if is_content(row))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(value.as_py()) for value in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; a null or empty page has an empty text. Repeated rows stay."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long")

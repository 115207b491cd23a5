"""HTML extraction (operator 5) by tag-path ratios: text length and punctuation are aggregated per root-to-leaf
tag path of a page, smoothed over the page's blocks, fused, and thresholded; what passes shows where the article
lies, and the article's blocks are returned in page order.

A page is read in time linear in its length, however its tags are broken or nested: places of quotes and ends of tags
are found once, paths are numbers, and what is asked of the elements around a block is kept with each element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import tidy

TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|(!--)|[!?])")
MARKS = re.compile("[>\"']")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

# Fixed values of HTML: elements without an end, with raw text, of running text; what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("article aside body blockquote div dl fieldset figure footer form header html main nav ol section table td th ul".split())
CLOSES_P = CONTAINERS | frozenset("address details h1 h2 h3 h4 h5 h6 hr p pre li dt dd tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table select".split())
LISTED = LISTS.union(CLOSED_BY, *CLOSED_BY.values())
# Elements and names of page furniture. "has-sidebar" and the like don't name the element itself.
FURNITURE = frozenset("nav header footer aside form button select menu dialog head".split())


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bwithout)(?<!\bno)[_-])(?:{words})(?=$|[\s_-])", re.I)


FURNITURE_NAME = _names(
    r"ads?|advert\w*|adverts|sponsor\w*|promo\w*|banner|sidebar|side-?bar|comments?|replies|respond|responses|disqus|notice|notices|cookie\w*|consent|alert|popup|modal|overlay"
    r"|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|share|sharing|social|subscribe|newsletter|signup|login|pagination|pager|widget|toolbar|skip|complementary|contentinfo"
)
#: Names of furniture that parts of articles have too, and those of them that lower a ratio (the others make it 0).
OPEN_NAME = _names(r"discussion|header|related|recommend\w*|search")
TEXT_NAME = _names(r"discussion|related|recommend\w*")
#: A section's id is mostly the anchor of its heading; these are furniture all the same.
SECTION_ID = _names(r"ads?|advert\w*|sponsor\w*|promo\w*|sidebar|side-?bar|comments?|replies|respond|responses|disqus|newsletter|subscribe|footer")
#: Blocks to either side that a block's ratio is smoothed with, and their weights.
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
#: A path is content if its fused ratio reaches this share of the page's largest.
SHARE = 0.1
#: <article> and <main> bound the article if they hold at least this share of the text of content paths.
CORE = 0.9
#: What a name in OPEN_NAME leaves of a path's ratio; the share of links from which such a part of the article is furniture.
LOWERED, LINKED = 0.3, 0.3
#: A named element wraps the article if it has this share of the text, or WRAPS and nothing like an article lies outside it.
HOLDS, WRAPS = 0.9, 0.5


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    parent: Element | None
    furniture: bool = False
    #: Its number in page order, and the largest below it; its path's number.
    no: int = 0
    last: int = 0
    path: int = 0
    #: The innermost element with a name of furniture, itself included; which kind this one is: "", "open" or "named".
    suspect: Element | None = None
    kind: str = ""
    lowered: float = 1.0
    #: From the root to here: <article>, <main> and <h1>; headings; the outermost <article> or <main>.
    landmarks: int = 0
    headings: int = 0
    outer: Element | None = None
    #: The nearest, itself included, that an open paragraph can't reach beyond, and that parts of lists ask about.
    stop: Element | None = None
    listed: Element | None = None

    def holds(self, other: Element) -> bool:
        return self.no <= other.no <= self.last


@dataclass(eq=False, slots=True)
class Block:
    at: Element
    path: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Tags:
    """Ends of a page's tags."""

    def __init__(self, page: str) -> None:
        self.page, self.marks = page, [m.start() for m in MARKS.finditer(page)]
        self.open: set[int] = set()  # quotes, met outside quotes, from which no end of a tag is reached

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at a place: the first > outside quotes, or if there is none the first; -1
        if there is none at all."""
        i, met = bisect_left(self.marks, at), []
        while i < len(self.marks) and (mark := self.marks[i]) not in self.open:
            if self.page[mark] == ">":
                return mark
            met.append(mark)
            close = self.page.find(self.page[mark], mark + 1)
            if close < 0:
                break
            i = bisect_left(self.marks, close + 1, i)
        self.open.update(met)
        return self.page.find(">", at)


def mark(made: Element, named: list[tuple[str, str]]) -> None:
    """Notes what the element's names say."""
    names = " ".join(x for _, x in named)
    if FURNITURE_NAME.search(names):
        ids = made.tag == "section" and not any(FURNITURE_NAME.search(x) for kind, x in named if kind != "id") and not SECTION_ID.search(names)
        made.kind, made.lowered = ("open", LOWERED) if ids else ("named", 0.0)
    elif OPEN_NAME.search(names):
        made.kind, made.lowered = "open", LOWERED if TEXT_NAME.search(names) or made.tag == "section" else 0.0
    if made.kind:
        made.suspect = made


class Tree:
    """Elements and blocks of text of a page, as its tags are read."""

    def __init__(self) -> None:
        self.root = Element("#", None)
        self.root.stop = self.root.listed = self.root
        self.at, self.elements = self.root, [self.root]
        self.opened: Counter[str] = Counter()
        self.paths: dict[tuple[int, str, str], int] = {}
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.link = 0

    def text(self, s: str) -> None:
        if self.current is None:
            if not s or s.isspace():
                return
            self.current = Block(self.at, self.at.path)
            self.blocks.append(self.current)
        self.current.parts.append(s)
        if self.link:
            self.current.linked += len(s.strip())

    def leave(self, to: Element) -> None:
        while self.at is not to:
            self.opened[self.at.tag] -= 1
            self.at = self.at.parent

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in INLINE or not self.opened[tag]:
            return
        up = self.at
        while up.tag != tag:
            up = up.parent
        self.leave(up.parent)
        self.current, self.link = None, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.current is not None:
                self.current.parts.append(" ")
            return
        if tag in INLINE:
            self.link += tag == "a"
            return
        if tag in VOID:
            if tag == "hr":
                self.current = None
            return
        self.current, self.link = None, 0
        if tag in CLOSES_P and self.at.stop.tag == "p":
            self.leave(self.at.stop.parent)
        if tag in CLOSED_BY:
            up = self.at.listed
            while up is not self.root and up.tag not in LISTS and up.tag not in CLOSED_BY[tag]:
                up = up.parent.listed
            while up.tag in CLOSED_BY[tag]:
                self.leave(up.parent)
                up = self.at
        named = [(kind.lower(), a or b or c) for kind, a, b, c in NAMED.findall(attributes)]
        names = " ".join(x for _, x in named)
        up = self.at
        path = self.paths.setdefault((up.path, tag, names), len(self.paths) + 1)
        made = Element(tag, up, up.furniture or tag in FURNITURE, len(self.elements), 0, path, up.suspect)
        made.landmarks, made.headings = up.landmarks + (tag in ("article", "main", "h1")), up.headings + (tag in HEADINGS)
        made.outer = up.outer or (made if tag in ("article", "main") else None)
        made.stop = made if tag == "p" or tag in CONTAINERS else up.stop
        made.listed = made if tag in LISTED else up.listed
        if names and tag not in ("body", "html") and tag not in HEADINGS:
            mark(made, named)
        self.elements.append(made)
        if not attributes.endswith("/"):
            self.at = made
            self.opened[tag] += 1

    def close(self) -> None:
        for x in reversed(self.elements):
            x.last = max(x.last, x.no)
            if x.parent is not None:
                x.parent.last = max(x.parent.last, x.last)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        self.blocks = [b for b in self.blocks if b.text]


def tree_of(page: str) -> Tree:
    """A page's elements and blocks of text, with their tag paths (block elements with their names), in page order."""
    tree, tags, last = Tree(), Tags(page), page.rfind(">")
    position = scan = 0  # the text not yet taken; where to look for the next tag
    while (lt := page.find("<", scan)) >= 0:
        if lt > last and page[lt + 1 : lt + 2] and page[lt + 1] in "/!" or lt > last and page[lt + 1 : lt + 2].isascii() and page[lt + 1 : lt + 2].isalpha():
            break  # a tag that doesn't end
        scan = lt + 1
        if (m := TAG.match(page, lt)) is None or lt > last:
            continue
        if m[3]:
            close = page.find("-->", m.end())
            end = close + 3 if close >= 0 else len(page)
        else:
            end = (tags.end(m.end()) if m[2] else page.find(">", lt)) + 1
        if lt > position:
            tree.text(html.unescape(page[position:lt]))
        position = scan = end
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            tree.end(tag)
        elif tag in RAW:
            found = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            position = scan = found.end() if found else len(page)
        else:
            tree.start(tag, attributes)
    if position < len(page):
        tree.text(html.unescape(page[position : lt if lt >= 0 else len(page)]))
    tree.close()
    return tree


def fuse(blocks: list[Block]) -> dict[int, float]:
    """Per path: text length and punctuation per block, fused (their product's root), less the share of links."""
    chars, marks, count, linked = (defaultdict(float) for _ in range(4))
    for b in blocks:
        chars[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        linked[b.path] += min(b.linked, len(b.text))
        count[b.path] += 1
    return {p: (chars[p] / n) ** 0.5 * (1 + marks[p] / n) ** 0.5 * (1 - linked[p] / chars[p]) for p, n in count.items()}


def ratios(blocks: list[Block], fused: dict[int, float], weights: dict[int, float]) -> dict[int, float]:
    """Per path: the fused ratio, weighted and smoothed over the page."""
    own = np.array([fused[b.path] * weights[b.path] for b in blocks])
    half = len(KERNEL) // 2
    smooth = np.convolve(np.pad(own, half, mode="edge"), KERNEL, mode="valid")
    total, count = defaultdict(float), defaultdict(int)
    for b, v in zip(blocks, smooth, strict=True):
        total[b.path] += v * weights[b.path]
        count[b.path] += 1
    return {p: (v / count[p] * fused[p] * weights[p]) ** 0.5 for p, v in total.items()}


def outside_of(x: Element) -> Element | None:
    """The next element with a name of furniture around one."""
    return x.parent.suspect


def wrappers(blocks: list[Block], suspects: list[Element], fused: dict[int, float]) -> set[Element]:
    """Elements with a name of furniture that wrap the article, so that their names don't count. suspects: all with
    such a name, in page order. Those that hold the same text, one in the other, are looked at as one."""
    held: Counter[Element] = Counter()
    for b in blocks:
        if b.at.suspect is not None:
            held[b.at.suspect] += len(b.text)
    for x in reversed(suspects):
        if (up := outside_of(x)) is not None:
            held[up] += held[x]
    same: dict[Element, Element] = {}
    for x in suspects:
        up = outside_of(x)
        same[x] = same[up] if up is not None and held[up] == held[x] else x
    cleared: set[Element] = set()
    total = sum(len(b.text) for b in blocks)
    while True:
        first: dict[Element, Element | None] = {}
        for x in suspects:
            up = outside_of(x)
            first[x] = (first[up] if up is not None else None) or (None if same[x] in cleared else same[x])
        within: dict[int, list[Block]] = defaultdict(list)
        outside = []
        for b in blocks:
            x = first[b.at.suspect] if b.at.suspect is not None else None
            (within[x.path] if x is not None else outside).append(b)
        sizes = {p: sum(len(b.text) for b in v) for p, v in within.items()}
        most = max(sizes, key=sizes.__getitem__, default=0)
        if not sizes or sizes[most] < WRAPS * total:
            return {x for x in suspects if same[x] in cleared}
        inner = within[most]
        inside = any(same[b.at.suspect] is first[b.at.suspect] and b.at.landmarks > first[b.at.suspect].parent.landmarks for b in inner)
        beside = any(b.at.landmarks for b in outside)
        weak = max((fused[b.path] for b in outside), default=0.0) < 0.5 * max(fused[b.path] for b in inner)
        if inside < beside or (inside == beside and not weak and sizes[most] < HOLDS * total):
            return {x for x in suspects if same[x] in cleared}
        cleared |= {first[b.at.suspect] for b in inner}


def cores(content: list[Block]) -> set[Element]:
    """The elements that bound the article: <article> or <main>, else the innermost one around all content."""
    held: Counter[Element] = Counter()
    for b in content:
        if b.at.outer is not None:
            held[b.at.outer] += len(b.text)
    if held and held.total() >= CORE * sum(len(b.text) for b in content):
        return set(held)
    core = content[0].at
    for b in content:
        while not core.holds(b.at):
            core = core.parent
    while (core.tag in LEAF or core.tag == "section") and core.parent is not None:
        core = core.parent
    return {core}


def loose_links(blocks: list[Block], passed: set[Block]) -> set[Block]:
    """Where only the page bounds the article: blocks of paths that are mostly links, before its first heading or
    content, or after its last content and not under a heading."""
    chars, linked = defaultdict(int), defaultdict(int)
    for b in blocks:
        chars[b.path] += len(b.text)
        linked[b.path] += min(b.linked, len(b.text))
    last = max(i for i, b in enumerate(blocks) if b in passed)
    out, inside = set(), False
    for i, b in enumerate(blocks):
        if i == last + 1 and not blocks[last].at.headings:
            inside = False
        inside |= b in passed or b.at.headings > 0
        if not inside and 2 * linked[b.path] >= chars[b.path]:
            out.add(b)
    return out


def main_text(page: str) -> str:
    """The article of a page; empty if there is none. What its bounds hold and what passes is returned, but for
    furniture: elements of FURNITURE, named ones, and parts with a name in OPEN_NAME that are mostly links."""
    tree = tree_of(page)
    blocks, suspects = tree.blocks, [x for x in tree.elements if x.kind]
    fused = fuse(blocks)
    cleared = wrappers([b for b in blocks if not b.at.furniture], suspects, fused)
    # what the names around a place say, those of wrappers aside: whether all are open, and the least ratio
    named: dict[Element | None, tuple[bool, float]] = {None: (True, 1.0)}
    for x in suspects:
        opened, lowered = named[outside_of(x)]
        named[x] = (opened, lowered) if x in cleared else (opened and x.kind == "open", min(lowered, x.lowered))
    plain = [b for b in blocks if not b.at.furniture and named[b.at.suspect][0]]
    if not plain:
        return ""
    weights = dict.fromkeys(fused, 0.0)
    for b in plain:
        weights[b.path] = named[b.at.suspect][1]
    ratio = ratios(blocks, fused, weights)
    most = max(ratio[b.path] for b in plain)
    # nothing but links: the article's
    content = [b for b in plain if (ratio[b.path] >= SHARE * most if most > 0 else b.at.outer is not None)]
    if not content:
        return ""
    bounds, passed = cores(content), set(content)
    chars, linked = Counter(), Counter()
    for b in plain:
        if (x := b.at.suspect) is not None:
            chars[x] += len(b.text)
            linked[x] += b.linked if b.at.headings == x.headings else 0
    for x in reversed(suspects):
        if (up := outside_of(x)) is not None:
            chars[up] += chars[x]
            linked[up] += linked[x] if x.headings == up.headings else 0
    mostly_text: dict[Element | None, bool] = {None: True}
    for x in suspects:
        mostly_text[x] = mostly_text[outside_of(x)] and (x in cleared or not linked[x] or linked[x] < LINKED * chars[x])
    loose = loose_links(plain, passed) if any(x.tag in ("body", "html", "#") for x in bounds) else set()
    core = next(iter(bounds))
    out = []
    for b in plain:
        held = b not in loose and (b.at.outer in bounds or core.holds(b.at)) and mostly_text[b.at.suspect]
        if held or b in passed:
            out.append(b.text)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id_col, url_col, text, n_chars (code points).

    A null html counts as empty and gives an empty text. Null ids, null urls and repeated rows are returned as they
    are; other columns aren't read. An empty table gives no rows. Pages of any length and depth are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [main_text(x or "") for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    found = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).mapInArrow(tidy(run), f"_id {kinds[0]}, _url {kinds[1]}, text string")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))

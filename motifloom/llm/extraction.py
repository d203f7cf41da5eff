"""Main text of HTML pages by a minimum cut.

A page is read into blocks: text between the borders of block elements, in page order.  A linear classifier turns the
regions a block lies in (semantic elements, roles, class and id words) and its text (length, links, punctuation) into
a cost for either label; these costs are the capacities from the source (content) and to the sink (boilerplate).
Neighbouring blocks, and successive blocks of one parent, are tied by smoothness edges that weaken with the distance in
the tree of elements, and between regions.  The maximum flow separates both; what the source still reaches is content.

Navigation, footers, comments and hidden parts are named by elements, roles and plain words; such a region outweighs the
text.  Other words (``legal``, ``share``, ``form`` and the like) and forms are a prior only: it falls with the share of
the page's text that the region holds, as what holds most of a page is not beside it.  Blocks of no region are told by
their text and by their neighbours, as the cut decides.

Markup is read by a scanner of its own that never looks back, so a page takes time in proportion to its length, whatever
is left open, nested or malformed in it, and raises no error.  A tag that does not end is dropped, as is a comment, and
declarations of any form are skipped.  Null and empty pages give an empty text.  Text of scripts, styles, comments,
templates, heads and controls is no block.  White space of a block becomes one space; blocks are joined by one space.
Repeated rows give repeated rows, an empty table none.  Of several minimum cuts that with the fewest content blocks
counts.  Very long and very deep pages are read whole.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and the words that name regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div body main nav aside footer header form blockquote".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
LASTING_WORDS = frozenset("comment comments commentlist disqus reply replies respond respondents related recommended recommendations sidebar aside".split())
BOILER_WORDS = LASTING_WORDS | frozenset("ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social widget pagination pager tags copyright legal disclaimer skip search form".split())
#: Of these, words that articles and whole pages are named by as well.
DOUBTFUL_WORDS = frozenset("legal share social search tags skip alert notice form header disclaimer copyright login pagination widget promotion banner overlay subscription".split())
CONTENT_WORDS = frozenset("article content post entry story main maintext bodytext articlebody posttext prose".split())

#: What may stand in a head; any other element ends it.
HEAD_TAGS = frozenset("html head base link meta title style script noscript template".split())
#: Words of a class that says how a page is laid out: those after the first set name no region, boilerplate before the second none, nor does a mix of both before the third.
LAYOUT_HAS, LAYOUT_STATES, LAYOUT_WRAPS = frozenset("has with no without".split()), frozenset("open closed enabled disabled".split()), frozenset("wrap wrapper container".split())

_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_space = re.compile(r"\s+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search


def region_words(name: str) -> set[str]:
    """The words of a class or id that name a region; of names of a layout, like has-sidebar, those about it are none."""
    words = [w.lower() for w in _words.findall(name)]
    at = next((i for i, w in enumerate(words) if w in LAYOUT_HAS), len(words))
    found = set(words[:at])
    if words and words[-1] in LAYOUT_STATES:
        found -= BOILER_WORDS
    elif words and words[-1] in LAYOUT_WRAPS and found & CONTENT_WORDS and found & BOILER_WORDS:
        found -= CONTENT_WORDS | BOILER_WORDS
    return found


class Element:
    """An open element: its region is 1 in content, -1 in boilerplate, 0 unknown; ``lasting`` boilerplate isn't left by
    an article; ``doubt`` is the element that only words in doubt, or a form, call boilerplate."""

    __slots__ = ("tag", "key", "parent", "region", "lasting", "doubt", "skipped", "link", "depth")

    def __init__(self, tag: str, key: int, above: Element | None) -> None:
        self.tag, self.key = tag, key
        self.parent, self.region, self.lasting, self.doubt, self.skipped, self.link, self.depth = (above.key, above.region, above.lasting, above.doubt, above.skipped, above.link, above.depth + 1) if above else (-1, 0, False, 0, False, False, 0)


@dataclass(frozen=True)
class Block:
    """A text with its share of link characters, element, region, and distance from the block before in the tree."""

    text: str
    links: float
    tag: str
    parent: int
    region: int
    doubt: int
    distance: int


_name = re.compile(r"[^\s/>=]*")
_gap = re.compile(r"[\s/]*")
_tag_name = re.compile(r"[^\s/>]*")
_assigned = re.compile(r"\s*=\s*")
_bare = re.compile(r"[^\s>]*")
_raw_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
_number = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]+)|0*([0-9]+));?")
#: The attributes that are read.
ATTRIBUTES = frozenset("class id role hidden aria-hidden style".split())


def decoded(text: str) -> str:
    """Character references resolved; numbers of more digits than any character has are none."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _number.sub(lambda m: m[0] if len(m[1] or m[2]) < 8 else "\ufffd", text)
    return unescape(text)


class Scanner:
    """Reads markup from left to right and calls ``start``, ``end`` and ``data``; what is left open is skipped at once,
    as the last places of its possible ends are known."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last = {x: html.rfind(x) for x in ('"', "'", ">", "-->", "--!>")}

    def find(self, what: str, at: int) -> int:
        """The next place, -1 if there is none, which takes no search."""
        return self.html.find(what, at) if at <= self.last[what] else -1

    def read(self) -> None:
        html, at = self.html, 0
        while at < len(html):
            tag = html.find("<", at)
            if tag < 0:
                tag = len(html)
            if tag > at:
                self.data(decoded(html[at:tag]))
            if tag + 1 >= len(html):
                break
            c = html[tag + 1]
            if c.isascii() and c.isalpha():
                at = self.tag(tag)
            elif c == "/":
                at = self.find(">", tag + 2) + 1
                name = _tag_name.match(html, tag + 2)[0].lower()
                if at and name[:1].isalpha():
                    self.end(name)
            elif html.startswith("<!--", tag):
                ends = [e for e in (self.find("-->", tag + 2), self.find("--!>", tag + 4)) if e >= 0]
                at = html.index(">", min(ends)) + 1 if ends else 0
            elif c in "!?":
                at = self.find(">", tag + 2) + 1
            else:
                self.data("<")
                at = tag + 1
            if not at:  # nothing ends it
                break

    def tag(self, at: int) -> int:
        """Reads a start tag; returns where the text goes on, 0 if it does not end."""
        html = self.html
        name = _tag_name.match(html, at + 1)
        tag, found, at = name[0].lower(), {}, name.end()
        while True:
            at = _gap.match(html, at).end()
            if at > self.last[">"]:
                return 0
            if html[at] == ">":
                break
            own = _name.match(html, at + 1) if html[at] == "=" else _name.match(html, at)
            key, at, value = html[at : own.end()].lower(), own.end(), None
            sign = _assigned.match(html, at)
            if sign:
                at = sign.end()
                quote = html[at : at + 1]
                close = self.find(quote, at + 1) if quote and quote in "\"'" else -1
                if close >= 0:
                    value, at = (at + 1, close), close + 1
                else:
                    end = _bare.match(html, at).end()
                    value, at = (at, end), end
            if key in ATTRIBUTES and key not in found:
                found[key] = decoded(html[value[0] : value[1]]) if value else ""
        self.start(tag, found)
        at += 1
        if tag in _raw_ends:
            close = _raw_ends[tag].search(html, at)
            if not close:
                return len(html)
            at = self.find(">", close.end()) + 1
            self.end(tag)
        return at


class Blocks(Scanner):
    """Collects the blocks of a page."""

    def __init__(self, html: str) -> None:
        super().__init__(html)
        self.keys = 0
        self.open = [Element("", 0, None)]
        self.places: dict[str, list[int]] = {}  # where elements of a tag are open, so that no search walks the page's depth
        self.blocky = [0]  # where elements that are not inline are open
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = 0
        self.at = self.open[0]
        self.depth = self.low = 0  # of the last block, and the least since then

    def border(self) -> None:
        if self.text:
            text = _space.sub(" ", "".join(self.text)).strip()
            if text:
                at, low = self.at, min(self.low, self.at.depth)
                self.blocks.append(Block(text, min(1.0, self.linked / len(text)), at.tag, at.key, at.region, at.doubt, self.depth + at.depth - 2 * low))
                self.depth, self.low = at.depth, at.depth
            self.text, self.linked = [], 0

    def nearest(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of some tags is, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_from(self, i: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self.open) > i:
            tag = self.open.pop().tag
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocky.pop()
        self.low = min(self.low, self.open[-1].depth)

    def end_head(self) -> None:
        """Closes a head that is left open, as what cannot stand in it does."""
        if self.open[-1].tag == "head":
            self.close_from(len(self.open) - 1)

    def close_to(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Closes the nearest of ``tags`` that is open within ``scope``."""
        i = self.nearest(tags)
        if i > self.nearest(scope):
            self.close_from(i)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag not in HEAD_TAGS:
            self.end_head()
        if tag == "br":
            self.text.append(" ")
            return
        inline = tag in INLINE
        if not inline:
            self.border()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_to(("p",), SCOPE)
        if tag in SAME:
            self.close_to(SAME[tag], frozenset({"ul", "ol", "dl", "table"}))
        if tag == "body":
            self.close_from(self.nearest(("html",)) + 1)
        self.keys += 1
        new = Element(tag, self.keys, self.open[-1])
        self.place(new, attrs)
        self.places.setdefault(tag, []).append(len(self.open))
        if not inline:
            self.blocky.append(len(self.open))
        self.open.append(new)

    def place(self, new: Element, attrs: dict[str, str]) -> None:
        """The region that a new element opens."""
        tag = new.tag
        new.skipped = new.skipped or tag in SKIPPED
        new.link = new.link or tag == "a"
        words = {w for k in ("class", "id") for name in (attrs.get(k) or "").split() for w in region_words(name)} if tag not in ("html", "body") else set()
        role = (attrs.get("role") or "").lower()
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or _hidden(attrs.get("style") or ""):
            new.region, new.lasting, new.doubt = -1, True, 0
        elif tag == "form" or role == "form":
            self.doubted(new)
        elif tag in BOILER_TAGS or role in BOILER_ROLES:
            new.region, new.lasting, new.doubt = -1, True, 0
        elif tag in CONTENT_TAGS or role in CONTENT_TAGS:
            if words & LASTING_WORDS:
                new.region, new.lasting, new.doubt = -1, True, 0
            elif not new.lasting or tag == "main":
                new.region, new.lasting, new.doubt = 1, False, 0
        elif words & BOILER_WORDS and not words & CONTENT_WORDS or words & LASTING_WORDS:
            if words & BOILER_WORDS <= DOUBTFUL_WORDS:
                self.doubted(new)
            else:
                new.region, new.lasting, new.doubt = -1, new.lasting or bool(words & LASTING_WORDS), 0
        elif tag == "header":
            self.doubted(new)
        elif words & CONTENT_WORDS and not new.lasting and (new.region >= 0 or new.doubt):
            new.region, new.doubt = 1, 0
        elif tag == "h1" and new.region < 0 and not new.lasting and self.nearest(CONTENT_TAGS):
            new.region, new.doubt = 1, 0  # the headline in an article's own header

    def doubted(self, new: Element) -> None:
        """A region that its name calls boilerplate, but that may hold the article."""
        if new.region >= 0:
            new.region, new.doubt = -1, new.key

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            return
        if tag not in INLINE:
            self.border()
        i = self.nearest((tag,))
        if i and (tag not in INLINE or i > self.blocky[-1]):
            self.close_from(i)

    def data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        top = self.open[-1]
        if top.skipped:
            return
        if not self.text:
            block = self.open[self.blocky[-1]]
            self.at = block if block.region == top.region else top
        elif top.region != self.at.region and data.strip():
            self.border()  # an inline element that is a region of its own
            self.at = top
        self.text.append(data)
        if top.link:
            self.linked += len(data.strip())


def score(block: Block, prior: float) -> float:
    """Log-odds that a block is content; weights are set by hand, as there are no labelled pages to fit them to."""
    text = block.text
    words = text.count(" ") + 1
    z = prior
    z += min(words, 40) / 10 - 0.5
    z -= 4.0 * block.links
    z += 0.7 if text[-1] in ".!?…:;\"'”»)" else -0.3
    if block.tag in ("p", "blockquote", "pre", "h1"):
        z += 0.8
    elif block.tag in ("li", "td", "th", "dd", "dt", "option", "legend", "figcaption"):
        z -= 0.6
    if "©" in text and words < 40:
        z -= 3.0
    return z


def priors(blocks: list[Block], region: float = 8.0) -> list[float]:
    """What the regions say of each block; a region in doubt says less, the more of the page's text it holds."""
    held: dict[int, int] = {}
    for b in blocks:
        if b.region >= 0 or b.doubt:
            held[b.doubt] = held.get(b.doubt, 0) + len(b.text)
    total = sum(held.values())
    return [b.region * (region * (1 - held[b.doubt] / total) ** 2 if b.doubt else region) for b in blocks]


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut: node i has capacity max(score, 0) from the source and
    max(-score, 0) to the sink, edges have theirs both ways.

    Each source node sends flow along shortest residual paths; what it reaches once it is stuck lies on its side for
    good and is searched no more."""
    n = len(scores)
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    left = [-min(z, 0.0) for z in scores]
    mine = [False] * n
    for s in range(n):
        more = max(scores[s], 0.0)
        while more > 1e-9 and not mine[s]:
            came = {s: -1}
            queue, end = deque([s]), -1
            while queue:
                v = queue.popleft()
                if left[v] > 1e-9:
                    end = v
                    break
                for e in near[v]:
                    if room[e] > 1e-9 and to[e] not in came and not mine[to[e]]:
                        came[to[e]] = e
                        queue.append(to[e])
            if end < 0:
                for v in came:
                    mine[v] = True
                break
            path, v = [], end
            while came[v] >= 0:
                path.append(came[v])
                v = to[came[v] ^ 1]
            flow = min([more, left[end], *(room[e] for e in path)])
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
            more -= flow
            left[end] -= flow
    return mine


def blocks_of(html: str) -> list[Block]:
    parser = Blocks(html)
    parser.read()
    parser.border()
    return parser.blocks


def labels(blocks: list[Block], smooth: float = 2.4) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            weight = smooth * 2 / (2 + b.distance)
            edges.append((i - 1, i, weight if b.region == blocks[i - 1].region else weight / 4))
        if (j := last.get((b.parent, b.region))) is not None and j < i - 1:
            edges.append((j, i, smooth / 4))
        last[b.parent, b.region] = i
    return min_cut([score(b, p) for b, p in zip(blocks, priors(blocks))], edges)


def main_text(html: str) -> str:
    """The content blocks of a page, joined by spaces."""
    blocks = blocks_of(html)
    return " ".join(b.text for b, kept in zip(blocks, labels(blocks)) if kept)


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every row, ``text`` and ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) if h else "" for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    given = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    spare = "html"
    while spare in keep:
        spare += "_"
    return pages.select(*keep, pages[html_col].alias(spare)).mapInArrow(run, f"{given}, text string, n_chars long")

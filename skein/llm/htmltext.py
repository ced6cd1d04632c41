"""Main text of web pages: text-to-tag ratios over the parser's blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

#: Elements by what they are for. What HARD holds is never text; what SOFT holds stands
#: beside the text, if the element ends with its own end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
HARD = frozenset("button canvas datalist head iframe noscript object script select style svg template textarea title".split())
SOFT = frozenset("aside dialog footer form menu nav".split())
LANDMARKS = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div body table td center blockquote".split())
GROUPS = frozenset("article section div ol ul dl li blockquote table".split())
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: Words of classes and ids. STRANGE ones name comments and adverts, BESIDE ones other
#: things that aren't text, WEAK ones may be either; MODIFIERS say that another element is spoken of.
STRANGE = frozenset("ad ads adbox advert adverts advertisement advertising comment comments disqus replies sponsor sponsored".split())
BESIDE = frozenset(
    "breadcrumb breadcrumbs consent cookie cookies gdpr login masthead menu modal nav navbar navigation newsletter pagination popup promo"
    " share sharing sidebar signup social subscribe subscription".split()
)
WEAK = frozenset(
    "banner disclaimer discussion footer notice notices overlay promotion recommended related reply respond responses toolbar topbar widget widgets".split()
)
MODIFIERS = frozenset("closed container content enabled has is layout main no not open page post the with without wrap wrapper".split())
PERSONAL = frozenset("author avatar byline date name posted time timestamp user username".split())

#: Evidence from which an element is dropped.
ENOUGH = 2.0

#: Characters a tag from which text counts as text rather than links, where the clusters don't ask for less.
TEXT_RATIO = 15.0

_NAME = re.compile(r"[a-z]+")
_TAG_START = re.compile(r"<[A-Za-z/!?]")
_REMARKS = re.compile(r"^[0-9]*\s*(?:reader )?(?:comments?|replies|responses|remarks)\b|^leave a (?:reply|comment)", re.I)


@dataclass
class Element:
    """An open or ended element that may be no text, or that groups others."""

    tag: str
    soft: bool = False  # by tag or role
    name: float = 0.0  # evidence of class and id
    strange: bool = False  # whether they name comments or adverts
    parent: int = 0  # the nearest enclosing element on record
    kind: str = ""  # tag and class, which siblings may share
    closed: bool = False  # by its own end tag
    personal: bool = False  # whether it tells an author or a date
    children: list[int] = field(default_factory=list)


@dataclass
class Piece:
    """Text of a line under the same elements on record, with the tags seen in it and its characters in links."""

    texts: list[str]
    tags: int
    links: int
    within: tuple[int, ...]  # numbers of the elements


@dataclass
class Block:
    """A line of the page: its pieces and where it stands."""

    pieces: list[Piece]
    path: tuple[int, ...]  # numbers of the enclosing containers, outermost first
    landmark: int  # number of the outermost article or main; 0 outside

    def without(self, gone: set[int]) -> str:
        """The text but for the pieces under these elements."""
        return _plain(t for p in self.pieces if gone.isdisjoint(p.within) for t in p.texts)

    def measure(self, gone: set[int]) -> tuple[int, int, int]:
        """Characters, tags and characters in links, but for the pieces under these elements."""
        kept = [p for p in self.pieces if gone.isdisjoint(p.within)]
        return len(_plain(t for p in kept for t in p.texts)), sum(p.tags for p in kept), sum(p.links for p in kept)


def _plain(texts: Iterable[str]) -> str:
    return " ".join("".join(texts).split())


@dataclass
class _Open:
    tag: str
    hard: bool
    container: int = 0
    element: int = 0


class BlockParser(HTMLParser):
    """Turns parser events into blocks as they come.

    Text within what is never text is dropped at the moment it comes. Of other elements only
    a record is kept; whether they count is decided when the whole page is known, since an element that
    its end tag doesn't end tells nothing about what follows.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.elements: list[Element] = [Element("")]  # number 0 is the page
        self.stack: list[_Open] = []
        self.pieces: list[Piece] = []
        self.numbers = self.anchors = self.verbatim = 0
        self._moved()

    def _moved(self) -> None:
        """Note what the open elements say of text that comes now."""
        self.dropped = any(x.hard for x in self.stack)
        self.within = tuple(x.element for x in self.stack if x.element)

    def _add(self, text: str, tags: int) -> None:
        if self.dropped:
            return
        if not self.pieces or self.pieces[-1].within != self.within:
            self.pieces.append(Piece([], 0, 0, self.within))
        last = self.pieces[-1]
        last.tags += tags
        if text:
            last.texts.append(text)
            last.links += len(text) if self.anchors else 0

    def _flush(self) -> None:
        if not self.pieces:
            return
        if any(not t.isspace() for p in self.pieces for t in p.texts):
            outer = next((x.container for x in self.stack if x.tag in LANDMARKS), 0)
            self.blocks.append(Block(self.pieces, tuple(x.container for x in self.stack if x.container), outer))
        self.pieces = []

    def _hidden(self, tag: str, told: dict[str, str]) -> bool:
        """Whether the element is never text, or isn't shown."""
        shown = "display:none" not in told.get("style", "").replace(" ", "")
        return tag in HARD or "hidden" in told or told.get("aria-hidden") == "true" or not shown

    def _name(self, tag: str, told: dict[str, str]) -> tuple[float, bool]:
        """What class and id say against the element, and whether they name comments or adverts.

        They say nothing of headings, of what wraps the page and, within preformatted text, of code.
        """
        if tag in UNNAMED or self.verbatim or tag in LANDMARKS and not any(x.tag in LANDMARKS for x in self.stack):
            return 0.0, False
        most, strange = 0.0, False
        for token in (told.get("class", "") + " " + told.get("id", "")).split():
            words = set(_NAME.findall(token))
            own = 2.0 if words & (STRANGE | BESIDE) else 1.0 if words & WEAK else 0.0
            if words & MODIFIERS and own and len(words) > 1:
                own = 1.0
            strange |= own == 2.0 and bool(words & STRANGE)
            most = max(most, own)
        return most, strange

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            if self.dropped and tag not in ("head", "title") and any(x.tag == "head" for x in self.stack):  # the head may end without a tag
                del self.stack[next(k for k, x in enumerate(self.stack) if x.tag == "head") :]
                self._moved()
        self._add(" " if tag == "br" else "", 1)
        told = {name: (value or "").lower() for name, value in attrs} if attrs else {}
        said = _NAME.findall(told["class"]) if "class" in told else []
        personal = tag == "time" or not PERSONAL.isdisjoint(said) or told.get("rel") == "author"
        if personal:
            for x in self.stack:
                self.elements[x.element].personal = True
        if tag in VOID:
            return
        self.anchors += tag == "a"
        self.verbatim += tag in ("pre", "code")
        hard = self._hidden(tag, told) if told else tag in HARD
        soft = tag in SOFT or tag == "header" and not any(x.tag in LANDMARKS for x in self.stack) or told.get("role") in ROLES
        name, strange = self._name(tag, told) if told else (0.0, False)
        open_ = _Open(tag, hard)
        if tag in CONTAINERS:
            self.numbers += 1
            open_.container = self.numbers
        if soft or name or tag in GROUPS and not hard:
            parent = next((x.element for x in reversed(self.stack) if x.element), 0)
            open_.element = len(self.elements)
            self.elements.append(Element(tag, soft, name, strange, parent, f"{tag} {told.get('class', '')}", personal=personal))
            self.elements[parent].children.append(open_.element)
        if hard or open_.container or open_.element or tag == "header":
            self.stack.append(open_)
            self._moved()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no empty form of elements that aren't void

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._add("", 1)
        self.anchors = max(0, self.anchors - (tag == "a"))
        self.verbatim = max(0, self.verbatim - (tag in ("pre", "code")))
        stack = self.stack
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == tag:
                self.elements[stack[k].element].closed = stack[k].element > 0
                del stack[k:]
                self._moved()
                return
            if stack[k].tag in LANDMARKS and tag not in ("body", "html", *LANDMARKS):
                return  # an end tag without its start inside the article

    def handle_data(self, data: str) -> None:
        self._add(data, 0)

    def close(self) -> None:
        super().close()
        self._flush()


def page_blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The blocks of a page and the elements on record; a tag that the page's end cuts off is no text."""
    parser = BlockParser()
    last = html.rfind("<")
    whole = last < 0 or html.find(">", last) >= 0 or not _TAG_START.match(html, last)
    parser.feed(html if whole else html[:last])
    parser.close()
    return parser.blocks, parser.elements


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring blocks, with the kernel renormalised at the ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    over = np.convolve(np.pad(ratios, radius), kernel, "valid")
    return over / np.convolve(np.pad(np.ones(len(ratios)), radius), kernel, "valid")


def threshold(values: np.ndarray) -> float:
    """Where two clusters of values meet: the fixed point of the means above and below."""
    cut = float(values.mean())
    for _ in range(50):
        high, low = values[values >= cut], values[values < cut]
        if not len(low):
            break
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _beside(blocks: list[Block], elements: list[Element]) -> set[int]:
    """Menus, forms and the like, by tag or role: those that end by their own end tag.

    Of an element that doesn't, what follows may be text. A form that holds most of what isn't in
    others wraps the page.
    """
    gone = {k for k, e in enumerate(elements) if e.soft and e.closed}
    for k in [k for k in gone if elements[k].tag == "form"]:
        others = gone - {k}
        own = sum(len(_plain(p.texts)) for b in blocks for p in b.pieces if k in p.within and others.isdisjoint(p.within))
        if 2 * own > sum(len(b.without(others)) for b in blocks):
            gone.discard(k)
    return gone


class _Evidence:
    """What speaks against the elements of a page, of a landmark or none: by name, links, structure and place."""

    def __init__(self, blocks: list[Block], elements: list[Element], gone: set[int]):
        self.elements, self.under = elements, {}
        for at, b in enumerate(blocks):
            for p in b.pieces:
                if gone.isdisjoint(p.within) and (text := _plain(p.texts)):
                    for k in p.within:
                        held = self.under.setdefault(k, [0, 0, 0, at, at, text, set()])
                        held[0] += len(text)
                        held[1] += p.tags
                        held[2] += min(p.links, len(text))
                        held[4] = at
                        held[6].add(b.landmark)
        clear = lambda b: any(gone.isdisjoint(p.within) and not any(self._named(k) or self._listed(k) for k in p.within) and not "".join(p.texts).isspace() for p in b.pieces)
        self.last = max((at for at, b in enumerate(blocks) if clear(b)), default=-1)

    def _named(self, k: int) -> bool:
        return self.elements[k].name > 0

    def _listed(self, k: int) -> bool:
        """Whether an element holds two or more of a kind that each tell an author or a date, as comments do."""
        kinds = [self.elements[c].kind for c in self.elements[k].children if self.elements[c].personal]
        return any(kinds.count(x) > 1 for x in kinds)

    def of(self, k: int, cut: float) -> float:
        chars, tags, links, first, last, text, landmarks = self.under[k]
        e = self.elements[k]
        if not e.name and not self._listed(k) or landmarks - {0} and 0 in landmarks or e.tag in LANDMARKS and not e.name:
            return 0.0
        out = e.name
        out += 0.5 * (2 * links > chars) + 1.0 * (2 * chars < cut * max(1, tags))
        out += 1.0 * self._listed(k) + 1.0 * bool(_REMARKS.search(text)) + 0.5 * (first > self.last)
        return out


def _unlike_text(blocks: list[Block], elements: list[Element], gone: set[int], cut: float, level: np.ndarray) -> set[int]:
    """The elements whose evidence is enough, but not those that wrap the page or its article.

    An element wraps if it holds an article, or if no block of the clusters' text would remain
    without it; one that is named comments or adverts only if nothing at all would.
    """
    told, out = _Evidence(blocks, elements, gone), set()
    for k in sorted(told.under):
        if told.of(k, cut) < ENOUGH or elements[k].soft and k in gone:
            continue
        without = gone | out | {k}
        holds = {b.landmark for b in blocks for p in b.pieces if k in p.within}
        if _contains_landmark(blocks, k):
            continue
        rest = [b for b, x in zip(blocks, level, strict=True) if b.landmark in holds and b.without(without) and (elements[k].strange or x >= cut)]
        if rest:
            out.add(k)
    # A heading of comments goes with them: where nothing but it is left.
    for k in sorted(told.under):
        pieces = [p for b in blocks for p in b.pieces if k in p.within and gone.isdisjoint(p.within)]
        left = _plain(t for p in pieces if out.isdisjoint(p.within) for t in p.texts)
        if left and not all(out.isdisjoint(p.within) for p in pieces) and (said := _REMARKS.match(left)) and len(left) <= said.end() + 12:
            out.add(k)
    return out


def _contains_landmark(blocks: list[Block], k: int) -> bool:
    """Whether an element holds a whole outermost article: all text of it stands within."""
    for landmark in {b.landmark for b in blocks if b.landmark}:
        own = [b for b in blocks if b.landmark == landmark]
        if all(k in p.within for b in own for p in b.pieces if not "".join(p.texts).isspace()):
            return True
    return False


def _region(blocks: list[Block], gone: set[int], marked: list[Block], linked: list[Block], cut: float) -> list[Block]:
    """The content of a page without landmarks.

    Marked text counts for every container around it. The region is the smallest container that
    holds nine tenths of it, widened while what a wider one adds is text rather than links, and what is
    marked elsewhere.
    """
    held: dict[int, int] = {}
    for b in marked:
        for c in {0, *b.path}:
            held[c] = held.get(c, 0) + len(b.without(gone))
    way = max(([c for c in (0, *b.path) if 10 * held[c] >= 9 * held[0]] for b in marked), key=len)
    within = lambda c: [b for b in blocks if not c or c in b.path]
    links = {id(b) for b in linked}
    chosen = within(way[-1])
    for c in reversed(way[:-1]):
        wider = within(c)
        kept = {id(b) for b in chosen}
        more = [b for b in wider if id(b) not in kept]
        chars, tags, _ = (sum(x) for x in zip(*(b.measure(gone) for b in more), strict=True)) if more else (0, 0, 0)
        if more and (not links.isdisjoint(map(id, more)) or chars < min(cut / 2, TEXT_RATIO) * max(1, tags)):
            break
        chosen = wider
    kept = {id(b) for b in chosen} | {id(b) for b in marked}
    return [b for b in blocks if id(b) in kept]


def main_text(html: str | None, *, sigma: float = 1.0) -> str:
    """The main text of a page, its blocks joined by line feeds.

    Blocks are the lines; each has a score, the ratio of its characters to its tags. Menus, forms and
    the like, told by elements that end as they should, score 0, and so do lines of links. What class
    and id say lowers the score of their elements. The scores are smoothed and split into two clusters;
    the blocks of the high one mark the content. Elements are then dropped on joint evidence: names,
    links, a ratio below the border of the clusters by half, siblings of a kind that tell authors or
    dates, a heading that speaks of comments, and a place after all else. The region is all article
    and main elements that hold marked text or aren't mostly links, or else the container around the
    marked text; every other block there is content, short ones too. A null or empty page, or one without
    text, gives an empty text.
    """
    blocks, elements = page_blocks(html or "")
    gone = _beside(blocks, elements)
    # Lines of links in an element that doesn't end as it should are its own, what else comes there is text.
    open_ = {k for k, e in enumerate(elements) if e.soft and not e.closed}
    linked = []
    scores = []
    for b in blocks:
        chars, tags, links = b.measure(gone)
        if any(not open_.isdisjoint(p.within) for p in b.pieces) and 2 * links > chars:
            linked.append(b)
        doubt = min((max((elements[k].name for k in p.within), default=0.0) for p in b.pieces if not "".join(p.texts).isspace()), default=0.0)
        scores.append(0.0 if linked and linked[-1] is b else chars / max(1, tags) * max(0.0, 1 - doubt / ENOUGH))
    if not any(b.without(gone) for b in blocks):
        return ""
    level = smoothed(np.array(scores), sigma)
    cut = min(threshold(level), float(level.max()))
    gone |= _unlike_text(blocks, elements, gone, cut, np.array(scores))
    links = {id(b) for b in linked}
    kept = [b for b in blocks if b.without(gone) and id(b) not in links]
    marked = [b for b, x in zip(blocks, level, strict=True) if x >= cut and b.without(gone) and id(b) not in links]
    if any(b.landmark for b in kept):
        texts = {b.landmark for b in marked}
        for k in {b.landmark for b in kept} - texts:
            chars, _, inside = (sum(x) for x in zip(*(b.measure(gone) for b in kept if b.landmark == k), strict=True))
            if 2 * inside <= chars:
                texts.add(k)
        region = [b for b in kept if b.landmark and b.landmark in texts] or [b for b in kept if b.landmark]
    else:
        region = _region(kept, gone, marked, linked, cut) if marked else kept
    return "\n".join(b.without(gone) for b in region)


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    Returns:
        page_id, url, text, n_chars: a row per input row; null pages have an empty text, and
        repeated rows the same one. Other columns are ignored, whatever their names. An empty
        table gives an empty one.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = main_text(html)
                rows.append((page, url, text, len(text)))
            yield rows

    fields = T._parse_datatype_string("text string, n_chars long")
    return map_rows(pages.select("page_id", "url", "html"), made, [pages.schema["page_id"], pages.schema["url"], *fields])

"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass decides blocks from where they stand (menus, footers,
forms, ... by their tags or by class and id), from link density, length and stop-word density. The second gives what is
left, mostly short blocks, the label of the nearest decided block of the same section.

Names, forms and tags left open are evidence, no verdict: such a section is main text after all where it holds most of
the page's prose.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import tidied

# Function words of common languages, which prose is full of and menus are not.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more my no not of on one or our out said she so some than that the their them then there these they this to two up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kein man mich mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur über "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous à été "
    "al algo ante como con contra cuando de del desde donde el ella en entre era es esta este esto fue ha hasta la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también te tiene un una y ya "
    "alla che chi ci con da dal della delle di e gli il io lei lo ma nel nella non per più quando questo se sono tra un uno "
    "até com da das de do dos e ela ele em essa foi mais mas na nas nem no nos não o os ou pela pelo por quem se sem seu sua são também um uma "
    "aan als dat de den die dit door een en er had heeft het hij ik in is je maar met naar niet nog of om ook op te uit van voor was wat werd zijn zo".split()
)
#: Tags that end a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Tags whose content isn't text of the page.
RAW_TAGS = frozenset("script style noscript template iframe textarea select svg annotation annotation-xml canvas object audio video head title".split())
#: Sections that hold no main text.
SIDE_TAGS = frozenset("nav footer aside button menu dialog".split())
#: Sections that mostly hold none.
FORM_TAGS = frozenset("form fieldset".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id, split at what is not a letter and at capitals.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion feedback replies reply respond responses talkback".split())
#: First words of names that say what a section has, not what it is.
MODIFIERS = frozenset("has no with without is show hide enable disable js".split())
#: Elements beyond which an open paragraph isn't ended.
SCOPES = frozenset("table td th caption button html".split())
SECTION_TAGS = frozenset("article main section body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HREF = re.compile(r"\bhref\b", re.I)
_STOP = re.compile("[.!?…]+(?:[\\s\"'»”)\\]]|$)|[。！？।॥؟۔]")
_EDGE = re.compile(r"^\W+|\W+$")


#: What a section without main text is known by: hidden; a tag or role; comments' names; other names and forms.
HIDDEN, TAG, COMMENT, NAME = 4, 3, 2, 1
#: Blocks after which a link left open ends.
LINKED_BLOCKS = 6


@dataclass
class Side:
    """A section that looks like one without main text."""

    kind: int
    closed: bool = False
    head: bool = False  # holds an article, main part or first heading
    lifted: bool = False


@dataclass
class Block:
    tag: str
    section: int
    inside: bool  # below article or main
    sides: tuple[Side, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    label: str = ""

    @property
    def side(self) -> bool:
        return any(not s.lifted for s in self.sides)

    @property
    def unlinked(self) -> int:
        return len(self.text) - len(" ".join("".join(self.linked).split()))


def _side(tag: str, attributes: str, inside: bool) -> int:
    """The kind of an element that looks like one without main text, from its tag and attributes; 0 for others."""
    kind = TAG if tag in SIDE_TAGS else NAME if tag in FORM_TAGS or tag == "header" and not inside or tag == "article" and inside else 0
    if not attributes or tag in ("html", "body"):
        return kind
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return HIDDEN
        if name == "role" and value.lower() in SIDE_ROLES:
            kind = max(kind, TAG)
        if name in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)]
                if not parts or parts[0] in MODIFIERS:
                    continue
                if any(p in COMMENT_WORDS for p in parts):
                    kind = max(kind, COMMENT)
                elif tag not in ("article", "main") and any(p in SIDE_WORDS for p in parts):
                    kind = max(kind, NAME)
    return kind


@dataclass
class _Open:
    tag: str
    sides: tuple[Side, ...]
    inside: bool
    section: int
    own: Side | None = None


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Tags may be left open or cross; the end of the page closes all."""
    out: list[Block] = []
    stack: list[_Open] = []
    sections = pos = 0
    link_at, link_until = -1, 0  # depth at which a link was opened, and the block at which it ends at last
    now = Block("", 0, False)

    def put(raw: str) -> None:
        if raw:
            s = html.unescape(raw)
            now.parts.append(s)
            if link_at >= 0:
                now.linked.append(s)

    def cut(tag: str) -> None:
        nonlocal now, link_at
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        if len(out) >= link_until:
            link_at = -1
        top = stack[-1] if stack else _Open("", (), False, 0)
        now = Block(tag, top.section, top.inside, top.sides)

    def close(upto: int, tag: str = "") -> None:
        """Pop the stack down to a depth; a side section is closed by its own tag only."""
        nonlocal link_at
        while len(stack) > upto:
            gone = stack.pop()
            if gone.own and gone.tag == tag and len(stack) == upto:
                gone.own.closed = True
        if len(stack) < link_at:
            link_at = -1

    while m := _TAG.search(page, pos):
        put(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            now.parts.append(" ")
            continue
        if not closing and tag in RAW_TAGS and not attributes.endswith("/"):
            if tag == "head":
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page) if tag in ("script", "style") else pos
            continue
        if tag == "a":
            link_at, link_until = (len(stack), len(out) + LINKED_BLOCKS) if not closing and _HREF.search(attributes) else (-1, 0)
            continue
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1)
            if at >= 0:
                close(at, tag)
            if tag in BLOCK_TAGS:
                cut("")
            continue
        if tag in VOID_TAGS or attributes.endswith("/"):
            if tag in BLOCK_TAGS:
                cut("")
            continue
        top = stack[-1] if stack else _Open("", (), False, 0)
        if tag in BLOCK_TAGS:
            # A paragraph ends where another block begins; a list item or cell where its next one does.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i, "p")
                    break
                if stack[i].tag in SCOPES:
                    break
            if tag in ("li", "td", "th", "dt", "dd", "option") and stack and stack[-1].tag == tag:
                close(len(stack) - 1, tag)
            top = stack[-1] if stack else _Open("", (), False, 0)
            kind = _side(tag, attributes, top.inside)
            own = Side(kind) if kind else None
            section = top.section
            if tag in SECTION_TAGS:
                sections += 1
                section = sections
            stack.append(_Open(tag, (*top.sides, own) if own else top.sides, top.inside or tag in ("article", "main"), section, own))
            if tag in ("article", "main", "h1"):
                for s in top.sides:
                    s.head = True
            cut(tag)
        elif kind := _side(tag, attributes, True):
            own = Side(kind)
            stack.append(_Open(tag, (*top.sides, own), top.inside, top.section, own))
            cut("")
    put(page[pos:])
    cut("")
    return out


def lift(found: list[Block], short: int = 70) -> None:
    """Mark the side sections that hold main text after all.

    Prose is what blocks of `short` characters have outside links. A section known by a name, a form, or a tag that was
    never closed is lifted, from the inner to the outer ones, if it has more than half of the prose outside closed side
    tags and comments. Where that leaves no prose, so are sections named for comments that hold the article.
    """
    prose = [b.unlinked if b.unlinked >= short else 0 for b in found]
    firm = lambda s: s.kind in (HIDDEN, COMMENT) or s.kind == TAG and s.closed
    total = sum(n for b, n in zip(found, prose, strict=True) if not any(map(firm, b.sides)))
    sides = {id(s): s for b in found for s in b.sides}
    # Blocks with prose whose inner sections are all lifted, one level after the other.
    open_to = [(b.sides, n) for b, n in zip(found, prose, strict=True) if n and not any(map(firm, b.sides))]
    for level in range(max((len(c) for c, _ in open_to), default=0) - 1, -1, -1):
        have: dict[int, int] = {}
        for chain, n in open_to:
            if len(chain) > level:
                have[id(chain[level])] = have.get(id(chain[level]), 0) + n
        for key, n in have.items():
            sides[key].lifted = 2 * n > total
        open_to = [(c, n) for c, n in open_to if len(c) <= level or c[level].lifted]
    if not any(n and not b.side for b, n in zip(found, prose, strict=True)):
        for s in sides.values():
            s.lifted = s.lifted or s.kind in (COMMENT, NAME) and s.head


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(_EDGE.sub("", w) in STOP_WORDS for w in words) / len(words) if words else 0.0


def sentences(text: str) -> bool:
    """Whether a text has the marks of sentences, about as often as prose has; for languages without a list of stop words."""
    words = max(len(text.split()), len(text) // 12)
    return len(_STOP.findall(text)) * 60 >= words


def classify(found: list[Block], short: int = 70, density: float = 0.15, links: float = 0.5, foreign: float = 0.04) -> None:
    """Set each block's label to good or bad.

    First pass: bad is what stands in a side section or is linked by more than the share `links`; good what has `short`
    characters and the stop-word density, what has them with next to no stop words (below `foreign`) but sentences, as
    in other languages, and preformatted text of that length; thin what has the length without the density, unless it
    stands in an article. Where a page has nothing good, what is thin is taken for its text, otherwise it is bad.
    Second pass: the rest takes the label of the nearest decided block of its section, of two equally near the one with
    its own tag, else the good one. Without a decided block an article's blocks are good, and others where the page has
    nothing good otherwise.
    """
    lift(found, short)
    for b in found:
        if b.side or len(b.text) - b.unlinked > links * len(b.text):
            b.label = "bad"
        elif len(b.text) >= short:
            share = stop_density(b.text)
            if share >= density or b.tag == "pre" or share < foreign and sentences(b.text):
                b.label = "good"
            elif not b.inside:
                b.label = "thin"
    thin = "bad" if any(b.label == "good" for b in found) else "good"
    for b in found:
        if b.label == "thin":
            b.label = thin
    decided = [b.label for b in found]
    # Side blocks are known for what they are; they say nothing about their neighbours.
    speaks = [bool(d) and not b.side for b, d in zip(found, decided, strict=True)]
    before, last = [], {}
    for i, b in enumerate(found):
        before.append(last.get(b.section))
        if speaks[i]:
            last[b.section] = i
    after, last = [None] * len(found), {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = last.get(found[i].section)
        if speaks[i]:
            last[found[i].section] = i
    open_ones = []
    for i, b in enumerate(found):
        if decided[i]:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        if not near:
            open_ones.append(b)
            continue
        far = min(abs(j - i) for j in near)
        near = [j for j in near if abs(j - i) == far]
        near = [j for j in near if found[j].tag == b.tag] or near
        b.label = "good" if any(decided[j] == "good" for j in near) else "bad"
    any_good = any(b.label == "good" for b in found) or any(b.inside for b in open_ones)
    for b in found:
        if not b.label:
            b.label = "good" if b.inside or not any_good else "bad"


def main_text(page: str | None) -> str:
    """The good blocks of a page, in order, joined by two line feeds; empty for a null or empty page."""
    found = blocks(page or "")
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, null html as an empty page; one row for each, also where rows repeat. A page of any length is read whole. An empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")

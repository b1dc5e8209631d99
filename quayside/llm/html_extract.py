"""Main text of web pages: blocks classified by stop words, length, links and place, then by their neighbours."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent words of the four languages of the pages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son lui nous comme mais pouvoir tout elle aux leur cette ses deux"
    " de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
# Elements that end a block where they begin and where they end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody"
    " td template tfoot th thead tr ul video audio object iframe noscript".split()
)
# Elements whose content is no text of the page.
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object")
# Elements that hold what surrounds a text, and those that may as well be put around a whole page.
SURROUNDING_TAGS = frozenset("nav footer aside menu button select dialog search head".split())
WRAPPING_TAGS = frozenset(("form", "fieldset"))
CONTENT_TAGS = frozenset(("article", "main"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that name what surrounds a text, or the text.
SURROUNDING_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner nav navbar navigation menu sidebar aside footer masthead"
    " topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus"
    " discussion share sharing social related recommended promo promotion newsletter subscribe signup login breadcrumb breadcrumbs pagination pager"
    " widget copyright legal adsbygoogle promoted skip search tags contentinfo complementary form subscription teaser".split()
)
CONTENT_NAMES = frozenset("article articlebody main content post entry story".split())
# First words of names that speak of something that is elsewhere on the page.
ABOUT_OTHERS = frozenset("has no not with without hide show is".split())

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
# One attribute after the other, each with its whole name, so that nothing inside a value counts as a name.
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+""")
NAMING = frozenset(("class", "id", "role", "itemprop"))
NAME_CUT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Signs that stand before and after words.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚…–—·•¿¡©"

# Thresholds for texts whose paragraphs have a quarter to a third of stop words, and a tenth where they are poor in them.
MAX_LINK_DENSITY = 0.2
MAX_CONTENT_LINK_DENSITY = 0.7
SHORT = 70
LONG = 120
VERY_LONG = 200
STOP_HIGH = 0.20
STOP_LOW = 0.10

GOOD, BAD, SHORT_BLOCK, NEAR = "good", "bad", "short", "near"


@dataclass
class Block:
    """A run of text without a block element inside."""

    #: Inside an element that surrounds texts; inside one whose name says so; inside the content.
    surrounding: bool
    named: bool
    content: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""
    links: float = 0.0
    density: float = 0.0
    label: str = ""


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """What class, id, role and itemprop call an element; whether there is a link; whether it is hidden.

    A name counts as a whole. Of a name of several words the last counts too, as that says what the
    element is, unless the first says that it speaks of another (`has-sidebar`).
    """
    names: set[str] = set()
    link = hidden = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "href":
            link = True
        elif key in ("hidden", "aria-hidden"):
            hidden = hidden or value.lower() in ("", "hidden", "true")
        elif key in NAMING:
            for word in value.split():
                parts = [x.lower() for x in NAME_CUT.split(word) if x]
                names.add(word.lower())
                if parts and parts[0] not in ABOUT_OTHERS:
                    names.add(parts[-1])
    return names, link, hidden


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, each with its place: inside something surrounding, or inside the content."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open block elements: name, surrounding, named, content
    current: Block | None = None
    in_link = False
    at = 0

    def place(heading: bool = False) -> Block:
        _, surrounding, named, content = stack[-1] if stack else ("", False, False, False)
        heading = heading or any(entry[0][0] == "h" and entry[0][1:].isdigit() for entry in stack[-1:])
        return Block(surrounding, named, content, heading)

    def add(raw: str) -> None:
        nonlocal current
        if raw:
            if current is None:
                current = place()
            text = entities.unescape(raw)
            current.parts.append(text)
            if in_link:
                current.link_chars += len("".join(text.split()))

    def end_block() -> None:
        nonlocal current, in_link
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            current.parts = []
            if current.text:
                blocks.append(current)
        current, in_link = None, False

    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not name:
            continue
        if not closing and name in RAW_TAGS and not (name in ("svg", "math", "object") and attributes.rstrip().endswith("/")):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name in BLOCK_TAGS:
                end_block()
            continue
        if name == "a":
            in_link = not closing and _names(attributes)[1]
        elif name == "br":
            add(" ")
        elif name in BLOCK_TAGS:
            end_block()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID_TAGS:
                # An open paragraph, entry or cell ends where the next one begins.
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if stack and stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    stack.pop()
                _, surrounding, named, content = stack[-1] if stack else ("", False, False, False)
                names, _, hidden = _names(attributes)
                if name in CONTENT_TAGS:
                    # The innermost of such elements says more than a name around it.
                    named, content = False, not surrounding
                elif name in SURROUNDING_TAGS or (name == "header" or "header" in names) and not content:
                    surrounding, content = True, False
                elif name not in ("html", "body"):
                    around, inside = bool(names & SURROUNDING_NAMES) or name in WRAPPING_TAGS, bool(names & CONTENT_NAMES)
                    if around and not inside:
                        named, content = True, False
                    elif inside and not around:
                        content = not named and not surrounding
                if hidden:
                    surrounding, content = True, False
                stack.append((name, surrounding, named, content))
    if at < len(page):
        add(page[at:])
    end_block()
    return blocks


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(EDGES) in STOP_WORDS for w in words) / max(1, len(words))


def _measure(b: Block) -> None:
    """The shares of characters in links and of stop words, each computed once."""
    b.links = b.link_chars / max(1, len("".join(b.text.split())))
    if not b.surrounding:
        b.density = stop_density(b.text)


def _rich(b: Block) -> bool:
    """Long, with many stop words and few links: a paragraph, wherever it stands."""
    return len(b.text) > LONG and b.density >= STOP_HIGH and b.links <= MAX_LINK_DENSITY


def in_known_language(blocks: list[Block]) -> bool:
    """Whether as many words of these blocks are stop words as in a poor paragraph of the languages of STOP_WORDS."""
    words = [w.strip(EDGES) for b in blocks for w in b.text.lower().split()]
    return sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words)


def _first_label(b: Block, known: bool) -> str:
    """Link density, length and stop-word density; place shifts what is asked of them.

    In the content a block needs no length if it has some stop words, and none of these if it is very long or
    the content is in no `known` language. Surrounding elements have no good block.
    """
    links, density, size = b.links, b.density, len(b.text)
    if b.surrounding or b.named:
        return BAD
    if links > (MAX_CONTENT_LINK_DENSITY if b.content else MAX_LINK_DENSITY):
        return SHORT_BLOCK if b.content else BAD
    if b.content:
        return GOOD if density >= STOP_LOW or size > VERY_LONG or not known else SHORT_BLOCK
    if size < SHORT:
        return SHORT_BLOCK
    if density >= STOP_HIGH:
        return GOOD if size > LONG else NEAR
    return NEAR if density >= STOP_LOW else BAD


def classify(blocks: list[Block]) -> None:
    """First pass: link density, length and stop-word density of all blocks. Second pass: undecided
    blocks take the label of the nearest decided neighbours; at equal distance both have to be good.

    Elements that call themselves the content lower the thresholds inside, and undecided blocks ask only
    neighbours on their own side; long blocks outside with many stop words stay good. Where most of
    the rich text is in elements with a surrounding name, or outside of the content, these names are not
    believed, and place says nothing of them.
    """
    for b in blocks:
        _measure(b)
    rich = [(b, len(b.text)) for b in blocks if not b.surrounding and _rich(b)]
    if sum(n for b, n in rich if b.named) > sum(n for b, n in rich if not b.named):
        for b in blocks:
            b.named = False
    if sum(n for b, n in rich if not b.named and not b.content) > sum(n for b, n in rich if b.content):
        for b in blocks:
            b.content = False
    inside, outside = [b for b in blocks if b.content], [b for b in blocks if not b.content]
    # Only blocks poor in stop words depend on the language.
    poor = any(b.density < STOP_LOW and len(b.text) <= VERY_LONG for b in inside)
    known = not poor or in_known_language(inside)
    for b in blocks:
        b.label = _first_label(b, known)
    # What stands around the content says nothing about it, and a page ends with what surrounds texts.
    _ask_neighbours(inside, "")
    _ask_neighbours(outside, BAD)


def _ask_neighbours(blocks: list[Block], edge: str) -> None:
    """Give undecided blocks a label; before the first and after the last block stands one with the label `edge`, if any."""

    def nearest(run: list[Block]) -> list[tuple[str, int]]:
        out, last, far = [], edge, 0
        for b in run:
            far += 1
            if b.label in (GOOD, BAD):
                last, far = b.label, 0
            out.append((last, far))
        return out

    sides = zip(blocks, nearest(blocks), reversed(nearest(blocks[::-1])))
    for b, (left, near_left), (right, near_right) in list(sides):
        if b.label in (SHORT_BLOCK, NEAR):
            left, right = left or right, right or left
            if left == right:
                b.label = left or BAD
            elif b.label == NEAR or b.heading:
                b.label = right if b.heading else GOOD
            elif near_left != near_right:
                b.label = left if near_left < near_right else right
            else:
                b.label = BAD


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages(page_id, url, html, ...)`: `page_id, url, text, n_chars`.

    A null or empty html, or one without main text, gives an empty text. The whole page is read,
    each row for itself, so there is no shuffle. Unclosed elements end with the element around
    them, an unclosed comment, script or tag at the end of the page. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as bigint) as page_id", "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

"""Main-text extraction with two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides by
structure, link density, length and stop-word density: blocks of menus, adverts
and the like, and blocks made of links, are bad; long blocks of running words
are good; short ones, and long ones of few stop words, stay open. The second
pass gives each open block the label of the nearest decided one: inside an
article only blocks of that article count.

Stop words are those of four languages and the short words that come back in
the page's own long blocks; text in other scripts than Latin is judged without.
Names (classes and ids) count as whole tokens only. A few reject an element,
but none that holds the article, and none at all where no text would be left;
the others only reject short blocks.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lithospark.llm.columns import Passing
from lithospark.llm.textkernel import slices

LONG = 80
LINKS = 0.5
STOP_DENSITY = 0.12

STOP_WORDS = frozenset(
    # en
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
    # de
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder "
    "sich sie sind so um und vom von vor war wie wird zu zum zur über "
    # fr
    "au aux avec ce ces cette dans de du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous à être "
    # es
    "al como con del el ella ellos esta este fue ha hay la las lo los más me mi muy no o para pero por que se según ser sin sobre su sus también una uno unos y ya él".split()
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu "
    "nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose place is kept, so that what they hold can be told.
HOLDERS = frozenset("article aside body dialog div dl fieldset figure footer form header main menu nav noscript ol section select span table td ul".split())
OUTSIDE = frozenset("aside dialog footer form header menu nav noscript select".split())
RAW = frozenset("annotation annotation-xml button head iframe object script style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole class or id tokens; a part of one may tell of the page (has-sidebar), or of what an article is about (tag-europe).
NAMES = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|(?:reader|user)-?comments?|comments?-?(?:area|body|list|section|thread)|consent|cookies?|cookie-(?:banner|consent|notice)|"
    r"disqus(?:_thread)?|footers?|gdpr|login|menus?|modal|nav(?:s|bar|igation)?|newsletter|notices?|paywall|popups?|promos?|recommend(?:ed|ations?)|related|repl(?:y|ies)|respond|sidebars?|sponsors?|sponsored|subscri(?:be|ptions?)|toolbar|topbar|widgets?)",
    re.I,
)
#: Tokens that say something of short blocks only.
HINTS = re.compile(r"(?:discussion|promotions?|search|shar(?:e|ing)|social|tags?)", re.I)
#: These do so outside of an article; inside, its title may stand there.
TOPS = re.compile(r"head(?:er)?", re.I)
ROLES = frozenset("banner complementary contentinfo dialog form navigation search alert".split())
#: A tag without quotes or the beginning of one; tag_end() finds where the latter ends. Nothing here looks back.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)(?:([^<>\"']*+)>)?+", re.S)
#: Blanks, an attribute's name, and the quote that opens its value or the value without quotes.
PART = re.compile(r"[\s/]*+=?+[^\s/<>=]*+(?:\s*+=\s*+(?:([\"'])|[^\s<>]*+))?+")
PLAIN = re.compile(r"[^<>]*+>")
ATTRIBUTE = re.compile(r"[\s/]*+(=?+[^\s/<>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s<>]*+)))?+")


RAW_END = {x: re.compile(rf"</{x}\s*>|(?=<body[\s>])" if x == "head" else rf"</{x}[^>]*>", re.I) for x in RAW}


def tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose name ends at at, or -1 if no tag is there. Quoted values may hold anything but their quote.

    dead: opening quotes from which no end was found. Each of the page's quotes
    is followed once in vain at most, so damaged markup costs no more than whole.
    """
    tried, k = [], at
    while True:
        m = PART.match(page, k)
        if m[1]:
            quote = m.end() - 1
            close = -1 if quote in dead else page.find(m[1], quote + 1)
            tried.append(quote)
            if close < 0:
                break
            k = close + 1
        elif m.end() > k:
            k = m.end()
        elif page.startswith(">", k):
            return k + 1
        else:
            break
    dead.update(tried)
    plain = PLAIN.match(page, at)
    return plain.end() if plain else -1


def unwanted(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element holds no part of an article: by what it is, by its names, or if short by its names. inside: it lies in one."""
    if name in OUTSIDE and not (inside and name == "header"):
        return True, False, False
    named = hinted = False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
            return True, False, False
        if key in ("class", "id") and name not in ("article", "body", "html", "main"):
            tokens = value.split()
            named = named or any(map(NAMES.fullmatch, tokens))
            hinted = hinted or any(map(HINTS.fullmatch, tokens)) or not inside and any(map(TOPS.fullmatch, tokens))
    return False, named, hinted


def blocks_of(page: str) -> list[tuple[str, int, bool, bool, bool, int]]:
    """(text, characters in links, unwanted by structure, by names, by names if short, article number or 0) of each block that has text.

    Names reject no element around an outermost article or main, unless another
    of these lies outside of all that names reject.
    """
    out: list[tuple[str, int, bool, int, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool, int, int]] = []
    around: list[int] = []
    parts: list[str] = []
    linked: list[str] = []
    anchor = articles = at = 0
    bad, hinted, article = False, False, 0
    once = False, False, False  # what the block's own tag says of it
    absent: set[str] = set()  # elements without text that are not closed any more
    named, outer = 0, {}  # where the innermost element starts that is rejected by name, and for each the one around it

    def close() -> None:
        nonlocal once
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(" ".join(html.unescape(" ".join(linked)).split())) if linked else 0
                out.append((text, links, bad or once[0], named, once[1], hinted or once[2], article))
            parts.clear()
            linked.clear()
        once = False, False, False

    def put(text: str) -> None:
        if text:
            parts.append(text)
            if anchor:
                linked.append(text)

    find, dead = TAG.search, set()
    while m := find(page, at):
        name, attributes, end = m[2], m[3], m.end()
        if name is not None and attributes is None:
            end = tag_end(page, m.end(), dead)
            if end < 0:
                put(page[at : m.end()])
                at = m.end()
                continue
            attributes = page[m.end() : end - 1]
        put(page[at : m.start()])
        at = end
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            elif name in BLOCK_TAGS or name in HOLDERS:
                if name in BLOCK_TAGS:
                    close()
                if name in HOLDERS and any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
                    now = stack[-1][1:] if stack else (False, False, 0, 0)
                    if (now[0], now[1], now[3]) != (bad, hinted, named):
                        close()
                    bad, hinted, article, named = now
            continue
        if name in RAW:
            if attributes.endswith("/"):
                continue
            end = None if name in absent else RAW_END[name].search(page, at)
            if end is None:
                absent.add(name)
            if name == "head":
                close()
            at = end.end() if end else (at if name in ("head", "button") else len(page))
            continue
        if name == "br":
            put(" ")
        elif name == "a":
            anchor = 1
        elif name in BLOCK_TAGS or name in HOLDERS:
            if name in BLOCK_TAGS:
                anchor = 0
                close()
            if name in HOLDERS and not attributes.endswith("/"):
                worse, by_name, if_short = unwanted(name, attributes, article > 0)
                if worse and not bad or by_name or if_short and not hinted:
                    close()
                bad, hinted = bad or worse, hinted or if_short
                if by_name:
                    outer[at] = named
                    named = at
                if name in ("article", "main") and not article:
                    if not bad:
                        around.append(named)
                    articles += 1
                    article = articles
                stack.append((name, bad, hinted, article, named))
            elif name in BLOCK_TAGS and attributes:
                once = unwanted(name, attributes, article > 0)
    put(page[at:])
    close()
    spared = {0}
    if all(around):
        for x in around:
            while x not in spared:
                spared.add(x)
                x = outer[x]
    return [(text, links, bad, x not in spared or own, short, article) for text, links, bad, x, own, short, article in out]


def common_words(blocks: list[tuple]) -> set[str]:
    """Short words that come back in at least three, and a fifth, of a page's long blocks."""
    seen: dict[str, int] = {}
    long = [b[0] for b in blocks if len(b[0]) >= LONG]
    for text in long:
        for w in {x for x in text.lower().split() if len(x) <= 4 and x.isalpha()}:
            seen[w] = seen.get(w, 0) + 1
    return {w for w, n in seen.items() if n >= max(3, len(long) / 5)}


def latin(text: str) -> bool:
    """Whether at least half of the letters are Latin ones."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in letters) >= len(letters)


def label(text: str, links: int, bad: bool, short: bool, article: int, own: Callable[[], set[str]]) -> bool | None:
    """True for text, False for what surrounds it, None where a block alone can't tell. own gives common_words() of the page."""
    if bad:
        return False
    n = len(text)
    if links > LINKS * n:
        # A sentence of an article may be a link as a whole; rows of links stand outside.
        return None if article else False
    if n < LONG:
        return False if short else None
    words = text.lower().split()
    listed = [w.strip(".,;:!?\"'()") in STOP_WORDS for w in words]
    if sum(listed) >= STOP_DENSITY * len(words):
        return True
    common = own()
    return True if sum(x or w in common for x, w in zip(listed, words, strict=True)) >= STOP_DENSITY * len(words) or not latin(text) else None


def labelled(blocks: list[tuple[str, int, bool, bool, int]], labels: list[bool | None]) -> list[bool]:
    """The second pass over (text, characters in links, bad, bad if short, article) blocks with labels."""
    inside = any(b[4] and not b[2] for b in blocks)
    good = any(labels)
    if not good and not inside:
        # Nothing stands out as text: all that is no menu or the like may be.
        labels = [False if bad or links > LINKS * len(text) else None for text, links, bad, _, _ in blocks]
    decided = list(labels)
    n = len(blocks)

    # The nearest decided block before and after each block, of its own article where it has one.
    def nearest(order: range) -> list[tuple[int, bool] | None]:
        seen: dict[int, tuple[int, bool]] = {}
        out: list[tuple[int, bool] | None] = [None] * n
        for i in order:
            home = blocks[i][4]
            out[i] = seen.get(home)
            if labels[i] is not None and not (home and blocks[i][2]):
                seen[home] = (i, labels[i])
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    for i, (_, _, _, _, article) in enumerate(blocks):
        if labels[i] is not None:
            continue
        near = [x for x in (before[i], after[i]) if x is not None]
        if not near or not good:
            decided[i] = bool(article) or not inside
        else:
            distance = min(abs(j - i) for j, _ in near)
            found = {text for j, text in near if abs(j - i) == distance}
            # Between text and surroundings: part of the article if it lies in one.
            decided[i] = found.pop() if len(found) == 1 else bool(article)
    return decided


def main_text(page: str) -> str:
    """The blocks of the article, in page order, joined by one space."""
    blocks = blocks_of(page)
    own = functools.cache(lambda: common_words(blocks))
    by_name = [(text, links, bad or named, short, article) for text, links, bad, named, short, article in blocks]
    labels = [label(*b, own) for b in by_name]
    if not any(labels) and not any(b[4] and not b[2] for b in by_name):
        # No article and no text is left: where there is some without them, the names mislead.
        bare = [(text, links, bad, False, article) for text, links, bad, _, _, article in blocks]
        found = [label(*b, own) for b in bare]
        if any(found):
            by_name, labels = bare, found
    return " ".join(b[0] for b, text in zip(by_name, labelled(by_name, labels), strict=True) if text)


def _extract(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                texts = [main_text(x) if x else "" for x in batch.column(column).to_pylist()]
                columns = {c: batch.column(c) for c in batch.schema.names if c != column}
                columns |= {"main_text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def extract_main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages without the page column, with main_text and n_chars (its code points).

    A null or empty page, and one without an article's text, give an empty
    string and 0. Every block's whole text is kept. Other columns pass through;
    those that are named like the added ones are replaced.
    """
    passing = Passing(pages, ["main_text", "n_chars"], page)
    rows = passing.df.select(*passing.inner, passing[page])
    return passing.restored(rows.mapInArrow(_extract(passing[page]), f"{passing.schema()}main_text string, n_chars long"))

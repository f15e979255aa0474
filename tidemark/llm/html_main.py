"""Main text of web pages by two passes of block rules.

Method: a page is cut into blocks of text. The first pass decides blocks by themselves: their container,
link density, length and stop-word density each add to a sum for or against. In the second pass the
ambiguous blocks, mostly short ones, inherit the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_batches

#: Markup from a "<" on: a comment, a declaration, or a tag. Quotes count after an equals sign only, and only if they are closed.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?>[^>=]+|=\s*+(?>\"[^\"]*\"|'[^']*'|))*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
#: The same without regard to quotes, for pages whose quotes don't match.
_PLAIN_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>[^>]*+)>|<[!?/][^>]*+>", re.S | re.I)
#: Where markup begins.
_OPENS = re.compile(r"<(?=[a-z/!?])", re.I)
#: After so many tags whose quotes run on to the page's end, quotes are ignored.
ODD_QUOTES = 8
_NUMBER = re.compile(r"&#(?:(?=\d)0*+(\d*)|x(?=[0-9a-f])0*+([0-9a-f]*));?", re.I | re.A)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

# HTML element names whose content isn't text of the page,
RAW = frozenset("script style noscript template textarea title iframe svg select object math canvas noframes".split())
# HTML element names, and names that pages give to what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
FORMAT = INLINE - {"span", "a", "label"}
BOILERPLATE_TAGS = frozenset("nav footer aside form button fieldset menu dialog head datalist".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar side aside widget widgets footer masthead toolbar topbar share sharing social related recommended recommendations trending popular "
    "comment comments commentlist discussion disqus replies reply respond reactions pager pagination paging skip tags taglist copyright legal disclaimer form search teaser".split()
)
#: What says so of an <article> element; pages put many other names there.
ARTICLE_LIKE_NAMES = frozenset("ad ads advert advertisement sponsored promo teaser related comment comments reply replies".split())
HEADER_NAMES = frozenset("header topheader siteheader".split())
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its like more my no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en entre est et il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa se ses son sur tout un une vous "
    "aber als am an auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und unter von vor war wenn wie wir zu zum zur "
    "al algo como con cuando de del desde donde e el ella ellos en entre era es esta este esto fue ha hay la las lo los más mi muy no o para pero por que se ser si sin sobre su sus también un una uno y ya".split()
)
HEADINGS = {f"h{level}": level for level in range(1, 7)}
#: An opening tag of the first kind ends an open element of the second.
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
LINK_DENSITY = 0.4
LONG = 90
#: An element within the article that its name puts aside stays if it has a block of so many characters; so long a block counts where a page has no known stop words.
PARAGRAPH = 70
#: A shorter block that may be a sentence goes with the article if it stands beside it on either side.
SENTENCE = 25
STOP_DENSITY = 0.15
#: What speaks for a block and against it, and the sums that decide it in the first pass.
FOR_ARTICLE, FOR_LONG, FOR_STOP_WORDS, AGAINST = 2, 1, 2, -4
TRUE_FROM, FALSE_UPTO = 3, -1
_OWNER = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Block:
    __slots__ = ("parts", "linked", "bad", "inside", "heading", "named", "label", "text")

    def __init__(self, bad: bool, inside: bool, heading: int, named: int = 0):
        self.parts, self.linked, self.bad, self.inside, self.heading, self.named, self.label, self.text = [], 0, bad, inside, heading, named, None, ""


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool | None:
    """Whether an element's name or attributes say that it isn't the article; None if inside it only a class or id says so."""
    verdict: bool | None = False
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside:
        return True
    for m in _ATTRIBUTE.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            words = set(re.split(r"[^a-z]+", value))
            if words & (BOILERPLATE_NAMES if tag != "article" else ARTICLE_LIKE_NAMES) or not inside and (words & HEADER_NAMES):
                if not inside:
                    return True
                verdict = None
    return verdict


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, tag, "/" or "", attributes) of comments, declarations (without a tag) and tags, in order and in linear time.

    Elements whose content isn't text are one piece up to their end tag, or to the page's end. A tag that the page
    ends in goes up to there.
    """
    last = page.rfind(">") + 1
    pattern, odd, at = _MARKUP, 0, 0
    while m := _OPENS.search(page, at):
        start = m.start()
        if start >= last and not page.startswith("<!--", start):
            yield start, len(page), "", "", ""
            return
        found = pattern.match(page, start)
        if found is None and pattern is _MARKUP:  # a quoted value that swallows the last ">"
            odd += 1
            if odd > ODD_QUOTES:
                pattern = _PLAIN_MARKUP
            found = _PLAIN_MARKUP.match(page, start)
        if found is None:
            at = start + 1
            continue
        at, tag = found.end(), (found["tag"] or "").lower()
        if tag in RAW and not found["end"] and not found["attrs"].endswith("/"):
            closes = _RAW_END[tag].search(page, at)
            at = (page.find(">", closes.end()) + 1 if closes else 0) or len(page)
            tag = ""
        yield start, at, tag, found["end"] or "", found["attrs"] or ""


def _number(m: re.Match) -> str:
    """A numeric reference without zeros in front; U+FFFD if it has more digits than any character."""
    digits = m[2] if m[1] is None else m[1]
    return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[1] is None else ''}{digits or 0};"


def unescaped(text: str) -> str:
    """Character references decoded, however many digits they have."""
    return html.unescape(_NUMBER.sub(_number, text)) if "&" in text else text


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in page order, with what their containers say."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, boilerplate, in the article, number of the named element
    bad = inside = False
    named = last_named = 0
    link, breaks, heading = 0, 0, 0
    block: Block | None = None
    at = 0

    def put(piece: str) -> None:
        nonlocal block, breaks
        if not piece or block is None and not piece.strip():
            return
        if block is None:
            block = Block(bad, inside, heading, named)
            found.append(block)
        block.parts.append(piece)
        if piece.strip():
            breaks = 0
            if link:
                block.linked += len("".join(piece.split()))

    opened: Counter[str] = Counter()
    for begins, ends, tag, closing, attrs in markup(page):
        put(page[at:begins])
        at = ends
        if not tag:
            continue
        if tag == "br":
            put(" ")
            breaks += 1
            if breaks > 1:
                block = None
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag not in INLINE:
            block = None
        if tag in VOID or tag in FORMAT:
            continue
        if closing:
            if not opened[tag]:
                continue
            gone = ""
            while gone != tag:
                gone = stack.pop()[0]
                opened[gone] -= 1
        else:
            if tag not in INLINE and stack and stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            if tag in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[tag].split():
                opened[stack.pop()[0]] -= 1
            was_bad, was_in, was_named = stack[-1][1:] if stack else (False, False, 0)
            if not attrs.endswith("/"):
                verdict = _boilerplate(tag, attrs, was_in)
                if verdict is None and not was_named:
                    last_named += 1
                    was_named = last_named
                stack.append((tag, was_bad or bool(verdict), was_in or tag in ("article", "main") or "articlebody" in attrs.lower(), was_named))
                opened[tag] += 1
            if tag not in INLINE:
                link = 0
        now = stack[-1][1:] if stack else (False, False, 0)
        if now != (bad, inside, named):
            block = None
            bad, inside, named = now
        heading = next((HEADINGS[t] for t, *_ in stack[-3:] if t in HEADINGS), 0)
    put(page[at:])
    for b in found:
        b.text = " ".join(unescaped("".join(b.parts)).split())
    return [b for b in found if b.text]


def has_stop_words(text: str) -> bool:
    """Whether a text has the stop words of a language as densely as its sentences have."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)


def label(blocks: list[Block]) -> None:
    """Set the labels: True for the article's blocks."""
    # inside the article a name decides only for an element of links, or without a long block
    sums: dict[int, list[int]] = {}
    for b in blocks:
        if b.named:
            of = sums.setdefault(b.named, [0, 0, 0])
            of[:] = of[0] + b.linked, of[1] + len(b.text.replace(" ", "")), max(of[2], len(b.text))
    for b in blocks:
        if b.named:
            linked, size, longest = sums[b.named]
            b.bad = b.bad or linked > LINK_DENSITY * size or longest < PARAGRAPH
    has_article = any(b.inside and not b.bad for b in blocks)
    # first pass: each block by itself; its container is one of the signals
    unknown = []
    for b in blocks:
        dense = b.linked > LINK_DENSITY * len(b.text.replace(" ", ""))
        long = len(b.text) >= LONG and not b.heading
        sum_ = AGAINST if b.bad else FOR_ARTICLE if b.inside else AGAINST if has_article else 0
        sum_ += AGAINST * (dense + bool(_OWNER.match(b.text)))
        if long:
            sum_ += FOR_LONG + FOR_STOP_WORDS * has_stop_words(b.text)
        b.label = True if sum_ >= TRUE_FROM else False if sum_ <= FALSE_UPTO else None
        if b.label is None and len(b.text) >= PARAGRAPH and not b.heading:
            unknown.append(b)
    # long blocks without known stop words: the article, if most text is in them; else their neighbours decide
    if sum(len(b.text) for b in unknown) > sum(len(b.text) for b in blocks if b.label):
        for b in unknown:
            b.label = True
    # second pass: ambiguous blocks follow their nearest decided neighbours, in the article those within it. An element
    # that its name or tag puts aside doesn't speak for what stands beside it there. An <h1> parts what is above and below
    decided = [(i, b.label) for i, b in enumerate(blocks) if b.label is not None and (not has_article or b.inside and not b.bad)]
    titles = np.cumsum([b.heading == 1 for b in blocks]).tolist()
    k = 0
    for i, b in enumerate(blocks):
        if b.label is not None:
            continue
        while k < len(decided) and decided[k][0] < i:
            k += 1
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if before and after and not b.heading:
            above, below = titles[i] > titles[before[0]], titles[after[0]] > titles[i]
            before, after = None if above and not below else before, None if below and not above else after
        if before is None and after is None:
            b.label = True
        elif b.heading and after is not None:  # a heading belongs to what it is above
            b.label = after[1]
        elif before is None or after is None:
            b.label = (before or after)[1]
        elif before[1] == after[1] or len(b.text) >= SENTENCE and has_stop_words(b.text):
            b.label = before[1] or after[1]
        else:
            near = i - before[0] - (after[0] - i)
            b.label = before[1] if near < 0 else after[1] if near > 0 else True


def main_text(page: str | None) -> str:
    """The article's blocks, joined by empty lines; an empty text if there is none."""
    blocks = blocks_of(page or "")
    label(blocks)
    return "\n\n".join(b.text for b in blocks if b.label)


def extract(page: Column, spark=None) -> Column:
    """The main text of each page of HTML.

    A null or empty page gives an empty text, and so does a page without an article. Pages are read
    whole, whatever their length, in time linear in it, and needn't be well-formed: elements may stay open,
    comments, scripts and tags may miss their end (they then go up to the page's end). Rows don't depend on
    one another; repeated rows get the same text, ties between neighbours keep a block, an empty table gives
    no rows, and other columns aren't read.
    """
    if spark is not None:
        bounded_batches(spark)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(page)

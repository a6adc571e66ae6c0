"""Main text of web pages: blocks are classified by stop words, length and links, then undecided ones by neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button audio video head title".split())
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "title"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
# Words of class, id and role attributes that name a part of a page other than its text.
PARTS = frozenset(
    """ad ads adsbox advert advertisement adverts banner billboard breadcrumb breadcrumbs byline-links comment comments
    commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar
    navigation newsletter notice notices notification pagination pager paywall popup promo promoted related recommended
    replies reply responses share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar
    widget alert complementary contentinfo search""".split()
)
TEXT_PARTS = frozenset("article main content post entry story body text articlebody".split())
# First words of names that tell what a box has around it or lacks.
ABOUT = frozenset("has no not with without is".split())
# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they
    this to was we were which with you au aux avec ce dans de des du elle en et est il ils la le les leur mais ne nous ou
    par pas pour que qui sa se son sur un une vous als auch auf das dem den der des die ein eine einen einer er es für
    hat ich im ist mit nicht sich sie sind und von war wie wird zu zum al como con del el ella ellos era esta fue las lo
    los más no para pero por se si sin su sus una uno y""".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[^\W\d_]+")
PARTS_OF_NAME = re.compile(r"[-_\d]+")
SPACE = re.compile(r"[\s ]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    role: str  # good inside an article, bad inside boilerplate, named if only class, id or role say so, else empty
    heading: bool
    label: str = ""


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: shares of linked characters and of stop words, lengths in code points."""

    link_density: float = 0.5
    short: int = 70
    long: int = 200
    few_stops: float = 0.10
    many_stops: float = 0.25


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag by name; names are in small letters, and those without a value are empty."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def is_named(tokens: list[str], names: frozenset[str]) -> bool:
    """Whether a class, id or role is one of ``names``, alone or as the last word of a compound (``site-footer``). Compounds
    that begin with a word of ``ABOUT`` (``has-sidebar``) name something else."""
    for token in tokens:
        words = [w for w in PARTS_OF_NAME.split(token) if w]
        if words and words[-1] in names and words[0] not in ABOUT:
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is read as far as it goes; open elements end with the page."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, role, skipped, link
    parts: list[tuple[str, bool]] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
        if text:
            role = stack[-1][1] if stack else ""
            linked = len(SPACE.sub(" ", "".join(t for t, link in parts if link)).strip())
            out.append(Block(text, linked, role, any(re.fullmatch("h[1-6]", s[0]) for s in stack)))
        parts.clear()

    def pop_to(i: int) -> None:
        close()
        del stack[i:]

    def put(raw: str) -> None:
        if raw and not (stack and stack[-1][2]):
            parts.append((html.unescape(raw), bool(stack and stack[-1][3])))

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            put(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes the nearest element of its name, if there is one
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is not None:
                if tag in INLINE and all(s[0] in INLINE for s in stack[i:]):
                    del stack[i:]
                elif tag not in INLINE:
                    pop_to(i)
            elif tag == "p":
                close()
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag not in INLINE:
            close()
            if tag in ENDS_P:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if i is not None and all(s[0] in INLINE for s in stack[i + 1 :]):
                    pop_to(i)
                while stack and stack[-1][0] in INLINE:  # formatting doesn't reach over a block
                    stack.pop()
            if tag == "li" and (i := _inside(stack, ("li",), ("ul", "ol", "menu"))) is not None:
                pop_to(i)
        role, skipped, link = (stack[-1][1:] if stack else ("", False, False))
        own = attributes(m[3])
        tokens = " ".join(own.get(k, "") for k in ("class", "id", "role")).lower().split()
        skipped = skipped or tag in SKIPPED or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(NO_DISPLAY.search(own.get("style", "")))
        if tag in INLINE:
            skipped = skipped or is_named(tokens, PARTS)  # an advert inside a sentence
        elif role != "bad" and tag not in ("html", "body"):
            if tag in BOILERPLATE or (tag == "header" and role != "good"):
                role = "bad"
            elif tag in ("article", "main"):
                role = "good"  # also in a box whose name says otherwise
            elif is_named(tokens, PARTS):
                role = "named"
            elif role != "named" and tag in ("div", "section", "td") and is_named(tokens, TEXT_PARTS):
                role = "good"
        if not m[0].endswith("/>") or tag in INLINE:
            stack.append((tag, role, skipped, link or tag == "a"))
        if tag in RAW:  # its content is not markup
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else size
    close()
    return out


def _inside(stack: list, tags: tuple, until: tuple) -> int | None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            return i
        if stack[i][0] in until:
            return None
    return None


def classify(blocks: list[Block], rules: Rules = Rules()) -> None:
    """Label each block good or bad.

    First pass: blocks inside boilerplate, by element or by name, and blocks that are mostly links are bad. Where the page names its
    article, other blocks outside it are bad. Of the rest, long blocks with many stop words are good, long blocks with
    hardly any are bad outside an article, and short or middling blocks stay undecided. Second pass: undecided blocks
    take the label of the nearest decided blocks of their own part; if both sides differ, an undecided heading follows
    the block after it and any other block the nearer side (the good one if equally near). Inside an article,
    undecided blocks without decided neighbours are good, outside bad.
    """
    named = any(b.role == "good" for b in blocks)
    for b in blocks:
        words = WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        links = b.linked / len(b.text)
        if b.role in ("bad", "named") or (named and b.role != "good") or (links > rules.link_density and b.role != "good"):
            b.label = "bad"
        elif links > rules.link_density and len(b.text) > rules.short:
            b.label = "bad"
        elif len(b.text) >= rules.short and stops >= rules.many_stops or len(b.text) >= rules.long and stops >= rules.few_stops:
            b.label = "good"
        elif b.role == "good":
            b.label = "short"
        else:
            b.label = "bad" if len(b.text) >= rules.long else "short"
    decided = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if b.label != "short":
            continue
        inner = (lambda j: b.role != "good" or blocks[j].role == "good")
        before = next((j for j in range(i - 1, -1, -1) if decided[j] != "short" and inner(j)), None)
        after = next((j for j in range(i + 1, len(blocks)) if decided[j] != "short" and inner(j)), None)
        near = [decided[j] for j in (before, after) if j is not None]
        if not near:
            b.label = "good" if b.role == "good" else "bad"
        elif len(set(near)) == 1:
            b.label = near[0]
        elif b.heading:
            b.label = decided[after]
        else:
            left, right = i - before, after - i
            b.label = decided[before] if left < right else decided[after] if right < left else "good"


def main_text(page: str | None) -> str:
    """The good blocks of a page, two line feeds between them; empty for NULL."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (its main text, empty if none) and ``n_chars``. ``html`` is left out.

    A page is one row and is read whole in its task; nothing is shuffled.
    """
    names = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def text(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in htmls:
            yield pd.Series([main_text(x) for x in h])

    out = pages.select(*names).withColumn("text", text(F.col("html")))
    return out.select(*[c for c in names if c != "html"], "text", F.char_length("text").cast("long").alias("n_chars"))

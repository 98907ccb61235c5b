"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags.  The first pass decides a block
from what it holds and where it stands: blocks in menus, headers, footers,
sidebars, notices, adverts, forms and comments, and those made of links, are
bad; long enough blocks with enough stop words (inside an article or main
element: any stop words, or length) are good; the short and the doubtful stay
open.  The second pass gives each open block the label of the nearest decided
block, first within its own article, the earlier one on a tie.  Good blocks,
white space made single, are joined by line feeds in page order.

A class or id says that an element stands around the article if one of its parts
is among the CUES (`cookie-notice`, `sidebar_left`), but not after a part such as
`no` or `with`, which speak of the page's layout; `header` says nothing inside
an article.  Where cues alone leave no text of a page that has an
article or main element, the cues outside of these are set aside.

Defined results: a null or empty page has the empty text; text before any tag
is a block of its own; unclosed elements last to the end of what holds them, an
unclosed comment, script or tag drops the rest of the page, an unclosed head
what stands before its body or first block; repeated rows give
the same text; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from .common import bounded_batches, lean

#: Characters under which a block is short, and from which it needs fewer stop words.
SHORT, LONG = 40, 200
#: Shares of a block's words that are stop words: enough for a good block, and for a long one.
STOP_HIGH, STOP_LOW = 0.25, 0.15
#: Share of a block's characters inside links from which it is bad.
LINKED = 0.33

#: Stop words by language (fixed word lists).
STOP_WORDS = {
    "en": "a about all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its may more most my no not of on one or other our out said she should so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "fr": "a au aux avec ce ces cette dans de des du elle elles en est et eu il ils je la le les leur lui ma mais me mes moi ne nos notre nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur ta te tes tu un une vos votre vous y",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur ob oder sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur",
    "es": "a al algo como con cual de del desde donde el ella ellos en entre era es esa ese eso esta este fue ha han hasta hay la las le les lo los más me mi muy nada ni no nos o otra otro para pero por que qué se sin sobre son su sus también te tiene todo tu un una uno y ya yo",
}
_STOPS = [frozenset(x.split()) for x in STOP_WORDS.values()]

#: Elements whose text is never shown or never part of an article.
DROPPED = "script|style|noscript|template|iframe|object|svg|annotation-xml|annotation|select|textarea|title|canvas|audio|video"
#: Elements that hold what stands around an article.
AROUND = frozenset("nav footer aside form dialog menu button".split())
#: Words in class, id or role that mark the same.
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners sponsor sponsored sponsors promo promotion sidebar sidenav side rail "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs topbar toolbar masthead header footer bottombar contentinfo complementary "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog comment comments commentlist disqus reply replies respond "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox form widget "
    "pagination pager copyright legal disclaimer hidden".split()
)
#: Parts of a class after which its other parts tell of a layout.
LAYOUTS = frozenset("no not with without has have is hide show layout two three".split())
#: Cues that say nothing inside an article, whose own parts they name.
HEADS = frozenset("header masthead".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    rf"|<(?P<drop>{DROPPED})\b[^>]*+(?:(?<=/)>|>.*?(?:</(?P=drop)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[/a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    """Text between two block-level tags, and what is known of it."""

    __slots__ = ("text", "linked", "around", "article", "label")

    def __init__(self, text: str, linked: int, around: bool, article: int):
        self.text, self.linked, self.around, self.article, self.label = text, linked, around, article, None


def marked(attributes: str, inside: bool) -> bool:
    """Whether class, id or role say that an element, which may be inside an article, stands around it, or the element is hidden."""
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            for part in _PART.split(name):
                if part in LAYOUTS:
                    break
                if part in CUES and not (inside and part in HEADS):
                    return True
    return bool(_HIDDEN.search(attributes))


def blocks_of(page: str, yields: bool = False) -> list[Block]:
    """The blocks of a page in order, the empty ones left out; with `yields`, cues outside an article or main element don't reach into it."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, int]] = []  # open elements: tag, whether around the article (1: by a cue), number of the article
    held: dict[str, list[int]] = {}  # places of the open elements of each tag
    around, article, articles, links, at, breaks, own, head = 0, 0, 0, 0, 0, 0, False, False

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(x for x, _ in parts)).split())
            if text:
                linked = len(" ".join(unescape("".join(x for x, y in parts if y)).split()))
                out.append(Block(text, linked, around > 0 or own, article))
            parts.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at and not head:
            parts.append((page[at : m.start()], links > 0))
            if breaks and page[at : m.start()].strip():
                breaks = 0
        at, tag = m.end(), m["tag"]
        if not tag:
            if m["drop"]:
                parts.append((" ", False))
            continue
        tag, end = tag.lower(), bool(m["end"])
        if tag == "head":
            head = not end
            continue
        if head and not end and tag in BLOCK_TAGS and tag != "html":
            head = False
        if tag == "br":
            parts.append((" ", False))
            breaks += 1
            if breaks == 2:
                close()
            continue
        if tag == "a":
            links = max(0, links - 1) if end else 1
            continue
        if tag in BLOCK_TAGS:
            close()
            breaks, own = 0, False
        if tag in VOID or tag in ("html", "body"):
            continue
        attributes = m["attr"]
        if tag == "p":
            own = not end and bool(attributes) and marked(attributes, article > 0)
            continue
        if not end:
            if attributes.endswith("/"):
                continue
            held.setdefault(tag, []).append(len(stack))
            stack.append((tag, around, article))
            if tag in ("article", "main"):
                if not article:
                    articles += 1
                    article = articles
                    around = 0 if yields and around == 1 else around
                if attributes and marked(attributes, True):
                    around = max(around, 1)
            elif tag in AROUND or (tag == "header" and not article):
                around = 2
            elif attributes and marked(attributes, article > 0):
                if tag not in BLOCK_TAGS:
                    close()
                around = max(around, 1)
        else:
            if held.get(tag):
                k = held[tag][-1]
                if tag not in BLOCK_TAGS and around != stack[k][1]:
                    close()
                _, around, article = stack[k]
                for inner, _, _ in stack[k:]:
                    held[inner].pop()
                del stack[k:]
            if tag in BLOCK_TAGS:
                links = 0
    if at < len(page) and not head:
        parts.append((page[at:], links > 0))
    close()
    return out


def stop_share(text: str) -> float:
    """The largest share, over the languages, of a text's words that are stop words."""
    words = _WORD.findall(text.lower())
    return max(sum(w in stops for w in words) for stops in _STOPS) / len(words) if words else 0.0


def decide(block: Block) -> None:
    """First pass: label a block by itself, or leave it open."""
    size = len(block.text)
    if block.around or block.linked > LINKED * size or ("©" in block.text and size < SHORT and not block.article):
        block.label = False
    elif size < SHORT:
        block.label = None
    else:
        share = stop_share(block.text)
        if block.article:
            block.label = True if share > 0 or size >= LONG else None
        elif share >= STOP_HIGH or (size >= LONG and share >= STOP_LOW):
            block.label = True
        else:
            block.label = None


def inherit(blocks: list[Block]) -> list[bool]:
    """Second pass: every block's label, open ones that of the nearest decided block, first within their article."""

    def nearest(inside: bool) -> list:
        best = [(len(blocks) + 1, None)] * len(blocks)
        for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
            last: dict[int, int] = {}
            for i in order:
                b, key = blocks[i], blocks[i].article if inside else 0
                if b.label is not None and not (inside and b.around):
                    last[key] = i
                elif key in last and abs(i - last[key]) < best[i][0]:
                    best[i] = (abs(i - last[key]), blocks[last[key]].label)
        return best

    own, any_ = nearest(True), nearest(False)
    out = []
    for b, (_, mine), (_, near) in zip(blocks, own, any_):
        label = b.label
        if label is None:
            label = mine if b.article and mine is not None else True if b.article else near
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    text = ""
    for yields in (False, True):
        blocks = blocks_of(page, yields)
        for block in blocks:
            decide(block)
        text = "\n".join(b.text for b, good in zip(blocks, inherit(blocks)) if good)
        if text or not any(b.article for b in blocks):
            break
    return text


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, url, text): the main text of every whole page."""
    bounded_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=[key, url, "text"])

    return pages.select(key, url, html).mapInArrow(lean(run), f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string")

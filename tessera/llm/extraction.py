"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at its block elements; inline elements do not cut, and a line break is white space. Blocks in
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, told by element, role, id or class, are left
out, as are scripts, styles and what is hidden. Pass one decides each other block by its length, the density of stop words and
the density of links; short blocks, and longer ones with a middling density, stay open. In pass two an open block takes the
label of the nearest decided block: at equal distances good in an article and bad elsewhere; a heading looks at what follows
it first. Where a page marks its article (``article``, else ``main`` or a like id or class), only blocks in it count, long
blocks in it need no stop words, and its borders are good neighbours; elsewhere borders are bad ones.

A page is read by one call from start to end in time that grows with its length; pages never meet, so nothing is shuffled.

Defined results: null or empty html gives an empty text. Elements may be left open: a paragraph ends at the next block, an
end tag closes what was opened inside its element, and an article ends what surrounds it by mistake (but not comments). An
unclosed comment or script lasts to the end of the page. Repeated rows give each their text. An empty table gives no rows.
Columns of the input are carried; those named like the results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.tokens import shipped, slices

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp".split())
OUT_TAGS = frozenset("aside audio button canvas datalist dialog footer form head header iframe map menu nav noscript object select svg template video".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENTS = frozenset("comment comments commentlist commentform respond disqus replies discussion".split())
#: Words of an id or class that mark what is no part of an article.
OUT_WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer footer gdpr hidden "
    "legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager paging pagination popup promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
#: Words of a class that say what a page has, not what the element is.
LAYOUT_WORDS = frozenset("has with no without hide show".split())
ARTICLE_NAMES = frozenset("article articlebody article-body article-content content entry entry-content main main-content maincontent post post-body post-content story story-body".split())
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset((
    "a about after all also an and are as at be been but by can could do for from had has have he her his i if in into is it its more no not of on one only or "
    "other our she so some such than that the their them then there these they this to was we were what when which who will with would you your "
    "aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich im ist kann man mit nach nicht noch "
    "nur oder sein sich sie sind so über um und von vor war werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle elles en est et été il ils je la le les leur mais même ne nous on ont ou où par pas plus pour qu que qui "
    "sa sans se ses son sont sur un une vous y "
    "al como con cuando del el ella ellas ellos entre era es esta este esto fue ha han hay la las lo los más me mi muy no nos o para pero por porque qué se ser "
    "si sin sobre su sus también tiene todo una uno ya").split())

SHORT_CHARS, LONG_CHARS = 70, 140
LOW_STOPS, HIGH_STOPS = 0.10, 0.20
MAX_LINKS, MAX_ARTICLE_LINKS = 0.2, 0.5
#: A tag with more characters ends at its first ``>``, in quotes or not.
TAG_CHARS = 1 << 13

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TO_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|([^\s=/>\"']+)")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ELSEWHERE, MAIN, ARTICLE = range(3)


class Block(NamedTuple):
    text: str
    zone: int
    section: int  # blocks of one section are neighbours
    heading: bool
    link_chars: int


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(name, attributes, "") of start tags, ("/name", "", "") of end tags and ("", "", text), in order."""
    at, size, tag_end = 0, len(page), page.find(">")
    while at < size:
        begin = page.find("<", at)
        if 0 <= tag_end < begin:
            tag_end = page.find(">", begin)
        if begin < 0 or tag_end < 0 and not page.startswith("<!--", begin):
            yield "", "", page[at:]
            return
        if begin > at:
            yield "", "", page[at:begin]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        name = NAME.match(page, begin + 1)
        if name is None:
            if page[begin + 1] in "!?/":
                at = tag_end + 1
            else:
                yield "", "", "<"
                at = begin + 1
            continue
        quoted = TO_END.match(page, name.end(), name.end() + TAG_CHARS)
        at = quoted.end() if quoted else page.find(">", name.end()) + 1
        low, close = name[1].lower(), page[begin + 1] == "/"
        yield ("/" + low if close else low), page[name.end() : at - 1], ""
        if low in RAW and not close:
            end = re.compile(rf"</{low}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size


def left_out(tag: str, attributes: str) -> tuple[bool, bool, int]:
    """(the element is no part of an article, it holds reader comments, the zone that it opens)."""
    zone = {"article": ARTICLE, "main": MAIN}.get(tag, ELSEWHERE)
    out = tag in OUT_TAGS
    if not attributes or attributes.isspace():
        return out, False, zone
    comments, names = False, []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if key in ("id", "class"):
            names += value.split()
        elif key == "role":
            out, zone = out or value.lower() in OUT_ROLES, max(zone, MAIN if value.lower() == "main" else ELSEWHERE)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out = True
        elif key == "style":
            out = out or "display:none" in value.replace(" ", "").lower()
    for name in names:
        words = [w.lower() for w in PART.findall(name)]
        if LAYOUT_WORDS.isdisjoint(words):
            comments = comments or not COMMENTS.isdisjoint(words)
            out = out or comments or tag not in ("html", "body", "main", "article") and not OUT_WORDS.isdisjoint(words)
    if tag in ("div", "section", "td") and any(n.lower() in ARTICLE_NAMES for n in names):
        zone = max(zone, MAIN)
    return out, comments, zone


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that no element marks as left out, with white space turned into one space, in order."""
    found: list[Block] = []
    pieces: list[str] = []
    links: list[str] = []
    open_tags: list[tuple[str, bool, bool, int]] = []  # tag, left out, comments, zone; with all that surrounds it
    still_open: Counter = Counter()
    section, heading, in_link = 0, False, False

    def end_block() -> None:
        nonlocal in_link
        text = " ".join("".join(pieces).split())
        if text:
            zone = open_tags[-1][3] if open_tags else ELSEWHERE
            found.append(Block(text, zone, section, heading, len(" ".join("".join(links).split()))))
        pieces.clear()
        links.clear()
        in_link = False

    def close(tag: str) -> None:
        nonlocal section
        while open_tags:
            name, _, _, zone = open_tags.pop()
            still_open[name] -= 1
            if zone != (open_tags[-1][3] if open_tags else ELSEWHERE):
                section += 1
            if name == tag:
                return

    for tag, attributes, text in markup(page):
        if text:
            if not (open_tags and open_tags[-1][1]):
                pieces.append(entities.unescape(text))
                if in_link:
                    links.append(pieces[-1])
            continue
        name = tag.lstrip("/")
        block = name in BLOCKS
        if block:
            end_block()
            heading = name in HEADINGS and tag == name
            if still_open["p"] and name != "p" and tag == name or tag == "p" and still_open["p"]:
                close("p")
        if name == "a":
            in_link = tag == "a"
        elif name == "br":
            pieces.append(" ")
        elif name in VOID or name in RAW:
            pass
        elif tag != name:
            if still_open[name]:
                close(name)
        else:
            out, comments, zone = left_out(name, attributes)
            if block or out:
                if zone == ARTICLE and open_tags and open_tags[-1][1] and not open_tags[-1][2]:  # it cannot be inside a menu
                    end_block()
                    open_tags.clear()
                    still_open.clear()
                _, was_out, was_comments, was_zone = open_tags[-1] if open_tags else ("", False, False, ELSEWHERE)
                if name in HEADINGS and was_zone == ARTICLE and was_out and not was_comments and open_tags[-1][0] == "header":
                    was_out = False  # the headline of an article
                if zone > was_zone:
                    section += 1
                open_tags.append((name, out or was_out, comments or was_comments, max(zone, was_zone)))
                still_open[name] += 1
    end_block()
    top = max((b.zone for b in found), default=ELSEWHERE)
    return [b for b in found if b.zone == top]


GOOD, BAD, OPEN = 1, 0, -1


def stop_words(text: str) -> tuple[int, int]:
    """(words, stop words)."""
    words = text.lower().split()
    return len(words), sum(map(STOP_WORDS.__contains__, words))


def first_pass(blocks: list[Block]) -> np.ndarray:
    """Good, bad or open for each block, from the block alone."""
    chars, links = (np.array(x, np.float64) for x in zip(*[(len(b.text), b.link_chars) for b in blocks]))
    words, stops = (np.array(x, np.float64) for x in zip(*[stop_words(b.text) for b in blocks]))
    article = np.array([b.zone != ELSEWHERE for b in blocks])
    linked, dense = links / chars, stops / words
    long = chars >= np.where(article, SHORT_CHARS, LONG_CHARS)
    label = np.full(len(blocks), OPEN)
    label[(chars >= SHORT_CHARS) & (dense >= HIGH_STOPS) & long | article & long] = GOOD
    label[~article & (chars >= SHORT_CHARS) & (dense < LOW_STOPS)] = BAD
    label[linked > np.where(article, MAX_ARTICLE_LINKS, MAX_LINKS)] = BAD
    label[~article & np.array(["©" in b.text for b in blocks])] = BAD
    return label


def second_pass(blocks: list[Block], label: np.ndarray) -> np.ndarray:
    """Whether each block is kept: open ones take the label of the nearest decided block of their section or its border."""
    n = len(blocks)
    section, border = np.array([b.section for b in blocks]), np.array([b.zone != ELSEWHERE for b in blocks]).astype(int)
    first = np.flatnonzero(np.append(True, section[1:] != section[:-1]))
    sizes = np.diff(np.append(first, n))
    start, end, place = np.repeat(first, sizes), np.repeat(first + sizes, sizes), np.arange(n)
    decided = label != OPEN
    back = np.maximum(np.maximum.accumulate(np.where(decided, place, -1)), start - 1)
    ahead = np.minimum(np.minimum.accumulate(np.where(decided, place, n)[::-1])[::-1], end)
    of_back = np.where(back < start, border, label[np.maximum(back, 0)])
    of_ahead = np.where(ahead >= end, border, label[np.minimum(ahead, n - 1)])
    heading = np.array([b.heading for b in blocks])
    nearest = np.where(place - back < ahead - place, of_back, of_ahead)
    nearest = np.where(place - back == ahead - place, np.where(of_back == of_ahead, of_back, border), nearest)
    nearest = np.where(heading & (ahead < end), of_ahead, nearest)
    return np.where(decided, label, nearest) == GOOD


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, kept in zip(blocks, second_pass(blocks, first_pass(blocks))) if kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the html, plus text and n_chars (its code points)."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = shipped(pages).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{html}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(p) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["_row", "text", "n_chars"])

    schema = StructType([rows.schema["_row"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in kept], "text", "n_chars")

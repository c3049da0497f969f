"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block has its words, its link density and those
of the blocks before and after it, the share of the page's running text in the part it stands in,
and marks from the elements around it. The tree is grown from the blocks of PAGES, a few small
pages whose blocks are labelled. A part of the page with a name of page furniture counts as one
only if it is a small one without the page's heading: names alone decide nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.shared import bounded

_OPENS = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
#: A tag whose quoted values, if any, hold no angle brackets.
_PLAIN = re.compile(r"((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
_MARK, _COMMENT_ENDS = re.compile("[>\"']"), re.compile("--!?>")
#: Elements whose content is no markup: only their own closing tag ends them.
_RAW = re.compile(r"<(script|style|noscript|textarea|title|iframe|xmp|noembed|noframes)\b", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in "script style noscript textarea title iframe xmp noembed noframes".split()}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Names of page furniture in class, id and role attributes, as parts between dashes, underscores and case changes.
_FURNITURE = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget "
    "cookie cookies consent gdpr notice alert disclaimer popup modal overlay dialog newsletter subscribe subscription signup login search form share sharing social related recommended recommendations "
    "comment comments commentlist respond reply replies disqus discussion pagination pager toolbar complementary contentinfo".split()
)
_CONTENT = frozenset("article main content post entry story body".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button select option label fieldset template svg head object canvas audio video".split())
#: An opening tag of the first kind ends open elements of the second.
_ENDS = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_STOPS = frozenset("ul ol dl table article section div body nav aside footer header main form td th".split())
#: The stops of each of these opening tags: an element that the tag ends is none.
_STOPS_OF = {tag: tuple(_STOPS.difference(ends)) for tag, ends in _ENDS.items()}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    part: int
    article: bool
    heading: bool


@dataclass
class Part:
    """An element that may be page furniture: by its tag or by a name. wraps: the page's own heading or article is in it."""

    above: int
    by_tag: bool
    form: bool
    words: int = 0
    wraps: bool = False


def _furniture(tag: str, attributes: str, article: bool) -> tuple[bool, bool, bool]:
    """Whether an element may be page furniture by its tag, and by a name; and whether an article begins."""
    names = set()
    if attributes and "=" in attributes:
        for found in _NAMES.findall(attributes):
            names |= {p.lower() for p in _PART.findall("".join(found))}
    inside = tag in ("article", "main") or bool(names & _CONTENT and not names & _FURNITURE)
    named = tag not in ("html", "body", "main") and bool(names & _FURNITURE) and not (article and names & {"header", "banner", "body"})
    return tag in _FURNITURE_TAGS or (tag == "header" and not article), named, inside and not (named and tag == "article")


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags in order; no name for what isn't shown: comments, declarations, and elements without markup.

    A ">" within quotes ends no tag, unless the quotes never end. Each place is gone over a bounded number of times: behind the last
    ">" of the page nothing is a tag, and an opening quote from which no tag could be ended is remembered.
    """
    last, dead, at = page.rfind(">"), set(), 0

    def ending(i: int) -> int:
        """Where the ">" of a tag is whose attributes begin at i; -1 without one outside quotes."""
        passed = []
        while i <= last and (mark := _MARK.search(page, i)):
            q = mark.start()
            if page[q] == ">":
                return q
            if q in dead:
                break
            passed.append(q)
            i = page.find(page[q], q + 1) + 1
            if not i:
                break
        dead.update(passed)
        return -1

    while 0 <= (start := page.find("<", at)) < last:
        at = start + 1
        if page.startswith("<!--", start):
            end = _COMMENT_ENDS.search(page, start + 4)
            at = end.end() if end else len(page)
            yield start, at, "", "", ""
            continue
        opens = _OPENS.match(page, start)
        if not opens:
            if page[start + 1] in "!?/":
                at = page.find(">", start + 2) + 1
                yield start, at, "", "", ""
            continue
        plain = _PLAIN.match(page, opens.end())
        end = plain.end() - 1 if plain else ending(opens.end())
        if end >= 0 and not opens[1] and (raw := _RAW.match(page, start)):
            closing = _RAW_ENDS[raw[1].lower()].search(page, end + 1)
            at = page.find(">", closing.end()) + 1 if closing and closing.end() <= last else len(page)
            yield start, at, "", "", ""
            continue
        if end < 0:
            end = page.find(">", opens.end())
        at = end + 1
        yield start, at, opens[1], opens[2].lower(), page[opens.end() : end]
    start = page.find("<!--", at)
    if start >= 0:  # a comment that never ends
        yield start, len(page), "", "", ""


def page_blocks(page: str) -> tuple[list[Block], list[Part]]:
    """Blocks with some text, in page order, references decoded, white space within a block made one space; and the
    parts of the page that they stand in, the first being the page itself."""
    out: list[Block] = []
    parts = [Part(-1, False, False)]
    stack: list[tuple[str, int, bool]] = []
    places: dict[str, list[int]] = {}  # of each tag, where its open elements are on the stack
    pieces: list[str] = []
    part, article = 0, False
    link, linked, heading, at = 0, 0, False, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(linked, words), part, article, heading))
            parts[part].words += words - out[-1].linked
        pieces.clear()
        linked = 0

    def last(tags: tuple[str, ...]) -> int:
        return max((found[-1] for t in tags if (found := places.get(t))), default=-1)

    def cut(i: int) -> None:
        """Ends the open elements from place i on."""
        nonlocal part, article
        for name, _, _ in stack[i:]:
            places[name].pop()
        del stack[i:]
        part, article = stack[-1][1:] if stack else (0, False)

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link:
            linked += len(text.split())

    def wrap() -> None:
        """The page's heading or article begins: named parts and forms around it hold the page's text."""
        i = part
        while i >= 0 and not parts[i].wraps and (parts[i].form or not parts[i].by_tag):
            parts[i].wraps = True
            i = parts[i].above

    for start, end, closing, tag, attributes in tokens(page):
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            link = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        if tag in _BLOCK:
            close()
        if closing:
            heading = heading and tag not in ("h1", "h2", "h3", "h4", "h5", "h6")
            if places.get(tag):
                cut(places[tag][-1])
        elif tag not in _VOID:
            if tag in _ENDS:
                stop = last(_STOPS_OF[tag])
                while (i := last(_ENDS[tag])) > stop:
                    cut(i)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = True
            elif tag in _BLOCK:
                heading = False
            if not attributes.endswith("/"):
                by_tag, named, begins = _furniture(tag, attributes, article)
                if begins or tag == "h1":
                    wrap()
                if by_tag or named:
                    parts.append(Part(part, by_tag, tag == "form"))
                    part = len(parts) - 1
                article = article or begins
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, part, article))
    add(page[at:])
    close()
    for p in reversed(parts[1:]):
        parts[p.above].words += p.words
    return out, parts


FEATURES = ("words", "link", "words_before", "link_before", "words_after", "link_after", "named_share", "tag_share", "article", "heading")
#: Labelled pages: [+n] stands for n words of main text, [-n] for n others; a block has the label of its words.
PAGES = (
    # news: menu, advert, article element, footer
    "<nav><ul><li><a>[-1]</a><li><a>[-2]</a><li><a>[-1]</a></ul></nav><div class=ad>[-7]</div><article><h1>[+12]</h1><p>[+80]<p>[+6]<p>[+1]<p>[+45]<p>[+9]</article><footer>[-11]</footer>",
    "<header><a>[-2]</a> [-3]</header><nav><a>[-1]</a> <a>[-1]</a></nav><main><h1>[+6]</h1><p>[+3]<p>[+120]<ul><li>[+4]<li>[+2]<li>[+5]</ul><p>[+25]<div class=share><a>[-1]</a> <a>[-1]</a></div><p>[+2]</main><aside><h2>[-3]</h2><p>[-40]<p>[-18]</aside><footer><a>[-2]</a> [-8]</footer>",
    # blog without semantic elements: densities and neighbours alone
    "<div><a>[-1]</a></div><div><a>[-2]</a></div><div>[-7]</div><h1>[+8]</h1><div>[+60]</div><div>[+5]</div><div>[+95]</div><div>[+30]</div><div>[-9]</div>",
    "<div><a>[-3]</a></div><div><a>[-1]</a></div><h2>[+3]</h2><div>[+70]</div><div>[+40]</div><h3>[+4]</h3><div>[+55]</div><div>[+12]</div><div>[+65]</div><div><a>[-4]</a></div><div><a>[-2]</a></div><div>[-6]</div>",
    "<table><tr><td><a>[-1]</a><td><a>[-1]</a></table><p>[-5]<p>[+50]<p>[+28]<p>[+7]<p>[+33]<p><a>[-3]</a> [-2] <a>[-4]</a>",
    "<div><a>[-1]</a></div><div><a>[-2]</a></div><div>[-6]</div><div>[+90]</div><div>[+41]</div><div>[-8]</div>",
    "<div><a>[-2]</a></div><h2>[+3]</h2><div>[+38]</div><div>[+52]</div><p>[+3]</p><div>[+64]</div><div><a>[-3]</a></div>",
    "<ul><li><a>[-1]</a><li><a>[-1]</a></ul><h1>[+9]</h1><p>[+18]<p>[+5]<p>[+2]<p>[+1]<p>[+12]<p>[+77]<p>[+6]<p>[+8]<ul><li><a>[-3]</a></ul>",
    "<div><a>[-9]</a></div><h1>[+7]</h1><p>[+60]<p>[+16]<h2>[+2]</h2><p>[+24]<div><a>[-12]</a></div>",
    # names around the text of the page, and around small parts of it
    "<div class='post share'><h1>[+7]</h1><p>[+90]<p>[+10]<p>[+50]</div><div class=related><a>[-5]</a> <a>[-6]</a></div>",
    "<div class=login-guide><p>[+75]<p>[+42]<p>[+8]<p>[+31]</div><div class=sidebar><p>[-20]<p>[-4]</div>",
    "<div class=story-related><article><h1>[+9]</h1><p>[+66]<p>[+15]</article></div><div class=comments><h2>[-2]</h2><p>[-45]<p>[-12]</div>",
    "<div id=cookie-notice>[-38]</div><article><h1>[+5]</h1><p>[+58]<p>[+3]</article><section id=comments><h2>[-1]</h2><p>[-50]<p>[-6]<p>[-22]</section>",
    "<form id=page><h1>[+6]</h1><p>[+85]<p>[+20]</form><form class=newsletter><p>[-14]<label>[-2]</label></form>",
    "<main><h1>[+4]</h1><p>[+35]<div class=newsletter-signup><p>[-16]</div><p>[+48]<div class=ad-slot>[-5]</div><p>[+11]</main><aside><p>[-70]</aside><footer>[-30]</footer>",
    # text to the end of the page
    "<nav><a>[-2]</a></nav><article><h1>[+8]</h1><p>[+44]<p>[+60]</article>",
    "<header><h2>[-2]</h2></header><article><h1>[+3]</h1><p>[+33]<p>[+20]<p>[+2]</article>",
    "<div><a>[-1]</a></div><div><a>[-2]</a></div><h1>[+5]</h1><div>[+70]</div><div>[+4]</div><div>[+25]</div>",
    # links within a text, lists of links, and texts of links
    "<article><h1>[+10]</h1><p>[+20] <a>[+4]</a> [+30]<p>[+3] <a>[+2]</a> [+4]<ul><li><a>[-5]</a><li><a>[-4]</a><li><a>[-6]</a></ul><p>[+52]</article>",
    "<div><a>[-6]</a></div><div><a>[-8]</a> [-2]</div><div><a>[-7]</a></div><h2>[-3]</h2><div><a>[-5]</a></div><div>[-2] <a>[-9]</a></div>",
)


def labelled(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of the blocks of labelled pages, and 1 for main text."""
    rows, labels = [], []
    for page in pages:
        found, parts = page_blocks(re.sub(r"\[([+-])(\d+)\]", lambda m: " ".join([{"+": "yes", "-": "no"}[m[1]]] * int(m[2])), page))
        rows += rows_of(found, parts)
        labels += ["yes" in b.text.split() for b in found]
    return np.array(rows, dtype=np.float64), np.array(labels, dtype=np.float64)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 1):
    """A tree (feature, limit, tree at or below, tree above) by Gini impurity, or the share of label 1 at a leaf."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= limit
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(limit), low
    if best is None:
        return share
    _, f, limit, low = best
    return f, limit, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least)


def decide(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def rows_of(found: list[Block], parts: list[Part]) -> list[tuple]:
    """The values of FEATURES of each block of a page; a missing neighbour has no words and no links. The shares are those
    of the innermost part by name and by tag, of all unlinked words: 1 where there is none, or one that wraps the page's
    heading or article; 0 where something else wraps these."""
    total = max(parts[0].words, 1)
    shares = [(1.0, 1.0)]
    for p in parts[1:]:
        named, tag = shares[p.above]
        own = 0.0 if parts[0].wraps else p.words / total
        shares.append((named, tag) if p.wraps else (named, own) if p.by_tag else (own, tag))
    size = [(b.words, b.linked / b.words) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], *shares[b.part], int(b.article), int(b.heading)) for i, b in enumerate(found)]


def main_text(page: str, tree) -> tuple[str, int, int]:
    """The main text, and the numbers of blocks and of blocks kept."""
    found, parts = page_blocks(page)
    kept = [b.text for b, row in zip(found, rows_of(found, parts), strict=True) if decide(tree, row)]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", examples: tuple[str, ...] = PAGES) -> DataFrame:
    """Rows (key, url, text, n_chars, n_blocks, n_kept), one for each row of pages.

    A null or empty page, and one without main text, has the empty text. The tree is grown from the
    blocks of ``examples``. Equal pages give equal texts;
    unclosed tags, comments and scripts reach to where their element must end; an empty table gives no rows.
    """
    tree = grow(*labelled(examples))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                made = [main_text(p or "", tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[0] for m in made], pa.string()), *(pa.array(x, pa.int64()) for x in ([len(m[0]) for m in made], [m[1] for m in made], [m[2] for m in made]))], names=["key", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = bounded(pages).select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars long, n_blocks long, n_kept long").withColumnRenamed("key", key)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

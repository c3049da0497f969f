"""Note anchors: small codes for page rectangles, word spans on pages and character spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes (fixed values): a rectangle; highlight, underline and strike of page words; comment, highlight, underline and strike of text.
PAGE_MARKS, TEXT_MARKS = ("pdfh", "pdfu", "pdfs"), ("txc", "txh", "txu", "txs")
_RECT = r"^pdf:(\d+):(-?\d+),(-?\d+),(-?\d+),(-?\d+)$"
_PAGE = r"^(pdfh|pdfu|pdfs):(\d+):(\d+)-(\d+)$"
_TEXT = r"^(txc|txh|txu|txs):(\d+)-(\d+)$"


def parse(c: Column) -> Column:
    """struct(kind, page, x0, y0, x1, y1, start, end), or null where the code or its bounds are wrong."""
    number = lambda pattern, i: F.regexp_extract(c, pattern, i).try_cast("long")
    none = F.lit(None).cast("long")
    made = lambda kind, page, rect, span: F.struct(kind.alias("kind"), page.alias("page"), *(x.alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), rect, strict=True)), span[0].alias("start"), span[1].alias("end"))
    rect = [number(_RECT, i) for i in range(2, 6)]
    page, text = (number(_PAGE, 3), number(_PAGE, 4)), (number(_TEXT, 2), number(_TEXT, 3))
    return (
        F.when(c.rlike(_RECT) & (rect[0] < rect[2]) & (rect[1] < rect[3]), made(F.lit("pdf"), number(_RECT, 1), rect, (none, none)))
        .when(c.rlike(_PAGE) & (page[0] <= page[1]), made(F.regexp_extract(c, _PAGE, 1), number(_PAGE, 2), [none] * 4, page))
        .when(c.rlike(_TEXT) & (text[0] < text[1]), made(F.regexp_extract(c, _TEXT, 1), none, [none] * 4, text))
    )


def rectangle(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Code of a rectangle with rounded edges (half to even); null where it has no area or the page is negative."""
    edges = [F.bround(x).cast("long") for x in (x0, y0, x1, y1)]
    code = F.concat(F.lit("pdf:"), page.cast("string"), F.lit(":"), F.concat_ws(",", *(e.cast("string") for e in edges)))
    return F.when((page >= 0) & (edges[0] < edges[2]) & (edges[1] < edges[3]), code)


def span(kind: str, start: Column, end: Column, page: Column | None = None) -> Column:
    """Code of a span: inclusive on pages, half open in text; null where it is empty."""
    place = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    if kind in PAGE_MARKS:
        return F.when((page >= 0) & (start >= 0) & (start <= end), F.concat(F.lit(f"{kind}:"), page.cast("string"), F.lit(":"), place))
    if kind in TEXT_MARKS:
        return F.when((start >= 0) & (start < end), F.concat(F.lit(f"{kind}:"), place))
    raise ValueError(f"no such mark: {kind}")


#: Colours of marks without a style of their own (fixed values).
HIGHLIGHT, LINE = "#FFE066", "#E0463C"


def on_page(c: Column) -> Column:
    """Whether a code is one of a page: a rectangle or a mark of page words."""
    return F.coalesce(c.rlike("^(?:pdf|pdfh|pdfu|pdfs):"), F.lit(False))


def style_of(kind: Column, given: Column) -> Column:
    """The colour given, or the default of a kind of mark."""
    return F.when(F.trim(F.coalesce(given, F.lit(""))) != "", F.trim(given)).when(kind == "highlight", HIGHLIGHT).otherwise(LINE)


def note_fault(paper_known: Column, kind: Column, content: Column, anchor: Column) -> Column:
    """Null where a note may be added: its paper is there, its place is right, and it has a text unless it is a mere mark."""
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    return F.when(~paper_known, "paper").when(kind.isin("paragraph", "comment") & blank, "content").when((kind != "paragraph") & anchor.isNull(), "anchor")

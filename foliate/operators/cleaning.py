"""Repair of extracted text: spaces within Han text, wrapped lines, noise lines, and paragraphs of page lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx

#: Han characters and full-width marks (fixed values).
_HAN, MARKS = r"一-鿿㐀-䶿", "，。；：、？！）】》〉」』…—·～（【《〈「『"
#: Marks behind which a line ends, beginnings of list items and of numbered headings (fixed values).
_ENDS = tx.SENTENCE_ENDS + "：:"
_ITEM = r"^\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|（\s*\d+\s*）|\d+\s*[.、)]|[▪•·\-*]\s+)"
NUMBERED = r"^\s*(?:[一二三四五六七八九十]+\s*[、.．]|[（(]\s*[一二三四五六七八九十0-9]+\s*[）)]|\d+(?:\.\d+)*\s*[、.．]|第\s*[一二三四五六七八九十0-9]+\s*[章节])"
#: Page numbers, notes of continuation, unmapped glyphs and editors' marks (fixed values).
_PAGE_NUMBER, _CONTINUED = r"^[\s—–\-－·.．]*\d{1,4}[\s—–\-－·.．]*$", r"[（(]\s*上接第\s*\d+\s*页\s*[）)]"
_GLYPH, _EDITOR = r"\(cid:\d+\)", r"\s*[（(]?\s*责\s*编\s*[:：][^）)]*[）)]?"
#: Items of a reference list, which are no running headers (fixed value).
_LISTED = r"^\s*\[\s*\d+\s*\]"
#: Limits of running headers and heading lines, and of gaps and indents that begin a paragraph (fixed values).
HEADER_LENGTH, HEADING_LENGTH, GAP_RATIO, GAP_EXTRA, INDENT_RATIO, INDENT_LEAST = 22, 30, 1.55, 4.0, 0.8, 6.0


def without_han_spaces(c: Column) -> Column:
    """Blanks between Han characters or full-width marks go; others stay."""
    return F.regexp_replace(c, rf"(?<=[{_HAN}{MARKS}])[ \t ]+(?=[{_HAN}{MARKS}])", "")


def unwrapped(c: Column) -> Column:
    """Lines of a block are joined: with a break behind a sentence end or before a list item, with a space between
    ASCII letters or digits, else directly. Blocks are set apart by one break. What joins two lines is told from
    these alone, so that the work is in proportion to the text."""

    def glued(own: Column) -> Column:
        def join(line: Column, i: Column) -> Column:
            edge = F.concat(F.right(F.get(own, i - 1), F.lit(1)), F.left(line, F.lit(1)))
            glue = F.when(edge.rlike(f"^[{_ENDS}]") | line.rlike(_ITEM), "\n").when(edge.rlike("^[A-Za-z0-9]{2}$"), " ").otherwise("")
            return F.when(i == 0, line).otherwise(F.concat(glue, line))

        return F.array_join(F.transform(own, join), "")

    merged = F.transform(F.split(c, r"\n\s*\n"), lambda b: tx.let(tx.line_paragraphs(b), glued))
    return F.array_join(F.filter(merged, lambda b: b != ""), "\n")


def is_garbage(line: Column) -> Column:
    """Stripped lines of symbols, or single words without Han characters: what glyphs of pictures leave behind.

    A line of one long ASCII word counts, too; this is for extracted Han text.
    """
    letters = F.length(F.regexp_replace(line, rf"[^{_HAN}A-Za-z0-9]", ""))
    symbols = F.length(line) - letters
    single = ~line.rlike(r"[一-鿿]") & ~line.contains(" ")
    return (line != "") & ((symbols > 2 * letters) | (single & ((letters >= 6) | F.length(line).between(2, 5) | ~line.rlike(r"^[\p{L}\p{N}]"))))


def cleaned_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text): texts without unmapped glyphs, page numbers, running headers, editors' marks and garbage
    lines, cut where another text is continued; blank lines between what stays are one."""
    cut = F.regexp_replace(F.split(F.col(text), _CONTINUED)[0], _GLYPH, "")
    rows = docs.select(key, F.posexplode(tx.lines(cut)).alias("no", "raw")).withColumn("whole", tx.strip(F.col("raw")))
    repeats = F.count("*").over(Window.partitionBy(key, "whole"))
    short = F.length("whole").between(1, HEADER_LENGTH) & ~F.col("whole").rlike(_LISTED)
    header = short & (repeats >= 2)
    line = F.regexp_replace("raw", _EDITOR, "")
    marked = rows.withColumn("header", header).withColumn("line", F.regexp_replace(line, f"{tx.BLANK}+$", "")).withColumn("bare", tx.strip(F.col("line")))
    # a line that an editor's mark was taken from counts as a header where what is left of it is one
    heads = marked.where("header").select(key, F.col("whole").alias("bare")).distinct().withColumn("again", F.lit(True))
    noisy = F.col("whole").rlike(_PAGE_NUMBER) | F.col("again").isNotNull() | is_garbage(F.col("bare"))
    kept = marked.join(heads, [key, "bare"], "left").where((F.col("whole") == "") | ((F.col("bare") != "") & ~noisy))
    order = Window.partitionBy(key).orderBy("no")
    blank = F.col("whole") == ""
    apart = kept.withColumn("blank", blank).withColumn("before", F.lag("blank").over(order)).where("NOT blank OR NOT coalesce(before, true)")
    parts = F.array_sort(F.collect_list(F.struct("no", F.when(F.col("blank"), "").otherwise(F.col("line")).alias("s"))))
    joined = F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["s"]), "\n"), r"\n+$", "")
    return docs.select(key).distinct().join(apart.groupBy(key).agg(joined.alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def page_paragraphs(lines: DataFrame) -> DataFrame:
    """Over (page, line, top, x0, text): rows (page, paragraph, text). A paragraph begins behind a wide gap, at an
    indent, or with a short numbered heading."""
    per_page = Window.partitionBy("page")
    order = per_page.orderBy("line")
    gap = F.col("top") - F.lag("top").over(order)
    rows = lines.withColumn("text", tx.strip(F.col("text"))).where("text <> ''").withColumn("gap", gap)
    stats = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("g"), F.array_sort(F.collect_list("x0")).alias("x"))
    middle = lambda a: F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)
    base = stats.select("page", F.when(F.size("g") > 0, middle(F.col("g"))).otherwise(0.0).alias("usual"), middle(F.col("x")).alias("left"))
    heads = (F.length("text") <= HEADING_LENGTH) & F.col("text").rlike(NUMBERED) & ~F.col("text").rlike("[。！？!?]")
    wide = F.col("gap") >= F.greatest(F.col("usual") * GAP_RATIO, F.col("usual") + GAP_EXTRA)
    indented = F.col("x0") - F.col("left") >= F.greatest(F.col("usual") * INDENT_RATIO, F.lit(INDENT_LEAST))
    opens = F.when(F.col("gap").isNull(), 0).otherwise((wide | indented | heads).cast("int"))
    numbered = rows.join(base, "page").withColumn("paragraph", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    return numbered.groupBy("page", "paragraph").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def json_block(c: Column) -> Column:
    """The JSON object in a model's reply: without its thoughts, from a fenced part where there is one, trailing
    commas dropped. Null where there is no object."""
    bare = tx.strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    fenced = F.get(F.filter(F.transform(F.split(bare, "```"), tx.strip), lambda p: p.contains("{")), F.lit(0))
    part = F.when(bare.contains("```"), F.coalesce(fenced, bare)).otherwise(bare)
    found = F.regexp_extract(part, r"(?s)\{.*\}", 0)
    repaired = F.regexp_replace(found, r",\s*([}\]])", "$1")
    return F.when((found != "") & F.try_parse_json(repaired).isNotNull(), repaired)


def section_text(dimension: Column, content: Column) -> Column:
    """A section's text: references line by line, others with their wrapped lines joined."""
    return F.when(dimension == "reference_list", F.array_join(tx.line_paragraphs(content), "\n")).otherwise(unwrapped(content))


def is_fragment(line: Column) -> Column:
    """A stripped line of less than six characters without a space or a Han character."""
    return ~line.contains(" ") & ~line.rlike(r"[一-鿿]") & (F.length(line) < 6)


#: Lines that are no running text: what is told about the paper and its authors, items of a reference list and lines that
#: go on with one, captions, and headings of references (fixed values).
META = r"^\s*(?:《[^》]+》|摘\s*要\s*[:：]?|关键词\s*[:：]|中图分类号|文献标识码|文章编号|基金项目|作者简介|作者单位|收稿日期|责\s*编\s*[:：]|●)"
_FOOTNOTE = r"(?:基金项目|作者简介|作者单位|收稿日期|责\s*编\s*[:：])"
_REFERENCE, _CAPTION = r"^\s*\[\s*\d+\s*\]", r"^\s*[图表]\s*\d*[\s.．、]"
_REFERENCE_GOES_ON = r"^\s*(?:\[[A-Z]{1,4}\]\.?|.*?(?:19|20)\d{2}\s*[，,（(]|.*?\d{1,4}\s*[-–]\s*\d{1,4})"
_REFERENCES = r"^\s*参\s*考\s*文\s*献\s*[:：]?\s*$"
#: Where a footnote begins within a line, and titles of authors (fixed values).
NOTE_BEGINS = r"\s*(?:[（(\[]\s*)?(?:作者简介|基金项目|作者单位|收稿日期)|[，,；;]?\s*主要研究方向\s*[:：]"
AUTHOR = r"(?:副教授|副研究员|讲师|教授|研究员|博士|硕士)"


#: What makes a line noise wherever it stands.
NOISE = "|".join((META, _FOOTNOTE, _REFERENCE, _REFERENCES, _REFERENCE_GOES_ON, _CAPTION))


def is_noise(line: Column) -> Column:
    """Stripped lines that no section's text is taken from."""
    numbered = line.contains("编号") & (line.contains("：") | line.contains(":"))
    return line.rlike(NOISE) | numbered | is_fragment(line)


def without_footnote(line: Column) -> Column:
    """What stands in a line before a footnote that has run into it, and before the last title of an author."""
    edges = "^[ \\[\\]（）()　\t，,；;、]+|[ \\[\\]（）()　\t，,；;、]+$"
    cut = tx.let(F.split(line, NOTE_BEGINS, 2)[0], lambda head: F.when(head.rlike(AUTHOR), F.regexp_replace(F.regexp_extract(head, rf"^(.*){AUTHOR}", 1), "副$", "")).otherwise(head))
    return F.regexp_replace(cut, edges, "")


#: The mark in front of a table that was put behind a text (fixed value).
_TABLE_MARK = r"\n*【(?:表格数据·第\d+页|Word表\d+)】"


def without_tables(c: Column) -> Column:
    """A text up to the first table that was put behind it."""
    return F.regexp_replace(F.split(F.coalesce(c, F.lit("")), _TABLE_MARK, 2)[0], f"{tx.BLANK}+$", "")


def with_tables(c: Column, tables: Column) -> Column:
    """A text with tables (structs of page, index, markdown) behind it, in their order, in place of those that it has."""
    blocks = F.transform(F.array_sort(tables), lambda t: F.concat(F.lit("\n\n【表格数据·第"), t["page"].cast("string"), F.lit("页】\n"), t["markdown"]))
    return F.concat(without_tables(c), F.array_join(blocks, ""))


def lenient_json(c: Column) -> Column:
    """JSON text as it is, or with trailing commas dropped and quotes within strings escaped: those that no comma, colon or
    closing bracket follows. Null where it can't be read even so.

    A quote closes a string where one of these marks comes next, and opens one behind one of them; all others are text.
    """
    commas = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    quotes = F.regexp_replace(commas, r'(?<!\\)(?<![\[{,:])(?<![\[{,:]\s)(?<![\[{,:]\s\s)"(?!\s*(?:[,:}\]]|$))', r'\\"')
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(commas).isNotNull(), commas).when(F.try_parse_json(quotes).isNotNull(), quotes)


#: Words of messages by what they tell (fixed values).
_FILE, _REFUSED = ("file", "文件", "附件"), ("supported values", "invalid_value", "not support", "unsupported", "item must be dict", "should in dict", "content is list", "file_id", "file_url", "不支持")
_TOO_LARGE = ("过大", "超限", "超过内联", "上限", "too large", "exceed", "request entity too large", "413")
_TOOLS = ("tools", "tool_choice", "tool_calls", "function", "unknown parameter", "unexpected field", "unrecognized", "invalid parameter", "参数不支持", "不支持的参数", "未知参数")
_PROTOCOL = ("400", "bad request", "invalid", "unsupported", "不支持")
_TOO_LONG = ("maximum context length", "context_length_exceeded", "context length", "maximum tokens", "token length", "input length", "too long", "reduce the length", "上下文", "长度", "太长")


def message_kinds(c: Column) -> dict[str, Column]:
    """What a message of a refused request tells: file_refused, degradable, tools_refused, too_long."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    refused = has(_FILE) & has(_REFUSED)
    return {"file_refused": refused, "degradable": refused | has(_TOO_LARGE), "tools_refused": has(_TOOLS) & has(_PROTOCOL), "too_long": has(_TOO_LONG)}

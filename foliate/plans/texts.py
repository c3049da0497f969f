"""Queries of line predicates, repaired replies, note rules, page layout and filled sections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import anchors as an
from foliate.functions import text as tx
from foliate.operators import cleaning as cl
from foliate.operators import fallback as fb
from foliate.operators import layout as lo
from foliate.operators import structure as st
from foliate.plans.documents import _BOXES, _GLUE, _LINES, _PARSED, _SECTIONED, _anchored, _boxes, _docs, _sectioned, _spread
from foliate.plans.registry import query
from foliate.sources import bridge as br
from foliate.sources import files
from foliate.sources.bridge import with_views

# words and lines

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9ß-öø-ɏ]{2,}')"


@query("str02_tokens", f"SELECT doc_id, len({_TOKENS}) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def str02(spark, sf_dir):
    words = tx.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query("str03_word_sets", f"SELECT doc_id, len(list_distinct({_TOKENS})) AS n, sha256(array_to_string(list_sort(list_distinct({_TOKENS})), ' ')) AS digest FROM documents")
def str03(spark, sf_dir):
    words = F.array_sort(F.array_distinct(tx.tokens(F.col("text"))))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


@query("str09_han_spaces", "SELECT doc_id, '研究方法， ' || source || ' 结论：' || lang || ' ' || text AS text FROM documents")
def str09(spark, sf_dir):
    """Spaces within Han text go; one between a mark and a Latin word stays."""
    spaced = F.concat(F.lit("研 究\t方  法 ， "), "source", F.lit(" 结 论 ："), "lang", F.lit(" "), "text")
    return _docs(spark, sf_dir).select("doc_id", cl.without_han_spaces(spaced).alias("text"))


_FRAGMENT = "NOT contains(s, ' ') AND NOT regexp_matches(s, '[一-鿿]') AND length(s) < 6"


@query("str12_fragments", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(line) AS s FROM ({_LINES})) WHERE s <> '' AND {_FRAGMENT} GROUP BY doc_id")
def str12(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(tx.line_paragraphs(F.col("text"))).alias("s"))
    return rows.where(cl.is_fragment(F.col("s"))).groupBy("doc_id").agg(F.count("*").alias("n"))


_MARKED = ("", "[12] ", "图 2 ", "基金项目：", "参考文献", "收稿日期 ", "编号：", "《题》")


#: The rule in SQL, over stripped lines s.
NOISE_SQL = f"(regexp_matches(s, '{cl.NOISE}') OR contains(s, '编号') AND regexp_matches(s, '[：:]') OR {_FRAGMENT})"


@query("str13_noise_lines", f"SELECT doc_id, string_agg(CAST(line_no AS VARCHAR), '|' ORDER BY line_no) AS noise FROM (SELECT doc_id, line_no, CASE WHEN line_no % 16 < 8 THEN list_extract([{', '.join(f"'{m}'" for m in _MARKED)}], CAST(line_no % 8 + 1 AS BIGINT)) ELSE '' END || trim(line) AS s FROM ({_LINES}) WHERE trim(line) <> '') WHERE {NOISE_SQL} GROUP BY doc_id")
def str13(spark, sf_dir):
    """Lines as they are, and lines behind a mark that makes them noise."""
    marked = F.filter(F.transform(tx.lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), tx.strip(x).alias("s"))), lambda r: r["s"] != "")
    mark = F.when(F.col("r.i") % 16 < 8, F.get(F.array(*map(F.lit, _MARKED)), F.col("r.i") % 8)).otherwise("")
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(marked).alias("r")).select("doc_id", "r.i", F.concat(mark, "r.s").alias("s"))
    noise = F.array_sort(F.collect_list(F.when(cl.is_noise(F.col("s")), F.col("i"))))
    return rows.groupBy("doc_id").agg(F.array_join(noise, "|").alias("noise")).where("noise <> ''")


#: What footnotes that have run into a line look like, by line.
_RUN_IN = ("", "，（作者简介：张三", "副教授，主要研究方向：材料", "（", " [收稿日期 2020", "讲师博士后面", "；", "基金项目：某")


@query(
    "str14_without_footnotes",
    f"""WITH l AS (SELECT doc_id, line_no, trim(line) || list_extract([{", ".join(f"'{x}'" for x in _RUN_IN)}], CAST((doc_id + line_no) % 8 + 1 AS BIGINT)) AS s FROM ({_LINES}) WHERE trim(line) <> ''),
 h AS (SELECT doc_id, line_no, regexp_split_to_array(s, '{cl.NOTE_BEGINS}')[1] AS h FROM l), c AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(h, '{cl.AUTHOR}') THEN regexp_replace(regexp_extract(h, '^(.*){cl.AUTHOR}', 1), '副$', '') ELSE h END AS c FROM h)
 SELECT doc_id, sha256(string_agg(trim(c, ' []（）()　' || chr(9) || '，,；;、'), chr(10) ORDER BY line_no)) AS digest, CAST(sum(length(trim(c, ' []（）()　' || chr(9) || '，,；;、'))) AS BIGINT) AS chars FROM c GROUP BY doc_id""",
)
def str14(spark, sf_dir):
    """The lines of texts, of which most have a footnote run into them."""
    ends = F.array(*map(F.lit, _RUN_IN))
    lines = F.filter(F.transform(tx.lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), tx.strip(x).alias("s"))), lambda r: r["s"] != "")
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(lines).alias("r"))
    bare = rows.select("doc_id", "r.i", cl.without_footnote(F.concat("r.s", F.get(ends, ((F.col("doc_id") + F.col("r.i")) % 8).cast("int")))).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "\n")
    return bare.groupBy("doc_id").agg(F.sha2(joined, 256).alias("digest"), F.sum(F.length("s")).alias("chars"))


@query("str18_merged_tables", "SELECT doc_id, rtrim(text, ' ' || chr(10)) || chr(10) || chr(10) || '【表格数据·第1页】' || chr(10) || source || chr(10) || chr(10) || '【表格数据·第2页】' || chr(10) || lang AS text FROM documents")
def str18(spark, sf_dir):
    """Tables put behind a text take the place of those that are there: once or twice gives the same."""
    tables = F.array(F.struct(F.lit(2).alias("page"), F.lit(0).alias("index"), F.col("lang").alias("markdown")), F.struct(F.lit(1).alias("page"), F.lit(0).alias("index"), F.col("source").alias("markdown")))
    return _docs(spark, sf_dir).select("doc_id", cl.with_tables(cl.with_tables(F.col("text"), tables), tables).alias("text"))


@query("str23_lenient_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'a \"b\" c, d' AS note FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 3 = 2")
def str23(spark, sf_dir):
    broken = F.regexp_replace("props", r"\}$", ', "note": "a "b" c, d",}')
    told = F.regexp_replace("props", r"\}$", ', "note": "a \\\\"b\\\\" c, d"}')
    json = cl.lenient_json(F.when(F.col("event_id") % 3 == 0, broken).when(F.col("event_id") % 3 == 1, told).otherwise("{no json"))
    return br.table(spark, sf_dir, "events").select("event_id", F.get_json_object(json, "$.k").alias("k"), F.get_json_object(json, "$.note").alias("note"))


@query("str24_message_kinds", "SELECT event_id, event_id % 5 = 0 AS file_refused, event_id % 5 IN (0, 1) AS degradable, event_id % 5 = 2 AS tools_refused, event_id % 5 = 3 AS too_long FROM events")
def str24(spark, sf_dir):
    said = F.array(*map(F.lit, ("File type NOT supported values", "文件过大", "400: unknown parameter tools", "Maximum context length is 8", "timed out")))
    kinds = cl.message_kinds(F.get(said, (F.col("event_id") % 5).cast("int")))
    return br.table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in kinds.items()))


# notes


@query("anc02_page_marks", "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'pdfh:' || event_id % 7 || ':' || event_id % 5 || '-' || (event_id % 5 + event_id % 4) END AS code, CASE WHEN event_id % 4 <> 3 THEN event_id % 5 + event_id % 4 END AS stop FROM events")
def anc02(spark, sf_dir):
    e = F.col("event_id")
    code = an.span("pdfh", e % 5, F.when(e % 4 == 3, e % 5 - 1).otherwise(e % 5 + e % 4), page=e % 7)
    return br.table(spark, sf_dir, "events").select("event_id", code.alias("code"), an.parse(code)["end"].alias("stop"))


@query("anc03_text_marks", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'txu:' || event_id || '-' || (event_id + event_id % 4) END AS code, CASE WHEN event_id % 4 <> 0 THEN event_id END AS start FROM events")
def anc03(spark, sf_dir):
    code = an.span("txu", F.col("event_id"), F.col("event_id") + F.col("event_id") % 4)
    return br.table(spark, sf_dir, "events").select("event_id", code.alias("code"), an.parse(code)["start"].alias("start"))


@query("anc04_anchor_kinds", with_views("SELECT id, paragraph_pos LIKE 'pdf%' AS on_page, CASE WHEN paragraph_pos LIKE 'pdf:%' THEN 'pdf' WHEN paragraph_pos LIKE 'txh:%' THEN 'txh' END AS kind FROM note", "note"))
def anc04(spark, sf_dir):
    return _anchored(spark, sf_dir).select("id", an.on_page(F.col("paragraph_pos")).alias("on_page"), F.col("a.kind").alias("kind"))


@query("anc05_note_rules", with_views("SELECT note.id, CASE WHEN lib.id IS NULL THEN 'paper' WHEN note.id % 4 IN (0, 1) AND note.id % 3 = 0 THEN 'content' WHEN note.id % 4 <> 0 AND paragraph_pos = '' THEN 'anchor' END AS fault, CASE WHEN note.id % 5 = 0 THEN '#123456' WHEN note.id % 4 = 2 THEN '#FFE066' ELSE '#E0463C' END AS style FROM note LEFT JOIN lib ON lib.id = lit_id AND lib.id % 7 <> 3", "note", "lib"))
def anc05(spark, sf_dir):
    known = br.library(spark, sf_dir).where("id % 7 <> 3").select(F.col("id").alias("lit_id"), F.lit(True).alias("_known"))
    kind = F.get(F.array(*map(F.lit, ("paragraph", "comment", "highlight", "underline"))), (F.col("id") % 4).cast("int"))
    rows = _anchored(spark, sf_dir).join(known, "lit_id", "left")
    fault = an.note_fault(F.coalesce("_known", F.lit(False)), kind, F.when(F.col("id") % 3 == 0, " ").otherwise("text"), F.col("a.kind"))
    return rows.select("id", fault.alias("fault"), an.style_of(kind, F.when(F.col("id") % 5 == 0, "#123456")).alias("style"))


@query("anc10_point_hits", with_views(f"SELECT lit_id, max(id) AS id FROM ({_PARSED}) WHERE kind = 'pdf' AND 10 <= 12 AND 12 <= x1 AND page % 2 = 1 GROUP BY lit_id", "note"))
def anc10(spark, sf_dir):
    """The newest note of each paper whose rectangle on an odd page holds the point (12, 30)."""
    inside = (F.col("a.x0") <= 12) & (F.col("a.x1") >= 12) & (F.col("a.y0") <= 30) & (F.col("a.y1") >= 30)
    return _anchored(spark, sf_dir).where(inside & (F.col("a.page") % 2 == 1)).groupBy("lit_id").agg(F.max("id").alias("id"))


# layout


def _sided(spark, sf_dir) -> DataFrame:
    return lo.sides(_boxes(spark, sf_dir).withColumn("divider", F.lit(215.0)))


_SIDED = f"SELECT *, CASE WHEN x0 <= 207.5 AND x1 >= 222.5 THEN 'span' WHEN (x0 + x1) / 2 < 215 THEN 'left' ELSE 'right' END AS side FROM ({_BOXES})"


@query("lay05_column_sides", f"SELECT page, pos, text, side FROM ({_SIDED})")
def lay05(spark, sf_dir):
    return _sided(spark, sf_dir).select("page", "pos", "text", "side")


@query("lay06_reading_slots", f"WITH w AS (SELECT DISTINCT page, side, top FROM ({_SIDED})), s AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top) - 1 AS k FROM w WHERE side = 'span') SELECT page, side, top, CASE WHEN side = 'span' THEN (SELECT k FROM s WHERE s.page = w.page AND s.top = w.top) ELSE (SELECT count(*) FROM s WHERE s.page = w.page AND s.top + 3.5 < w.top) END AS slot, CASE side WHEN 'span' THEN 2 WHEN 'right' THEN 1 ELSE 0 END AS rank FROM w")
def lay06(spark, sf_dir):
    """A word's top as a line: words of a side with the same top are one."""
    return lo.merge_slots(_sided(spark, sf_dir).select("page", "side", "top").distinct()).select("page", "side", "top", "slot", "rank")


@query("lay07_body_tops", f"WITH w AS (SELECT DISTINCT page, pos % 2 AS side, CAST(floor((pos + 1) / 2) * 12.0 + page % 5 * floor((pos + 1) / 2) AS DOUBLE) AS top FROM ({_BOXES})), p AS (SELECT page, top FROM w l WHERE side = 1 AND EXISTS (SELECT 1 FROM w r WHERE r.page = l.page AND r.side = 0 AND abs(r.top - l.top) <= 3.5)), g AS (SELECT *, lead(top) OVER (PARTITION BY page ORDER BY top) - top AS gap, (SELECT count(*) FROM p q WHERE q.page = p.page AND q.top BETWEEN p.top AND p.top + 120) AS n FROM p) SELECT page, min(top) AS body_top FROM g WHERE (gap IS NULL OR gap <= 30) AND n >= 4 GROUP BY page")
def lay07(spark, sf_dir):
    """Two columns of lines from the odd and even words of pages."""
    line = F.floor((F.col("pos") + 1) / 2)
    rows = _boxes(spark, sf_dir).select("page", F.when(F.col("pos") % 2 == 1, "left").otherwise("right").alias("side"), (line * 12.0 + F.col("page") % 5 * line).cast("double").alias("top"))
    return lo.body_tops(rows.distinct())


@query("lay08_page_texts")
def lay08(spark, sf_dir):
    """Words of an order as a page of two columns."""
    shifted = F.when(F.col("pos") % 2 == 0, F.col("x0") / 4 + 240).otherwise(F.col("x0") / 4)
    words = _boxes(spark, sf_dir).withColumn("x0", shifted).withColumn("x1", F.col("x0") + 30)
    return lo.page_texts(words, 440.0, 60.0, support=1)


@query("lay09_line_paragraphs", f"WITH l AS (SELECT page, top, min(x0) AS x0, min(text) AS text FROM (SELECT page, CAST(pos * 20.0 + CASE WHEN pos > 4 THEN 30 ELSE 0 END AS DOUBLE) AS top, x0, text FROM ({_BOXES})) GROUP BY page, top), g AS (SELECT *, top - lag(top) OVER (PARTITION BY page ORDER BY top) AS gap FROM l), m AS (SELECT page, coalesce(list_sort(list(gap) FILTER (gap > 0))[CAST(floor(count(gap) FILTER (gap > 0) / 2) AS INT) + 1], 0) AS usual, list_sort(list(x0))[CAST(floor(count(*) / 2) AS INT) + 1] AS base FROM g GROUP BY page), o AS (SELECT g.*, CASE WHEN gap IS NULL THEN 0 WHEN gap >= greatest(usual * 1.55, usual + 4) OR x0 - base >= greatest(usual * 0.8, 6) THEN 1 ELSE 0 END AS opens FROM g JOIN m ON m.page = g.page) SELECT page, string_agg(CASE WHEN gap IS NULL THEN '' WHEN opens = 1 THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY top) AS text FROM o GROUP BY page")
def lay09(spark, sf_dir):
    """Pages whose lines have one word each."""
    words = _boxes(spark, sf_dir).withColumn("top", F.col("pos") * 20.0 + F.when(F.col("pos") > 4, 30.0).otherwise(0.0))
    single = words.groupBy("page", "top").agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"), F.min("text").alias("text"))
    paragraphs = cl.page_paragraphs(lo.line_texts(single))
    return paragraphs.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


@query("ord09_reading_order", f"SELECT page, pos, text, row_number() OVER (PARTITION BY page ORDER BY top, x0, text) AS place FROM ({_BOXES})")
def ord09(spark, sf_dir):
    return _boxes(spark, sf_dir).select("page", "pos", "text", F.row_number().over(Window.partitionBy("page").orderBy("top", "x0", "text")).alias("place"))


@query("lay03_joined_words", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '研究，' || event_id WHEN 1 THEN '研究 ' || event_id ELSE '研究' || event_id END AS text FROM events")
def lay03(spark, sf_dir):
    """Three words of a line: Han ones and marks stand together, others where the gap is small."""
    e = F.col("event_id")
    parts = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit("研").alias("text")), F.struct(F.lit(30.0).alias("x0"), F.lit("究").alias("text")), F.struct(F.when(e % 3 == 2, 43.0).otherwise(60.0).alias("x0"), F.when(e % 3 == 0, F.concat(F.lit("，"), e.cast("string"))).otherwise(e.cast("string")).alias("text")))
    words = br.table(spark, sf_dir, "events").select(e.alias("page"), F.explode(parts).alias("w")).select("page", "w.*", (F.col("w.x0") + 12).alias("x1"), F.lit(7.0).alias("top"))
    return lo.line_texts(words).select(F.col("page").alias("event_id"), "text")


#: Beginnings of files by encoding: Han text, traditional Han text, and a Latin letter that a space follows.
_BEGINS = {"gb18030": "研究方法", "big5": "測試", "latin-1": "Café "}


@query(
    "src09_decoded_files",
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '{_BEGINS["gb18030"]}' || source WHEN 3 THEN '{_BEGINS["big5"].encode("big5").decode("gb18030")}' || source WHEN 4 THEN '{_BEGINS["latin-1"]}' || source ELSE trim(text, ' ' || chr(10)) END AS text,
 CASE doc_id % 5 WHEN 2 THEN 'gb18030' WHEN 3 THEN 'gb18030' WHEN 4 THEN 'latin-1' ELSE 'utf-8-sig' END AS encoding FROM documents""",
)
def src09(spark, sf_dir):
    """Files in UTF-8, with and without a mark of byte order and with DOS line breaks, in GB 18030, Big5 and Latin-1. As the first
    encoding that fits is taken, Big5 is read as GB 18030, which has a character for each of its pairs of bytes."""
    dos = F.encode(F.concat(F.lit("\ufeff"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(" \n")), "UTF-8")
    raw = F.when(F.col("doc_id") % 5 == 0, dos).when(F.col("doc_id") % 5 == 1, F.encode("text", "UTF-8"))
    for i, (name, begin) in enumerate(_BEGINS.items(), 2):
        raw = raw.when(F.col("doc_id") % 5 == i, F.concat(F.lit(bytearray(begin.encode(name))), F.encode("source", "UTF-8")))
    return files.decoded_texts(_docs(spark, sf_dir).select("doc_id", raw.alias("raw")), "raw", "doc_id")


@query("doc04_section_anchors", f"WITH {_SECTIONED} SELECT doc_id, dimension, string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) AS anchors FROM (SELECT DISTINCT doc_id, dimension, CAST(floor(line_no / 3) AS INT) AS p FROM lined JOIN dims ON d = CAST(least(floor(line_no / 3), 4) AS INT)) GROUP BY doc_id, dimension")
def doc04(spark, sf_dir):
    spaced = _sectioned(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\n(?=Abstract|Methods|Innovations|Conclusions|References)", "\n\n"))
    rows = st.section_paragraphs(spaced, empty=True).groupBy("doc_id", "dimension").agg(F.array_sort(F.collect_list("paragraph")).alias("p"))
    return rows.select("doc_id", "dimension", F.array_join(F.col("p").cast("array<string>"), "|").alias("anchors"))


# filled sections


_SENTENCES = ("本文采用问卷方法研究数据来源并分析了结果，得到了一些", "我们首次提出了一种新颖的设计思路，它的效果很好！", "五、结语", "这一部分总结了全部的工作并给出了展望。")


def _told(spark, sf_dir) -> DataFrame:
    """Texts with a Han sentence, or a heading of a conclusion, before every fifth line."""
    own = F.array(*map(F.lit, _SENTENCES))
    plain = F.array_join(F.transform(tx.lines(F.col("text")), lambda x, i: F.when(i % 5 == 2, F.concat(F.get(own, (i / 5).cast("int") % 4), F.lit("\n"), x)).otherwise(x)), "\n")
    return _spread(spark, sf_dir).select("doc_id", plain.alias("text"))


_TRUNCATED = "CASE WHEN length(t) <= {cap} THEN t WHEN c.cut - 1 >= {cap} // 2 THEN trim(substring(t, 1, c.cut), ' ' || chr(9) || chr(10)) ELSE trim(substring(t, 1, {cap}), ' ' || chr(9) || chr(10)) END"
_TOLD = f"""lined AS ({_LINES}), told AS (SELECT doc_id, line_no * 2 AS pos, line FROM lined UNION ALL SELECT doc_id, line_no * 2 - 1, list_extract([{", ".join(f"'{x}'" for x in _SENTENCES)}], CAST(line_no // 5 % 4 + 1 AS BIGINT)) FROM lined WHERE line_no % 5 = 2),
 numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, trim(line, ' ' || chr(9)) AS s FROM told),
 marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, {NOISE_SQL} AS noise, regexp_matches(s, '{fb.TITLE}') AS title, regexp_matches(s, '{cl.NUMBERED}') AS num FROM numbered WHERE s <> ''),
 kinds AS (SELECT *, noise OR num AND length(s) <= 30 AS stops, NOT noise AND NOT (k < 6 AND title) AS may, NOT noise AND regexp_matches(s, '{fb.METHOD}') AND (length(s) >= 20 OR num) AS method, NOT noise AND regexp_matches(s, '{fb.INNOVATION}') AND length(s) >= 20 AS innovation FROM marked),
 starts AS (SELECT doc_id, k, i, num, 'research_method' AS dimension, 4 AS size FROM kinds WHERE method QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1
 UNION ALL SELECT doc_id, k, i, num, 'innovation_point', 3 FROM kinds WHERE innovation QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1 UNION ALL SELECT doc_id, k, i, num, 'research_background', 4 FROM kinds WHERE may),
 near AS (SELECT b.doc_id, b.dimension, b.k AS k0, b.num AS num0, x.k, x.i, x.s, x.stops, lag(x.s) OVER w AS before, CASE WHEN x.i - lag(x.i) OVER w > 1 THEN 1 ELSE 0 END AS gap FROM starts b JOIN kinds x ON x.doc_id = b.doc_id AND x.k BETWEEN b.k AND b.k + b.size - 1 WINDOW w AS (PARTITION BY b.doc_id, b.dimension, b.k ORDER BY x.k)),
 spans AS (SELECT *, sum(CASE WHEN k > k0 AND stops THEN 1 ELSE 0 END) OVER v AS n_stops, sum(gap) OVER v AS n_gaps FROM near WINDOW v AS (PARTITION BY doc_id, dimension, k0 ORDER BY k)),
 texts AS (SELECT doc_id, dimension, k0, string_agg({_GLUE.replace("line, '^", "s, '^").replace("left(line", "left(s")} || s, '' ORDER BY k) AS t, string_agg(CAST(i AS VARCHAR), '|' ORDER BY k) AS lines FROM spans WHERE n_stops = 0 AND n_gaps <= CASE WHEN num0 THEN 1 ELSE 0 END GROUP BY doc_id, dimension, k0),
 cuts AS (SELECT *, 900 - length(regexp_extract(reverse(substring(t, 1, 900)), '^[^。！？!?”’' || chr(10) || ']*')) AS cut FROM texts),
 shown AS (SELECT doc_id, dimension, k0, lines, {_TRUNCATED.format(cap=900)} AS content FROM cuts c)"""


@query(
    "doc03_filled_spans",
    f"""WITH {_TOLD} SELECT doc_id, dimension, content, lines FROM shown WHERE content <> '' AND (dimension <> 'research_background' OR length(content) >= 20 AND regexp_matches(content, '{fb.SENTENCE}'))
 QUALIFY row_number() OVER (PARTITION BY doc_id, dimension ORDER BY k0) = 1""",
)
def doc03s(spark, sf_dir):
    """What stands in for background, methods and innovations of texts that have no headings of sections."""
    found = fb.filled_sections(_told(spark, sf_dir), precision=4).where(F.col("dimension").isin("research_background", "research_method", "innovation_point"))
    return found.select("doc_id", "dimension", "content", F.array_join(F.col("lines").cast("array<string>"), "|").alias("lines"))


@query("doc03_filled_sections")
def doc03(spark, sf_dir):
    """Texts of which some have headings, with Han sentences between their lines."""
    sentence = F.array(*map(F.lit, ("本文采用问卷方法研究数据来源。", "我们首次提出了一种新颖的设计思路，效果很好！", "五、结语", "这一部分总结了全部的工作并给出了展望。")))
    plain = F.array_join(F.transform(tx.lines(F.col("text")), lambda x, i: F.when(i % 5 == 2, F.concat(F.get(sentence, (i / 5).cast("int") % 4), F.lit("\n"), x)).otherwise(x)), "\n")
    docs = _spread(spark, sf_dir).select("doc_id", plain.alias("text")).where("doc_id % 2 = 1").union(_sectioned(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id", "text"))
    return fb.filled_sections(docs, precision=4)

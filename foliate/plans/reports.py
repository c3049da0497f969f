"""Queries of the cleaning, report and settings operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import cleaning as cl
from foliate.operators import report as rp
from foliate.operators import structure as st
from foliate.operators import tables as tb
from foliate.plans.documents import _GLUE, _LINES, _docs, _sectioned, _spread
from foliate.plans.registry import query
from foliate.sources import bridge as br
from foliate.sources import files
from foliate.sources.bridge import with_views


@query("src06_settings", "SELECT coalesce(d.k, e.event_type) AS config_key, coalesce(e.v, d.v) AS config_value FROM (VALUES ('click', 'a'), ('theme', 'light')) d(k, v) FULL JOIN (SELECT event_type, CAST(count(*) AS VARCHAR) AS v FROM events GROUP BY 1) e ON e.event_type = d.k")
def src06(spark, sf_dir):
    stored = br.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config_key")).agg(F.count("*").cast("string").alias("config_value"))
    return rp.settings(stored, {"click": "a", "theme": "light"})


@query("src07_file_faults", with_views("SELECT id, CASE WHEN id % 11 = 0 THEN 'no path' WHEN id % 11 = 1 THEN 'format' WHEN file_size <= 0 OR id % 11 = 2 THEN 'empty' END AS fault FROM lib", "lib"))
def src07(spark, sf_dir):
    n = F.col("id") % 11
    path = F.when(n == 0, " ").when(n == 1, F.concat("file_path", F.lit(".png"))).otherwise(F.concat(F.lit("X/"), F.replace("file_path", F.lit(".txt"), F.lit(".TXT"))))
    return br.library(spark, sf_dir).select("id", rp.file_fault(path, F.when(n == 2, 0).otherwise(F.col("file_size"))).alias("fault"))


@query("src14_manifest_files", with_views("SELECT path, size FROM prev", "prev"))
def src14(spark, sf_dir):
    rows = br.manifest_before(spark, sf_dir).withColumn("part", F.floor(F.regexp_extract("path", "([0-9]+)", 1).cast("long") / 500))
    manifests = rows.groupBy("part").agg(F.collect_list(F.struct("path", "size")).alias("f"))
    name = F.when(F.col("part") % 2 == 0, F.to_json(F.struct(F.col("f").alias("cumulative_files")))).otherwise(F.to_json(F.struct(F.col("f").alias("files"))))
    return files.manifest_files(manifests.select(name.alias("manifest"))).select("path", "size")


@query("snk02_text_reports", with_views("""SELECT lib.id, '解析报告_' || regexp_replace(trim(title, ' ' || chr(10)), '[\\\\/:*?"<>|]', '_', 'g') || '_' || lib.id || '.txt' AS file, '文献基础信息' || chr(10) || repeat('=', 40) || chr(10) || '文献标题：' || title || chr(10) || '作者：' || author || chr(10) || '发表时间：' || CASE WHEN publish_time = '' THEN '未知' ELSE publish_time END || chr(10) || '期刊/来源：' || journal_source || chr(10)
 || chr(10) || '二、核心观点' || chr(10) || repeat('=', 40) || chr(10) || trim(r.core_view, ' ' || chr(10)) || chr(10) AS report FROM lib JOIN (SELECT lit_id, arg_max(core_view, parse_seq) AS core_view FROM report GROUP BY lit_id) r ON r.lit_id = lib.id""", "lib", "report"))  # fmt: skip
def snk02(spark, sf_dir):
    newest = tb.latest(br.reports(spark, sf_dir), "lit_id", F.desc("parse_seq"), F.desc("id")).select(F.col("lit_id").alias("id"), "core_view")
    full = newest.select("id", F.lit("").alias("keywords"), *(F.col("core_view") if d == "core_view" else F.lit(None).cast("string").alias(d) for d in st.DIMENSIONS))
    return rp.text_reports(br.library(spark, sf_dir), full)


@query("flt14_visible_dimensions", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS core_view, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS reference_list FROM documents")
def flt14(spark, sf_dir):
    switches = F.concat(F.lit('{"core_view": '), (F.col("doc_id") % 2 != 0).cast("string"), F.lit(', "reference_list": '), (F.col("doc_id") % 3 != 0).cast("string"), F.lit("}"))
    on = lambda name: F.element_at(rp.filled_switches(switches), name)
    return _docs(spark, sf_dir).select("doc_id", F.when(on("core_view"), F.col("source")).otherwise("").alias("core_view"), F.when(on("reference_list"), F.col("lang")).otherwise("").alias("reference_list"))


@query("flt17_brief_arguments", "SELECT doc_id, CASE WHEN length(text) > 200 THEN '<' || length(text) || ' characters>' ELSE text END AS brief FROM documents")
def flt17(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.when(F.length("text") > 200, F.concat(F.lit("<"), F.length("text").cast("string"), F.lit(" characters>"))).otherwise(F.col("text")).alias("brief"))


@query("flt18_contained_paths", "SELECT page_id, page_id % 3 <> 0 AS inside FROM pages")
def flt18(spark, sf_dir):
    path = F.concat(F.lit("/data/./lib/"), F.when(F.col("page_id") % 3 == 0, "../../etc/").otherwise("a/../b/"), F.col("page_id").cast("string"))
    return br.table(spark, sf_dir, "pages").select("page_id", rp.within(path, "/data/lib").alias("inside"))


@query("str07_unwrapped_lines", f"WITH p AS (SELECT doc_id, line_no, trim(line) AS line FROM ({_LINES})), g AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM p WHERE line <> '') SELECT d.doc_id, coalesce(t, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg({_GLUE} || line, '' ORDER BY line_no) AS t FROM g GROUP BY doc_id) g ON g.doc_id = d.doc_id")
def str07(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", cl.unwrapped(F.col("text")).alias("text"))


@query("str10_cleaned_text")
def str10(spark, sf_dir):
    noise = F.concat(F.col("text"), F.lit("\n\n\n— 67 —\n(cid:12)ab cd\nHead line\nHead line\n!!##"))
    return cl.cleaned_lines(_spread(spark, sf_dir).select("doc_id", noise.alias("text")))


@query("str11_garbage_lines", f"SELECT doc_id, count(*) AS n FROM ({_LINES}) WHERE trim(line) <> '' AND (length(regexp_replace(trim(line), '[A-Za-z0-9]', '', 'g')) > 2 * (length(trim(line)) - length(regexp_replace(trim(line), '[A-Za-z0-9]', '', 'g'))) OR (NOT contains(trim(line), ' ') AND (length(trim(line)) - length(regexp_replace(trim(line), '[A-Za-z0-9]', '', 'g')) >= 6 OR length(trim(line)) BETWEEN 2 AND 5 OR NOT regexp_matches(trim(line), '^[\\p{{L}}\\p{{N}}]')))) GROUP BY doc_id")
def str11(spark, sf_dir):
    rows = _spread(spark, sf_dir).select("doc_id", F.explode(tx.line_paragraphs(F.col("text"))).alias("line"))
    return rows.where(cl.is_garbage(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("str22_json_blocks", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def str22(spark, sf_dir):
    reply = F.concat(F.lit("<think>{a}</think>Here:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    return br.table(spark, sf_dir, "events").select("event_id", F.get_json_object(cl.json_block(reply), "$.k").alias("k"))


@query("str26_urls", "SELECT page_id, regexp_replace(trim(url), '/+$', '') AS url FROM pages")
def str26(spark, sf_dir):
    return br.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(tx.strip(F.concat(F.lit(" "), F.col("url"), F.lit("/ "))), "/+$", "").alias("url"))


@query("str28_page_lists", "SELECT page_id, (page_id % 9) || '|' || (page_id + 1) AS pages FROM pages")
def str28(spark, sf_dir):
    listed = F.concat(F.col("page_id") % 9, F.lit(", x,，"), F.col("page_id") + 1)
    return br.table(spark, sf_dir, "pages").select("page_id", F.array_join(rp.page_numbers(listed).cast("array<string>"), "|").alias("pages"))


@query("set07_pages_left", with_views("SELECT lit_id, string_agg(CAST(p AS VARCHAR), '|' ORDER BY p) AS pages_left FROM (SELECT DISTINCT lit_id FROM note) CROSS JOIN (SELECT unnest(range(8)) AS p) WHERE (lit_id, p) NOT IN (SELECT lit_id, id % 100 FROM note) GROUP BY lit_id", "note"))
def set07(spark, sf_dir):
    read = br.notes(spark, sf_dir).groupBy("lit_id").agg(F.collect_set((F.col("id") % 100).cast("int")).alias("read"))
    left = F.array_except(F.sequence(F.lit(0), F.lit(7)), "read")
    return read.where(F.size(left) > 0).select("lit_id", F.array_join(left.cast("array<string>"), "|").alias("pages_left"))


@query("arr01_switches", with_views("SELECT lit_id, 'true|true|true|' || CASE WHEN lit_id % 2 = 0 THEN 'false' ELSE 'true' END || '|true|true' AS switches FROM report WHERE version = 0", "report"))
def arr01(spark, sf_dir):
    given = F.when(F.col("lit_id") % 2 == 0, '{"innovation_point": false, "unknown": true}').otherwise("broken {")
    return br.reports(spark, sf_dir).where("version = 0").select("lit_id", F.array_join(F.map_values(rp.filled_switches(given)).cast("array<string>"), "|").alias("switches"))


@query("dml08_global_notes", with_views("SELECT id AS lit_id, CASE WHEN n.lit_id IS NULL OR id % 2 = 0 THEN 'global ' || id ELSE n.note_content END AS note FROM lib LEFT JOIN (SELECT lit_id, arg_min(note_content, id) AS note_content FROM note WHERE note_type = 'global' GROUP BY lit_id) n ON n.lit_id = lib.id WHERE id % 2 = 0 OR n.lit_id IS NOT NULL UNION ALL SELECT lit_id, arg_min(note_content, id) FROM note WHERE note_type = 'global' AND lit_id NOT IN (SELECT id FROM lib) GROUP BY lit_id", "lib", "note"))
def dml08(spark, sf_dir):
    have = tb.latest(br.notes(spark, sf_dir).where("note_type = 'global'"), "lit_id", F.asc("id")).select("lit_id", F.col("note_content").alias("note"))
    new = br.library(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("lit_id"), F.concat(F.lit("global "), F.col("id").cast("string")).alias("note"))
    return tb.upsert(have, new, "lit_id")


@query("dml12_states", with_views("SELECT id, CASE WHEN is_parsed <> 1 THEN is_parsed WHEN id % 8 = 1 THEN 3 ELSE 2 END AS is_parsed FROM lib", "lib"))
def dml12(spark, sf_dir):
    lit = br.library(spark, sf_dir).select("id", "is_parsed")
    done = lit.where("is_parsed = 1").select("id", F.when(F.col("id") % 8 == 1, 3).otherwise(2).alias("is_parsed"))
    return tb.patch(lit, done, "id")


@query("dml17_preset_labels", "SELECT DISTINCT source AS tag_name FROM documents UNION ALL SELECT DISTINCT lang FROM documents WHERE lang <> 'de' UNION ALL SELECT 'fresh'")
def dml17(spark, sf_dir):
    """Sources are labels; languages and two more are preset, of which those that are labels or categories ('de') are left out."""
    docs = br.table(spark, sf_dir, "documents")
    labels, categories = docs.select(F.col("source").alias("tag_name")).distinct(), docs.where("lang = 'de'").select(F.col("lang").alias("tag_name")).distinct()
    preset = docs.select(F.explode(F.array("lang", F.lit("fresh"), F.lit("src1"))).alias("tag_name"))
    return tb.insert_missing(labels, tb.without(preset, categories, ["tag_name"]), ["tag_name"])


@query("agg11_heading_lines", "SELECT doc_id, CAST(ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 3.0) AS BIGINT) AS n FROM documents WHERE text <> ''")
def agg11(spark, sf_dir):
    titles = st.heads(tx.lines(F.col("text")))
    return _sectioned(spark, sf_dir).select("doc_id", F.size(titles).cast("long").alias("n")).where("n > 0")


_ITEM_COUNTS = "SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9ß-öø-ɏ]{2,}')) AS word FROM benchmark) GROUP BY 1, 2"


@query("ord06_top_keywords", f"WITH w AS ({_ITEM_COUNTS}), d AS (SELECT word, count(*) AS df FROM w GROUP BY word), s AS (SELECT item_id, sum(n) AS size FROM w GROUP BY item_id) SELECT item_id, string_agg(word, '|' ORDER BY k) AS top FROM (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY round(n / size * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1), 9) DESC, word) AS k FROM w JOIN d USING (word) JOIN s USING (item_id)) WHERE k <= 5 GROUP BY item_id")
def ord06(spark, sf_dir):
    top = st.weighted_words(br.table(spark, sf_dir, "benchmark"), 5, key="item_id")
    return top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda r: r["word"]), "|").alias("top"))


@query("rec05_delete_guards", with_views("SELECT id, (SELECT count(*) FROM tag c WHERE c.parent_id = tag.id) > 0 AS has_children, (SELECT count(*) FROM lib WHERE category_id = tag.id) > 0 AS has_papers FROM tag WHERE tag_type = 1", "tag", "lib"))
def rec05(spark, sf_dir):
    tags = br.tags(spark, sf_dir)
    children = tags.select(F.col("parent_id").alias("id")).distinct().withColumn("_c", F.lit(True))
    papers = br.library(spark, sf_dir).select(F.col("category_id").alias("id")).distinct().withColumn("_p", F.lit(True))
    return tags.where("tag_type = 1").join(children, "id", "left").join(papers, "id", "left").select("id", F.col("_c").isNotNull().alias("has_children"), F.col("_p").isNotNull().alias("has_papers"))


@query("lay04_page_paragraphs")
def lay04(spark, sf_dir):
    rows = br.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 12.0 + F.when(F.col("l_linenumber") > 3, 20.0).otherwise(0.0)).alias("top"), (F.col("l_partkey") % 3 * 8.0).alias("x0"), F.col("l_partkey").cast("string").alias("text"))
    return cl.page_paragraphs(rows.dropDuplicates(["page", "line"]))

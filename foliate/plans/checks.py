"""Queries of projections, verification and further table operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import cleaning as cl
from foliate.operators import report as rp
from foliate.operators import structure as st
from foliate.operators import tables as tb
from foliate.plans.documents import _GLUE, _LINES, _SECTIONED, _docs, _sectioned, _spread
from foliate.plans.registry import query
from foliate.sources import bridge as br
from foliate.sources.bridge import with_views


@query("flt15_report_views", with_views("SELECT r.id, r.version, lib.title, lib.author, lib.publish_time, 'a|b' AS keywords FROM report r JOIN lib ON lib.id = r.lit_id", "report", "lib"))
def flt15(spark, sf_dir):
    words = tx.json_list(F.when(F.col("version") >= 0, '["a", "b"]'))
    lit = br.library(spark, sf_dir).select(F.col("id").alias("lit_id"), "title", "author", "publish_time")
    return br.reports(spark, sf_dir).join(lit, "lit_id").select("id", "version", "title", "author", "publish_time", F.array_join(words, "|").alias("keywords"))


@query("flt20_history_predicates", "SELECT user_id, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'purchase' AND value > 50) AS done, count(*) FILTER (event_type <> 'view') AS others FROM events GROUP BY user_id")
def flt20(spark, sf_dir):
    return br.table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("failed"),
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("done"),
        F.count_if(F.col("event_type") != "view").alias("others"),
    )


@query("jn06_tags_of_a_paper", with_views("SELECT bind.id, tag_name FROM bind JOIN tag ON tag.id = tag_id WHERE lit_id = 28", "bind", "tag"))
def jn06(spark, sf_dir):
    names = br.tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "tag_name")
    return br.bindings(spark, sf_dir).where("lit_id = 28").join(names, "tag_id").select("id", "tag_name").orderBy("id")


@query("jn13_cited_paragraphs", f"SELECT d.doc_id, d.anchor, l.line IS NOT NULL AS found, trim(coalesce(l.line, '')) AS paragraph FROM (SELECT doc_id, doc_id % 5 AS anchor FROM documents UNION ALL SELECT doc_id, 99 FROM documents) d LEFT JOIN (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS p FROM ({_LINES}) WHERE trim(line) <> '') l ON l.doc_id = d.doc_id AND l.p = d.anchor")
def jn13(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    asked = docs.select("doc_id", F.lit("core_view").alias("dimension"), F.array((F.col("doc_id") % 5).cast("int"), F.lit(99)).alias("anchors"))
    return st.cited_paragraphs(asked, docs).select("doc_id", "anchor", F.col("paragraph").isNotNull().alias("found"), F.coalesce("paragraph", F.lit("")).alias("paragraph"))


@query("jn14_section_paragraphs", f"WITH {_SECTIONED} SELECT DISTINCT doc_id, dimension, CAST(floor(line_no / 3) AS INT) AS paragraph FROM lined JOIN dims ON d = CAST(least(floor(line_no / 3), 4) AS INT)")
def jn14(spark, sf_dir):
    spaced = _sectioned(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\n(?=Abstract|Methods|Innovations|Conclusions|References)", "\n\n"))
    return st.section_paragraphs(spaced, empty=True)


@query("win04_line_ordinals", f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ordinal FROM ({_LINES}) WHERE trim(line) <> ''")
def win04(spark, sf_dir):
    rows = F.filter(F.transform(tx.lines(F.col("text")), lambda x, i: F.struct(i.alias("n"), tx.strip(x).alias("s"))), lambda r: r["s"] != "")
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(rows).alias("ordinal", "r")).select("doc_id", F.col("r.n").alias("line_no"), "ordinal")


@query("win07_section_bounds", f"WITH {_SECTIONED} SELECT doc_id, dimension, CAST(head_at + 1 AS BIGINT) AS first_line, CAST(coalesce(lead(head_at) OVER (PARTITION BY doc_id ORDER BY d), total) AS BIGINT) AS end_line FROM open JOIN dims USING (dimension, d)")
def win07(spark, sf_dir):
    return st.sections(_sectioned(spark, sf_dir, ended=True)).select("doc_id", "dimension", F.col("first_line").cast("long").alias("first_line"), F.col("end_line").cast("long").alias("end_line"))


@query("win08_first_hits", f"WITH {_SECTIONED} SELECT doc_id, dimension, CAST(head_at AS BIGINT) AS line_no FROM open")
def win08(spark, sf_dir):
    return st.opened(_sectioned(spark, sf_dir)).select("doc_id", F.explode("opens").alias("h")).select("doc_id", "h.dimension", F.col("h.line").cast("long").alias("line_no"))


@query("str06_section_text", f"WITH p AS (SELECT doc_id, line_no, trim(line) AS line FROM ({_LINES})), g AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM p WHERE line <> '') SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS items, string_agg({_GLUE} || line, '' ORDER BY line_no) AS joined FROM g GROUP BY doc_id")
def str06(spark, sf_dir):
    of = lambda d: cl.section_text(F.lit(d), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", of("reference_list").alias("items"), of("core_view").alias("joined")).where("items <> ''")


@query("str16_marked_paragraphs", f"SELECT doc_id, string_agg('【段落' || p || '】' || trim(line), chr(10) || chr(10) ORDER BY p) AS shown FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS p FROM ({_LINES}) WHERE trim(line) <> '') WHERE p IN (0, 2) GROUP BY doc_id")
def str16(spark, sf_dir):
    wide = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return _spread(spark, sf_dir).select("doc_id", st.marked(wide, F.array(*map(F.lit, (2, 0, 2, -1, 999)))).alias("shown")).where("shown <> ''")


@query("str21_titles", with_views("SELECT id, CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE trim(title, ' ' || chr(10)) END AS title FROM lib", "lib"))
def str21(spark, sf_dir):
    meta = F.when(F.col("id") % 4 == 0, F.lit(" \n")).otherwise(F.col("title"))
    stem = F.regexp_extract("file_path", r"([^/]+)\.[^.]+$", 1)
    return br.library(spark, sf_dir).select("id", F.when(tx.is_blank(meta), stem).otherwise(tx.strip(meta)).alias("title"))


@query("doc11_still_asked", f"WITH {_SECTIONED} SELECT doc_id, dimension FROM secs WHERE length(content) < 50")
def doc11(spark, sf_dir):
    found = st.sections(_sectioned(spark, sf_dir)).select("doc_id", "dimension", F.col("content").alias("local"))
    return st.still_asked(found).select("doc_id", "dimension")


@query("dml01_insert_with_ids", with_views("SELECT (SELECT max(id) FROM bind) + row_number() OVER (ORDER BY id) AS id, id AS lit_id, CAST(202 AS BIGINT) AS tag_id FROM lib WHERE id % 25 = 0", "lib", "bind"))
def dml01(spark, sf_dir):
    rows = br.library(spark, sf_dir).where("id % 25 = 0").select(F.col("id").alias("lit_id"), F.lit(202).cast("long").alias("tag_id"))
    return tb.with_new_ids(rows, br.bindings(spark, sf_dir), "lit_id").select("id", "lit_id", "tag_id")


@query("dml03_delete", with_views("SELECT id FROM note WHERE lit_id % 2 = 1", "note"))
def dml03(spark, sf_dir):
    own = br.notes(spark, sf_dir)
    return tb.without(own, own.where("lit_id % 2 = 0"), ["id"]).select("id")


@query("dml07_upsert_latest", with_views("SELECT id, lit_id, CASE WHEN lit_id % 4 = 0 AND row_number() OVER (PARTITION BY lit_id ORDER BY parse_seq DESC, id DESC) = 1 THEN 'new' ELSE core_view END AS core_view FROM report UNION ALL SELECT -id, id, 'new' FROM lib WHERE id % 4 = 0 AND id NOT IN (SELECT lit_id FROM report)", "report", "lib"))
def dml07(spark, sf_dir):
    own = br.reports(spark, sf_dir)
    new = br.library(spark, sf_dir).where("id % 4 = 0").select(F.col("id").alias("lit_id"))
    value = F.when(F.col("lit_id") % 4 == 0, F.lit("new")).otherwise(F.col("core_view"))
    updated = tb.update_latest(own, "lit_id", {"core_view": value}, F.desc("parse_seq"), F.desc("id")).select("id", "lit_id", "core_view")
    added = new.join(own.select("lit_id"), "lit_id", "left_anti").select((-F.col("lit_id")).alias("id"), "lit_id", F.lit("new").alias("core_view"))
    return updated.unionByName(added)


@query("dml19_added_column", with_views("SELECT id, '' AS keywords FROM report", "report"))
def dml19(spark, sf_dir):
    old = br.reports(spark, sf_dir).select("id")
    return old.unionByName(spark.createDataFrame([], "id long, keywords string"), allowMissingColumns=True).na.fill("", ["keywords"])


@query("snk09_file_names", with_views("""SELECT id, regexp_replace(trim(title, ' ' || chr(10)), '[\\\\/:*?"<>|]', '_', 'g') AS name FROM lib""", "lib"))
def snk09(spark, sf_dir):
    return br.library(spark, sf_dir).select("id", tx.safe_name(F.col("title")).alias("name"))


@query("arr06_disabled_dimensions", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'core_view,' ELSE '' END || 'reference_list' AS disabled FROM documents")
def arr06(spark, sf_dir):
    given = F.when(F.col("doc_id") % 2 == 0, '{"core_view": false, "reference_list": false}').otherwise('{"reference_list": false}')
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.map_keys(F.map_filter(rp.filled_switches(given), lambda _, on: ~on)), ",").alias("disabled"))

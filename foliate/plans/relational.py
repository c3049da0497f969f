"""Queries of the relational operators over the library views, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import search as se
from foliate.operators import tables as tb
from foliate.operators import trees as tr
from foliate.plans.registry import query
from foliate.sources import bridge as br
from foliate.sources.bridge import with_views

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HIT = lambda c, k: f"contains({_LOWER.format(c)}, '{k}')"
_LISTED = "id, title, category_id, CAST(is_parsed AS INT) AS is_parsed, strftime(create_time, '%Y-%m-%d %H:%M:%S') AS created"


def _listed(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "category_id", "is_parsed", F.date_format("create_time", "yyyy-MM-dd HH:mm:ss").alias("created"))


def _searched(spark, sf_dir: str, f: se.Filters) -> DataFrame:
    views = (v(spark, sf_dir) for v in (br.library, br.bindings, br.tags, br.notes, br.reports))
    return se.search(*views, f)


# scans and look-ups


@query("src01_scan_newest_first", with_views(f"SELECT {_LISTED} FROM lib", "lib"))
def src01(spark, sf_dir):
    return _listed(br.library(spark, sf_dir).orderBy(F.desc("create_time"), F.desc("id")))


@query("src02_by_id", with_views(f"SELECT {_LISTED} FROM lib WHERE id = 42", "lib"))
def src02(spark, sf_dir):
    return _listed(br.library(spark, sf_dir).where("id = 42"))


@query("src03_by_hash", with_views("SELECT file_hash, min(id) AS id, count(*) AS n FROM lib GROUP BY file_hash", "lib"))
def src03(spark, sf_dir):
    return br.library(spark, sf_dir).groupBy("file_hash").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("src04_by_status", with_views(f"SELECT {_LISTED} FROM lib WHERE is_parsed = 2", "lib"))
def src04(spark, sf_dir):
    return _listed(br.library(spark, sf_dir).where("is_parsed = 2").orderBy(F.desc("create_time")))


@query("src18_reference_lists", with_views("SELECT tag_type, count(*) AS n, string_agg(tag_name, '|' ORDER BY sort_order, id) AS names FROM tag GROUP BY tag_type", "tag"))
def src18(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("sort_order", "id", "tag_name")))
    return br.tags(spark, sf_dir).groupBy("tag_type").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["tag_name"]), "|").alias("names"))


# filters

_ANYWHERE = f"""SELECT id, title FROM lib WHERE {_HIT('title', 'in')} AND ({_HIT('title', 'and')} OR {_HIT('author', 'and')} OR {_HIT('journal_source', 'and')}
 OR EXISTS (SELECT 1 FROM bind b JOIN tag t ON b.tag_id = t.id WHERE b.lit_id = lib.id AND {_HIT('t.tag_name', 'and')})
 OR EXISTS (SELECT 1 FROM note n WHERE n.lit_id = lib.id AND {_HIT('n.note_content', 'and')}) OR EXISTS (SELECT 1 FROM report r WHERE r.lit_id = lib.id AND {_HIT('r.core_view', 'and')}))"""


@query("flt01_literal_keyword", with_views(f"SELECT id, title FROM lib WHERE {_HIT('title', 'the')}", "lib"))
def flt01(spark, sf_dir):
    return br.library(spark, sf_dir).where(tx.contains_literal(F.col("title"), "The")).select("id", "title")


@query(
    "flt02_library_search",
    with_views(
        f"""SELECT lib.id, title, c.tag_name AS category, coalesce((SELECT string_agg(t.tag_name, '|' ORDER BY b.id) FROM bind b JOIN tag t ON b.tag_id = t.id WHERE b.lit_id = lib.id AND (c.tag_name IS NULL OR t.tag_name <> c.tag_name)), '') AS tags
 FROM lib LEFT JOIN tag c ON c.id = lib.category_id AND c.tag_type = 1 WHERE {_HIT('title', 'tox')} OR {_HIT('author', 'tox')} OR {_HIT('journal_source', 'tox')}
 OR EXISTS (SELECT 1 FROM bind b JOIN tag t ON b.tag_id = t.id WHERE b.lit_id = lib.id AND {_HIT('t.tag_name', 'tox')})
 OR EXISTS (SELECT 1 FROM note n WHERE n.lit_id = lib.id AND {_HIT('n.note_content', 'tox')}) OR EXISTS (SELECT 1 FROM report r WHERE r.lit_id = lib.id AND {_HIT('r.core_view', 'tox')})""",
        "lib", "tag", "bind", "note", "report",
    ),
)
def flt02(spark, sf_dir):
    found = _searched(spark, sf_dir, se.Filters(keyword="TOX"))
    return se.attach_tags(found, br.bindings(spark, sf_dir), br.tags(spark, sf_dir)).select("id", "title", "category", F.array_join("tags", "|").alias("tags"))


@query("flt02b_keyword_in_any_of_five_tables", with_views(_ANYWHERE.replace(f"{_HIT('title', 'in')} AND ", ""), "lib", "tag", "bind", "note", "report"))
def flt02b(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(keyword="and")).select("id", "title")


@query("flt03_title_search", with_views(f"SELECT {_LISTED} FROM lib WHERE {_HIT('title', 'der')}", "lib"))
def flt03(spark, sf_dir):
    return _listed(br.library(spark, sf_dir).where(tx.contains_literal(F.col("title"), "DER")).orderBy(F.desc("create_time")))


@query("flt04_has_tag", with_views("SELECT id FROM lib WHERE EXISTS (SELECT 1 FROM bind WHERE lit_id = lib.id AND tag_id = 202)", "lib", "bind"))
def flt04(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(tag_id=202)).select("id")


@query("flt05_category", with_views("SELECT id FROM lib WHERE category_id = 103", "lib"))
def flt05(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(category_id=103)).select("id")


@query("flt06_format", with_views("SELECT id FROM lib WHERE lit_type = 'DOCX'", "lib"))
def flt06(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(lit_type=" DOCX ")).select("id")


@query("flt07_year_or_import_year", with_views("SELECT id, publish_time FROM lib WHERE publish_time LIKE '2024%' OR (publish_time = '' AND year(create_time) = 2024)", "lib"))
def flt07(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(year="2024")).select("id", "publish_time")


@query("flt08_parse_status", with_views("SELECT id, is_parsed FROM lib WHERE is_parsed <> 2", "lib"))
def flt08(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(parsed="todo")).select("id", "is_parsed")


@query("flt09_time_range", with_views("SELECT id FROM lib WHERE create_time >= TIMESTAMP '2024-01-08' AND create_time < TIMESTAMP '2024-01-15'", "lib"))
def flt09(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(since=datetime(2024, 1, 8), before=datetime(2024, 1, 15))).select("id")


@query(
    "flt10_all_filters",
    with_views(
        f"SELECT id, title, file_size FROM lib WHERE {_HIT('title', 'in')} AND lit_type = 'TXT' AND is_parsed <> 2 AND (publish_time LIKE '2016%' OR (publish_time = '' AND year(create_time) = 2016)) AND EXISTS (SELECT 1 FROM bind WHERE lit_id = lib.id AND tag_id = 201)"
        .replace(_HIT("title", "in"), _ANYWHERE.split(" AND (", 1)[1].rstrip().removesuffix(")").join("()").replace("'and'", "'in'")),
        "lib", "tag", "bind", "note", "report",
    ),
)
def flt10(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(keyword="in", lit_type="TXT", parsed="todo", year="2016", tag_id=201, sort="file_size", ascending=True)).select("id", "title", "file_size")


@query("flt12_note_types", with_views("SELECT note_type, count(*) AS n, count(DISTINCT lit_id) AS papers FROM note GROUP BY note_type", "note"))
def flt12(spark, sf_dir):
    return br.notes(spark, sf_dir).groupBy("note_type").agg(F.count("*").alias("n"), F.countDistinct("lit_id").alias("papers"))


@query("flt19_backup_list", with_views("SELECT path, CASE WHEN size < 1024 THEN concat(CAST(size AS VARCHAR), ' B') ELSE printf('%.1f KB', size / 1024.0) END AS size_text, l.id IS NOT NULL AS file_exists FROM prev LEFT JOIN lib l ON l.file_path = path AND l.id % 9 <> 0", "prev", "lib"))
def flt19(spark, sf_dir):
    there = br.library(spark, sf_dir).where("id % 9 <> 0").select(F.col("file_path").alias("path"), F.lit(True).alias("_there"))
    return br.manifest_before(spark, sf_dir).join(there, "path", "left").select("path", tx.human_size(F.col("size")).alias("size_text"), F.col("_there").isNotNull().alias("file_exists"))


# joins


@query("jn03_bound_tag_names", with_views("SELECT lit_id, tag_name FROM bind JOIN tag ON tag.id = bind.tag_id", "bind", "tag"))
def jn03(spark, sf_dir):
    return br.bindings(spark, sf_dir).join(br.tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "tag_name"), "tag_id").select("lit_id", "tag_name")


@query("jn04_label_category_collisions", with_views("SELECT t.id AS label_id, t.tag_name, min(c.id) AS category_id FROM tag t JOIN tag c ON t.tag_name = c.tag_name AND t.tag_type = 2 AND c.tag_type = 1 GROUP BY t.id, t.tag_name", "tag"))
def jn04(spark, sf_dir):
    tags = br.tags(spark, sf_dir)
    categories = tags.where("tag_type = 1").select("tag_name", F.col("id").alias("c"))
    return tags.where("tag_type = 2").join(categories, "tag_name").groupBy(F.col("id").alias("label_id"), "tag_name").agg(F.min("c").alias("category_id"))


@query("jn05_attach_tags", with_views("""SELECT lib.id, c.tag_name AS category, coalesce(string_agg(t.tag_name, '|' ORDER BY b.id) FILTER (c.tag_name IS NULL OR t.tag_name <> c.tag_name), '') AS tags
 FROM lib LEFT JOIN tag c ON c.id = lib.category_id AND c.tag_type = 1 LEFT JOIN bind b ON b.lit_id = lib.id LEFT JOIN tag t ON t.id = b.tag_id GROUP BY lib.id, c.tag_name""", "lib", "tag", "bind"))  # fmt: skip
def jn05(spark, sf_dir):
    return se.attach_tags(br.library(spark, sf_dir).select("id", "category_id"), br.bindings(spark, sf_dir), br.tags(spark, sf_dir)).select("id", "category", F.array_join("tags", "|").alias("tags"))


@query("jn07_reported_ids", with_views("SELECT id FROM lib WHERE EXISTS (SELECT 1 FROM report WHERE lit_id = lib.id)", "lib", "report"))
def jn07(spark, sf_dir):
    return br.library(spark, sf_dir).join(br.reports(spark, sf_dir).select(F.col("lit_id").alias("id")), "id", "left_semi").select("id")


@query("jn08_latest_report", with_views("SELECT lib.id, r.core_view FROM lib LEFT JOIN (SELECT lit_id, arg_max(core_view, parse_seq) AS core_view FROM report GROUP BY lit_id) r ON r.lit_id = lib.id", "lib", "report"))
def jn08(spark, sf_dir):
    newest = tb.latest(br.reports(spark, sf_dir), "lit_id", F.desc("parse_seq"), F.desc("id")).select(F.col("lit_id").alias("id"), "core_view")
    return br.library(spark, sf_dir).select("id").join(newest, "id", "left").select("id", "core_view")


@query("jn10_missing_files", with_views("SELECT file_path AS path FROM lib WHERE file_path IN (SELECT path FROM prev) AND id % 4 <> 1 AND id % 7 <> 2", "lib", "prev"))
def jn10(spark, sf_dir):
    files = br.library(spark, sf_dir).select("id", F.col("file_path").alias("path"))
    return tb.missing_files(files, br.manifest_before(spark, sf_dir), files.where("id % 4 = 1"), files.where("id % 7 = 2")).select("path")


@query("jn11_reconcile", with_views("""SELECT coalesce(action, 'kept') AS action, count(*) AS n FROM (SELECT CASE WHEN p.path IS NULL THEN 'add' WHEN l.id % 11 = 3 THEN 'relink' WHEN p.size <> l.file_size THEN 'time_fixed' END AS action
 FROM lib l LEFT JOIN prev p ON p.path = l.file_path) GROUP BY 1""", "lib", "prev"))  # fmt: skip
def jn11(spark, sf_dir):
    lit = br.library(spark, sf_dir)
    found = lit.select("id", F.col("file_path").alias("name"), F.col("file_path").alias("path"), F.col("file_size").alias("time"))
    numbers = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    records = br.manifest_before(spark, sf_dir).select(F.col("path").alias("name"), "path", F.col("size").alias("time"), (numbers % 11 != 3).alias("valid"))
    return tb.reconcile(found, records).groupBy(F.coalesce("action", F.lit("kept")).alias("action")).agg(F.count("*").alias("n"))


@query("jn12_cascade", with_views("SELECT 'lib' AS name, count(*) AS n FROM lib WHERE id % 5 <> 1 UNION ALL SELECT 'bind', count(*) FROM bind WHERE lit_id % 5 <> 1 UNION ALL SELECT 'note', count(*) FROM note WHERE lit_id % 5 <> 1 OR lit_id NOT IN (SELECT id FROM lib)", "lib", "bind", "note"))
def jn12(spark, sf_dir):
    lit = br.library(spark, sf_dir)
    left = tb.cascade(lit, lit.where("id % 5 = 1"), {"bind": (br.bindings(spark, sf_dir), "lit_id"), "note": (br.notes(spark, sf_dir), "lit_id")})
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name or "lib").alias("name"), "n") for name, df in left.items()]
    return counted[0].union(counted[1]).union(counted[2])


# aggregations


@query("agg01_count", with_views("SELECT count(*) AS n FROM lib", "lib"))
def agg01(spark, sf_dir):
    return br.library(spark, sf_dir).agg(F.count("*").alias("n"))


@query("agg02_per_tag", with_views("SELECT tag.id, tag_name, count(lit_id) AS n FROM tag LEFT JOIN bind ON tag_id = tag.id WHERE tag_type = 2 GROUP BY tag.id, tag_name", "tag", "bind"))
def agg02(spark, sf_dir):
    counts = br.bindings(spark, sf_dir).groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("_n"))
    return br.tags(spark, sf_dir).where("tag_type = 2").join(counts, "id", "left").select("id", "tag_name", F.coalesce("_n", F.lit(0)).alias("n"))


@query("agg03_per_category", with_views("SELECT tag.id, count(lib.id) AS n FROM tag LEFT JOIN lib ON category_id = tag.id WHERE tag_type = 1 GROUP BY tag.id", "tag", "lib"))
def agg03(spark, sf_dir):
    counts = br.library(spark, sf_dir).groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("_n"))
    return br.tags(spark, sf_dir).where("tag_type = 1").join(counts, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("n"))


@query("agg04_next_sort_order", with_views("SELECT p.id AS parent_id, coalesce(max(c.sort_order) + 1, 1) AS next_order FROM tag p LEFT JOIN tag c ON c.parent_id = p.id WHERE p.tag_type = 1 GROUP BY p.id", "tag"))
def agg04(spark, sf_dir):
    tags = br.tags(spark, sf_dir)
    top = tags.groupBy("parent_id").agg(F.max("sort_order").alias("_m")).withColumnRenamed("parent_id", "_p")
    return tags.where("tag_type = 1").join(top, F.col("id") == F.col("_p"), "left").select(F.col("id").alias("parent_id"), F.coalesce(F.col("_m") + 1, F.lit(1)).alias("next_order"))


@query(
    "agg05_years",
    with_views(
        """, pub AS (SELECT DISTINCT publish_time AS year FROM lib WHERE regexp_matches(publish_time, '^\\d{4}')), imp AS (SELECT DISTINCT CAST(year(create_time) AS VARCHAR) AS year FROM lib WHERE publish_time = '')
 SELECT year, 'published' AS kind FROM pub UNION ALL SELECT year, 'imported' FROM imp WHERE year NOT IN (SELECT year FROM pub)""",
        "lib",
    ).replace(") , pub", "), pub"),
)
def agg05(spark, sf_dir):
    lit = br.library(spark, sf_dir)
    published = lit.select(F.regexp_extract(tx.strip(F.col("publish_time")), r"^\d{4}", 0).alias("year")).where("year <> ''").distinct()
    taken_in = lit.where("publish_time = ''").select(F.year("create_time").cast("string").alias("year")).distinct()
    return published.withColumn("kind", F.lit("published")).union(taken_in.join(published, "year", "left_anti").withColumn("kind", F.lit("imported")))


@query("agg06_types", with_views("SELECT DISTINCT lit_type FROM lib WHERE lit_type <> ''", "lib"))
def agg06(spark, sf_dir):
    return br.library(spark, sf_dir).select("lit_type").where(~tx.is_blank(F.col("lit_type"))).distinct()


@query("agg07_storage", with_views("SELECT lit_type, CAST(sum(file_size) AS BIGINT) AS bytes, round(100.0 * sum(file_size) / sum(sum(file_size)) OVER (), 1) AS percent FROM lib GROUP BY lit_type", "lib"))
def agg07(spark, sf_dir):
    areas = br.library(spark, sf_dir).groupBy("lit_type").agg(F.sum("file_size").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())
    return areas.select("lit_type", "bytes", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col("bytes") / total, 1)).alias("percent"))


# latest rows, orders and sets


@query("win01_latest_report", with_views("SELECT lit_id, id, version FROM report QUALIFY row_number() OVER (PARTITION BY lit_id ORDER BY parse_seq DESC, id DESC) = 1", "report"))
def win01(spark, sf_dir):
    return tb.latest(br.reports(spark, sf_dir), "lit_id", F.desc("parse_seq"), F.desc("id")).select("lit_id", "id", "version")


@query("win02_update_latest", with_views("SELECT id, CASE WHEN row_number() OVER (PARTITION BY lit_id ORDER BY parse_seq DESC, id DESC) = 1 THEN reverse(core_view) ELSE core_view END AS core_view FROM report", "report"))
def win02(spark, sf_dir):
    return tb.update_latest(br.reports(spark, sf_dir), "lit_id", {"core_view": F.reverse("core_view")}, F.desc("parse_seq"), F.desc("id")).select("id", "core_view")


@query("win10_unique_names", with_views("SELECT id, author || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n - 1 AS VARCHAR) END AS unique_name FROM (SELECT id, author, row_number() OVER (PARTITION BY author ORDER BY id) AS n FROM lib)", "lib"))
def win10(spark, sf_dir):
    return tb.numbered(br.library(spark, sf_dir).select("id", "author"), F.col("author"), "id").select("id", F.col("unique").alias("unique_name"))


@query("ord01_sorted_page", with_views("SELECT id, file_size FROM lib ORDER BY file_size ASC, id DESC LIMIT 100", "lib"))
def ord01(spark, sf_dir):
    return _searched(spark, sf_dir, se.Filters(sort="file_size", ascending=True)).select("id", "file_size").limit(100)


@query("ord02_recent_log", with_views("SELECT id, operate_type FROM oplog ORDER BY operate_time DESC, id DESC LIMIT 50", "oplog"))
def ord02(spark, sf_dir):
    return br.log(spark, sf_dir).orderBy(F.desc("operate_time"), F.desc("id")).limit(50).select("id", "operate_type")


@query("ord03_log_of_paper", with_views("SELECT id, strftime(operate_time, '%Y-%m-%d %H:%M:%S') AS at FROM oplog WHERE lit_id = 7", "oplog"))
def ord03(spark, sf_dir):
    return br.log(spark, sf_dir).where("lit_id = 7").orderBy(F.desc("operate_time"), F.desc("id")).select("id", F.date_format("operate_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("ord04_note_order", with_views("SELECT lit_id, id, row_number() OVER (PARTITION BY lit_id ORDER BY note_type, id) AS place FROM note", "note"))
def ord04(spark, sf_dir):
    return br.notes(spark, sf_dir).select("lit_id", "id", F.row_number().over(Window.partitionBy("lit_id").orderBy("note_type", "id")).alias("place"))


@query("set01_add_tags", with_views("SELECT lit_id, string_agg(CAST(tag_id AS VARCHAR), '|' ORDER BY tag_id) AS tags FROM (SELECT lit_id, tag_id FROM bind UNION SELECT id, 202 FROM lib WHERE id % 4 = 0) GROUP BY lit_id", "lib", "bind"))
def set01(spark, sf_dir):
    more = br.library(spark, sf_dir).where("id % 4 = 0").select(F.col("id").alias("lit_id"), F.lit(202).cast("long").alias("tag_id"))
    both = br.bindings(spark, sf_dir).select("lit_id", "tag_id").union(more)
    return both.groupBy("lit_id").agg(F.array_join(F.array_sort(F.collect_set("tag_id")), "|").alias("tags"))


@query("set02_replace_tags", with_views("SELECT lit_id, tag_id FROM bind WHERE lit_id % 6 <> 0 UNION ALL SELECT id, CAST(203 AS BIGINT) FROM lib WHERE id % 6 = 0", "lib", "bind"))
def set02(spark, sf_dir):
    wanted = br.library(spark, sf_dir).where("id % 6 = 0").select(F.col("id").alias("lit_id"), F.lit(203).cast("long").alias("tag_id"))
    return tb.replace_set(br.bindings(spark, sf_dir).select("lit_id", "tag_id"), wanted, "lit_id")


@query("set03_incremental_diff", with_views("SELECT file_path AS path, file_size AS size FROM lib LEFT JOIN prev ON path = file_path WHERE path IS NULL OR size <> file_size", "lib", "prev"))
def set03(spark, sf_dir):
    now = br.library(spark, sf_dir).select(F.col("file_path").alias("path"), F.col("file_size").alias("size"))
    return tb.changed_files(now, br.manifest_before(spark, sf_dir))


# updates as new tables


@query("dml02_update_rows", with_views("SELECT id, CASE WHEN id % 3 = 1 THEN reverse(title) ELSE title END AS title, author FROM lib", "lib"))
def dml02(spark, sf_dir):
    lit = br.library(spark, sf_dir).select("id", "title", "author")
    return tb.patch(lit, lit.where("id % 3 = 1").select("id", F.reverse("title").alias("title"), F.lit(1).alias("unknown")), "id")


@query("dml04_upsert", with_views("SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE author END AS author, journal_source FROM lib WHERE id % 5 <> 0 UNION ALL SELECT id, 'new', 'added' FROM lib WHERE id % 10 = 0", "lib"))
def dml04(spark, sf_dir):
    lit = br.library(spark, sf_dir).select("id", "author", "journal_source")
    changes = lit.where("id % 2 = 0").select("id", F.lit("new").alias("author"), F.lit("added").alias("journal_source"))
    return tb.upsert(lit.where("id % 5 <> 0"), changes, "id", only_new=("journal_source",))


@query("dml05_insert_missing", with_views("SELECT lit_id, tag_id FROM bind UNION SELECT id, CAST(201 AS BIGINT) FROM lib WHERE id % 8 = 0", "lib", "bind"))
def dml05(spark, sf_dir):
    rows = br.library(spark, sf_dir).where("id % 8 = 0").select(F.col("id").alias("lit_id"), F.lit(201).cast("long").alias("tag_id"))
    return tb.insert_missing(br.bindings(spark, sf_dir).select("lit_id", "tag_id"), rows, ["lit_id", "tag_id"])


@query("dml06_unbind", with_views("SELECT lit_id, tag_id FROM bind WHERE NOT (tag_id = 203 AND lit_id % 2 = 0)", "bind"))
def dml06(spark, sf_dir):
    own = br.bindings(spark, sf_dir).select("lit_id", "tag_id")
    return tb.without(own, own.where("tag_id = 203 AND lit_id % 2 = 0"), ["lit_id", "tag_id"])


@query("dml10_assign_category", with_views("SELECT id, CASE WHEN id % 9 = 0 THEN CAST(105 AS BIGINT) ELSE category_id END AS category_id FROM lib", "lib"))
def dml10(spark, sf_dir):
    lit = br.library(spark, sf_dir).select("id", "category_id")
    return tb.patch(lit, lit.where("id % 9 = 0").select("id", F.lit(105).cast("long").alias("category_id")), "id")


@query("dml14_import", with_views("SELECT id, CASE WHEN file_size <= 0 THEN 'empty' WHEN id % 2 = 1 AND n = 1 AND file_hash NOT IN (SELECT file_hash FROM lib WHERE id % 2 = 0) THEN 'new' ELSE 'duplicate' END AS code FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS n FROM lib WHERE id % 2 = 1)", "lib"))
def dml14(spark, sf_dir):
    lit = br.library(spark, sf_dir).select("id", "file_hash", "file_size")
    return tb.import_plan(lit.where("id % 2 = 1"), lit.where("id % 2 = 0")).select("id", "code")


@query("dml16_name_clashes", with_views("SELECT tag_name, count(*) AS n FROM tag GROUP BY tag_name HAVING count(*) > 1", "tag"))
def dml16(spark, sf_dir):
    return br.tags(spark, sf_dir).groupBy("tag_name").agg(F.count("*").alias("n")).where("n > 1")


@query("dml18_collision_migration", with_views("SELECT l.id, CASE WHEN l.category_id = 0 AND b.lit_id IS NOT NULL THEN CAST(3 AS BIGINT) ELSE l.category_id END AS category_id FROM lib l LEFT JOIN (SELECT DISTINCT lit_id FROM bind WHERE tag_id = 203) b ON b.lit_id = l.id", "lib", "bind"))
def dml18(spark, sf_dir):
    lit, hit = br.library(spark, sf_dir).select("id", "category_id"), jn04(spark, sf_dir)
    promoted = br.bindings(spark, sf_dir).join(hit.select(F.col("label_id").alias("tag_id"), F.col("category_id").alias("to")), "tag_id").groupBy(F.col("lit_id").alias("id")).agg(F.min("to").alias("to"))
    return lit.join(promoted, "id", "left").select("id", F.when((F.col("category_id") == 0) & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("category_id")).alias("category_id"))


@query("dml20_type_migration", with_views("SELECT id, CASE WHEN lit_type = 'DOCX' AND lower(concat(file_path, CASE WHEN id % 3 = 0 THEN '.DOC' ELSE '' END)) LIKE '%.doc' THEN 'DOC' ELSE lit_type END AS lit_type FROM lib", "lib"))
def dml20(spark, sf_dir):
    path = F.concat("file_path", F.when(F.col("id") % 3 == 0, ".DOC").otherwise(""))
    return br.library(spark, sf_dir).select("id", F.when((F.col("lit_type") == "DOCX") & F.lower(path).endswith(".doc"), "DOC").otherwise(F.col("lit_type")).alias("lit_type"))


# trees


_CATEGORIES = "SELECT id, tag_name, parent_id, sort_order FROM tag WHERE tag_type = 1 UNION ALL SELECT id, tag_name, parent_id, sort_order FROM deep"


def _tree(select: str) -> str:
    """SQL over the categories, level by level."""
    views = f"tag AS ({br.SQL['tag']}), deep AS ({br.SQL['deep']}), c AS ({_CATEGORIES})"
    return f"""WITH RECURSIVE {views}, t AS (SELECT id, tag_name, 0 AS depth, tag_name AS path, printf('%06d', sort_order) || '.' || printf('%012d', id) AS place FROM c WHERE parent_id = 0
 UNION ALL SELECT c.id, c.tag_name, t.depth + 1, t.path || '/' || c.tag_name, t.place || '/' || printf('%06d', c.sort_order) || '.' || printf('%012d', c.id) FROM c JOIN t ON c.parent_id = t.id) {select}"""


@query("rec01_category_tree", _tree("SELECT * FROM t"))
def rec01(spark, sf_dir):
    tree = tr.tag_tree(br.categories(spark, sf_dir))
    place = F.array_join(F.transform("key", lambda k: F.concat_ws(".", F.lpad(k["s"].cast("string"), 6, "0"), F.lpad(k["i"].cast("string"), 12, "0"))), "/")
    return tree.select("id", "tag_name", "depth", F.array_join("path", "/").alias("path"), place.alias("place"))


@query("rec02_indented_options", _tree("SELECT id, repeat('　', depth) || CASE WHEN depth > 0 THEN '└ ' ELSE '' END || tag_name AS label, row_number() OVER (ORDER BY place) AS place FROM t"))
def rec02(spark, sf_dir):
    tree = tr.tag_tree(br.categories(spark, sf_dir))
    label = F.concat(F.repeat(F.lit("　"), F.col("depth")), F.when(F.col("depth") > 0, "└ ").otherwise(""), F.col("tag_name"))
    return tb.ranked(tree.select("id", label.alias("label"), "key"), "key").select("id", "label", F.col("_n").alias("place"))


@query("rec03_descendants", _tree(", d AS (SELECT parent_id AS ancestor, id AS descendant FROM c WHERE parent_id <> 0 UNION ALL SELECT c.parent_id, descendant FROM d JOIN c ON c.id = d.ancestor WHERE c.parent_id <> 0) SELECT * FROM d"))
def rec03(spark, sf_dir):
    return tr.descendants(br.categories(spark, sf_dir).select("id", "parent_id"))

"""The corpus tables as a document library: papers, tags, bindings, notes, reports, log and manifests.

Each function gives a lazy frame; SQL has the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows dealt anew by a key, for work that is long for each row: a file of few row groups would leave it to as few tasks.
    What groups rows by the key behind it shuffles no more."""
    return rows.repartition(key)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.col("source").alias("author"),
        F.when(d % 7 == 0, "").otherwise((2015 + d % 10).cast("string")).alias("publish_time"),
        F.col("lang").alias("journal_source"),
        F.element_at(F.array(*map(F.lit, ("PDF", "TXT", "DOCX", "DOC"))), (d % 4 + 1).cast("int")).alias("lit_type"),
        F.concat(F.lit("lib/"), d.cast("string"), F.lit(".txt")).alias("file_path"),
        F.col("n_chars").alias("file_size"),
        F.sha2("text", 256).alias("file_hash"),
        F.when(d % 5 == 0, 0).otherwise(100 + d % 25).cast("long").alias("category_id"),
        (d % 4).cast("int").alias("is_parsed"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), d.cast("int"), F.lit(0), F.lit(0))).alias("create_time"),
        "text",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories (type 1: regions with nations below) and labels (type 2)."""
    kinds = "id long, tag_type int, tag_name string, parent_id long, sort_order int"
    roots = table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT)", "1", "r_name", "CAST(0 AS BIGINT)", "CAST(r_regionkey AS INT)")
    leaves = table(spark, sf_dir, "nation").selectExpr("CAST(100 + n_nationkey AS BIGINT)", "1", "n_name", "CAST(n_regionkey + 1 AS BIGINT)", "CAST(n_nationkey AS INT)")
    labels = spark.createDataFrame([(201, 2, "high-quality", 0, 1), (202, 2, "toxic", 0, 2), (203, 2, "ASIA", 0, 3)], kinds)
    return roots.union(leaves).union(labels).toDF("id", "tag_type", "tag_name", "parent_id", "sort_order")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories among the tags, and below a root for each forty documents a chain of them."""
    d = F.col("doc_id")
    deep = table(spark, sf_dir, "documents").select(
        (d + 1000).alias("id"), F.lit(1).alias("tag_type"), F.concat_ws("-", "source", d.cast("string")).alias("tag_name"), F.when(d % 40 == 0, 0).otherwise(d + 999).cast("long").alias("parent_id"), (d % 7).cast("int").alias("sort_order")
    )
    return tags(spark, sf_dir).where("tag_type = 1").union(deep)


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    parts = [labels.where(when).select((F.col("doc_id") * 10 + i).alias("id"), F.col("doc_id").alias("lit_id"), F.lit(200 + i).cast("long").alias("tag_id")) for i, when in enumerate(("quality = 1", "toxic = 1", "doc_id % 3 = 0"), 1)]
    return parts[0].union(parts[1]).union(parts[2])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn AS id",
        "conv_id AS lit_id",
        "CASE WHEN role = 'system' THEN 'global' ELSE 'paragraph' END AS note_type",
        "CASE WHEN role = 'system' THEN '' WHEN role = 'user' THEN concat('txh:', turn * 10, '-', turn * 10 + 7) ELSE concat('pdf:', turn, ':10,20,', 10 + turn, ',60') END AS paragraph_pos",
        "text AS note_content",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS operate_type", "props AS operate_content", "user_id AS lit_id", "ts AS operate_time", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS operate_status")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a report for each benchmark item."""
    both = table(spark, sf_dir, "benchmark").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.selectExpr("item_id * 2 + v AS id", "item_id AS lit_id", "text AS core_view", "v AS version", "CASE WHEN item_id % 2 = 0 THEN v ELSE 1 - v END AS parse_seq")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for each source and language of the documents; that of the least id is the default."""
    own = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("id"))
    least = own.agg(F.min("id").alias("_least"))
    return own.join(F.broadcast(least)).select("id", F.concat_ws(" ", "source", "lang").alias("name"), F.col("lang").alias("subject"), (F.col("id") == F.col("_least")).cast("int").alias("is_default"))


def manifest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").selectExpr("concat('lib/', doc_id, '.txt') AS path", "CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS size")


#: The same views in the oracle's SQL, by name.
SQL = {
    "lib": """SELECT doc_id AS id, substring(text, 1, 60) AS title, source AS author,
 CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(2015 + doc_id % 10 AS VARCHAR) END AS publish_time, lang AS journal_source,
 CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'TXT' WHEN 2 THEN 'DOCX' ELSE 'DOC' END AS lit_type,
 concat('lib/', CAST(doc_id AS VARCHAR), '.txt') AS file_path, n_chars AS file_size, sha256(text) AS file_hash,
 CASE WHEN doc_id % 5 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(100 + doc_id % 25 AS BIGINT) END AS category_id,
 CAST(doc_id % 4 AS INT) AS is_parsed, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS create_time, text FROM documents""",
    "tag": """SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 1 AS tag_type, r_name AS tag_name, CAST(0 AS BIGINT) AS parent_id, CAST(r_regionkey AS INT) AS sort_order FROM region
 UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 1, n_name, CAST(n_regionkey + 1 AS BIGINT), CAST(n_nationkey AS INT) FROM nation
 UNION ALL SELECT CAST(201 AS BIGINT), 2, 'high-quality', CAST(0 AS BIGINT), 1 UNION ALL SELECT CAST(202 AS BIGINT), 2, 'toxic', CAST(0 AS BIGINT), 2 UNION ALL SELECT CAST(203 AS BIGINT), 2, 'ASIA', CAST(0 AS BIGINT), 3""",
    "deep": "SELECT doc_id + 1000 AS id, source || '-' || doc_id AS tag_name, CASE WHEN doc_id % 40 = 0 THEN 0 ELSE doc_id + 999 END AS parent_id, CAST(doc_id % 7 AS INT) AS sort_order FROM documents",
    "bind": """SELECT doc_id * 10 + 1 AS id, doc_id AS lit_id, CAST(201 AS BIGINT) AS tag_id FROM labels WHERE quality = 1
 UNION ALL SELECT doc_id * 10 + 2, doc_id, CAST(202 AS BIGINT) FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id * 10 + 3, doc_id, CAST(203 AS BIGINT) FROM labels WHERE doc_id % 3 = 0""",
    "note": """SELECT conv_id * 100 + turn AS id, conv_id AS lit_id, CASE WHEN role = 'system' THEN 'global' ELSE 'paragraph' END AS note_type,
 CASE WHEN role = 'system' THEN '' WHEN role = 'user' THEN concat('txh:', CAST(turn * 10 AS VARCHAR), '-', CAST(turn * 10 + 7 AS VARCHAR)) ELSE concat('pdf:', CAST(turn AS VARCHAR), ':10,20,', CAST(10 + turn AS VARCHAR), ',60') END AS paragraph_pos, text AS note_content FROM conversations""",
    "oplog": "SELECT event_id AS id, event_type AS operate_type, props AS operate_content, user_id AS lit_id, ts AS operate_time, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS operate_status FROM events",
    "report": "SELECT item_id * 2 + v AS id, item_id AS lit_id, text AS core_view, CAST(v AS INT) AS version, CASE WHEN item_id % 2 = 0 THEN v ELSE 1 - v END AS parse_seq FROM benchmark CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v) vv",
    "rule": "SELECT id, source || ' ' || lang AS name, lang AS subject, CASE WHEN id = (SELECT min(doc_id) FROM documents) THEN 1 ELSE 0 END AS is_default FROM (SELECT source, lang, min(doc_id) AS id FROM documents GROUP BY source, lang)",
    "prev": "SELECT concat('lib/', CAST(doc_id AS VARCHAR), '.txt') AS path, CASE WHEN doc_id % 6 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 10 <> 0",
}


def with_views(sql: str, *names: str) -> str:
    """The oracle query with the named views in front."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql

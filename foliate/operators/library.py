"""Rules, exports, backups and deletions of the library, as plans over its tables: each gives rows with what is to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx

#: Formats with their suffixes; formats of input files by suffix (fixed values).
EXPORTS = {"word": ".docx", "txt": ".txt", "pdf": ".pdf"}
INPUTS = {".pdf": "PDF", ".docx": "DOCX", ".doc": "DOC", ".txt": "TXT"}
#: Ids up to which rules are built in, longest subject, and bounds of a rule's precision (fixed values).
BUILT_IN, SUBJECT, PRECISION = 4, 20, (1, 5)
MASK = "********"


def suffix(path: Column) -> Column:
    """The last suffix of a path in lower case, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_type(path: Column) -> Column:
    """The type that a path's suffix names, or null."""
    out = F.lit(None).cast("string")
    for end, kind in INPUTS.items():
        out = F.when(suffix(path) == end, kind).otherwise(out)
    return out


def export_fault(fmt: Column, path: Column) -> Column:
    """Null where the format is known and the path has its suffix."""
    wanted = F.lit(None).cast("string")
    for name, end in EXPORTS.items():
        wanted = F.when(F.lower(fmt) == name, end).otherwise(wanted)
    return F.when(wanted.isNull(), "format").when(suffix(path) != wanted, "suffix")


def saved_names(reports: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds file to reports (id, title, stamp, place): a name that nothing has yet. Of rows with the same name the
    one of least place keeps it; others, and all where the library has the name, get _2, _3 and so on."""
    stem = F.concat_ws("_", F.lit("解析报告"), tx.safe_name(F.col("title")), F.col("id").cast("string"), F.col("stamp"))
    taken = existing.groupBy("stem").agg(F.count("*").alias("_taken"))
    place = F.row_number().over(Window.partitionBy("stem").orderBy("place")) + F.coalesce("_taken", F.lit(0))
    numbered = reports.withColumn("stem", stem).join(taken, "stem", "left").withColumn("_place", place)
    return numbered.withColumn("file", F.when(F.col("_place") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("_place").cast("string")))).drop("_taken", "_place", "stem")


def rule_of(asked: DataFrame, rules: DataFrame, configured: int | None) -> DataFrame:
    """Over (id, given): the rule given if there is one of this id, else the configured one, else the default."""
    ids = rules.select(F.col("id").alias("_rule"))
    last = rules.agg(F.max(F.when(F.col("id") == configured, F.col("id"))).alias("_set"), F.max(F.when(F.col("is_default") == 1, F.col("id"))).alias("_default"))
    found = asked.join(ids, F.col("given") == F.col("_rule"), "left").join(F.broadcast(last))
    return found.select("id", F.coalesce("_rule", "_set", "_default").alias("rule_id"))


def rule_changes(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Over (name, subject, precision, place): each asked rule with its code (blank, long, exists, or null for one that is
    added) and its precision within bounds. Of several with one name the first that is right is added."""
    known = rules.select(F.col("name").alias("_name")).distinct().withColumn("_known", F.lit(True))
    fault = F.when(tx.is_blank(F.col("name")), "blank").when(F.length("subject") > SUBJECT, "long")
    rows = changes.withColumn("_fault", fault).join(known, F.col("name") == F.col("_name"), "left")
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.col("_fault").isNotNull(), "place")) == 1
    code = F.coalesce("_fault", F.when(F.col("_known") | ~first, "exists"))
    return rows.withColumn("code", code).withColumn("precision", F.least(F.greatest("precision", F.lit(PRECISION[0])), F.lit(PRECISION[1]))).drop("_fault", "_known", "_name")


def deletions(asked: DataFrame, locked: DataFrame, stops: bool = False) -> DataFrame:
    """Over ids: what becomes of each. A file goes before its row, so a locked file keeps both; with stops, as when all
    is cleared, nothing behind the first locked one is tried."""
    held = asked.join(locked.select("id").distinct().withColumn("_held", F.lit(True)), "id", "left")
    if not stops:
        return held.select("id", F.when(F.col("_held"), "locked").otherwise("deleted").alias("outcome"))
    first = held.agg(F.min(F.when(F.col("_held"), F.col("id"))).alias("_first"))
    outcome = F.when(F.col("id") < F.coalesce("_first", F.col("id") + 1), "deleted").when(F.col("id") == F.col("_first"), "locked").otherwise("not tried")
    return held.join(F.broadcast(first)).select("id", outcome.alias("outcome"))


def backup_plan(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Over files (path, size): the manifest of a backup. A full one packs all files; one that follows a manifest packs
    those that are new or of another size. All files are listed, as they are when it is made."""
    if before is None:
        return now.select("path", "size", F.lit(True).alias("packed"))
    old = before.groupBy("path").agg(F.max("size").alias("_size"))
    return now.join(old, "path", "left").select("path", "size", (F.col("_size").isNull() | (F.col("_size") != F.col("size"))).alias("packed"))


def write_backup(tables: dict[str, DataFrame], manifest: DataFrame, folder: str) -> None:
    """Writes the tables and the manifest below a folder that all executors see, the manifest last: a folder without one
    is no backup."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/table={name}")
    manifest.write.parquet(f"{folder}/manifest")


def masked(secret: Column) -> Column:
    """What may be shown of a stored key: whether there is one."""
    return F.when(tx.is_blank(secret), "").otherwise(MASK)

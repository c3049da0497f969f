"""Keyed table operators: latest rows, set changes, and updates as new frames.

Tables are never changed in place: each operator gives the table's next state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.sources.staging import staged


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def update_latest(df: DataFrame, key: str, values: dict[str, Column], *order: Column) -> DataFrame:
    """Sets columns in the first row of each key only."""
    marked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return marked.withColumns({c: F.when(F.col("_n") == 1, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_n")


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Takes over the non-null columns of changes by key; unknown columns and keys are ignored."""
    names = [c for c in df.columns if c in changes.columns and c != key]
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)).dropDuplicates([key])
    return df.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def upsert(df: DataFrame, changes: DataFrame, key: str, only_new: tuple[str, ...] = ()) -> DataFrame:
    """Changes win by key, but for the columns only_new, which are taken over with new keys alone."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in df.columns if c != key), F.lit(True).alias("_in"))
    old = df.withColumn("_old", F.lit(True))
    both = old.join(new, key, "full")
    kept = lambda c: F.when(F.col("_in").isNull() | (F.col("_old").isNotNull() & F.lit(c in only_new)), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
    return both.select(*(F.col(key) if c == key else kept(c) for c in df.columns))


def insert_missing(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose keys aren't there yet, of several with the same keys one."""
    return df.unionByName(rows.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti").select(*df.columns))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Parents without the ids in gone, and children (frame, column) without the rows that refer to them."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    drop = lambda df, c: df.join(ids, F.col(c) == F.col("_gone"), "left_anti")
    return {"": drop(parents, "id")} | {name: drop(df, c) for name, (df, c) in children.items()}


def replace_set(bindings: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """The owners in wanted get exactly the pairs in wanted."""
    return without(bindings, wanted, [owner]).unionByName(wanted.distinct())


def ranked(df: DataFrame, order: str, group: Column | None = None) -> DataFrame:
    """Adds _n: the place of each row, from 1, in the order of a column, within its group or in all.

    Rows are written in ranges of (group, order) that hold about equal numbers of them, whatever the values are; they are numbered within a
    range, and the ranges before are added up. No task sees more of a large group than a range of it. Nulls of the
    group are one group, those of the order come first; rows of one place in the order get places in any order.
    """
    placed = staged(df.withColumn("_group", F.lit(0) if group is None else group).repartitionByRange("_group", order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "_group").orderBy(order)))
    # a row for each range and group: groups lie side by side, so most ranges have a few, or one
    sizes = placed.groupBy("_part", "_group").agg(F.count("*").alias("_size"))
    split = sizes.join(sizes.groupBy("_group").agg(F.count("*").alias("_parts")).where("_parts > 1").select(F.col("_group").alias("_g")), F.col("_group").eqNullSafe(F.col("_g"))).drop("_g")
    before = split.withColumn("_before", F.sum("_size").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_size"))
    again = before.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_before")
    joined = inner.join(F.broadcast(again), (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_group", "_part", "_p", "_g", "_before")


def numbered(df: DataFrame, name: Column, order: str, separator: str = "_", first: int = 1) -> DataFrame:
    """Adds unique: the name, or with a running suffix where rows before have the same name."""
    n = F.col("_n") - 1
    return ranked(df, order, name).withColumn("unique", F.when(n == 0, name).otherwise(F.concat(name, F.lit(separator), (n + first - 1).cast("string")))).drop("_n")


def changed_files(now: DataFrame, before: DataFrame, by: str = "size") -> DataFrame:
    """Files that are new, or differ in the column ``by``, against the manifest before."""
    old = before.select("path", F.col(by).alias("_before")).dropDuplicates(["path"])
    return now.join(old, "path", "left").where(F.col("_before").isNull() | (F.col("_before") != F.col(by))).drop("_before")


def missing_files(referenced: DataFrame, manifest: DataFrame, packed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Referenced files that existed at the backup and are neither packed nor on disk; an empty manifest asks nothing."""
    known = manifest.limit(1).count() > 0
    asked = referenced.join(manifest.select("path"), "path", "left_semi") if known else referenced
    return reduce(lambda df, other: df.join(other.select("path"), "path", "left_anti"), (packed, on_disk), asked)


def reconcile(found: DataFrame, records: DataFrame) -> DataFrame:
    """Adds action for each backup file (name, path, time): add, relink, time_fixed, or null; earlier ones win."""
    old = records.select("name", F.col("path").alias("_path"), F.col("time").alias("_time"), "valid")
    both = found.join(old, "name", "left")
    action = F.when(F.col("_path").isNull(), "add").when(~F.col("valid"), "relink").when(F.col("_time") != F.col("time"), "time_fixed")
    return both.withColumn("action", action).drop("_path", "_time", "valid")


def import_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds code for each incoming file (id, file_hash, file_size): empty, duplicate of the library or of an
    earlier incoming file, or new."""
    known = existing.select("file_hash").distinct().withColumn("_known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("id")) == 1
    code = F.when(F.coalesce(F.col("file_size"), F.lit(0)) <= 0, "empty").when(F.col("_known").isNotNull() | ~F.col("_first"), "duplicate").otherwise("new")
    return incoming.join(known, "file_hash", "left").withColumn("_first", first).withColumn("code", code).drop("_known", "_first")


def with_new_ids(rows: DataFrame, table: DataFrame, order: str) -> DataFrame:
    """Adds ids that follow the table's greatest, in the order of a column of whole numbers that tells the rows apart."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return ranked(rows, order).join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n")).drop("_n", "_top")

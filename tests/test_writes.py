"""Tables that merges change, and snapshots that are written, broken and restored."""

import pytest
from pyspark.sql import functions as F

from foliate.operators import snapshots as sn
from foliate.operators import tables as tb
from foliate.operators import versioned as ve


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    table = ve.Table(spark, f"file:{tmp_path}/t")
    first = spark.range(5000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("old").alias("note"))
    table.create(first, ["id"])
    before = table.listing()["where"]
    changes = spark.createDataFrame([(i * 700, "changed", "new") for i in range(10)], "id long, name string, note string")
    want = rows(tb.upsert(first, changes, "id", ("note",)))
    touched = ve.upsert(table, changes, only_new=("note",))
    after = table.listing()["where"]
    assert 1 <= len(touched) <= 10 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    assert rows(table.read()) == want and rows(table.read(0)) == rows(first)
    assert ve.upsert(table, changes.limit(0)) == [] and max(table.versions()) == 1
    table.vacuum()
    assert rows(table.read()) == want and table.versions() == [1]


def test_rows_may_go_and_buckets_be_empty(spark, tmp_path):
    table = ve.Table(spark, f"file:{tmp_path}/t")
    table.create(spark.range(3).select("id", F.lit(1).alias("v")), ["id"], 3)
    gone = spark.range(3).select("id", F.lit(0).alias("v"))
    table.merge(gone, lambda old, new: tb.without(old, new, ["id"]))
    assert table.read().count() == 0 and table.read().columns == ["id", "v"]
    ve.upsert(table, gone)
    assert rows(table.read()) == [(0, 0), (1, 0), (2, 0)]
    empty = ve.Table(spark, f"file:{tmp_path}/empty")
    empty.create(gone.limit(0), ["id"])
    assert empty.read().count() == 0


def test_of_two_writers_one_fails_and_a_broken_merge_leaves_no_trace(spark, tmp_path):
    table = ve.Table(spark, f"file:{tmp_path}/t")
    table.create(spark.range(100).select("id", F.lit("a").alias("v")), ["id"])
    change = spark.createDataFrame([(1, "b")], "id long, v string")

    def late(old, new):
        ve.upsert(ve.Table(spark, f"file:{tmp_path}/t"), new)  # another writer is faster
        return tb.upsert(old, new, "id")

    with pytest.raises(FileExistsError):
        table.merge(change, late)

    def broken(old, new):
        return old.withColumn("v", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception, match="no"):
        table.merge(change, broken)
    assert table.versions() == [0, 1] and table.read().where("v = 'b'").count() == 1 and table.read().count() == 100


def test_latest_reports_and_imports(spark, tmp_path):
    reports = ve.Table(spark, f"file:{tmp_path}/r")
    reports.create(spark.createDataFrame([(1, 7, "a", 1), (2, 7, "b", 2), (3, 8, "c", 1)], "id long, lit_id long, text string, seq int"), ["lit_id"])
    values = spark.createDataFrame([(70, 7, "new", 0), (90, 9, "new", 0)], "id long, lit_id long, text string, seq int")
    ve.upsert_latest(reports, values, "text", F.desc("seq"), F.desc("id"))
    assert rows(reports.read()) == [(1, 7, "a", 1), (2, 7, "new", 2), (3, 8, "c", 1), (90, 9, "new", 0)]
    papers = ve.Table(spark, f"file:{tmp_path}/p")
    kinds = "id long, file_hash string, file_size long"
    papers.create(spark.createDataFrame([(1, "x", 5)], kinds), ["file_hash"])
    ve.import_new(papers, spark.createDataFrame([(2, "x", 5), (4, "y", 6), (3, "y", 6), (5, "z", 0), (6, "w", None)], kinds))
    assert rows(papers.read()) == [(1, "x", 5), (3, "y", 6)]


def content(df):
    return df.select("path", F.encode("text", "UTF-8").alias("content"))


def test_snapshots_keep_contents_once_and_restore_as_one(spark, tmp_path):
    store = sn.Store(spark, f"file:{tmp_path}/backups")
    old = spark.createDataFrame([(f"lib/{i}.txt", f"text {i}") for i in range(40)] + [("lib/copy.txt", "text 1")], "path string, text string")
    new = old.where("path <> 'lib/3.txt'").withColumn("text", F.when(F.col("path") == "lib/5.txt", "changed").otherwise(F.col("text"))).union(spark.createDataFrame([("lib/new.txt", "new"), ("lib/moved.txt", "text 3")], old.schema))
    none = spark.createDataFrame([], "name string, kind string, files long, bytes long")
    one = store.take("b1", {"lib": old, "backups": none}, content(old), full=True)
    assert one["files"] == 40 and one["tables"] == {"lib": 41, "backups": 1}
    two = store.take("b2", {"lib": new, "backups": store.table("b1", "backups")}, content(new))
    assert two["files"] == 2 and rows(store.table("b2", "backups")) == [("b1", "full", 40, one["bytes"]), ("b2", "incremental", 2, len("changed") + len("new"))]
    assert store.current() is None
    store.restore("b1")
    store.restore("b2")
    assert store.current() == "b2" and rows(store.table(store.current(), "lib")) == rows(new)
    assert sorted((r.path, bytes(r.content).decode()) for r in store.restored_files("b2").collect()) == rows(new)
    with pytest.raises(ValueError, match="there is"):
        store.take("b2", {}, content(new))
    assert store.take("b0", {"lib": old}, content(old.limit(0)))["files"] == 0


def test_a_snapshot_that_breaks_between_tables_is_none(spark, tmp_path):
    store = sn.Store(spark, f"file:{tmp_path}/backups")
    lib = spark.createDataFrame([("a", "x")], "path string, text string")
    store.take("b1", {"lib": lib}, content(lib), full=True)
    store.restore("b1")
    bad = lib.select(F.raise_error(F.lit("disk is full")).alias("x"))
    changed = lib.withColumn("text", F.lit("y"))
    with pytest.raises(Exception, match="disk is full"):
        store.take("b2", {"lib": changed, "notes": bad}, content(changed))
    assert store.names() == ["b1"] and store.fault("b2") == "missing" and rows(store.table(store.current(), "lib")) == [("a", "x")]
    assert store.objects().count() == 1
    assert store.roll_back() == ["b2"] and store.roll_back() == []
    store.take("b2", {"lib": changed}, content(changed))
    assert store.names() == ["b1", "b2"]


def test_gates_of_a_restore(spark, tmp_path):
    store = sn.Store(spark, f"file:{tmp_path}/backups")
    lib = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    for name, tables, files in (("ok", {"lib": lib}, lib), ("core", {"notes": lib}, lib), ("path", {"lib": lib}, lib.withColumn("path", F.concat(F.lit("../"), "path"))), ("rows", {"lib": lib}, lib), ("version", {"lib": lib}, lib), ("original", {"lib": lib}, lib.withColumn("text", F.concat("text", F.lit("!"))))):
        store.take(name, tables, content(files))
    store.table("rows", "lib").limit(1).coalesce(1).write.mode("append").parquet(f"{store.root}/snapshots/rows/table=lib")
    store.files.write("records/version.json", store.files.read("records/version.json").replace('"version": 1', '"version": 2'))
    store.files.delete("objects/original")
    spark.createDataFrame([], "sha256 string, content binary").write.parquet(f"{store.root}/objects/original")
    assert {n: store.fault(n) for n in (*store.names(), "none")} == {"core": "core", "none": "missing", "ok": None, "original": "original", "path": "path", "rows": "rows", "version": "version"}
    store.restore("ok")
    with pytest.raises(sn.Refused, match="path"):
        store.restore("path")
    assert store.current() == "ok"


@pytest.mark.parametrize("short", [1_000_000, 0])
def test_contents_stay_where_they_are_read(spark, tmp_path, monkeypatch, short):
    """of contents only those of repeated paths are shuffled for a snapshot, and a restore moves each once; lists too long to be
    sent give the same."""
    monkeypatch.setattr(sn, "BROADCAST_ROWS", short)
    store = sn.Store(spark, f"file:{tmp_path}/backups")
    old = spark.createDataFrame([(f"{i}", f"text {i % 30}") for i in range(40)] + [("twice", "same"), ("twice", "same"), ("both", "p"), ("both", "q"), (None, "no path"), ("none", None)], "path string, text string")
    new = old.where("path IS NULL OR path <> '3'").union(spark.createDataFrame([("new", "new"), ("newer", "new"), ("again", "text 3")], old.schema))
    lost = {"p", "q"} - {min("pq", key=lambda s: __import__("hashlib").sha256(s.encode()).hexdigest())}
    for name, df, full, want in (("b1", old, True, {f"text {i}" for i in range(30)} | {"same", "no path"} | lost), ("b2", new, False, {"new"}), ("b3", new, True, {f"text {i}" for i in range(30)} | {"same", "no path", "new"} | lost), ("b4", new, False, set())):
        assert store.take(name, {"lib": df}, content(df), full)["files"] == len(want)
        assert sorted(bytes(r.content).decode() for r in spark.read.parquet(f"{store.root}/objects/{name}").collect()) == sorted(want)
    papers = spark.createDataFrame([("new", 1), ("3", 2), ("4", 3), ("4", 4)], "path string, id long")
    found = store.restored_files("b2", papers)
    assert sorted((r.path, r.id, bytes(r.content).decode()) for r in found.collect()) == [("4", 3, "text 4"), ("4", 4, "text 4"), ("new", 1, "new")]
    if not short:
        return
    single = new.where("path NOT IN ('twice', 'both')")
    told = content(single).withColumn("sha256", F.sha2("content", 256))
    store.take("b5", {"lib": single}, content(single), True)
    packed, _ = store._packed("b5", told, True)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan, plan

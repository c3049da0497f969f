"""Backups that are written and read: tables, and files kept once by their content, published by a record that comes last.

    root/objects/<snapshot>/            contents (sha256, content) that no earlier snapshot has
    root/snapshots/<snapshot>/table=... tables, and the manifest of all files (path, size, sha256, and rows: how many had the path)
    root/records/<snapshot>.json        the record: without one a snapshot is not there
    root/CURRENT                        the snapshot that is restored
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.sources.staging import BROADCAST_ROWS, Files, discard, staged

#: Version of the layout, and the table that a backup can't do without (fixed values).
VERSION, CORE = 1, "lib"
_FILES = "path string, size long, sha256 string"


class Refused(Exception):
    """A restore that a gate has stopped; nothing has changed."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def names(self) -> list[str]:
        """Snapshots that are there, in order of name."""
        return [n.removesuffix(".json") for n in self.files.names("records") if n.endswith(".json") and n[0] not in "._"]

    def record(self, name: str) -> dict:
        return json.loads(self.files.read(f"records/{name}.json"))

    def table(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/{name}/table={table}")

    def manifest(self, name: str) -> DataFrame:
        return self.spark.read.schema(_FILES).parquet(f"{self.root}/snapshots/{name}/manifest")

    def objects(self) -> DataFrame:
        """Contents of all snapshots that are there, one of each."""
        found = [f"{self.root}/objects/{n}" for n in self.names()]
        return self.spark.read.schema("sha256 string, content binary").parquet(*found) if found else self.spark.createDataFrame([], "sha256 string, content binary")

    def take(self, name: str, tables: dict[str, DataFrame], files: DataFrame, full: bool = False) -> dict:
        """Writes a snapshot of tables and files (path, content) and gives its record.

        A full one holds all contents, another those alone that no snapshot has. Among the tables, ``backups`` (name, kind, files,
        bytes) gets the snapshot's own row. A half-written one of this name is cleared before; a complete one is refused.
        Equal contents are kept once; of several files with one path the greatest content by its hash stays.
        """
        if self.files.exists(f"records/{name}.json"):
            raise ValueError(f"there is a snapshot {name}")
        self.discard(name)
        told = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
        here = f"{self.root}/snapshots/{name}"
        files_of_path = told.groupBy("path").agg(F.max(F.struct("sha256", "size")).alias("f"), F.count("*").alias("rows"))
        files_of_path.select("path", "f.size", "f.sha256", "rows").write.parquet(f"{here}/manifest")
        packed, marks = self._packed(name, told, full)
        packed.write.parquet(f"{self.root}/objects/{name}")
        discard(marks)
        own = self.spark.read.schema("sha256 string, content binary").parquet(f"{self.root}/objects/{name}")
        n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
        kind = "full" if full else "incremental"
        if "backups" in tables:
            row = self.spark.createDataFrame([(name, kind, n, size)], "name string, kind string, files long, bytes long")
            tables = {**tables, "backups": tables["backups"].unionByName(row)}
        for table, df in tables.items():
            df.write.parquet(f"{here}/table={table}")
        rows = {t: self.table(name, t).count() for t in tables}
        record = {"version": VERSION, "kind": kind, "files": n, "bytes": size, "tables": rows, "before": self.names()}
        self.files.write(f"records/{name}.json", json.dumps(record))
        return record

    def _packed(self, name: str, told: DataFrame, full: bool) -> tuple[DataFrame, DataFrame]:
        """Rows (sha256, content) that a snapshot packs, and the staged list that tells them. One path is chosen for each content from the manifest, and contents stay
        where they are read: the shorter list, of paths to pack or of the others, goes to them. A list that is counted to be too
        long for that is shuffled, and the contents with it, once. Contents of paths of several rows are set apart and shuffled."""
        listed = self.spark.read.schema(f"{_FILES}, rows long").parquet(f"{self.root}/snapshots/{name}/manifest")
        one = listed.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("path")).alias("f"))
        if not full:
            one = one.join(self.objects().select("sha256"), "sha256", "left_anti")
        chosen = one.select(F.col("f.path").alias("_path"), F.lit(True).alias("packed"))
        marked = listed.join(chosen, F.col("path").eqNullSafe(F.col("_path")), "left")
        marks = staged(marked.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256"), "rows", F.coalesce("packed", F.lit(False)).alias("packed")), "packing")
        single = F.col("packed") & (F.col("rows") == 1)
        n, others, repeated = marks.agg(F.count_if(single), F.count_if(~single), F.count_if(F.col("packed") & ~single)).first()
        short = marks.where(single if n <= others else ~single).select("_path")
        sent = F.broadcast(short) if min(n, others) <= BROADCAST_ROWS else short
        found = told.join(sent, F.col("path").eqNullSafe(F.col("_path")), "left_semi" if n <= others else "left_anti").select("sha256", "content")
        if not repeated:
            return found, marks
        several = marks.where(F.col("packed") & ~single)
        same = F.col("path").eqNullSafe(F.col("_path")) & (F.col("sha256") == F.col("_sha256"))
        return found.unionByName(told.join(several, same, "left_semi").select("sha256", "content").dropDuplicates(["sha256"])), marks

    def discard(self, name: str) -> None:
        """Takes away what a snapshot without a record has left behind."""
        if not self.files.exists(f"records/{name}.json"):
            for part in ("snapshots", "objects"):
                self.files.delete(f"{part}/{name}")

    def roll_back(self) -> list[str]:
        """Takes away all half-written snapshots; returns their names."""
        half = sorted({*self.files.names("snapshots"), *self.files.names("objects")} - set(self.names()))
        for name in half:
            self.discard(name)
        return half

    def fault(self, name: str) -> str | None:
        """The first gate that a snapshot doesn't pass: missing, version, core, rows, path, original; null for none.

        rows: a table's number of rows isn't the record's. path: a file would leave the library's folder. original: a file's content is nowhere.
        """
        if not self.files.exists(f"records/{name}.json"):
            return "missing"
        record = self.record(name)
        if record["version"] != VERSION:
            return "version"
        if CORE not in record["tables"]:
            return "core"
        if any(not self.files.exists(f"snapshots/{name}/table={t}") or self.table(name, t).count() != n for t, n in record["tables"].items()):
            return "rows"
        listed = self.manifest(name)
        if not listed.where(F.col("path").rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:")).isEmpty():
            return "path"
        if not listed.join(self.objects().select("sha256"), "sha256", "left_anti").isEmpty():
            return "original"
        return None

    def restore(self, name: str) -> None:
        """Makes a snapshot the current one, if it passes all gates: one rename changes all tables and files together."""
        if fault := self.fault(name):
            raise Refused(fault)
        self.files.write("CURRENT", name)

    def current(self) -> str | None:
        return self.files.read("CURRENT") if self.files.exists("CURRENT") else None

    def restored_files(self, name: str, papers: DataFrame | None = None) -> DataFrame:
        """Rows (path, size, sha256, content) of a snapshot's files, with their contents from whichever snapshot holds them.

        With papers, a table with a path: its rows whose path is a file of the snapshot, with these columns behind their own.
        Contents move once, by their hash: what names a file is put together before.
        """
        kept, listed = self.objects().dropDuplicates(["sha256"]), self.manifest(name)
        named = listed if papers is None else papers.join(listed, "path")
        return named.join(kept, "sha256", "left").select(*(["path"] if papers is None else papers.columns), "size", "sha256", "content")

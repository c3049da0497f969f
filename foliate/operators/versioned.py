"""Tables that are changed by writing: a merge rewrites the buckets that changed keys fall into, and a new version lists them.

    folder/_versions/00000003.json      the buckets of version 3, and the folder of each
    folder/data/00000003-.../bucket=17  what version 3 has written; other buckets stay where earlier versions have them

A version is there when its list is: it is written last and gets its name by a rename that fails where the name is taken.
What a broken merge has left behind is listed nowhere.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.operators import tables as tb
from foliate.sources.staging import Files

BUCKETS = 64


class Table:
    """A table below a folder, dealt to buckets by a hash of its keys."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("_versions") if n[:1].isdigit()]

    def listing(self, version: int | None = None) -> dict:
        """Keys, schema, number of buckets, and the folder of each bucket with rows, of a version (the last one)."""
        at = max(self.versions()) if version is None else version
        return json.loads(self.files.read(f"_versions/{at:08d}.json"))

    def create(self, df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        self._publish(0, {"keys": keys, "schema": df.schema.json(), "buckets": buckets, "where": {}}, df, range(buckets))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version; of these buckets only."""
        listed = self.listing(version)
        found = [f"{self.folder}/{path}" for b, path in sorted(listed["where"].items()) if only is None or int(b) in only]
        schema = self._schema(listed)
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(listed: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(listed["schema"]))

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _publish(self, version: int, listed: dict, rows: DataFrame, touched) -> int:
        """Writes rows as the content of the touched buckets of a version; fails where another writer has made it."""
        path = f"data/{version:08d}-{uuid.uuid4().hex[:8]}"
        names = [f.name for f in self._schema(listed)]
        dealt = rows.select(*names, self._bucket(listed["keys"], listed["buckets"]).alias("bucket"))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
        made = {n.removeprefix("bucket="): f"{path}/{n}" for n in self.files.names(path) if n.startswith("bucket=")}
        kept = {b: p for b, p in listed["where"].items() if int(b) not in set(touched)}
        self.files.claim(f"_versions/{version:08d}.json", json.dumps({**listed, "where": {**kept, **made}}))
        return version

    def merge(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """A new version: ``change(old rows, changes)`` gives the next rows of the buckets that keys of changes fall into. All rows
        of a key are in one bucket, so others need not be read. Returns these buckets; there are at most as many as the
        table has. Nothing is written where there are no changes."""
        version = max(self.versions())
        listed = self.listing(version)
        touched = sorted(r.b for r in changes.select(self._bucket(listed["keys"], listed["buckets"]).alias("b")).distinct().collect())
        if touched:
            self._publish(version + 1, listed, change(self.read(version, touched), changes), touched)
        return touched

    def vacuum(self) -> None:
        """Deletes all versions but the last, and data that it doesn't list; nothing may be reading these."""
        last = max(self.versions())
        used = {p.split("/")[1] for p in self.listing(last)["where"].values()}
        for name in self.files.names("data"):
            if name not in used:
                self.files.delete(f"data/{name}")
        for v in self.versions():
            if v != last:
                self.files.delete(f"_versions/{v:08d}.json")


def upsert(table: Table, changes: DataFrame, only_new: tuple[str, ...] = ()) -> list[int]:
    """Changes win by the table's key; columns only_new are taken over with new keys alone."""
    (key,) = table.listing()["keys"]
    return table.merge(changes, lambda old, new: tb.upsert(old, new, key, only_new))


def upsert_latest(table: Table, values: DataFrame, column: str, *order: Column) -> list[int]:
    """Over a table of several rows a key and values (key, column, and what a new row has): the first row in the order takes the value; a
    key without rows gets one."""
    (key,) = table.listing()["keys"]

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        told = old.join(new.select(key, F.col(column).alias("_new")), key, "left")
        updated = tb.update_latest(told, key, {column: F.coalesce("_new", column)}, *order).select(*old.columns)
        return updated.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))

    return table.merge(values, change)


def import_new(table: Table, incoming: DataFrame) -> list[int]:
    """Adds the first of the incoming files of each content that the table (by file_hash) doesn't have; empty files and others stay out."""

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        wanted = tb.import_plan(new, old).where("code = 'new'").select(*old.columns)
        return old.unionByName(wanted)

    return table.merge(incoming, change)

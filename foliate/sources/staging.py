"""Folders that the driver and all executors share: tables written once and read back, and files moved by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a counted table goes to every executor.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one of this machine's if executors are threads of this
    process, as in tests; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:/tmp/foliate-checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The frame written once and read back: cuts the lineage and outlives executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.staged_at = path
    return again


def discard(*frames: DataFrame) -> None:
    """Deletes tables that staged has written, once everything that was read from them is written itself."""
    for frame in frames:
        Files(frame.sparkSession, frame.staged_at).delete("")


class Files:
    """Small files and names below a folder, on any file system that Spark reaches; for the driver."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.gateway, self.base = spark._jvm, spark.sparkContext._gateway, base.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def qualified(self) -> str:
        """The folder as listings name it, with its scheme."""
        return self.fs.makeQualified(self._path("")).toString()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none where there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _written(self, name: str, text: str):
        """A temporary file in the folder of a name."""
        target = self._path(name)
        temporary = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return temporary

    def _renamed(self, source, name: str, over: bool) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if over else kind.NONE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(source, self.fs.makeQualified(self._path(name)), options)

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; it takes the place of the one before in one step."""
        self._renamed(self.fs.makeQualified(self._written(name, text)), name, True)

    def claim(self, name: str, text: str) -> None:
        """The same for a name that nothing has yet: of two writers one fails."""
        temporary = self.fs.makeQualified(self._written(name, text))
        try:
            self._renamed(temporary, name, False)
        except Exception as e:
            self.fs.delete(temporary, False)
            raise FileExistsError(name) from e

    def move(self, source: str, target: str) -> None:
        """A folder or file to another name that isn't taken."""
        self.fs.mkdirs(self._path(target).getParent())
        if self.exists(target) or not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

"""Scratch tables in the folder that executors share, and small files through Hadoop's file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only if that is unset and the master is local."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        base = _LOCAL[sc.applicationId]
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and return it as read from there.

    This cuts the lineage: what follows depends on files in shared storage, not on executors.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """One side of a join of tables with a row for each file or range: neither side is sent to all executors by way of the driver.

    Spark judges tables by the size of their Parquet files, and paths are there in a small part of the memory they take in a join.
    """
    return df.hint("merge")


class Files:
    """Small files in any of Hadoop's file systems, from the driver."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.base = base.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file as a whole."""
        self._put(name, text, replace=True)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; false if it is there already."""
        return self._put(name, text, replace=False)

    def _put(self, name: str, text: str, replace: bool) -> bool:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(name).getParent())
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        kinds = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(kinds, 0, options.OVERWRITE if replace else options.NONE)
        try:
            context.rename(draft, self._path(name), kinds)
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if replace or "already exists" not in str(e):
                raise
            return False

    def read_json(self, name: str, default=None):
        return json.loads(self.read(name)) if self.exists(name) else default

    def write_json(self, name: str, value) -> None:
        self.write(name, json.dumps(value, sort_keys=True))

"""Lineage cuts and joins that broadcast only what has been measured as small."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured bytes are under this.
BROADCAST_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set, and then only in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Tables of one operation, in a folder of its own inside the shared checkpoint folder.

    ``cut`` writes a frame as Parquet and goes on from the files: executors lost later cost nothing but a
    new read. The shuffle files of a finished table go at once, and ``drop`` deletes tables that
    nothing reads any more. Tables that a result still reads are deleted when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/tessera-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._end)

    def _end(self) -> None:
        # The session may have been stopped, and its folder removed, before.
        with contextlib.suppress(Exception):
            remove(self.spark, self.folder)

    def cut(self, frame: DataFrame, *spent: DataFrame) -> DataFrame:
        """``frame``, written and read again; after that the tables ``spent`` are dropped."""
        path, before = f"{self.folder}/{len(self.paths):04d}-{uuid.uuid4().hex[:8]}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            frame.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        self.drop(*spent)
        return table

    def drop(self, *spent: DataFrame) -> None:
        for table in spent:
            if (found := self.paths.get(id(table))) and found[1]:
                remove(self.spark, found[1])
                self.paths[id(table)] = (table, "")

    def bytes(self, table: DataFrame) -> int:
        """Bytes of a table's files."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][1])
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def maybe_broadcast(frame: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, array: str | None = None, blob: str | None = None) -> DataFrame:
    """``frame`` (already cut) with a broadcast hint if its counted size is under the limit.

    ``array`` names a column of arrays, whose elements are counted as rows of ``row_bytes`` too, and ``blob`` one
    of strings or bytes, which are added. Beyond the limit the frame comes back unchanged and the join shuffles.
    """
    n = F.count("*") + (F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0))
    more = F.coalesce(F.sum(F.octet_length(blob)), F.lit(0)) if blob else F.lit(0)
    return F.broadcast(frame) if frame.agg(n * row_bytes + more).first()[0] <= limit else frame

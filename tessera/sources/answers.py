"""The answer cache: one Parquet table of answers by request, parted by the first digits of the key.

A key is the hash of a request and of who was asked (clients.identity), so no client gets another one's answer. Rows hold the
request (state, questions and options), the answer, what it cost and when it came, so a cache can be audited. A
lookup reads only the parts in which it has keys. A file that cannot be read costs its own rows: they are asked
again. Each run that asks adds at most one file to a part; ``compact`` joins a part's files into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import Tables

SCHEMA = "key string, client string, request string, answer string, cost double, asked timestamp, part string"
#: Hex digits of the key that name its part: 256 parts.
DIGITS = 2


def part_of(key: str = "key"):
    # The letter keeps a name of digits from being read as a number.
    return F.concat(F.lit("k"), F.substring(key, 1, DIGITS))


class AnswerCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self, parts: list[str] | None = None) -> DataFrame:
        """All readable rows, or those of some parts."""
        if not self._there():
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("basePath", self.path).parquet(self.path)
        return found if parts is None else found.where(F.col("part").isin(parts))

    def held(self, requests: DataFrame) -> DataFrame:
        """(key, answer) of the requests that have one; of several answers, the first that came."""
        parts = [r[0] for r in requests.select(part_of()).distinct().collect()]  # 256 at most
        mine = self.rows(parts).join(requests.select("key").distinct(), "key", "left_semi")
        return mine.groupBy("key").agg(F.min_by("answer", F.struct("asked", "answer")).alias("answer"))

    def add(self, answers: DataFrame, client: str) -> None:
        """Appends answers (key, request, answer, cost) of a client."""
        rows = answers.select("key", F.lit(client).alias("client"), "request", "answer", "cost", F.current_timestamp().alias("asked"), part_of().alias("part"))
        rows.repartition("part").write.partitionBy("part").mode("append").parquet(self.path)

    def compact(self) -> int:
        """Joins the files of each part that has several, one row a key; returns the number of parts. Nobody may add meanwhile."""
        if not self._there():
            return 0
        several = self.rows().select("part", F.input_file_name().alias("file")).groupBy("part").agg(F.count_distinct("file").alias("n")).where("n > 1").select("part")
        parts = [r[0] for r in several.collect()]  # 256 at most
        if parts:
            tables, names = Tables(self.spark), ["key", "client", "request", "answer", "cost", "asked", "part"]
            first = F.min_by(F.struct(*names[1:-1]), F.struct("asked", "answer")).alias("first")
            kept = tables.cut(self.rows(parts).groupBy("part", "key").agg(first).select("key", *(f"first.{n}" for n in names[1:-1]), "part"))
            kept.repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)
            tables.drop(kept)
        return len(parts)

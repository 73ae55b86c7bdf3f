"""Columns looked up once for each distinct key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Least confidence of an answer, by type.
LEAST_CONFIDENCE = {"category": 0.7, "binary": 0.7, "numeric": 0.4}
TOLERANCE = 0.2


def keyed(frame: DataFrame, *columns: str) -> DataFrame:
    """Adds ``key``, the composite key of the columns ("" where a part is missing)."""
    return frame.withColumn("key", X.composite_key(*(F.col(c) for c in columns)))


def key_counts(frame: DataFrame, min_count: int = 1) -> DataFrame:
    """(key, count) of the non-empty keys that occur often enough."""
    return frame.where("key <> ''").groupBy("key").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)


def to_ask(counts: DataFrame, answers: DataFrame) -> DataFrame:
    """Keys without an answer, or with an error for one."""
    return counts.join(answers.where("source <> 'error'").select("key").distinct(), "key", "left_anti")


def batches(keys: DataFrame, size: int, parts: int = 64) -> DataFrame:
    """(batch, keys): keys in order, ``size`` to a batch.

    Keys are numbered within md5 parts, so no task sorts them all; a batch never mixes parts.
    """
    part = (F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int") % parts).alias("part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    out = keys.select("key", part).withColumn("batch", F.floor((rank - 1) / size))
    return out.groupBy("part", "batch").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(F.concat_ws("-", "part", "batch").alias("batch"), "keys")


def first_wins(answers: DataFrame, order: str) -> DataFrame:
    """One answer for each key: the first by ``order``."""
    w = Window.partitionBy("key").orderBy(order)
    return answers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def validated(value: Column, kind: str, values: Sequence[str] = (), low: float | None = None, high: float | None = None) -> Column:
    """The accepted value as text, null if it is rejected: unknown, no number, out of range, or no candidate.

    A category is accepted in another spelling of the same normal form and takes the candidate's.
    """
    if kind == "numeric":
        x = X.parsed_number(value)
        ok = x.isNotNull()
        if low is not None:
            ok = ok & (x >= low)
        if high is not None:
            ok = ok & (x <= high)
        return F.when(ok, x.cast("string"))
    given, out = X.normalised(value), F.lit(None).cast("string")
    for v in reversed(list(values)):
        out = F.when(given == X.normalised(F.lit(v)), F.lit(v)).otherwise(out)
    return out


def thresholded(answers: DataFrame, threshold: float) -> DataFrame:
    """Applied when read: answers of little confidence are rejected, but stay in the cache as they are."""
    low = F.coalesce(F.col("confidence"), F.lit(0.0)) < threshold
    return answers.withColumn("source", F.when(F.col("value").isNotNull() & low, "rejected").otherwise(F.col("source"))).withColumn("value", F.when(~low, F.col("value")))


def resolved(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (with ``key``) joined to their key's value, confidence, source and share of its cost."""
    counts = rows.groupBy("key").agg(F.count("*").alias("_count"))
    priced = answers.join(counts, "key").withColumn("cost", F.coalesce(F.col("cost"), F.lit(0.0)) / F.col("_count")).drop("_count")
    out = rows.join(priced, "key", "left")
    source = F.when(F.col("key") == "", "skipped").otherwise(F.coalesce("source", F.lit("unknown")))
    return out.withColumns({"source": source, "cost": F.coalesce("cost", F.lit(0.0))})


def agreement(frame: DataFrame, value: str, known: str, numeric: bool) -> DataFrame:
    """One row: n, agreement of looked-up values with a column that knows better."""
    if numeric:
        got, want = X.parsed_number(F.col(value)), X.parsed_number(F.col(known))
        both, same = got.isNotNull() & want.isNotNull(), F.abs(got - want) <= TOLERANCE * F.abs(want)
    else:
        both, same = F.col(value).isNotNull() & F.col(known).isNotNull(), X.normalised(F.col(value)) == X.normalised(F.col(known))
    return frame.where(both).agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"))


def review_queue(answers: DataFrame, counts: DataFrame) -> DataFrame:
    """Keys without a value, most frequent first."""
    return answers.where(F.col("source").isin("unknown", "rejected", "error")).join(counts, "key").select("key", "count", "source").orderBy(F.col("count").desc(), "key")


def status(frame: DataFrame) -> DataFrame:
    return frame.groupBy("source").agg(F.count("*").alias("n"))


def cost_per_key(batch: int, price_in: float, price_out: float) -> float:
    """Dollars a key from prices per million tokens; the instructions are read from the provider's cache."""
    return ((60 + 15 * batch) * price_in + 600 * price_in * 0.1 + 70 * batch * price_out) / 1e6 / batch

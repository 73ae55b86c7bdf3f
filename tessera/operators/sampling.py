"""Samples, folds and row counts that are the same on every run and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut


def half_even(x: float) -> int:
    """A rate times a count as a number of rows, ties to even."""
    return int(round(x))


def capped(frame: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n rows: those of the least md5 of the id."""
    return frame.orderBy(F.md5(F.col(id_col).cast("string")), F.col(id_col)).limit(n)


def fold(id_col: Column, n: int) -> Column:
    """Fold 0 to n - 1 by the id's md5."""
    return (F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")


def places_within(frame: DataFrame, group: str, order: Sequence[Column], place: str = "place") -> DataFrame:
    """Adds ``place``, the rank from 1 within each group (nulls are one), without a task that holds a whole group.

    Rows are dealt to ranges of (group, order); a row's place is its rank in its group's part of the range and the
    sizes of that group's parts before. ``order`` must tell rows apart. Names that start with "__" are its own.
    """
    keys = [F.col("__g"), *(F.col(f"__{i}") for i in range(len(order)))]
    own = frame.select("*", F.col(group).alias("__g"), *(c.alias(f"__{i}") for i, c in enumerate(order)))
    parts = cut(own.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    local = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part", "__g").orderBy(*keys[1:])))
    sizes = parts.groupBy("__g", "__part").agg(F.count("*").alias("__size"))
    # A group has a row for each range that it reaches.
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    joined = local.join(before, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")))
    return joined.select(*frame.columns, (F.col("__row") + F.col("__before")).alias(place))


def stratified_folds(frame: DataFrame, label: str, id_col: str, n: int, out: str = "fold") -> DataFrame:
    """Adds folds that share out each label evenly, in md5 order of the id."""
    placed = places_within(frame, label, [F.md5(F.col(id_col).cast("string")), F.col(id_col)], "__place")
    return placed.withColumn(out, ((F.col("__place") - 1) % n).cast("int")).drop("__place")

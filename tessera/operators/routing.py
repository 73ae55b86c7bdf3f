"""Signals of doubt, and which rows go to the expensive answer."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..sources.checkpoints import cut
from .sampling import half_even

#: Share of all places of unseen words from which on a word is hot.
HOT_WORD = 1e-3
#: Most rows that are taken in order by one task.
TAKEN = 50_000
# Estimates of an external answer, in seconds and dollars.
SECONDS_A_CALL, SETUP_SECONDS, COST_A_ROW, WARN_DOLLARS = 4.6, 23.85, 0.0086, 0.10


def top_rows(frame: DataFrame, signal: str, id_col: str, n: int, descending: bool = True) -> DataFrame:
    """Exactly n rows of highest (or lowest) signal, ties to the lesser id: TakeOrdered for few, else by places, as it gathers n rows in one task."""
    order = F.col(signal).desc_nulls_last() if descending else F.col(signal).asc_nulls_last()
    if n > TAKEN:
        return places(frame, signal, id_col, descending).where(F.col("place") <= n).select(*frame.columns)
    return frame.orderBy(order, F.col(id_col)).limit(n)


def selected(frame: DataFrame, signal: str, id_col: str, rate: float | None = None, threshold: float | None = None, approved: DataFrame | None = None) -> DataFrame:
    """Rows to send: the top share, else those at the threshold, else all; approved rows go afterwards, unreplaced."""
    if rate is not None:
        if not 0 <= rate <= 1:
            raise TesseraError("a rate is between 0 and 1")
        out = top_rows(frame, signal, id_col, half_even(frame.count() * rate))
    else:
        out = frame if threshold is None else frame.where(F.col(signal) >= threshold)
    return out if approved is None else out.join(approved.select(id_col).distinct(), id_col, "left_anti")


def unseen_levels(frame: DataFrame, train: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, unseen_levels): how many categories of a row are not in train; a null counts as unseen."""
    out, hits = frame.select(id_col, *columns), F.lit(0)
    for i, c in enumerate(columns):
        known = train.where(F.col(c).isNotNull()).select(F.col(c)).distinct().withColumn(f"_{i}", F.lit(True))
        out = out.join(known, c, "left")
        hits = hits + F.when(F.col(f"_{i}").isNull(), 1).otherwise(0)
    return out.select(F.col(id_col), hits.alias("unseen_levels"))


def unseen_words(frame: DataFrame, train: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, unseen_words): share of a text's lower-cased words that no training text has; 0 without words."""
    listed = lambda f: F.filter(F.split(F.lower(F.coalesce(f[text], F.lit(""))), r"\s+"), lambda w: w != "")
    rows = frame.select(F.col(id_col).alias("__id"), listed(frame).alias("__words"))
    words = rows.select("__id", F.explode("__words").alias("w"))
    # Distinct words of either side meet, so no word is hot; then only words that train lacks are sought in the rows.
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    lacking = cut(counted.join(train.select(F.explode(listed(train)).alias("w")).distinct(), "w", "left_anti"))
    total = lacking.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = total * HOT_WORD
    # Those in more than a thousandth of the lines left are a thousand at most: they are broadcast, and the others fill no task.
    hot, rest = F.broadcast(lacking.where(F.col("n") > often).select("w")), lacking.where(F.col("n") <= often).select("w")
    found = words.join(hot, "w", "left_semi").unionByName(words.join(rest, "w", "left_semi"))
    unseen = found.groupBy("__id").agg(F.count("*").alias("u"))
    share = F.when(F.size("__words") > 0, F.coalesce("u", F.lit(0)) / F.size("__words")).otherwise(0.0)
    return rows.join(unseen, "__id", "left").select(F.col("__id").alias(id_col), share.cast("double").alias("unseen_words"))


def unseen_signal(frame: DataFrame, train: DataFrame, id_col: str, categorical: Sequence[str], text: str | None) -> DataFrame:
    """(id, signal): unseen categories plus the share of unseen words."""
    out = unseen_levels(frame, train, id_col, categorical)
    if text is None:
        return out.select(id_col, F.col("unseen_levels").cast("double").alias("signal"))
    return out.join(unseen_words(frame, train, id_col, text), id_col).select(id_col, (F.col("unseen_levels") + F.col("unseen_words")).alias("signal"))


def confidence(frame: DataFrame, signal: str) -> DataFrame:
    """Adds ``confidence``: 1 less the signal scaled to its range, 1 if all signals are equal; null stays null."""
    ends = frame.agg(F.min(signal).alias("_low"), F.max(signal).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span < 1e-12, 1.0).otherwise(1.0 - (F.col(signal) - F.col("_low")) / span)
    return frame.join(F.broadcast(ends)).withColumn("confidence", F.when(F.col(signal).isNotNull(), scaled)).drop("_low", "_high")


def curve(frame: DataFrame, signal: str, id_col: str, truth: str, base: str, answer: str, rates: Sequence[float], cost: float = COST_A_ROW, classification: bool = False) -> DataFrame:
    """(rate, n_sent, error, cost_usd) if the rows of highest signal took the answer.

    One sort by signal for all rates: each row's place comes from its partition's offset, so that no
    task holds all rows; then one aggregate for each rate over the same pass.
    """
    n = frame.count()
    placed = places(frame, signal, id_col)
    sums = []
    for rate in rates:
        k = half_even(n * rate)
        value = F.when(F.col("place") <= k, F.col(answer)).otherwise(F.col(base))
        miss = (value == F.col(truth)).cast("double") if classification else F.abs(value - F.col(truth))
        sums.append(F.struct(F.lit(float(rate)).alias("rate"), F.lit(k).cast("long").alias("n_sent"), F.avg(miss).alias("error"), F.lit(k * cost).alias("cost_usd")))
    return placed.agg(F.array(*sums).alias("c")).select(F.inline("c"))


def places(frame: DataFrame, signal: str, id_col: str, descending: bool = True) -> DataFrame:
    """Adds ``place``, the rank from 1 by signal (descending unless told, then id), without a window over one partition."""
    from pyspark.sql import Window

    order = [F.col(signal).desc_nulls_last() if descending else F.col(signal).asc_nulls_last(), F.col(id_col)]
    parts = cut(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.alias("s").join(sizes.alias("t"), F.col("t._part") < F.col("s._part"), "left").groupBy("s._part").agg(F.coalesce(F.sum("t._size"), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn("place", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def seconds(n: int, workers: int = 8, a_call: float = SECONDS_A_CALL, setup: float = SETUP_SECONDS) -> float:
    return setup + math.ceil(n / workers) * a_call


def unit_cost(cost: float, calls: int, hits: int, default: float = COST_A_ROW) -> float:
    return cost / (calls - hits) if calls > hits else default


def plan(frame: DataFrame, signal: str, id_col: str, rate: float | None = None, threshold: float | None = None, approved: DataFrame | None = None, cost: float = COST_A_ROW, workers: int = 8) -> dict:
    """Rows, dollars and seconds of a prediction, without a call."""
    n, sent = frame.count(), selected(frame, signal, id_col, rate, threshold, approved).count()
    return {"n_rows": n, "n_sent": sent, "cost_usd": sent * cost, "cost_of_all_usd": n * cost, "seconds": seconds(sent, workers) if sent else 0.0}


def merged(frame: DataFrame) -> Column:
    """Origin of a row's answer from flag columns: approved, sent and answered, sent and failed, middle tier, first model."""
    return F.when(F.col("approved").isNotNull(), "human").when(F.col("sent") & F.col("answer").isNotNull(), "llm").when(F.col("sent"), "fallback").when(F.col("tier").isNotNull(), "jev").otherwise("model")

"""Errors, losses and what a column contributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict bounds of a screen.
WORTH, UNLIKELY, TINY = 0.10, 0.05, 2.220446049250313e-16
#: Standard errors that the gain over keys must reach: chance alone does so about once in forty times.
CLEAR = 2.0


def mean_absolute_error(truth: Column, value: Column) -> Column:
    return F.avg(F.abs(value - truth))


def accuracy(truth: Column, value: Column) -> Column:
    return F.avg((truth == value).cast("double"))


def log_loss(label: Column, probabilities: Column) -> Column:
    """Mean of -ln of the true class's probability, clipped away from 0 and 1; ``label`` counts from 0."""
    return F.avg(loss(label, probabilities))


def loss(label: Column, probabilities: Column) -> Column:
    """One row's part of log_loss()."""
    p = F.element_at(probabilities, label.cast("int") + 1)
    return -F.log(F.greatest(F.least(p, F.lit(1 - TINY)), F.lit(TINY)))


def contribution(folds: DataFrame, without: str, with_: str) -> DataFrame:
    """One row from one row a fold: mean scores, contribution, fold wins, verdict.

    Where the folds tell their keys' gains (``gain`` and ``gain2``, sums over keys of the gain and of its square), a column is accepted only if
    their sum is clear of chance: the rows of a key share one value, so keys and not rows are independent of each other.
    """
    clear = F.sum("gain") >= CLEAR * F.sqrt(F.sum("gain2")) if "gain" in folds.columns else F.lit(True)
    one = folds.agg(clear.alias("_clear"), F.count("*").alias("folds"), F.avg(without).alias("score_without"), F.avg(with_).alias("score_with"), F.count_if(F.col(without) > F.col(with_)).alias("wins"))
    share = F.when(F.col("score_without") != 0, (F.col("score_without") - F.col("score_with")) / F.col("score_without")).otherwise(0.0)
    verdict = F.when((share >= WORTH) & (F.col("wins") >= F.col("folds") - 1), "worth_trying").when(share < UNLIKELY, "unlikely_to_help").otherwise("inconclusive")
    accepted = (share > 0) & (F.col("wins") >= F.col("folds") - 1) & F.coalesce("_clear", F.lit(False))
    return one.select("*", share.alias("contribution"), verdict.alias("verdict"), accepted.alias("accepted")).drop("_clear")

"""Does a column carry signal? Cross-validated scores with and without it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import text as X
from ..sources.checkpoints import cut
from . import sampling, scores
from .models import Trees
from .neighbours import small
from .profile import infer_task
from .text_svd import TextSVD, TooFewGrams

#: Columns that a fold's text becomes, and the characters of a text that are looked at.
TEXT_COLUMNS, TEXT_CHARS = 64, 500


def fold_scores(frame: DataFrame, target: str, id_col: str, numeric: Sequence[str], categorical: Sequence[str], extra_numeric: Sequence[str] = (), extra_categorical: Sequence[str] = (), folds: int = 3, task: str | None = None, trees: int = 10, depth: int = 3, text: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(fold, without, with): mean absolute error or log loss of each fold, without and with the extra columns.

    With ``keys``, the columns that an extra one is looked up by, a key's rows are in one fold, so that no tree can learn a key by heart; then there
    are gain and gain2 too, the sums over keys of what the extra columns take off the errors, and of its square. Where the keys do not
    suffice for that (under two a fold, or a class that only one fold has), the folds are those of rows.

    ``text`` becomes columns by a decomposition fitted on each fold's training rows alone; where those have no frequent n-gram, it adds none.
    """
    task = task or infer_task(frame, target)
    data = frame.where(F.col(target).isNotNull())
    if data.count() < 2 * folds:
        raise TesseraError("too few rows for the folds")
    by_rows = lambda: data.withColumn("_fold", sampling.fold(F.col(id_col), folds)) if task == "regression" else sampling.stratified_folds(data, target, id_col, folds, "_fold")
    if keys:
        keyed = data.withColumn("_key", X.composite_key(*(F.col(c) for c in keys)))
        keyed = keyed.withColumn("_fold", sampling.fold(F.col("_key"), folds))
        kinds = F.lit("") if task == "regression" else F.col(target).cast("string")
        there = keyed.groupBy("_fold").agg(F.collect_set(kinds).alias("c"), F.count_distinct("_key").alias("n")).collect()  # a row a fold, of a target's classes
        several = all(sum(x in r["c"] for r in there) > 1 for x in {x for r in there for x in r["c"]})
        keys = keys if len(there) == folds and min(r["n"] for r in there) > 1 and several else ()
    data = (keyed if keys else by_rows()).cache()
    classes = [r[0] for r in data.select(F.col(target).cast("string").alias("c")).distinct().orderBy("c").collect()] if task == "classification" else None

    counts = cut(TextSVD().counts(data, id_col, text).join(small(data.select(F.col(id_col).alias("id"), "_fold")), "id")) if text else None

    def with_text(fold: int) -> tuple[DataFrame, list[str]]:
        known = counts.where(F.col("_fold") != fold)
        try:
            model = TextSVD(TEXT_COLUMNS).fit_counts(known, data.where(F.col("_fold") != fold).count())
        except TooFewGrams:
            return data, []
        made, names = model.columns(data, id_col, text, counts=counts)
        return cut(made), names

    def predicted(train: DataFrame, test: DataFrame, out: str, numeric: Sequence[str], categorical: Sequence[str], complete: Sequence[str] = ()) -> DataFrame:
        if not numeric and not categorical and not complete:
            numeric, train, test = ["_one"], train.withColumn("_one", F.lit(1.0)), test.withColumn("_one", F.lit(1.0))
        return Trees(numeric, categorical, "forest" if task == "classification" else "boosted", task, trees=trees, depth=depth, complete=complete).fit(train, target).predict(test, out)

    def miss(out: str) -> Column:
        if task == "regression":
            return F.abs(F.col(out) - F.col(target))
        return scores.loss(F.array_position(F.array(*map(F.lit, classes)), F.col(target).cast("string")) - 1, F.col(out))

    def mean(frame: DataFrame, out: str) -> float:
        return frame.agg(F.avg(miss(out))).first()[0]

    rows = []
    for i in range(folds):
        split = lambda rows: (rows.where(F.col("_fold") != i), rows.where(F.col("_fold") == i))  # noqa: B023, E731
        first = predicted(*split(data), "_p", numeric, categorical)
        whole, made = with_text(i) if text else (data, [])
        train, test = split(whole)
        more = [*numeric, *extra_numeric], [*categorical, *extra_categorical], made
        if keys:
            both = predicted(train, first, "_q", *more).groupBy("_key").agg(F.count("*").alias("n"), F.sum(miss("_p")).alias("a"), F.sum(miss("_q")).alias("b"))
            rows.append((i, *both.agg(F.sum("a") / F.sum("n"), F.sum("b") / F.sum("n"), F.sum(F.col("a") - F.col("b")), F.sum(F.pow(F.col("a") - F.col("b"), 2.0))).first()))
        else:
            rows.append((i, mean(first, "_p"), mean(predicted(train, test, "_p", *more), "_p")))
    data.unpersist()
    return frame.sparkSession.createDataFrame(rows, "fold int, without double, with double" + (", gain double, gain2 double" if keys else ""))


def screen(frame: DataFrame, target: str, text: str, id_col: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), task: str | None = None, folds: int = 5, sample: int = 20_000) -> DataFrame:
    """One row: n_rows, scores without and with the text, contribution, wins, verdict."""
    data = sampling.capped(frame.where(F.col(target).isNotNull()), id_col, sample).withColumn("__text", X.clipped(F.col(text), TEXT_CHARS))
    out = scores.contribution(fold_scores(data, target, id_col, numeric, categorical, folds=folds, task=task, text="__text"), "without", "with")
    return out.withColumn("n_rows", F.lit(data.count()))


def score_column(frame: DataFrame, target: str, id_col: str, column: str, kind: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), folds: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """One row for a new column: contribution, wins, accepted. ``keys``: the columns that it is looked up by."""
    extra = {"extra_numeric": [column]} if kind == "numeric" else {"extra_categorical": [column]}
    return scores.contribution(fold_scores(frame, target, id_col, numeric, categorical, folds=folds, keys=keys, **extra), "without", "with").withColumn("column", F.lit(column))

"""Similar cases: numeric, vector and text similarity, the k nearest, and what they say."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import arrays as A
from ..functions import text as X
from ..sources.checkpoints import cut
from . import quantiles

#: Training rows that a task of a search holds at most.
REFERENCE_BLOCK = 32_768
#: Similarities that a task holds at a time.
HELD = 1 << 22
#: Reference sides up to this many rows are broadcast and compared in one pass.
BROADCAST_ROWS = 20_000


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if a count of at most rows + 1 shows it small; else the join's own strategy."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def standards(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median m_c and, after imputation, population deviation s_c (1 if 0) of each column."""
    middle = quantiles.medians(train, columns)
    medians = train.sparkSession.createDataFrame([tuple(middle[c] for c in columns)], ", ".join(f"`m_{c}` double" for c in columns))
    filled = train.join(F.broadcast(medians))
    spread = filled.agg(*(F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}"))).alias(f"s_{c}") for c in columns))
    spread = spread.select(*(F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0).alias(f"s_{c}") for c in columns))
    return medians.join(F.broadcast(spread))


def imputed(frame: DataFrame, columns: Sequence[str], known: DataFrame) -> DataFrame:
    """Nulls take the training median."""
    return frame.join(F.broadcast(known)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) for c in columns}).drop(*(x for c in columns for x in (f"m_{c}", f"s_{c}")))


def numeric_similarities(pairs: DataFrame, queries: DataFrame, train: DataFrame, id_col: str, columns: Sequence[str], weight: float = 0.15) -> DataFrame:
    """(id, train_id, similarity) of given pairs: -weight times the mean standardised distance."""
    known = standards(train, columns)
    q = imputed(queries.select(id_col, *columns), columns, known).select(F.col(id_col).alias("id"), F.array(*columns).alias("x"))
    t = imputed(train.select(id_col, *columns), columns, known).select(F.col(id_col).alias("train_id"), F.array(*columns).alias("y"))
    scale = known.select(F.array(*(F.col(f"s_{c}") for c in columns)).alias("s"))
    gap = A.total(F.zip_with(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), "s", lambda d, s: d / s)) / len(columns)
    return pairs.join(small(q), "id").join(small(t), "train_id").join(F.broadcast(scale)).select("id", "train_id", (-weight * gap).alias("similarity"))


def numeric_pairs(queries: DataFrame, train: DataFrame, id_col: str, columns: Sequence[str], weight: float = 0.15) -> DataFrame:
    """(id, train_id, similarity) of all pairs: -weight times the mean standardised distance.

    The training side must be small (it is broadcast); each query row streams past it.
    """
    known = standards(train, columns)
    q = imputed(queries.select(id_col, *columns), columns, known).select(F.col(id_col).alias("id"), F.array(*columns).alias("x"))
    t = imputed(train.select(id_col, *columns), columns, known).select(F.col(id_col).alias("train_id"), F.array(*columns).alias("y"))
    scale = known.select(F.array(*(F.col(f"s_{c}") for c in columns)).alias("s"))
    gap = A.total(F.zip_with(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), "s", lambda d, s: d / s)) / len(columns)
    return q.join(F.broadcast(scale)).join(small(t)).select("id", "train_id", (-weight * gap).alias("similarity"))


def best_of(k: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of queries (id, x) and references (train_id, y): the k best (id, train_id, similarity) of each query."""

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        r = r.sort_by("train_id")
        ids, others, values, picked = q.column("id"), r.column("train_id"), [], []
        if len(q) and len(r):
            x, y = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1) for t, c in ((q, "x"), (r, "y")))
            step = max(1, HELD // len(y))
            for a in range(0, len(x), step):
                held = measure(x[a : a + step], y)
                least = np.partition(held, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(held), -np.inf)
                for i, row in enumerate(held):
                    near = np.flatnonzero(row >= least[i])
                    near = near[np.argsort(-row[near], kind="stable")][:k]
                    picked.append((np.full(len(near), a + i), near))
                    values.append(row[near])
        own, other = (np.concatenate([p[i] for p in picked]) if picked else np.zeros(0, int) for i in (0, 1))
        return pa.table({"id": ids.take(pa.array(own)), "train_id": others.take(pa.array(other)), "similarity": np.concatenate(values) if values else np.zeros(0)})

    return best


def nearest_numeric(queries: DataFrame, train: DataFrame, id_col: str, columns: Sequence[str], k: int, weight: float = 0.15) -> DataFrame:
    """The k nearest training rows by -weight times the mean standardised distance, by an index of this one search."""
    from .neighbour_index import NeighbourIndex

    return NeighbourIndex(id_col, columns, weight=weight).fit(train).nearest(queries, k)


def nearest_vectors(queries: DataFrame, references: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """The k nearest references by cosine, rounded to 12 digits so that equal vectors tie."""
    from .neighbour_index import NeighbourIndex

    return NeighbourIndex(id_col, vector=vector).fit(references).nearest(queries, k)


def gram_counts(frame: DataFrame, id_col: str, text: Column, low: int = 2, high: int = 4) -> DataFrame:
    """(id, gram, n) of character n-grams; a word that repeats in a text is taken apart once."""
    words = frame.select(F.col(id_col).alias("id"), F.explode(X.ngram_words(text)).alias("word")).groupBy("id", "word").agg(F.count("*").alias("c"))
    return words.select("id", "c", F.explode(X.word_ngrams(F.col("word"), low, high)).alias("gram")).groupBy("id", "gram").agg(F.sum("c").alias("n"))


def gram_frequencies(frame: DataFrame, id_col: str, text: Column, low: int = 2, high: int = 4) -> DataFrame:
    """(gram, df): how many ids have each n-gram. A text's grams are told apart in its row, so only each task's sums are shuffled.

    Rows that repeat an id (null too) count as one; only their grams are shuffled by id.
    """
    rows = frame.select(F.col(id_col).alias("id"), text.alias("text"))
    again = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("again"))
    both = rows.join(small(cut(again)), F.col("id").eqNullSafe(F.col("again")), "left").withColumn("several", F.col("again").isNotNull() | F.col("id").isNull())
    grams = lambda f: f.select("id", F.explode(X.distinct_ngrams(X.ngram_words(F.col("text")), low, high)).alias("gram")).where(~F.contains("gram", F.lit("  ")))
    found = grams(both.where("not several")).select("gram").unionByName(grams(both.where("several")).distinct().select("gram"))
    return found.groupBy("gram").agg(F.count("*").alias("df"))


def idf(n_rows: int) -> Column:
    return F.log((1.0 + n_rows) / (1.0 + F.col("df"))) + 1.0


def gram_weights(counts: DataFrame, n_rows: int, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(gram, df, idf) of grams in at least ``min_df`` rows, the most frequent ``max_features`` (ties to the lesser gram); idf = ln((1 + n) / (1 + df)) + 1."""
    kept = counts.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= min_df)
    if max_features is not None:
        kept = kept.orderBy(F.desc("n"), "gram").limit(max_features)
    return kept.select("gram", "df", idf(n_rows).alias("idf"))


def sparse_vectors(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, gram, w): L2-normalised tf-idf. A norm is summed in the order of the grams, so that equal texts have equal weights to the last bit."""
    raw = counts.where("id is not null").join(weights, "gram").select("id", "gram", (F.col("n") * F.col("idf")).alias("w"))
    listed = raw.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gram", "w"))).alias("c"))
    normed = listed.withColumn("norm", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    return normed.select("id", "norm", F.inline("c")).select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def sparse_pairs(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(id, train_id, similarity) of pairs that share a gram: an inverted-index join, partial sums before the shuffle."""
    r = references.select(F.col("id").alias("train_id"), "gram", F.col("w").alias("v"))
    return queries.join(r, "gram").groupBy("id", "train_id").agg(F.sum(F.col("w") * F.col("v")).alias("similarity"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar of each id with their rank from 1; ties go to the lesser train_id."""
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("train_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def median_of(found: DataFrame, targets: DataFrame, id_col: str, target: str) -> DataFrame:
    """(id, prediction): median target of the neighbours."""
    return found.join(targets.select(F.col(id_col).alias("train_id"), F.col(target).alias("y")), "train_id").groupBy("id").agg(F.median("y").alias("prediction"))


def rates_of(found: DataFrame, targets: DataFrame, id_col: str, label: str, classes: Sequence) -> DataFrame:
    """(id, probabilities): share of the neighbours in each class, in the order of ``classes``."""
    joined = found.join(targets.select(F.col(id_col).alias("train_id"), F.col(label).alias("y")), "train_id")
    return joined.groupBy("id").agg(F.array(*(F.avg((F.col("y") == c).cast("double")) for c in classes)).alias("probabilities"))


def k_auto(n_references: int, n_labels: int) -> int:
    return max(1, min(5, n_references // max(1, n_labels)))


def votes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, score, first_rank): similarity, clipped at 0, summed over the neighbours of each label.

    ``labels`` has train_id and label.
    """
    return found.join(labels, "train_id").groupBy("id", "label").agg(F.sum(F.greatest(F.col("similarity"), F.lit(0.0))).alias("score"), F.min("rank").alias("first_rank"))


def elected(vote: DataFrame) -> DataFrame:
    """(id, value, confidence): the label of the highest score, the nearest on ties; confidence is its share of the best two."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("first_rank"))
    ranked = vote.withColumn("place", F.row_number().over(order)).where("place <= 2")
    one = ranked.groupBy("id").agg(F.max(F.when(F.col("place") == 1, F.col("label"))).alias("value"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("s1"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("s2"))
    return one.select("id", "value", F.when(F.col("s1") + F.col("s2") > 0, F.col("s1") / (F.col("s1") + F.col("s2"))).otherwise(0.0).alias("confidence"))


def require_features(text: str | None, numeric: Sequence[str]) -> None:
    if not text and not numeric:
        raise TesseraError("similar cases need a text column or a numeric one")

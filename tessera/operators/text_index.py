"""Exact k nearest texts by cosine, from an inverted index that skips the long lists.

A query's grams are weighted, so the most frequent of them together can add only so much to a similarity:
the sum of each weight times the largest weight in that gram's list, and no more than the norm of the query's
weights there times the largest norm of a reference. What is left of a query's grams once those that together stay
below its k-th best known similarity are set aside must be shared by every row that can still enter. So

1. each query meets short excerpts of its rarest grams' lists (the references of most weight), and the true
   similarities of the k best found there give the least similarity worth looking for;
2. only the lists of the grams that are not set aside are joined, and a pair whose sum there, with all that the others
   could add, stays below that is dropped;
3. the similarities of the rest are computed from all grams.

A query with fewer than k partners in step 1 joins all its lists. Results equal those of all pairs.

Equal vectors are one, on both sides: a search compares the different ones only, each under its least id. The k nearest rows
are among the k least ids of each of the k nearest of those, for ties go to the lesser id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..sources.checkpoints import Tables
from . import neighbours

#: Rows of a list's excerpt, and lists that a query looks into for its first partners.
EXCERPT, FIRST_LISTS = 32, 32
#: Partners that a search by two similarities asks each of its own for at first, at least.
FIRST_PARTNERS = 64


class TextIndex:
    """Sparse vectors (id, gram, w) of references, ready for any number of searches.

    Weights below 0 are refused, for a bound would not hold. A null id, gram or weight is left out; a vector
    without grams is near to nothing; rows that repeat (id, gram) add up.
    """

    def __init__(self, digits: int = 12):
        self.digits = digits

    def fit(self, vectors: DataFrame) -> TextIndex:
        self.tables = Tables(vectors.sparkSession)
        rows = vectors.select(F.col("id").alias("train_id"), "gram", F.col("w").alias("v")).where("train_id is not null and gram is not null and v is not null")
        summed = self.tables.cut(rows.groupBy("train_id", "gram").agg(F.sum("v").alias("v")))
        #: Every reference, and the least id of those that equal it.
        self.equal = self.tables.cut(least_of_equal(summed, "train_id", "v"))
        self.vectors = self.tables.cut(summed.join(self.equal.where("train_id = least").select("train_id"), "train_id", "left_semi"), summed)
        self.lists = self.tables.cut(self.vectors.groupBy("gram").agg(F.count("*").alias("df"), F.max("v").alias("top"), F.min("v").alias("low")))
        # Row numbers up to a bound are cut before the shuffle too, so a long list is in no task whole.
        order = Window.partitionBy("gram").orderBy(F.desc("v"), "train_id")
        self.excerpts = self.tables.cut(self.vectors.withColumn("n", F.row_number().over(order)).where(F.col("n") <= EXCERPT).drop("n"))
        self.norm = self.vectors.groupBy("train_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0.0))).first()[0]
        self.size = self.equal.where("train_id = least").count()
        if self.lists.where("low < 0").head(1):
            raise TesseraError("a text index takes no weights below 0")
        #: Rows of lists that the last search joined, and those that all its grams have.
        self.joined, self.all = 0, 0
        return self

    def similarities(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(id, train_id, similarity) of distinct pairs, from all their grams; pairs that share none are left out."""
        both = pairs.select("id", "train_id").join(self.equal, "train_id")
        found = self._similarities(both.select("id", F.col("least").alias("train_id")).distinct(), queries)
        return both.join(found.withColumnRenamed("train_id", "least"), ["id", "least"]).select("id", "train_id", "similarity")

    def _similarities(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """similarities() of the references that stand for their equals."""
        q = queries.select("id", "gram", "w")
        both = pairs.select("id", "train_id").join(q, "id").join(self.vectors, ["train_id", "gram"])
        return both.groupBy("id", "train_id").agg(F.round(F.sum(F.col("w") * F.col("v")), self.digits).alias("similarity"))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, train_id, similarity, rank) of the k most similar references that share a gram; ties go to the lesser train_id."""
        tables = Tables(queries.sparkSession)
        known = tables.cut(queries.where("id is not null and w is not null").groupBy("id", "gram").agg(F.sum("w").alias("w")))
        equal = tables.cut(least_of_equal(known, "id", "w"))
        found = self._nearest(known.join(equal.where("id = least").select("id"), "id", "left_semi"), k, tables)
        # Row numbers up to a bound are cut before the shuffle, so a vector with many equals is in no task whole.
        own = self.equal.withColumn("n", F.row_number().over(Window.partitionBy("least").orderBy("train_id"))).where(F.col("n") <= k).select("train_id", "least")
        rows = found.drop("rank").withColumnRenamed("train_id", "least").join(own, "least").drop("least")
        best = neighbours.nearest(rows, k).withColumnRenamed("id", "least")
        out = tables.cut(equal.join(best, "least").select("id", "train_id", "similarity", "rank"))
        tables.drop_others(out)
        return out

    def _nearest(self, known: DataFrame, k: int, tables: Tables) -> DataFrame:
        """nearest() among different vectors, each under its least id."""
        q = tables.cut(known.join(self.lists, "gram").select("id", "gram", "w", "df", "top"))
        if q.where("w < 0").head(1):
            raise TesseraError("a text index takes no weights below 0")
        if self.size <= k:  # every reference is wanted, so there is nothing to skip
            return tables.cut(neighbours.nearest(self._similarities(q.join(self.vectors, "gram").select("id", "train_id").distinct(), q), k))
        first = q.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("df", F.desc("w"), "gram"))).where(F.col("n") <= FIRST_LISTS)
        met = first.join(self.excerpts, "gram").groupBy("id", "train_id").agg(F.sum(F.col("w") * F.col("v")).alias("similarity"))
        begun = self._similarities(tables.cut(neighbours.nearest(met, k)), q)
        least = begun.groupBy("id").agg(F.count("*").alias("c"), F.min("similarity").alias("least")).where(F.col("c") >= k).select("id", "least")
        # A rounded similarity is less than another if it is less by one unit of the last digit.
        goal = F.coalesce(F.col("least"), F.lit(0.0)) - 10.0**-self.digits - 1e-9
        longest = Window.partitionBy("id").orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = F.least(F.sum(F.col("w") * F.col("top")).over(longest), F.sqrt(F.sum(F.col("w") * F.col("w")).over(longest)) * F.lit(self.norm))
        sized = q.withColumn("added", added).join(least, "id", "left").withColumn("goal", goal)
        sized = tables.cut(sized.withColumn("aside", F.col("added") < F.col("goal")))
        self.joined, self.all = sized.agg(F.coalesce(F.sum(F.when(~F.col("aside"), F.col("df"))), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
        rest = sized.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("aside"), F.col("added"))), F.lit(0.0)).alias("others"), F.first("goal").alias("goal"))
        summed = sized.where(~F.col("aside")).join(self.vectors, "gram").groupBy("id", "train_id").agg(F.sum(F.col("w") * F.col("v")).alias("part"))
        able = tables.cut(summed.join(rest, "id").where(F.col("part") + F.col("others") >= F.col("goal")))
        whole = able.where("others = 0").select("id", "train_id", F.round("part", self.digits).alias("similarity"))
        found = whole.unionByName(self._similarities(able.where("others > 0"), q))
        return tables.cut(neighbours.nearest(found, k))


def least_of_equal(vectors: DataFrame, id_col: str, weight: str) -> DataFrame:
    """(id, least): every id of sparse vectors (id, gram, weight), and the least one whose grams and weights are the same."""
    told = vectors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("gram", weight))).alias("c")).select(id_col, F.sha2(F.to_json("c"), 256).alias("c"))
    least = told.groupBy("c").agg(F.min(id_col).alias("least"))
    return told.join(least, "c").select(id_col, "least")


def nearest_together(queries: DataFrame, id_col: str, n_references: int, k: int, text, numbers, scores) -> DataFrame:
    """(id, train_id, similarity, rank) by a sum of two similarities, each with a search of its own, without all pairs.

    ``text(queries, m)`` and ``numbers(queries, m)`` give the m nearest by either, ``scores(pairs)`` the sum for pairs. A reference that neither found is
    no nearer than the last ones of both together; queries whose k-th sum does not exceed that ask for four times as many. A query that shares
    grams with fewer than m rows has text similarity 0 for all others.
    """
    tables, m, settled = Tables(queries.sparkSession), max(4 * k, FIRST_PARTNERS), []
    while True:
        a, b = tables.cut(text(queries, m)), tables.cut(numbers(queries, m))
        both = tables.cut(scores(a.select("id", "train_id").unionByName(b.select("id", "train_id")).distinct()))
        best = tables.cut(neighbours.nearest(both, k))
        if m >= n_references:
            settled.append(best)
            break
        last = lambda x, name: x.groupBy("id").agg(F.max(F.when(F.col("rank") == m, F.col("similarity"))).alias(name))  # noqa: E731, B023
        kth = best.groupBy("id").agg(F.max(F.when(F.col("rank") == k, F.col("similarity"))).alias("kth"))
        bound = kth.join(last(a, "ta"), "id", "left").join(last(b, "tb"), "id", "left")
        # Fewer than m by numbers: every reference was met.
        sure = tables.cut(bound.where("tb is null or kth > coalesce(ta, 0) + tb + 1e-9").select("id"))
        settled.append(tables.cut(best.join(sure, "id", "left_semi")))
        queries = tables.cut(queries.join(sure.withColumnRenamed("id", id_col), id_col, "left_anti"))
        tables.drop_others(queries, *settled)
        if not queries.head(1):
            break
        m *= 4
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    out = tables.cut(out)
    tables.drop_others(out)
    return out

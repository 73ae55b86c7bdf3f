"""A fitted index of training rows by numbers or vectors: exact nearest rows from the blocks that can hold one.

Rows are dealt to the nearest of a bounded number of pivots, rows of the table itself. For each block and each pivot the index knows
the least and the greatest distance. By the triangle inequality a block's rows are at least as far from a query as the
query's distance to any pivot is outside of the block's distances to it. A query first visits the blocks of the least bound that
hold k rows together; their k-th row gives a radius, and then it visits each other block whose bound is within it. All
others cannot hold a nearer row, nor an equally near one of a lesser id.

Numbers are compared by the mean standardised distance, vectors by the Euclidean distance of their directions, which orders
as the cosine does. What is fitted (medians, deviations, pivots, blocks) is kept for any number of searches, and may be saved. A
table of at most ``whole`` rows is one block, which each query visits. Hot blocks, those of equal rows for instance, are cut
into pieces of at most ``whole`` rows, and queries of a block into pieces of ``QUERY_ROWS``, so a task is always bounded.

One number has an order, so a larger table needs no blocks then: the k nearest rows are among the k least ids of each of the k + 1 next distinct
values on either side. Distinct values are dealt to ranges, each with so many values of its neighbours, and each distinct query is answered
once. Where values farther off may be as near, for rounding, a query goes to the blocks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import arrays as A
from ..sources.checkpoints import Tables
from . import neighbours
from .quantiles import medians

PIVOTS = 64
QUERY_ROWS = 8192
#: Most neighbours that are sought among next values.
NEXT_VALUES = 64
#: Slack of a bound, for rounding: relative, and absolute for directions, whose cosines are rounded to 12 digits.
NEAR, ROUNDED = 1e-9, 1e-5


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def next_values(k: int, weight: float, scale: float):
    """A function of distinct queries (x) and values (y, ids): the k nearest (x, train_id, similarity, rank), or rank 0 where values farther off may be as near."""

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by("y")
        xs, ys, lists = q.column("x").to_numpy(), v.column("y").to_numpy(), v.column("ids").combine_chunks()
        ids, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.empty(len(ids) + 1, np.int64)
        place[pc.sort_indices(ids).to_numpy()], place[-1] = np.arange(len(ids)), len(ids)
        # Rows of ``ids`` by value; the last one stands for none.
        held = np.where(np.arange(k) < sizes[:, None], (np.cumsum(sizes) - sizes)[:, None] + np.arange(k), len(ids))
        held = np.concatenate([held, np.full((1, k), len(ids))])
        out, step = [], max(1, neighbours.HELD // (k * (2 * k + 3)))
        for a in range(0, len(xs), step):
            x = xs[a : a + step]
            at = np.searchsorted(ys, x, "left")[:, None] + np.arange(-k - 1, k + 2)
            there = (at >= 0) & (at < len(ys))
            at = np.where(there, at, len(ys))
            near = np.where(there, -weight * (np.abs(x[:, None] - np.append(ys, 0.0)[at]) / scale), -np.inf)
            row = held[at].reshape(len(x), -1)
            each = np.where(row < len(ids), np.repeat(near, k, axis=1), -np.inf)
            first = np.lexsort((place[row], -each), axis=1)[:, :k]
            row, each = np.take_along_axis(row, first, 1), np.take_along_axis(each, first, 1)
            some = row < len(ids)
            outer = there[:, [0, -1]] & (near[:, [0, -1]] >= each[:, -1:])
            some &= ~outer.any(1)[:, None]
            i, rank = np.nonzero(some)
            out.append((x[i], row[some], each[some], rank + 1))
            lost = x[outer.any(1)]
            out.append((lost, np.full(len(lost), -1), np.zeros(len(lost)), np.zeros(len(lost), int)))
        x, row, near, rank = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((float, int, float, int)))
        return pa.table({"x": x, "train_id": ids.take(pa.array(row, mask=row < 0)), "similarity": near, "rank": rank.astype(np.int32)})

    return best


class NeighbourIndex:
    """``numeric`` columns, or one ``vector`` column."""

    def __init__(self, id_col: str, numeric: Sequence[str] = (), vector: str | None = None, weight: float = 0.15, pivots: int = PIVOTS, whole: int = neighbours.REFERENCE_BLOCK):
        if bool(numeric) == bool(vector):
            raise TesseraError("an index is over numeric columns or over one vector column")
        self.id_col, self.numeric, self.vector, self.weight = id_col, list(numeric), vector, weight
        self.most_pivots, self.whole = pivots, whole
        self.visited: dict[str, int] = {}

    def _rows(self, frame: DataFrame, name: str, x: str) -> DataFrame:
        """(name, x): ids and what is compared; rows without it take no part."""
        if self.vector:
            value: Column = A.normalised(F.col(self.vector)).cast("array<double>")
        else:
            value = F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(m)) for c, m in zip(self.numeric, self.medians, strict=True)))
        return frame.select(F.col(self.id_col).alias(name), value.alias(x)).where(F.col(x).isNotNull())

    def fit(self, train: DataFrame) -> NeighbourIndex:
        self.tables = Tables(train.sparkSession)
        if self.numeric:
            middle = medians(train, self.numeric)
            self.medians = [middle[c] if middle[c] is not None else 0.0 for c in self.numeric]
            filled = self._rows(train, "train_id", "y")
            spread = filled.agg(*(F.stddev_pop(F.get("y", F.lit(i))) for i in range(len(self.numeric)))).first()
            self.scale = [float(s) if s else 1.0 for s in spread]
        rows = self.tables.cut(self._rows(train, "train_id", "y"))
        self.size = rows.count()
        self.pivots = np.zeros((0, 0))
        if self.size > self.whole:
            count = min(self.most_pivots, 2 * math.ceil(self.size / self.whole))
            some = rows.orderBy(F.xxhash64("train_id"), "train_id").limit(count).collect()
            self.pivots = np.unique(np.array([r["y"] for r in some], float), axis=0)
        self._deal(rows)
        return self

    def _deal(self, rows: DataFrame) -> None:
        """Blocks of the rows, and their distances to the pivots."""
        if not len(self.pivots):
            self.blocks, self.n = rows.withColumn("block", F.lit(0)), np.array([self.size])
            self.low = self.high = np.zeros((1, 0))
            return
        pivots, apart, kind = self.pivots, self.distance, dict(rows.dtypes)["train_id"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = apart(matrix(batch.column("y")), pivots).argmin(1) if batch.num_rows else np.zeros(0, int)
                yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32))], ["train_id", "y", "block"])

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, low, high = np.zeros(len(pivots), np.int64), np.full((len(pivots),) * 2, np.inf), np.full((len(pivots),) * 2, -np.inf)
            for batch in batches:
                if batch.num_rows:
                    block, far = batch.column("block").to_numpy(), apart(matrix(batch.column("y")), pivots)
                    n += np.bincount(block, minlength=len(n))
                    np.minimum.at(low, block, far)
                    np.maximum.at(high, block, far)
            b, p = np.nonzero(np.isfinite(low))
            yield pa.record_batch([pa.array(b), pa.array(p), pa.array(low[b, p]), pa.array(high[b, p]), pa.array(np.where(p == 0, n[b], 0))], ["b", "p", "low", "high", "n"])

        self.blocks = self.tables.cut(rows.mapInArrow(deal, f"train_id {kind}, y array<double>, block int"), rows)
        sums = self.blocks.mapInArrow(reach, "b long, p long, low double, high double, n long").groupBy("b", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()  # pivots ** 2 rows
        self.n = np.zeros(len(pivots), np.int64)
        self.low, self.high = np.full((len(pivots),) * 2, np.inf), np.full((len(pivots),) * 2, -np.inf)
        b, p = sums["b"].to_numpy(), sums["p"].to_numpy()
        self.low[b, p], self.high[b, p] = sums["low"].to_numpy(), sums["high"].to_numpy()
        np.add.at(self.n, b, sums["n"].to_numpy())

    @property
    def distance(self):
        """A metric of two matrices of rows."""
        if self.vector:
            return lambda x, y: np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]))
        scale = self.scale

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            gap = np.zeros((len(x), len(y)))
            for d, s in enumerate(scale):
                gap += np.abs(x[:, d, None] - y[None, :, d]) / s
            return gap / len(scale)

        return apart

    @property
    def similarity(self):
        """Of two matrices of rows: the cosine to 12 digits, or less ``weight`` times the distance."""
        if self.vector:
            return lambda x, y: np.round(x @ y.T, 12)
        weight, apart = self.weight, self.distance
        return lambda x, y: -weight * apart(x, y)

    @property
    def radius(self):
        """Of similarities: no row of at least that similarity is farther."""
        if self.vector:
            return lambda s: np.sqrt(np.maximum(0, 2 - 2 * s)) + ROUNDED
        weight = self.weight
        return lambda s: np.where(np.isfinite(s), -s / weight, np.inf) if weight > 0 else np.full(len(s), np.inf)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, train_id, similarity, rank): the k most similar rows of each query; ties go to the lesser train_id."""
        tables = Tables(queries.sparkSession)
        rows = tables.cut(self._rows(queries, "id", "x"))
        if len(self.numeric) == 1 and self.size > self.whole and 0 < k <= NEXT_VALUES and self.weight > 0 and math.isfinite(self.scale[0]):
            return self._next_values(rows, k, tables)
        return self._search(rows, k, tables)

    def _next_values(self, rows: DataFrame, k: int, tables: Tables) -> DataFrame:
        """nearest() by one number."""
        kinds = dict(rows.dtypes)["id"], dict(self.blocks.dtypes)["train_id"]
        rows = tables.cut(rows.select("id", F.get("x", F.lit(0)).alias("x")), rows)
        sought = tables.cut(rows.select("x").distinct())
        # Row numbers up to a bound are cut before the shuffle too, so a frequent value is in no task whole.
        least = Window.partitionBy("y").orderBy("train_id")
        own = self.blocks.select("train_id", F.get("y", F.lit(0)).alias("y")).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k)
        values = tables.cut(own.groupBy("y").agg(F.array_sort(F.collect_list("train_id")).alias("ids")))
        n, asked = values.count(), sought.count()
        cells = math.ceil(max(n, asked) / QUERY_ROWS)
        starts = np.unique(values.agg(F.percentile_approx("y", [i / cells for i in range(1, cells)], 20 * cells)).first()[0]) if cells > 1 else np.zeros(0)
        wide = k + 1

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The first and last values that a task has in each range."""
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                y = np.sort(batch.column("y").to_numpy())
                at = np.searchsorted(starts, y, "right")
                for c in np.unique(at):
                    both = np.unique(np.concatenate([held.get(c, y[:0]), y[at == c]]))
                    held[c] = both if len(both) <= 2 * wide else np.concatenate([both[:wide], both[-wide:]])
            yield pa.record_batch([pa.array(np.concatenate([*held.values(), np.zeros(0)]))], ["y"])

        # Twice so many values a range and a task, then at most twice so many a range, which the driver takes.
        some = values.select("y").mapInArrow(ends, "y double").repartition(1).mapInArrow(ends, "y double") if len(starts) else values.limit(0).select("y")
        edge = np.sort(some.toArrow()["y"].to_numpy())
        below = np.searchsorted(edge, starts, "left")
        low = np.concatenate([[-np.inf], [edge[i - wide] if i >= wide else -np.inf for i in below]])
        high = np.concatenate([[edge[i + wide - 1] if i + wide <= len(edge) else np.inf for i in below], [np.inf]])

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column("y").to_numpy()
                first, last = np.searchsorted(high, y, "left"), np.searchsorted(low, y, "right") - 1
                times = last - first + 1
                at = np.repeat(np.arange(len(y)), times)
                yield pa.record_batch([batch.column("y").take(pa.array(at)), batch.column("ids").take(pa.array(at)), pa.array((np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first[at]).astype(np.int32))], ["y", "ids", "cell"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column("x"), pa.array(np.searchsorted(starts, batch.column("x").to_numpy(), "right").astype(np.int32))], ["x", "cell"])

        q = tables.cut(sought.mapInArrow(deal, "x double, cell int"))
        chunks = F.broadcast(q.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks")))  # a row a range
        q = q.join(chunks, "cell").select("x", "cell", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("chunk"))
        v = values.mapInArrow(reach, f"y double, ids array<{kinds[1]}>, cell int").join(chunks, "cell").select("y", "ids", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        best = next_values(k, self.weight, self.scale[0])
        found = tables.cut(q.groupBy("cell", "chunk").cogroup(v.groupBy("cell", "chunk")).applyInArrow(best, f"x double, train_id {kinds[1]}, similarity double, rank int"))
        out = rows.join(found.where("rank > 0"), "x").select("id", "train_id", "similarity", "rank")
        unsure = found.where("rank = 0").select("x")
        self.visited = {"queries": rows.count(), "blocks": len(starts) + 1, "visits": asked}
        if unsure.head(1):
            left = tables.cut(rows.join(unsure, "x", "left_semi").select("id", F.array("x").alias("x")))
            seen = self.visited
            out = out.unionByName(self._search(left, k, tables))
            self.visited = seen | {"visits": seen["visits"] + self.visited["visits"]}
        tables.drop(sought, values, q)
        return out

    def _search(self, rows: DataFrame, k: int, tables: Tables) -> DataFrame:
        """nearest() by the blocks."""
        self.visited = {"queries": rows.count(), "blocks": len(self.n), "visits": 0}
        if not len(self.pivots):
            self.visited["visits"] = self.visited["queries"]
            return neighbours.nearest(self._meet(rows.withColumn("block", F.lit(0)), k, tables), k)
        first = tables.cut(self._visits(rows.withColumn("least", F.lit(None).cast("double")), k))
        found = tables.cut(neighbours.nearest(self._meet(first, k, tables), k))
        # The k-th similarity, where there are k.
        least = found.where(F.col("rank") == k).select("id", F.col("similarity").alias("least"))
        second = tables.cut(self._visits(rows.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), k))
        self.visited["visits"] = first.count() + second.count()
        more = self._meet(second, k, tables)
        return neighbours.nearest(tables.cut(found.drop("rank").unionByName(more)), k)

    def _visits(self, rows: DataFrame, k: int) -> DataFrame:
        """(id, x, block): the blocks that hold k rows first, without ``least``; else the others within its radius."""
        pivots, apart, n, low, high, radius = self.pivots, self.distance, self.n, self.low, self.high, self.radius
        there = np.flatnonzero(n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = apart(matrix(batch.column("x")), pivots)
                bound = np.zeros((len(far), len(there)))
                for i, b in enumerate(there):
                    bound[:, i] = np.maximum((far - high[b]).max(1), (low[b] - far).max(1))
                order = np.lexsort((far[:, there], bound), axis=1)
                held = np.cumsum(n[there][order], axis=1)
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, held - n[there][order] < k, axis=1)
                least = batch.column("least").to_numpy(zero_copy_only=False)
                go = early if np.isnan(least).all() else ~early & (bound * (1 - NEAR) <= radius(least)[:, None])
                i, b = np.nonzero(go)
                at = pa.array(i)
                yield pa.record_batch([batch.column("id").take(at), batch.column("x").take(at), pa.array(there[b].astype(np.int32))], ["id", "x", "block"])

        return rows.select("id", "x", "least").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, x array<double>, block int")

    def _meet(self, visits: DataFrame, k: int, tables: Tables) -> DataFrame:
        """(id, train_id, similarity): the k best rows of each piece of a block that a query visits."""
        counted = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
        pieces = [(int(b), max(1, math.ceil(n / self.whole)), math.ceil(counted[b] / QUERY_ROWS)) for b, n in enumerate(self.n.tolist()) if b in counted]
        sizes = F.broadcast(visits.sparkSession.createDataFrame(pieces, "block int, parts int, chunks int"))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = visits.join(sizes, "block").select("id", "x", "block", dealt("id", "chunks").alias("chunk"), each("parts").alias("part"))
        r = self.blocks.join(sizes, "block").select("train_id", "y", "block", dealt("train_id", "parts").alias("part"), each("chunks").alias("chunk"))
        kinds = dict(visits.dtypes)["id"], dict(self.blocks.dtypes)["train_id"]
        best = neighbours.best_of(k, self.similarity)
        return q.groupBy("block", "part", "chunk").cogroup(r.groupBy("block", "part", "chunk")).applyInArrow(best, f"id {kinds[0]}, train_id {kinds[1]}, similarity double")

    def save(self, path: str) -> None:
        """The blocks as Parquet and all else as JSON, below ``path``."""
        self.blocks.write.mode("overwrite").partitionBy("block").parquet(f"{path}/blocks")
        state = {k: getattr(self, k) for k in ("id_col", "numeric", "vector", "weight", "most_pivots", "whole", "size")} | {k: getattr(self, k, None) for k in ("medians", "scale")}
        state |= {k: getattr(self, k).tolist() for k in ("pivots", "n", "low", "high")}
        self.blocks.sparkSession.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourIndex:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        out = cls(state["id_col"], state["numeric"], state["vector"], state["weight"], state["most_pivots"], state["whole"])
        out.size, out.medians, out.scale, out.tables = state["size"], state["medians"], state["scale"], Tables(spark)
        out.n = np.array(state["n"], np.int64)
        for k in ("pivots", "low", "high"):
            setattr(out, k, np.array(state[k], float).reshape(len(state[k]), -1) if state[k] else np.zeros((0, 0)))
        out.blocks = spark.read.parquet(f"{path}/blocks")
        return out

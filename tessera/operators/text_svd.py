"""Few dense columns of a text: the truncated singular value decomposition of sparse n-gram vectors.

Randomised subspace iteration: each pass over the rows sums A'(A Q) for a thin Q in the tasks, so that only
blocks of (grams x columns) leave them; the sums are Spark's. The number of grams is bounded by the fit, so what the
driver holds does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..sources.checkpoints import Tables
from . import neighbours

#: Rows that a task holds densely at a time, and tasks of a pass: each gives one block of sums.
HELD_ROWS, MOST_TASKS = 1024, 512


def dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, dense rows of length 1) of slices of a batch with ``j`` and ``w``, places and weights."""
    for a in range(0, batch.num_rows, HELD_ROWS):
        part = batch.slice(a, HELD_ROWS)
        j, w = part.column("j"), part.column("w")
        out = np.zeros((len(part), width))
        row = np.repeat(np.arange(len(part)), np.diff(j.offsets.to_numpy()))
        out[row, j.flatten().to_numpy()] = w.flatten().to_numpy()
        yield a, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.finfo(float).tiny)


class TooFewGrams(TesseraError):
    """No n-gram is in enough rows."""


class TextSVD:
    """tf-idf of character n-grams, reduced to ``components`` columns.

    Grams in fewer than ``min_df`` rows are left out, and of the others the ``max_features`` most frequent stay. Null and empty
    texts are zero vectors. A column's largest loading is positive. With fewer grams than components, there are as
    many columns as grams; a frame without any gram is refused.
    """

    def __init__(self, components: int = 64, max_features: int = 2000, min_df: int = 2, passes: int = 5, oversample: int = 10, low: int = 2, high: int = 4, seed: int = 0):
        self.components, self.max_features, self.min_df, self.passes = components, max_features, min_df, passes
        self.oversample, self.low, self.high, self.seed = oversample, low, high, seed

    def fit(self, frame: DataFrame, id_col: str, text: str) -> TextSVD:
        tables = Tables(frame.sparkSession)
        counts = tables.cut(self.counts(frame, id_col, text))
        self.fit_counts(counts, frame.count())
        tables.drop(counts)
        return self

    def counts(self, frame: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, gram, n): what fit_counts() and transform_counts() take. It depends on no other row, so folds can share it."""
        return neighbours.gram_counts(frame, id_col, F.col(text), self.low, self.high)

    def fit_counts(self, counts: DataFrame, n_rows: int) -> TextSVD:
        tables = Tables(counts.sparkSession)
        # Bounded by max_features.
        kept = neighbours.gram_weights(counts, n_rows, self.min_df, self.max_features).select("gram", "idf").orderBy("gram").collect()
        if not kept:
            raise TooFewGrams("no n-gram is frequent enough")
        self.grams = [(r["gram"], i, r["idf"]) for i, r in enumerate(kept)]
        rows = tables.cut(self._rows(counts))
        width = min(len(kept), self.components + self.oversample)
        q = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((len(kept), width)))[0]
        for _ in range(self.passes):
            z = self._product(rows, q)
            values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
            order = np.argsort(-values)[: self.components]
            loadings, self.singular = q @ turn[:, order], np.sqrt(np.maximum(values[order], 0))
            q = np.linalg.qr(z)[0]
        sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
        self.loadings = loadings * np.where(sign == 0, 1, sign)
        tables.drop(rows)
        return self

    def _rows(self, counts: DataFrame) -> DataFrame:
        """(id, j, w): places and tf-idf of each row's kept grams."""
        places = counts.sparkSession.createDataFrame(self.grams, "gram string, j int, idf double")
        raw = counts.join(F.broadcast(places), "gram").groupBy("id").agg(F.collect_list(F.struct("j", (F.col("n") * F.col("idf")).alias("w"))).alias("x"))
        return raw.select("id", F.col("x.j").alias("j"), F.col("x.w").alias("w"))

    def _product(self, rows: DataFrame, q: np.ndarray) -> np.ndarray:
        """A'(A q), summed in the tasks and then by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(q)
            for batch in batches:
                for _, x in dense(batch, len(q)):
                    total += x.T @ (x @ q)
            n = q.size
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(total.ravel())], ["cell", "v"])

        parts = rows.select("j", "w").coalesce(MOST_TASKS).mapInArrow(run, "cell int, v double")
        sums = parts.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # grams x columns
        out = np.zeros(q.size)
        out[sums.column("cell").to_numpy()] = sums.column("v").to_numpy()
        return out.reshape(q.shape)

    def transform(self, frame: DataFrame, id_col: str, text: str) -> DataFrame:
        """(id, x array<double>) of each row with a kept gram."""
        return self.transform_counts(self.counts(frame, id_col, text))

    def transform_counts(self, counts: DataFrame) -> DataFrame:
        rows, loadings = self._rows(counts), self.loadings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, x in dense(batch, len(loadings)):
                    out = x @ loadings
                    flat = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))
                    yield pa.record_batch([batch.column("id").slice(a, len(out)), flat], ["id", "x"])

        return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, x array<double>")

    def columns(self, frame: DataFrame, id_col: str, text: str, prefix: str = "_t", counts: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """The frame with a number column for each component, 0 where a row has no kept gram."""
        names = [f"{prefix}{i}" for i in range(self.loadings.shape[1])]
        made = self.transform_counts(self.counts(frame, id_col, text) if counts is None else counts).select(F.col("id").alias(id_col), *(F.col("x")[i].alias(c) for i, c in enumerate(names)))
        return frame.drop(*names).join(made, id_col, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names}), names

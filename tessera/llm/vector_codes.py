"""Product codes of vectors by Lloyd rounds with Elkan's pruning.

A vector becomes integers, floor(``SCALE`` * x), and is cut into ``PARTS`` equal parts. Each part position has a codebook of up
to ``ENTRIES`` entries that starts as that part of the first vectors by id. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the componentwise floored mean of its parts.

Beside its vector, a row keeps for each part the entry, an upper bound of the distance to it, and a lower bound of
the distance to every entry. When entries move, upper bounds grow and lower bounds shrink by the distance moved. An entry is
looked at only if neither its lower bound nor half its distance from the present entry is above the upper bound;
entries that are not looked at are strictly farther than the nearest one, so no tie is lost. What is looked at
is compared by integer distances. Bounds are rounded outwards: upper ones are float64 times 1 + 1e-12, lower ones
whole steps of one byte (1 byte an entry, 64 a part). A step is a 128th of the widest gap in the part's first codebook.

Each round is one pass that writes rows with their bounds as Parquet, and one that adds up parts by entry in each task: what
reaches the driver is ``PARTS * ENTRIES`` sums, whatever the number of vectors. Lost executors cost a new read of the last table.

Rows whose vector is null or has a null, NaN or infinite component are dropped. The dimension is that of the
least id; if it is no multiple of ``PARTS``, vectors are filled up with zeros. Vectors of another length, or with a
component so large that its squared distances would not fit a long, or all of them where the least id's is empty, stay in
the result with a null code and error and take no part in the codebooks. Rows that repeat an id, or have a null one, are coded one by one; as first entries they
come in order of id (null last), then of vector. Null labels count as one label; the sum of a label is null if it would not fit a
long. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
_OUT = 1 + 1e-12
_STATE = "vec_id long, label string, q array<long>, entry binary, upper binary, lower binary"


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, and all squared distances. Exact: in float64 only where every product fits 53 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * 4 * most**2 < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        far = ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    else:
        far = np.zeros((len(x), len(book)), np.int64)
        for i in range(x.shape[1]):
            far += (x[:, i, None] - book[None, :, i]) ** 2
    return far.argmin(1), far


def reassign(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, distances computed) of one part position after its bounds were shifted.

    ``lower`` has a float64 bound for each row and entry, ``upper`` one for each row's present entry.
    """
    gaps = np.sqrt(nearest_of_all(book, book)[1].astype(np.float64)) / _OUT / 2
    beside = gaps + np.where(np.eye(len(book), dtype=bool), np.inf, 0)
    # Rows nearer to their entry than half way to any other one keep it unseen.
    open_ = np.flatnonzero(upper >= beside.min(1, initial=np.inf)[entry])
    entry, upper, lower = entry.copy(), upper.copy(), lower.copy()
    if not len(open_):
        return entry, upper, lower, 0
    own = ((x[open_] - book[entry[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(own.astype(np.float64)) * _OUT
    look = (lower[open_] <= upper[open_, None]) & (gaps[entry[open_]] <= upper[open_, None])
    look[np.arange(len(open_)), entry[open_]] = True  # the present entry takes part, so ties go by index
    row, col = np.nonzero(look)
    far = ((x[open_[row]] - book[col]) ** 2).sum(1)
    lower[open_[row], col] = np.sqrt(far.astype(np.float64)) / _OUT
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(far, first)
    hit = np.flatnonzero(far == least[row])
    best = hit[np.append(True, row[hit][1:] != row[hit][:-1])]  # columns ascend in a row: the lowest index of a tie
    entry[open_] = col[best]
    upper[open_] = np.sqrt(least.astype(np.float64)) * _OUT
    return entry, upper, lower, len(col)


def steps_of(books: np.ndarray) -> np.ndarray:
    """The step of a part's one-byte lower bounds."""
    return np.array([max(1.0, float(np.sqrt(nearest_of_all(b, b)[1].max(initial=0))) / 128) for b in books])


def packed(lower: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.floor(lower / step), 0, 255).astype(np.uint8)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64, copy=False)


def blob(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def unblob(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), *shape)


def parts_of(x: np.ndarray, count: int) -> np.ndarray:
    return x.reshape(len(x), count, -1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, label_text, q) of the rows that are kept; components beyond a long become null."""
    v = F.col(vector_col)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * F.lit(float(SCALE))).cast("long"))
    return kept.where(F.col("v").isNotNull() & sound).select("vec_id", "label", F.transform("v", whole).alias("q"))


def first_books(rows: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """Codebooks (parts, entries, width) of the first rows, and the dimension before filling up."""
    first = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    least = rows.orderBy(*first).select("q").limit(1).collect()
    if not least:
        return np.zeros((parts, 0, 0), np.int64), 0
    size = len(least[0]["q"])
    got = rows.where(usable(size)).orderBy(*first).select("q").limit(entries).collect()
    x = np.array([r["q"] for r in got], np.int64).reshape(len(got), size)
    x = np.pad(x, ((0, 0), (0, -size % parts)))
    return np.ascontiguousarray(parts_of(x, parts).transpose(1, 0, 2)), size


def usable(size: int):
    """Whether a vector has the dimension, and components whose squared distances add up in a long."""
    most = int((2.0**62 / max(1, size)) ** 0.5 / 2)
    return (F.size("q") == size) & F.forall("q", lambda x: F.coalesce(F.abs(x) <= most, F.lit(False)))


class Coder:
    """Codebooks of one run, with the passes over its rows."""

    def __init__(self, books: np.ndarray, size: int):
        self.books, self.size, self.steps = books, size, steps_of(books)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def values(self, column: pa.Array) -> np.ndarray:
        x = np.pad(matrix(column, self.size), ((0, 0), (0, -self.size % self.shape[0])))
        return parts_of(x, self.shape[0])

    def start(self, rows: DataFrame) -> DataFrame:
        """First assignment: all distances, kept as bounds."""
        parts, entries, _ = self.shape
        books, steps, values = self.books, self.steps, self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = values(batch.column("q"))
                entry, upper, lower = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts)), np.zeros((len(x), parts, entries), np.uint8)
                for p in range(parts):
                    near, far = nearest_of_all(x[:, p], books[p])
                    root = np.sqrt(far.astype(np.float64))
                    entry[:, p], upper[:, p], lower[:, p] = near, root[np.arange(len(x)), near] * _OUT, packed(root / _OUT, steps[p])
                yield kept_batch(batch, entry, upper, lower)

        return rows.mapInArrow(run, _STATE)

    def step(self, state: DataFrame, moved_to: np.ndarray) -> DataFrame:
        """Bounds shifted by the movement of the entries, then a pruned assignment to the new ones."""
        parts, entries, _ = self.shape
        steps, values = self.steps, self.values
        shift = np.sqrt(((moved_to - self.books) ** 2).sum(2).astype(np.float64)) * _OUT

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = values(batch.column("q"))
                entry = unblob(batch.column("entry"), np.uint8, (parts,)).copy()
                upper = unblob(batch.column("upper"), np.float64, (parts,)).copy()
                lower = unblob(batch.column("lower"), np.uint8, (parts, entries)).copy()
                for p in range(parts):
                    at = entry[:, p].astype(np.int64)
                    near, high, low, _ = reassign(x[:, p], at, (upper[:, p] + shift[p][at]) * _OUT, np.maximum(0, lower[:, p] * steps[p] - shift[p]), moved_to[p])
                    entry[:, p], upper[:, p], lower[:, p] = near, high, packed(low, steps[p])
                yield kept_batch(batch, entry, upper, lower)

        return state.mapInArrow(run, _STATE)

    def moved(self, state: DataFrame) -> np.ndarray:
        """Floored means of the parts of each entry; entries without parts stay."""
        parts, entries, width = self.shape
        values = self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
            for batch in batches:
                x = values(batch.column("q"))
                place = (unblob(batch.column("entry"), np.uint8, (parts,)).astype(np.int64) + np.arange(parts) * entries).ravel()
                count += np.bincount(place, minlength=parts * entries)
                flat = x.reshape(-1, width)
                for i in range(width):
                    np.add.at(total[:, i], place, flat[:, i])
            used = np.flatnonzero(count)
            at = np.repeat(used, width)
            yield pa.record_batch([pa.array(at), pa.array(np.tile(np.arange(width), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], ["place", "i", "total", "n"])

        sums = state.select("q", "entry").mapInArrow(run, "place long, i long, total long, n long").groupBy("place", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = self.books.copy().reshape(parts * entries, width)
        for r in sums.collect():  # parts * entries * width rows at most
            new[r["place"], r["i"]] = r["total"] // r["n"]
        return new.reshape(self.shape)

    def finish(self, state: DataFrame) -> DataFrame:
        """(vec_id, label, code, error) of the last assignment."""
        parts = self.shape[0]
        books, values = self.books, self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = values(batch.column("q"))
                entry = unblob(batch.column("entry"), np.uint8, (parts,))
                error = sum(((x[:, p] - books[p][entry[:, p]]) ** 2).sum(1) for p in range(parts))
                yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([e.tobytes().hex() for e in entry], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def kept_batch(batch: pa.RecordBatch, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    """The rows of a batch with new bounds."""
    n = batch.num_rows
    return pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("q"), blob(entry), blob(upper.view(np.uint8).reshape(n, -1)), blob(lower.reshape(n, -1))], ["vec_id", "label", "q", "entry", "upper", "lower"])


def fit(rows: DataFrame, parts: int, entries: int, rounds: int, tables: Tables) -> tuple[Coder | None, DataFrame | None]:
    """The coder after all rounds, and the table of its rows assigned to the final entries; nothing without rows."""
    books, size = first_books(rows, parts, entries)
    if not size or not books.shape[1]:
        return None, None
    coder = Coder(books, size)
    state = tables.cut(coder.start(rows.where(usable(size))))
    for _ in range(rounds):
        new = coder.moved(state)
        state = tables.cut(coder.step(state, new), state)
        coder.books = new
    return coder, state


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row that is kept. ``entries`` is 256 at most."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    tables = Tables(vectors.sparkSession)
    rows = tables.cut(quantised(vectors, id_col, vector_col, label_col))
    coder, state = fit(rows, parts, entries, rounds, tables)
    nothing = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if coder is None:
        coded, name = nothing, digest(np.zeros(0))
    else:
        coded, name = tables.cut(coder.finish(state).unionByName(nothing.where(~usable(coder.size))), state, rows), digest(coder.books)
    sums = coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")).withColumnRenamed("label", "other")
    sums = maybe_broadcast(tables.cut(sums), 64)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("other")), "left").select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))

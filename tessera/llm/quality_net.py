"""Quality by random-indexing word vectors and a two-layer network with a calibrated temperature.

A text's tokens are runs of letters and digits (any byte above ASCII counts as a letter, case matters) and runs of one other
character that is no white space. Tokens are hashed into ``BUCKETS``. Each bucket has a fixed sparse random vector of ``WIDTH``
entries with ``NONZERO`` ones of +-1. Random indexing adds up, for each bucket, the vectors of the ``REACH`` tokens before and
after each of its occurrences, over every document of the corpus: integers, summed in each task before the shuffle, so what
reaches the driver is ``BUCKETS`` rows of ``WIDTH`` numbers whatever the corpus. A token's vector is its bucket's own random
vector beside the normalised, centred sum of its neighbours.

A text is pooled into the mean and the deviation of its tokens' vectors and the mean inner products, in either half, of the
vectors of tokens one and two apart. A network of one hidden layer of ``HIDDEN`` rectified units, written in numpy and fitted by Adam,
gives a logit; a temperature turns it into a probability. The temperature is fitted on a fifth of the sample to a network of
the other rows; the network that scores is then fitted to all of them. Labelled rows are sampled: at most ``PER_CLASS`` of each label, least hash of doc_id first,
each weighing as many rows as it stands for, so that probabilities follow the real shares of the labels. Only pooled vectors of
the sample reach the driver. Rows whose crc32(doc_id) mod 5 is 0 are never learned from.

Every text is scored whole. A text without tokens (null, empty, white space) scores 0. Of repeated doc_ids with a label, one
text (the least pooled vector) is learned from; ids with two different labels are not learned from. With labelled rows of
one class only, every other text scores that class (0 without any). Null ids count as held out. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import RAW_SEPARATORS, U64, hash_ranges, mix, raw, slices, strings
from .toxicity import held_out

BUCKETS = 1 << 14
WIDTH = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
PER_CLASS = 4000
ROUNDS = 800
RATE = 3e-3
DECAY = 1e-3
#: Standardised inputs are cut off at this size: a text of one repeated word is far out in some direction that no other text has.
LIMIT = 2.0
#: Bytes of text that are worked on at a time; tokens of a longer text are pooled in blocks.
SLICE_BYTES = 2 << 20
BLOCK = 1 << 17
_kinds = np.arange(256)
_kinds[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1
_kinds[RAW_SEPARATORS] = 0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and the first token of each row (rows + 1)."""
    data, at = raw(strings(column))
    kind = _kinds[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    found = hash_ranges(data, starts, ends)[0]
    return (found & U64(BUCKETS - 1)).astype(np.uint16), np.searchsorted(starts, at)


def index_vectors() -> np.ndarray:
    """The fixed random vector of each bucket, (BUCKETS, WIDTH) of -1, 0 and 1."""
    out = np.zeros((BUCKETS, WIDTH), np.int8)
    rows = np.arange(BUCKETS)
    for k in range(NONZERO):
        # Each nonzero entry has a block of places of its own, so that no two meet.
        draw = mix(rows.astype(U64) * U64(NONZERO) + U64(k + 1))
        place = k * (WIDTH // NONZERO) + (draw % U64(WIDTH // NONZERO)).astype(np.int64)
        out[rows, place] = np.where(draw >> U64(63), 1, -1)
    return out


def neighbour_sums(bucket: np.ndarray, bounds: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` the vectors of the tokens around each token of the same row."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for start in range(0, len(bucket), BLOCK):
        a, b = max(0, start - REACH), min(len(bucket), start + BLOCK + REACH)
        ids, rows = bucket[a:b], row[a:b]
        vectors = index[ids].astype(np.int16)
        around = np.zeros_like(vectors)
        for d in range(1, REACH + 1):
            same = (rows[d:] == rows[:-d])[:, None]
            around[d:] += vectors[:-d] * same
            around[:-d] += vectors[d:] * same
        mine = slice(start - a, min(start + BLOCK, len(bucket)) - a)
        ids, around = ids[mine], around[mine]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        total[ids[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)


def contexts(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sums of neighbours' vectors for each bucket, over every document: (BUCKETS, WIDTH)."""
    names = [f"c{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, WIDTH), np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                neighbour_sums(*tokens(part.column("text")), index, total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(used), *(pa.array(total[used, i]) for i in range(WIDTH))], ["bucket", *names])

    sums = documents.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((BUCKETS, WIDTH), np.int64)
    for r in sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():  # BUCKETS rows at most
        out[r[0]] = r[1:]
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """(BUCKETS, 2 * WIDTH): a bucket's own vector beside the direction of its neighbours, less the mean direction."""
    size = np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True))
    way = np.divide(sums, size, out=np.zeros(sums.shape), where=size > 0)
    seen = size[:, 0] > 0
    if seen.any():
        way[seen] -= way[seen].mean(0)
    return np.concatenate([index_vectors() / NONZERO**0.5, way], 1).astype(np.float32)


def pool(bucket: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and deviation of the tokens' vectors of each row, and how alike tokens 1 to ``REACH`` apart are; zeros for rows without tokens."""
    rows, n, width = len(bounds) - 1, np.diff(bounds), table.shape[1]
    total, square, alike = np.zeros((rows, width)), np.zeros((rows, width)), np.zeros((rows, 2 * REACH))
    row = np.repeat(np.arange(rows), n)
    for start in range(0, len(bucket), BLOCK):
        # The first tokens of the next block are there to be compared with only.
        size, where = min(BLOCK, len(bucket) - start), row[start : start + BLOCK + REACH]
        wide = table[bucket[start : start + BLOCK + REACH]]
        vectors = wide[:size]
        first = np.flatnonzero(np.append(True, where[1:size] != where[: size - 1]))
        at = where[first]
        total[at] += np.add.reduceat(vectors, first, axis=0, dtype=np.float64)
        square[at] += np.add.reduceat(vectors * vectors, first, axis=0, dtype=np.float64)
        for d in range(1, REACH + 1):
            m = min(size, len(wide) - d)
            for half, part in enumerate((slice(0, width // 2), slice(width // 2, width))):
                near = np.zeros(size)
                near[:m] = np.einsum("ij,ij->i", wide[:m, part], wide[d : d + m, part]) * (where[:m] == where[d : d + m])
                alike[at, 2 * d - 2 + half] += np.add.reduceat(near, first)
    size = np.maximum(n, 1)[:, None]
    mean = total / size
    return np.concatenate([mean, np.sqrt(np.maximum(0, square / size - mean**2)), alike / size], 1)


@dataclass
class Net:
    """Standardised inputs, one hidden layer, a logit, and the temperature that divides it."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -LIMIT, LIMIT)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(self.inputs(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def fit_net(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, hidden: int = HIDDEN) -> Net:
    """Adam on the weighted log loss of all rows, with weight decay."""
    rng = np.random.default_rng(1)
    scale = x.std(0)
    net = Net(x.mean(0), np.where(scale > 1e-9, scale, 1), rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = net.inputs(x)
    share = weight / weight.sum()
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, rounds + 1):
        inner = z @ values[0] + values[1]
        h = np.maximum(inner, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ values[2] + values[3][0], -500, 500)))
        slope = (p - y) * share
        back = np.outer(slope, values[2]) * (inner > 0)
        slopes = [z.T @ back + DECAY * values[0], back.sum(0), h.T @ slope + DECAY * values[2], np.array([slope.sum()])]
        for v, s, m, q in zip(values, slopes, first, second, strict=True):
            m += 0.1 * (s - m)
            q += 0.001 * (s * s - q)
            v -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    return net


def log_loss(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum() / weight.sum())


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits, from 1 to 16, of the least log loss, by golden section over its logarithm, where the loss has one dip.

    It is not under 1: rows that are told apart without error would ask for ever smaller ones.
    """
    low, high, part = 0.0, np.log(16.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        if log_loss(logit / np.exp(a), y, weight) <= log_loss(logit / np.exp(b), y, weight):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Net | float:
    """The calibrated network; with one class only, that class. Every fifth row of a class calibrates a network of the others."""
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    place = np.zeros(len(y), np.int64)
    for side in (0, 1):
        mine = y == side
        place[mine] = np.arange(mine.sum())
    aside = place % 5 == 4
    if len(set(y[aside].tolist())) < 2:
        return fit_net(x, y, weight)  # too few rows to calibrate with
    part = fit_net(x[~aside], y[~aside], weight[~aside])
    net = fit_net(x, y, weight)
    net.temperature = temperature(part.logit(x[aside]), y[aside], weight[aside])
    return net


@dataclass
class Model:
    table: np.ndarray
    net: Net | float


def pooled(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, y, f): the pooled vector of each row of (doc_id, text, y)."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                f = pool(*tokens(part.column("text")), shared.value)
                lists = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * np.int32(f.shape[1]), f.ravel())
                yield pa.record_batch([part.column("doc_id"), part.column("y"), lists], ["doc_id", "y", "f"])

    return documents.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f array<double>")


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Word vectors of the whole corpus, and a network fitted to a bounded sample of the labelled rows that are not held out."""
    table = word_vectors(contexts(documents, text_col))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", "y")
    usable = known.join(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sides = [usable.where(F.col("y") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for side in (0, 1)]
    sample = docs.join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id")  # 2 x per_class rows
    rows = pooled(sample, table).groupBy("doc_id").agg(F.first("y").alias("y"), F.min("f").alias("f")).collect()
    rows.sort(key=lambda r: r["doc_id"])  # the same rows give the same network
    y = np.array([r["y"] for r in rows], np.int64)
    weight = np.array([counts[side] / max(1, (y == side).sum()) for side in y.tolist()])
    return Model(table, fit(np.array([r["f"] for r in rows]), y, weight))


def score(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                bucket, bounds = tokens(part.column("text"))
                value = np.full(part.num_rows, model.net) if isinstance(model.net, float) else model.net.probability(pool(bucket, bounds, model.table))
                value = np.round(np.where(np.diff(bounds) > 0, value, 0.0), 9)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

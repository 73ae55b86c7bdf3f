"""Toxic spans by a linear-chain conditional random field.

Each token is clean or toxic. A token's features are its word and its prefixes of 3 to 6 bytes (ASCII
letters lower-cased), hashed into ``BUCKETS`` weights; a 2 x 2 transition table links neighbours.
Forward-backward gives each token's marginal; a text's score is a logistic function of the sum of cubes
and the largest of its marginals, and runs of tokens with a marginal of 0.5 or more are its toxic spans.

Labels are of documents, so tokens are labelled first: in toxic texts of the sample, a token is toxic if
one of its features stands between many different neighbours in toxic texts (copies of a passage
count once) and next to never in clean ones. The field is then fitted to these labelled tokens by
AdaGrad on the exact likelihood gradient. The sample is bounded: ``PER_CLASS`` texts of each class of
at most ``SAMPLE_CHARS`` characters, least hash of doc_id first. Only labels are read from it; language,
source and doc_id are no features.

Scoring reads every text whole. Null and empty texts score like a text of clean tokens only. Without a
labelled row of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import PLAIN_SEPARATORS, U64, Words, hash_ranges, mix, slices, strings, words

BUCKETS = 1 << 18
PER_CLASS = 1000
SAMPLE_CHARS = 10_000
SLICE_BYTES = 8 << 20
PREFIXES = (3, 4, 5, 6)
FOLDS, HELD_OUT = 5, 0
MIN_CONTEXTS, MIN_ODDS = 8, 30.0
SPANS = "array<struct<start: long, stop: long, probability: double>>"
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def tokens(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words and their feature buckets: word, prefixes, and bucket 0, which all tokens share."""
    w = words(strings(column), PLAIN_SEPARATORS, hashed=False)
    ends = [w.ends, *(np.minimum(w.starts + k, w.ends) for k in PREFIXES)]
    found = hash_ranges(_fold[w.data], w.starts, *ends)
    w.hashes = found[0]
    buckets = [(mix(h ^ U64(i + 1)) & U64(BUCKETS - 1)).astype(np.int64) for i, h in enumerate(found)]
    return w, np.stack([*buckets, np.zeros(len(w.starts), np.int64)], 1)


@dataclass
class Field:
    """Weights of the toxic state against the clean one; transitions of clean to clean are 0."""

    weights: np.ndarray
    chain: np.ndarray  # start, clean to toxic, toxic to clean, toxic to toxic
    link: np.ndarray  # intercept, log1p of the sum of cubed marginals, largest marginal

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].astype(np.float64)
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return np.exp(np.clip(out, -30, 30))

    def marginals(self, e: np.ndarray, bounds: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Probability of the toxic state of each token; e are exponentials of emissions.

        Rows of similar length run side by side, one step of the chain at a time; ``pairs`` gets the
        expected number of starts in, and transitions to and from, the toxic state.
        """
        start, enter, leave, stay = np.exp(self.chain)
        n = np.diff(bounds)
        out = np.zeros(len(e))
        size = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 1))), -1).astype(int)
        for s in np.unique(size[size >= 0]):
            rows = np.flatnonzero(size == s)
            rows = rows[np.argsort(-n[rows], kind="stable")]
            steps, first = int(n[rows[0]]), bounds[rows]
            live = np.searchsorted(-n[rows], -np.arange(1, steps + 1), side="right")  # rows with a token at each step
            ahead, back = np.zeros((steps, len(rows))), np.ones((steps + 1, len(rows)))
            at = np.minimum(first[None, :] + np.arange(steps)[:, None], len(e) - 1)
            x = e[at]
            r = start * x[0]
            ahead[0] = r
            for t in range(1, steps):
                m = live[t]
                r = r[:m]
                r = np.minimum(x[t, :m] * (enter + stay * r) / (1 + leave * r), 1e30)
                ahead[t, :m] = r
            for t in range(steps - 2, -1, -1):
                m = live[t + 1]
                q = x[t + 1, :m] * back[t + 1, :m]
                back[t, :m] = (leave + stay * q) / (1 + enter * q)
            there = np.arange(steps)[:, None] < n[rows][None, :]
            odds = ahead * back[:steps]
            out[at[there]] = (odds / (1 + odds))[there]
            if pairs is not None:
                pairs[0] += (odds[0] / (1 + odds[0])).sum()
                if steps > 1:
                    q = x[1:] * back[1:steps]
                    r = ahead[:-1]
                    a, b, c = enter * q, leave * r, stay * r * q
                    total, inside = 1 + a + b + c, there[1:]
                    for i, y in enumerate((a, b, c)):
                        pairs[i + 1] += (y / total)[inside].sum()
        return out

    def score(self, total: np.ndarray, largest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.link[0] + self.link[1] * np.log1p(total) + self.link[2] * largest)))


def toxic_features(w: Words, features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which buckets mark toxic tokens, by the number of different (bucket, neighbours) in each class."""
    row = w.row_of()
    near = np.zeros((len(row), 2), U64)
    near[1:, 0] = np.where(row[1:] == row[:-1], w.hashes[:-1], U64(0))
    near[:-1, 1] = np.where(row[1:] == row[:-1], w.hashes[1:], U64(0))
    context = mix(near[:, 0] ^ mix(near[:, 1] + U64(1)))
    counts = []
    for side in (1, 0):
        mine = label[row] == side
        got = np.zeros(BUCKETS, np.int64)
        for k in range(features.shape[1]):
            # As many bits of the context as fit beside the bucket tell contexts apart.
            key = np.unique((features[mine, k].astype(U64) << U64(46)) | (context[mine] >> U64(18)))
            got += np.bincount((key >> U64(46)).astype(np.int64), minlength=BUCKETS)
        counts.append(got)
    toxic, clean = counts
    n1, n0 = max(1, int((label[row] == 1).sum())), max(1, int((label[row] == 0).sum()))
    return (toxic >= MIN_CONTEXTS) & ((toxic / n1) >= MIN_ODDS * ((clean + 0.5) / n0))


def fit(texts: list[str], labels: list[int], rounds: int = 30, rate: float = 0.5, decay: float = 1e-6) -> Field:
    """Labels tokens, fits the field to them, and the document link to the labels."""
    field = Field(np.zeros(BUCKETS), np.array([-4.0, -4.0, 0.0, 0.0]), np.array([-50.0, 0.0, 0.0]))
    field.weights[0] = -3.0  # a word never seen is clean until its neighbours say otherwise
    label = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return field
    w, features = tokens(pa.array(texts, pa.large_string()))
    row = w.row_of()
    marks = toxic_features(w, features, label)
    y = (marks[features].any(axis=1) & (label[row] == 1)).astype(np.float64)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    first = w.bounds[:-1][np.diff(w.bounds) > 0]
    seen = np.array([y[first].sum(), (y[inner] * (1 - y[inner - 1])).sum(), ((1 - y[inner]) * y[inner - 1]).sum(), (y[inner] * y[inner - 1]).sum()])
    used, place = np.unique(features, return_inverse=True)
    place = place.reshape(features.shape)
    square, chain_square = np.full(len(used), 1e-6), np.full(4, 1e-6)
    for _ in range(rounds):
        expected = np.zeros(4)
        p = field.marginals(field.emissions(features), w.bounds, expected)
        slope = np.zeros(len(used))
        for k in range(features.shape[1]):
            slope += np.bincount(place[:, k], weights=y - p, minlength=len(used))
        slope -= decay * len(y) * field.weights[used]
        square += slope**2
        field.weights[used] += rate * slope / np.sqrt(square)
        chain_slope = seen - expected
        chain_square += chain_slope**2
        field.chain += rate * chain_slope / np.sqrt(chain_square)
    total, largest = summary(field.marginals(field.emissions(features), w.bounds), w.bounds)
    # Newton steps of a ridge logistic regression, both classes weighing the same.
    x = np.stack([np.ones(len(label)), np.log1p(total), largest], 1)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * len(label) ** 0.5
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T * (weight * p * (1 - p) + 1e-9) @ x + ridge, x.T @ (weight * (label - p)) - ridge @ beta)
    field.link = beta
    field.weights = field.weights.astype(np.float32)
    return field


def summary(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of cubes and maximum of each row, 0 for rows without tokens: many faint tokens make no toxic text."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    total, largest = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    if len(full):
        total[full] = np.add.reduceat(p**3, bounds[full])
        largest[full] = np.maximum.reduceat(p, bounds[full])
    return total, largest


def held_out(doc_id):
    """Whether crc32 of the id as text leaves the remainder that is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS) -> Field:
    """A field fitted to a bounded sample of the labelled rows that are not held out."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    short = documents.where(F.char_length("text") <= chars).select("doc_id").distinct()
    usable = known.join(short, "doc_id", "left_semi")
    sides = [usable.where(F.col("y") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for side in (0, 1)]
    sample = F.broadcast(sides[0].unionByName(sides[1]))  # 2 x per_class rows
    texts = documents.select("doc_id", "text").join(sample, "doc_id").where(F.char_length("text") <= chars)
    # Sorted, so that the same rows give the same field.
    rows = sorted((r["doc_id"], r["text"], r["y"]) for r in texts.limit(4 * per_class).collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; span offsets count code points."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                w, features = tokens(part.column("text"))
                p = field.marginals(field.emissions(features), w.bounds)
                value = np.round(field.score(*summary(p, w.bounds)), 9)
                spans: list[list[dict]] = [[] for _ in range(w.rows)]
                hot = np.flatnonzero(p >= 0.5)
                if len(hot):
                    points = np.zeros(len(w.data) + 1, np.int32)
                    np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
                    row = np.searchsorted(w.bounds, hot, side="right") - 1
                    lengths = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
                    origin = np.cumsum(lengths) - lengths
                    new = np.append(True, (hot[1:] != hot[:-1] + 1) | (row[1:] != row[:-1]))
                    group = np.flatnonzero(new)
                    for a, b in zip(group.tolist(), np.append(group[1:], len(hot)).tolist(), strict=True):
                        r, base = int(row[a]), int(points[origin[row[a]]])
                        spans[r].append({"start": int(points[w.starts[hot[a]]]) - base, "stop": int(points[w.ends[hot[b - 1]]]) - base, "probability": float(np.round(p[hot[a:b]].max(), 6))})
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])))], ["doc_id", "held_out", "score", "predicted", "spans"])

    ids = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, spans {SPANS}")

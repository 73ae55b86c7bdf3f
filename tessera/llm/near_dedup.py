"""Near-duplicate groups by ProbMinHash.

A text's features are its five-word shingles, weighted by their occurrences. Each shingle runs a
Poisson process of its weight as rate: arrivals come at exponential gaps, each lands in one of
``REGISTERS`` registers, and a register keeps the shingle that arrived first. A shingle stops as soon
as its next arrival is later than every register's first one. Two texts agree in a register with
probability J_P, the probability Jaccard similarity of their weighted shingles. ``BANDS`` bands of
registers give the buckets that texts must share to be compared; linking.py compares them without
all pairs of a bucket; and a link counts only if J_P computed from the shingles themselves is 0.8 or
more. At that similarity 20 bands of 5 registers miss one pair in 3000, and above it fewer.

Texts of equal shingles form a class at once, so that any number of copies costs one node. The
result has a row for each input row: doc_id, class_id (the least doc_id of the group), class_size.
Null and empty texts have no shingles and form one class, as copies of each other. Rows of a null
doc_id have a null class; rows that repeat a doc_id are one document, linked to what any of
its texts is linked to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster_io import Tables, maybe_broadcast
from .linking import components, link, packed
from .text_arrays import U64, mix, shingles, signed, slices, strings, words

BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Pairs whose registers agree in less than this share are not worth an exact look: at a similarity
#: of 0.8 that is six standard errors below the mean.
ESTIMATE = 0.56
SKETCH = "doc_id long, h1 long, h2 long, sketch binary"
_C2, _C3 = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def weighted(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in ascending order, their weights, and the rows' bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h)))
    return h[first], weight, np.searchsorted(row[first], np.arange(len(bounds)))


def sketches(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The (rows, m) register contents; rows without features keep zeros."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    first, content = np.full((rows, m), np.inf), np.zeros((rows, m), U64)
    flat, names = first.ravel(), content.ravel()
    rate, time, i = weight.astype(np.float64), np.zeros(len(h)), 0
    while len(h):
        i += 1
        seed = mix(h + U64(i * 0xD6E8FEB86659FD93 & 2**64 - 1))
        # Uniform in (0, 1]: the gap of a Poisson process of this rate.
        time = time - np.log(((seed >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        place = row * m + (mix(seed ^ _C2) % U64(m)).astype(np.int64)
        sooner = np.flatnonzero(time < flat[place])
        np.minimum.at(flat, place[sooner], time[sooner])
        won = sooner[time[sooner] == flat[place[sooner]]]
        names[place[won]] = h[won]
        go = time < first.max(axis=1)[row]
        h, row, rate, time = h[go], row[go], rate[go], time[go]
    return content


def similarity(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """Probability Jaccard of two ascending arrays of distinct shingles with weights.

    The sum over common d of 1 / sum over all e of max(n_e / n_d, m_e / m_d); common shingles of the
    same two weights share a term, so there are few of them.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 1.0 if not len(a) and not len(b) else 0.0
    x, y = n[i].astype(float), m[j].astype(float)
    if (x == 1).all() and (y == 1).all() and (n == 1).all() and (m == 1).all():
        return len(i) / (len(a) + len(b) - len(i))
    alone_a, alone_b = n.sum() - x.sum(), m.sum() - y.sum()
    pairs, many = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
    return float(sum(c / (np.maximum(pairs[:, 0] / p, pairs[:, 1] / q) @ many + alone_a / p + alone_b / q) for (p, q), c in zip(pairs, many, strict=True)))


def _fold(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """Order-free 64-bit hash of each row's weighted shingles."""
    terms = np.zeros(len(h) + 1, U64)
    np.cumsum(mix((h ^ U64(seed)) + weight.astype(U64) * _C3), out=terms[1:])
    return signed(mix((terms[bounds[1:]] - terms[bounds[:-1]]) ^ U64(seed)))


def shingle_rows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return weighted(*shingles(words(strings(part.column("text"), lower=True))))


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            h, weight, bounds = shingle_rows(part)
            got = (sketches(h, weight, bounds) >> U64(32)).astype(np.uint32)
            yield pa.record_batch([part.column("doc_id"), pa.array(_fold(h, weight, bounds, 0x1234567)), pa.array(_fold(h, weight, bounds, 0x89ABCDEF)), pa.array([x.tobytes() if n else None for x, n in zip(got, np.diff(bounds), strict=True)], pa.binary())], ["doc_id", "h1", "h2", "sketch"])


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of each sketch."""
    for batch in batches:
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(U64)
        key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(U64)), sketches.shape[:2])
        for r in range(ROWS):
            key = mix(key ^ sketches[:, :, r])
        nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
        yield pa.record_batch([pa.array(signed(np.ascontiguousarray(key)).ravel()), pa.array(nodes)], ["key", "node"])


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles and weights of each text, packed."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, weight, bounds = shingle_rows(part)
            weight = weight.astype(np.uint32)
            blobs = [h[a:b].tobytes() + (weight[a:b].tobytes() if (weight[a:b] != 1).any() else b"") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([part.column("node"), pa.array([b - a for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int32()), pa.array(blobs, pa.binary())], ["node", "n", "blob"])


def _unpack(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob, U64, n), np.frombuffer(blob, np.uint32, n, 8 * n) if len(blob) > 8 * n else np.ones(n, np.uint32)


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(x).to_pylist() for x in ("a", "b", "na", "nb", "xa", "xb")]
        keep = [(a, b) for a, b, na, nb, xa, xb in zip(*cols, strict=True) if similarity(*_unpack(na, xa), *_unpack(nb, xb)) >= SIMILARITY - 1e-12]
        yield pa.record_batch([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], ["a", "b"])


def weights_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct shingle of each text: its weight, and the text's hash, its total, and whether all its weights are one."""
    for batch in batches:
        for part in slices(batch, "text"):
            h, weight, bounds = shingle_rows(part)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            total = np.bincount(row, weight, len(n)).astype(np.int64)
            yield pa.record_batch([part.column("node").take(pa.array(row)), part.column("comp").take(pa.array(row)), pa.array(_fold(h, weight, bounds, 0x1234567)[row]), pa.array(signed(h)), pa.array(weight.astype(np.int64)), pa.array(total[row]), pa.array((total == n)[row])], ["node", "comp", "own", "shingle", "weight", "total", "plain"])


def prefix_pairs(texts: DataFrame, tables: Tables, *spent: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different groups among ``texts`` (node, comp, text), with all of J_P of ``SIMILARITY`` or more.

    If u and v are the shares of two texts' weight on shingles that the other lacks, J_P is at most
    1 / (1 / (1 - u) + 1 / (1 - v) - 1), and just that where all weights are one. Shingles are put in one order, the rarest among
    these texts first. What stands before the first common shingle of two texts is in one of them only, so its shares
    bound u and v from below: two texts are paired by a shingle only if the bound of what is before it reaches the similarity.
    Where all weights of both are one, the common shingles are as many in either, so the lesser of what is left bounds both.
    So texts that have a long passage in common and more than a fifth of their own do not meet, however many they are.
    """
    rows = texts.mapInArrow(weights_of, "node long, comp long, own long, shingle long, weight long, total long, plain boolean")
    common = tables.cut(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    # Shingles of one text alone come first of all; what is left of its weight is theirs.
    after = Window.partitionBy("node", "own").orderBy(F.desc("n"), "shingle")
    left = rows.join(common, "shingle").withColumn("share", F.sum("weight").over(after) / F.col("total"))
    heads = tables.cut(left.where(F.col("share") >= SIMILARITY - 1e-9).select("shingle", "node", "comp", "share", "total", "plain"), common, *spent)
    x, y = (heads.select("shingle", F.col("node").alias(at), *(F.col(c).alias(f"{c[0]}{at}") for c in ("comp", "share", "total", "plain"))) for at in ("a", "b"))
    common = F.least(F.col("sa") * F.col("ta"), F.col("sb") * F.col("tb")) >= (F.col("ta") + F.col("tb")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6
    bound = (1 / F.col("sa") + 1 / F.col("sb") <= 1 + 1 / SIMILARITY + 1e-9) & (~(F.col("pa") & F.col("pb")) | common)
    return tables.cut(x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & bound).select("a", "b").distinct(), heads)


def agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint32).reshape(-1, REGISTERS) for x in ("sa", "sb"))
        share = (a == b).mean(axis=1)
        keep = pa.array(share >= least)
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share).filter(keep)], ["a", "b", "share"])


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", estimate: float = ESTIMATE) -> DataFrame:
    """(doc_id, class_id, class_size) for each row of ``documents``.

    ``estimate`` is the share of agreeing registers from which on a pair that shares a bucket is looked at exactly; 0: all are.
    """
    tables = Tables(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = tables.cut(docs.where("doc_id is not null").mapInArrow(sketch, SKETCH))
    # Only texts of equal shingles need a look at their hashes' group.
    copies = tables.cut(made.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n"))
    member = made.join(maybe_broadcast(copies, 32), ["h1", "h2"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    own = member.where("doc_id = node and sketch is not null")
    repeated = tables.cut(own.groupBy("node").count().where("count > 1").drop("count"))
    several = bool(repeated.head(1))
    if several:
        key = ["node", "h1", "h2"]
        own = own.join(repeated, "node", "left_anti").select(*key, "sketch").unionByName(own.join(repeated, "node", "left_semi").select(*key, "sketch").dropDuplicates(key))
    own = tables.cut(own.select("node", "sketch"), repeated)
    same = tables.cut(member.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")), made, copies)
    buckets, drawn = packed(own, band_keys, BANDS), maybe_broadcast(own, 4 * REGISTERS + 48)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(drawn.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(drawn.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        agreed = both.select("a", "b", "sa", "sb").mapInArrow(lambda x: agreeing(x, estimate), "a long, b long, share double")
        # Pairs are distinct, and still are unless a node has several sketches.
        near = tables.cut(agreed.groupBy("a", "b").agg(F.max("share").alias("share")) if several else agreed)
        # First the best pair of each node: most groups hang together by them; then what still joins groups.
        best = tables.cut(near.groupBy("b").agg(F.max_by("a", "share").alias("a")).select("a", "b"))
        held = verified(best)
        comp = components(held, tables)
        known = maybe_broadcast(comp, 16)
        more = near.select("a", "b").join(known.toDF("a", "ca"), "a", "left").join(known.toDF("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        rest = tables.cut(more.join(best, ["a", "b"], "left_anti"), near, best, comp)
        if not rest.head(1):
            return held
        also = verified(rest)
        return tables.cut(held.unionByName(also), held, also, rest)

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
        rows = docs.join(maybe_broadcast(ids, 16), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
        packed = tables.cut(rows.mapInArrow(contents, "node long, n int, blob binary"))
        near = maybe_broadcast(packed, 64, blob="blob")
        both = pairs.join(near.toDF("a", "na", "xa"), "a").join(near.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb")
        # A repeated doc_id may prove a pair more than once; components() can bear that.
        return tables.cut(both.mapInArrow(exact, "a long, b long"), packed)

    def narrow(large: DataFrame) -> DataFrame:
        nodes = tables.cut(large.select("node", "comp").distinct())
        texts = docs.join(maybe_broadcast(nodes, 24), F.col("doc_id") == F.col("node")).select("node", "comp", "text")
        return prefix_pairs(texts, tables, nodes)

    comp = link(buckets, verify, narrow, tables)
    tables.drop(own)
    # Copies hang on their node. A copy comes twice where a doc_id repeats, and two nodes may share it, so this is a graph again.
    twice = same.groupBy("b").count().where("count > 1").select("b").unionByName(same.join(comp.select(F.col("node").alias("b")), "b", "left_semi").select("b"))
    if twice.head(1):
        comp = components(tables.cut(same.unionByName(comp.select(F.col("comp").alias("a"), F.col("node").alias("b")))), tables)
    else:
        hung = same.join(maybe_broadcast(comp.toDF("a", "comp"), 16), "a", "left").select(F.col("b").alias("node"), F.coalesce("comp", "a").alias("comp"))
        comp = tables.cut(hung.unionByName(comp.select("node", "comp")), comp)
    tables.drop(same)
    out = docs.select("doc_id").join(maybe_broadcast(comp.where("node <> comp").toDF("doc_id", "comp"), 16), "doc_id", "left").select("doc_id", F.coalesce("comp", "doc_id").alias("class_id"))
    sizes = tables.cut(comp.where("node <> comp").groupBy("comp").agg((F.count("*") + 1).alias("class_size")).withColumnRenamed("comp", "class_id"))
    return out.join(maybe_broadcast(sizes, 16), "class_id", "left").select("doc_id", "class_id", F.when(F.col("class_id").isNotNull(), F.coalesce("class_size", F.lit(1).cast("long"))).alias("class_size"))


def survivors(documents: DataFrame) -> DataFrame:
    """The documents that are their class's first; rows of a null doc_id stay."""
    tables = Tables(documents.sparkSession)
    gone = tables.cut(classes(documents).where("doc_id <> class_id").select("doc_id").distinct())
    return documents.join(maybe_broadcast(gone, 16), "doc_id", "left_anti")

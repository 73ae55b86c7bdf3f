"""Connected groups from hash buckets, without emitting a bucket's pairs.

Nodes share a bucket if some hash of theirs is equal. Every verified link between nodes of one bucket
joins their groups. Instead of a bucket's pairs, this looks at

1. a star: each node against two leaders of its bucket, the least id and the most popular node. A
   node is popular if its buckets are large; the text that many copies were made from is in
   the largest ones, though the copies may be too far from each other to be linked;
2. in buckets whose nodes are still in different groups, again and again, the nodes outside of the
   bucket's largest group against one node of it, as long as step 3 would be larger than the buckets
   and the last round made it smaller by a quarter;
3. what is left: the nodes of one bucket and different groups. Where that is few pairs for each node,
   the pairs; the nodes of all other buckets are given to ``narrow``, which knows from what the nodes
   contain which of them can be linked at all, and leaves out only pairs that cannot.

So a bucket of near copies costs a few comparisons for each of its nodes, and no link that could
change a group is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast

#: The pairs a node from which on a round of step 2 is worth it.
WORTH = 16
#: Up to so many pairs a node a bucket's pairs are written out in step 3.
FEW = 4
#: Parts that keys are dealt to at least, and the bytes of keys and nodes that one of them may have.
BINS, BIN_BYTES = 1 << 10, 32 << 20
PACKED = "bin int, keys binary, nodes binary"
#: So few edges between groups are joined in one task; more are contracted by Spark joins first.
LOCAL_EDGES = 1 << 17
Verify = Callable[[DataFrame], DataFrame]
Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(nodes: DataFrame, keys: Keys, each: int) -> DataFrame:
    """The buckets of ``nodes`` for link(): the rows (key, node) that ``keys`` makes, about ``each`` a node, as one row for each batch and part of the keys."""
    bits = max(BINS, nodes.count() * each * 16 // BIN_BYTES).bit_length() - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keys(batches):
            key, node = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "node"))
            part = (key.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, node, part = key[order], node[order], part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            at = np.append(8 * first, 8 * len(key)).astype(np.int32)
            both = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(x)]) for x in (key, node)]
            yield pa.record_batch([pa.array(part[first]), *both], ["bin", "keys", "nodes"])

    return nodes.mapInArrow(rows, PACKED)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, l1, n) of the keys that several nodes have, from packed rows in the order of their parts; l1 is the least node of a key, n their number."""

    def made(keys: list[bytes], nodes: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, node = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(nodes), np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        many = np.append(same, False) | np.append(False, same)
        key, node = key[many], node[order[many]]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        least, n = np.repeat(node[first], n), np.repeat(n, n)
        keep = n > 1
        table = pa.table([key[keep], node[keep], least[keep], n[keep]], ["key", "node", "l1", "n"])
        yield from table.to_batches(1 << 16)

    part, keys, nodes = None, [], []
    for batch in batches:
        for p, k, x in zip(*(batch.column(c).to_pylist() for c in ("bin", "keys", "nodes")), strict=True):
            if p != part and keys:
                yield from made(keys, nodes)
                keys, nodes = [], []
            part = p
            keys.append(k)
            nodes.append(x)
    if keys:
        yield from made(keys, nodes)


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all nodes of a bounded number of edges (u, v): union by the lesser root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    nodes = np.fromiter(root, np.int64, len(root))
    yield pa.record_batch([pa.array(nodes), pa.array([find(x) for x in nodes.tolist()], pa.int64())], ["node", "comp"])


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, comp) of every node in edges (a, b); comp is the least node of the group.

    Each round points every node at its least neighbour, follows the pointers to their ends, and goes on with
    the edges that still lead from one end to another: at most half as many nodes a round. Minima
    are taken before their shuffle, and the joins may be split where a node has very many neighbours.
    Once few edges are left, one task joins them. Null ends are left out. ``edges`` should be a written table: it is
    counted first, and repeats in it are only taken out where they are many.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    if edges.count() > LOCAL_EDGES:
        edges = tables.cut(edges.distinct())
    levels = []
    while edges.count() > LOCAL_EDGES:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = tables.cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp"), F.lit(True).alias("moved")))
        while True:
            # Pointers lead to lesser nodes only, so they end; each turn halves the way.
            far = tables.cut(known.join(known.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), known)
            known, ended = far, not far.where("moved").head(1)
            if ended:
                break
        levels.append(known)
        at = lambda side: known.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))  # noqa: B023, E731
        rest = edges.join(at("u"), "u").join(at("v"), "v").where("cu <> cv")
        edges = tables.cut(rest.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), edges)
    out = edges.coalesce(1).mapInArrow(roots, "node long, comp long")
    for known in reversed(levels):
        up = tables.cut(out)
        out = known.join(maybe_broadcast(up.toDF("comp", "top"), 16), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return tables.cut(out, *levels, edges)


def link(buckets: DataFrame, verify: Verify, narrow: Verify, tables: Tables) -> DataFrame:
    """(node, comp) of the nodes that verified links connect to others, over all that the ``buckets`` bring together.

    ``buckets`` come from packed(). ``verify`` takes a table of distinct pairs (a, b), a < b, and returns the table of
    those that hold. ``narrow`` takes nodes (key, node, comp) of buckets that are large and in several groups, and returns
    distinct pairs a < b of different groups, all that hold among them; what else is in them goes through ``verify``.
    """
    every = tables.cut(buckets.repartition("bin").sortWithinPartitions("bin").mapInArrow(shared, "key long, node long, l1 long, n long"))
    # A bucket of two is its own pair; only larger ones need their nodes.
    led = every.where("n > 2")
    popular = led.groupBy("node").agg(F.sum("n").alias("p"))
    leader = led.join(popular, "node").groupBy("key").agg(F.max_by("node", F.struct("p", -F.col("node"))).alias("l2"))
    leader = tables.cut(leader)
    pair = lambda x: F.struct(F.least("node", x).alias("a"), F.greatest("node", x).alias("b"))
    star = led.join(maybe_broadcast(leader, 24), "key").select(F.explode(F.array(pair("l1"), pair("l2"))).alias("p")).select("p.a", "p.b")
    tested = tables.cut(star.unionByName(every.where("n = 2").select(F.col("l1").alias("a"), F.col("node").alias("b"))).where("a < b").distinct(), leader)
    links, turn, before = verify(tested), 0, None
    while True:
        comp = components(links, tables)
        rest = led.select("key", "node").join(maybe_broadcast(comp, 16), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        parts = rest.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64(F.lit(turn), "node")).alias("top"))
        whole = parts.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("k"), F.max_by(F.struct("comp", "top"), F.struct("c", "comp")).alias("most")).where("k > 1")
        whole = tables.cut(whole.select("key", "s", "q", F.col("most.comp").alias("comp0"), F.col("most.top").alias("top")))
        nodes, left = whole.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0))).first()
        mixed = tables.cut(rest.join(maybe_broadcast(whole, 48), "key"), whole)
        if left <= WORTH * nodes or (before is not None and left > 0.75 * before):
            break
        before, turn = left, turn + 1
        more = tables.cut(mixed.where("comp <> comp0").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), mixed)
        found = verify(more)
        tested, links = tables.cut(tested.unionByName(more), tested, more), tables.cut(links.unionByName(found), links, found, comp)
    tables.drop(every)
    few = (F.col("s") * F.col("s") - F.col("q")) / 2 <= FEW * F.col("s")
    x, y = (mixed.where(few).select("key", F.col("node").alias(at), F.col("comp").alias(f"c{at}")) for at in ("a", "b"))
    pairs = x.join(y, "key").where("ca <> cb and a < b").select("a", "b")
    large = mixed.where(~few).select("key", "node", "comp")
    spent = [mixed, tested]
    if large.head(1):
        spent.append(narrow(large))
        pairs = pairs.unionByName(spent[-1])
    pairs = tables.cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"), *spent)
    found = verify(pairs)
    if not found.head(1):
        tables.drop(pairs, found)
        return comp
    both = tables.cut(links.unionByName(found), links, found, pairs, comp)
    return components(both, tables)

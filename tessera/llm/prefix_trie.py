"""Prefix trie of conversations: MSD radix partitioning by turns, finished by multikey quicksort.

A turn is (role, text), null as empty. Turns are dictionary-encoded: each distinct one gets a long id through its SHA-256, so
texts are hashed where they are read and never shuffled. A rebuilt conversation is an array of ids, and equal
conversations are one row with their number, least id and the digest of their ids; a bucket of copies is a single row from then on.

The trie is built from the top. All sequences start in the root's bucket. A round parts each bucket by its next turn;
parts of more than ``LOCAL`` sequences become buckets of the next round, at the end of their longest common prefix (the
turns on the way are nodes with one child and take no round of their own). The others are grouped by
bucket and turn and finished in their task by multikey quicksort, with a stack of ranges in place of recursion; each range of an
equal turn is a node. Sums over subtrees of the buckets above are taken from the last round to the first. No task holds more than
``LOCAL`` sequences of a group, and what the buckets above need is one row a bucket.

Rows of a null conv_id belong to no conversation. Turns of a conversation are ordered by turn (null first), those of an
equal turn by the SHA-256 of role and text. A conversation is one row of its task: its ids and word counts (16 bytes a
turn) must fit there, its texts need not. Empty tables have no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast

#: A bucket of at most so many distinct sequences is finished in one task.
LOCAL = 256
#: Ids of equal conversations are joined into strings by ranges of two to this power before they meet.
ID_BITS = 9
#: A turn in more than this share of the rows is looked up in a broadcast table: there are at most 1 / HOT of them.
HOT = 1e-3
#: Rows that a task sorts at a time; a group that began before is finished first.
ROWS = 8192
SPACES = r"[\x20\x09-\x0D]+"
EMPTY = hashlib.sha256().hexdigest()
NODES = "bucket string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
KINDS = {"bucket": pa.string(), "top": pa.bool_(), "ends_sha256": pa.string()}


def turns_of(conversations: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, turn, mark, id, words) of every row: ``mark`` is the turn's SHA-256, ``id`` its number in the dictionary."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.array_remove(F.split(text, SPACES), ""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), words.cast("long").alias("words"))
    rows = tables.cut(rows)
    counted = rows.groupBy("mark").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    book = tables.cut(counted)
    often = HOT * max(1, rows.count())
    # No turn outside of the broadcast table is frequent enough to fill a task.
    rest = rows.join(F.broadcast(book.where(F.col("n") > often).select("mark", F.col("id").alias("hot"))), "mark", "left")
    known = rest.where("hot is not null").withColumnRenamed("hot", "id")
    looked_up = rest.where("hot is null").drop("hot").join(book.where(F.col("n") <= often).select("mark", "id"), "mark")
    names = ["conv_id", "turn", "mark", "id", "words"]
    return tables.cut(known.select(names).unionByName(looked_up.select(names)), rows, book)


def heads(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(4)).cast("int")


def rebuilt(turns: DataFrame, tables: Tables) -> DataFrame:
    """(conv_id, seq, words): the first h turns of conversation c - c % 20 (the remainder has the sign of c), then the own turns after the first h."""
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "mark", "id", "words"))).alias("t"))
    own = tables.cut(ordered.select("conv_id", F.transform("t", lambda x: x["id"]).alias("seq"), F.transform("t", lambda x: x["words"]).alias("words")))
    first = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, 3).alias("seq0"), F.slice("words", 1, 3).alias("words0"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", heads(F.col("conv_id"))).join(first, "base", "left")
    none = F.array().cast("array<long>")
    part = lambda mine, shared: F.concat(F.slice(F.coalesce(shared, none), F.lit(1), F.col("h")), F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine), F.lit(1))))
    return tables.cut(both.select("conv_id", part("seq", F.col("seq0")).alias("seq"), part("words", F.col("words0")).alias("words")), own)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys: (seq, words, n, conv, ends). The ids of a key come in ascending pieces and are hashed as they pass."""
    now, head, n, state = None, None, 0, hashlib.sha256()
    done: list[tuple] = []

    def table() -> pa.RecordBatch:
        out = pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))], ["seq", "words", "n", "conv", "ends"])
        done.clear()
        return out

    for batch in batches:
        keys, ids, counts, least, seqs, words = (batch.column(c) for c in ("key", "ids", "n", "conv", "seq", "words"))
        for i, key in enumerate(keys.to_pylist()):
            if key == now:
                state.update(b",")
            else:
                if head:
                    done.append((*head[:2], n, head[2], state.hexdigest()))
                now, n, state, head = key, 0, hashlib.sha256(), (seqs[i].as_py(), words[i].as_py(), least[i].as_py())
            state.update(ids[i].as_py().encode())
            n += counts[i].as_py()
        if len(done) >= ROWS:
            yield table()
    if head:
        done.append((*head[:2], n, head[2], state.hexdigest()))
    yield table()


def distinct_sequences(convs: DataFrame, tables: Tables) -> DataFrame:
    """(seq, words, n, conv, ends): each distinct sequence with its number of conversations, the least of them and their digest.

    Ids are gathered by ranges of 2 ** ``ID_BITS``, sorted, and joined; the pieces of one sequence then pass through one
    hash in order, a bounded batch at a time.
    """
    key = F.sha2(F.array_join(F.transform("seq", lambda x: x.cast("string")), ","), 256)
    pieces = convs.groupBy(key.alias("key"), (F.shiftright("conv_id", ID_BITS)).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("c"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    pieces = pieces.select("key", "range", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"), F.size("c").cast("long").alias("n"), F.col("c")[0].alias("conv"), "seq", "words")
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "key").sortWithinPartitions("key", "range")
    return tables.cut(dealt.mapInArrow(digests, "seq array<long>, words array<long>, n long, conv long, ends string"))


class Grown:
    """Nodes of a run of groups, as lists; a node's parent precedes it."""

    def __init__(self) -> None:
        self.bucket: list[str] = []
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.above: list[int | None] = []
        self.n: list[int] = []
        self.conv: list[int | None] = []
        self.word: list[int] = []
        self.ends: list[str] = []

    def add(self, bucket: str, depth: int, parent: int, above: int | None, word: int) -> int:
        for column, value in ((self.bucket, bucket), (self.depth, depth), (self.parent, parent), (self.above, above), (self.n, 0), (self.conv, None), (self.word, word), (self.ends, EMPTY)):
            column.append(value)
        return len(self.depth) - 1

    def end(self, node: int, n: int, conv: int, ends: str) -> None:
        self.n[node], self.conv[node], self.ends[node] = n, conv, ends

    def table(self) -> pa.RecordBatch:
        size = len(self.depth)
        n, conv, children, leaves, saved = self.n, self.conv, [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * self.word[i]
            if (up := self.parent[i]) >= 0:
                n[up] += n[i]
                conv[up] = conv[i] if conv[up] is None else min(conv[up], conv[i])
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        above = [conv[up] if up >= 0 else self.above[i] for i, up in enumerate(self.parent)]
        columns = (self.bucket, [up < 0 for up in self.parent], conv, self.depth, above, n, children, leaves, saved, self.ends)
        names = [x.split()[0] for x in NODES.split(", ")]
        return pa.record_batch([pa.array(c, KINDS.get(k, pa.int64())) for k, c in zip(names, columns, strict=True)], names)


def quicksort(rows: list[tuple], bucket: str, at: int, above: int, out: Grown) -> None:
    """Nodes of distinct sequences that share their first ``at`` + 1 turns, from depth ``at`` + 1 on; rows are (seq, words, n, conv, ends).

    A range of rows is parted in three by a pivot turn. The equal part is a node: its rows that end there
    are taken off, the others are a range at the next turn. Ranges wait on a stack.
    """
    todo = [(rows, at, -1)]
    while todo:
        part, d, up = todo.pop()
        if len(part) == 1:
            seq, words, n, conv, ends = part[0]
            for k in range(d, len(seq)):
                up = out.add(bucket, k + 1, up, above, words[k])
            out.end(up, n, conv, ends)
            continue
        pivot = part[len(part) // 2][0][d]
        less, same, more = [], [], []
        for r in part:
            x = r[0][d]
            (same if x == pivot else less if x < pivot else more).append(r)
        node = out.add(bucket, d + 1, up, above, same[0][1][d])
        deeper = [r for r in same if len(r[0]) > d + 1]
        if len(deeper) < len(same):
            out.end(node, *next(r for r in same if len(r[0]) == d + 1)[2:])
        todo += [(x, y, z) for x, y, z in ((more, d, up), (deeper, d + 1, node), (less, d, up)) if x]


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the groups (bucket, next) of a sorted partition."""
    out, group, now = Grown(), [], None
    for batch in batches:
        names = ("bucket", "next", "at", "above", "seq", "words", "n", "conv", "ends")
        for bucket, turn, at, above, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or (bucket, turn) != now[:2]:
                if group:
                    quicksort(group, now[0], *now[2:], out)
                    if len(out.depth) >= ROWS:
                        yield out.table()
                        out = Grown()
                now, group = (bucket, turn, at, above), []
            group.append(tuple(row))
    if group:
        quicksort(group, now[0], *now[2:], out)
    yield out.table()


def common(low: Column, high: Column, at: Column) -> Column:
    """Length of the common prefix of two different arrays that agree up to ``at``, which it includes."""
    size = F.least(F.size(low), F.size(high))
    differ = F.transform(F.sequence(at, size), lambda i: F.coalesce(F.get(low, i) != F.get(high, i), F.lit(True)))
    return (at + F.array_position(differ, True) - 1).cast("int")


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    tables = Tables(conversations.sparkSession)
    turns = turns_of(conversations, tables)
    convs = rebuilt(turns, tables)
    tables.drop(turns)
    sequences = distinct_sequences(convs, tables)
    tables.drop(convs)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    root = sequences.agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), F.count("*").alias("k")).first()
    spark = conversations.sparkSession
    if not root["k"]:
        return spark.createDataFrame([], NODES).drop("bucket", "top")
    # Buckets of each round: their key, the bucket above, depth at both ends of their chain, and what their rows hold together.
    rounds = [spark.createDataFrame([("", "", None, -1, 0, root["n"], root["conv"], [0])], "bucket string, up string, above long, before int, at int, n long, conv long, chain array<long>")]
    active = sequences.select(F.lit("").alias("bucket"), F.lit(0).alias("at"), F.lit(root["conv"]).cast("long").alias("above"), "seq", "words", "n", "conv", "ends")
    going = None
    ended, grown = [], []
    while True:
        ended.append(tables.cut(active.where(F.size("seq") == F.col("at")).select("bucket", "ends")))
        going = tables.cut(active.where(F.size("seq") > F.col("at")).withColumn("next", F.get("seq", F.col("at"))), *([going] if going else [sequences]))
        large = going.groupBy("bucket", "next").agg(F.count("*").alias("k")).where(F.col("k") > local)
        large = maybe_broadcast(tables.cut(large.select("bucket", "next", F.lit(True).alias("large"))), 256)
        marked = going.join(large, ["bucket", "next"], "left")
        small = marked.where("large is null").repartition(parts, "bucket", "next").sortWithinPartitions("bucket", "next")
        grown.append(tables.cut(small.mapInArrow(finish, NODES)))
        split = marked.where("large")
        low, high = F.min("seq"), F.max("seq")
        sums = split.groupBy("bucket", "next", "at").agg(low.alias("low"), high.alias("high"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min_by("words", "seq").alias("words"), F.first("above").alias("above"))
        sums = sums.withColumn("end", common(F.col("low"), F.col("high"), F.col("at")))
        key = F.concat_ws(".", "bucket", F.col("next").cast("string"))
        below = sums.select(key.alias("bucket"), F.col("bucket").alias("up"), "above", F.col("at").alias("before"), F.col("end").alias("at"), "n", "conv", F.slice("words", F.col("at") + 1, F.col("end") - F.col("at")).alias("chain"))
        below = tables.cut(below)
        if not below.head(1):
            tables.drop(going, below)
            break
        rounds.append(below)
        deeper = maybe_broadcast(below.select("bucket", F.col("at").alias("at2"), F.col("conv").alias("above2")), 256)
        active = split.withColumn("bucket", key).join(deeper, "bucket").select("bucket", F.col("at2").alias("at"), F.col("above2").alias("above"), "seq", "words", "n", "conv", "ends")
    return sums_above(rounds, ended, grown, tables)


def sums_above(rounds: list[DataFrame], ended: list[DataFrame], grown: list[DataFrame], tables: Tables) -> DataFrame:
    """All nodes: the local ones, and those of the buckets, whose subtrees are added up from the last round to the first."""
    out, below = [], None
    for buckets, ends, local in reversed(list(zip(rounds, ended, grown, strict=True))):
        parts = local.where("top").select("bucket", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        if below is not None:
            parts = parts.unionByName(below)
        sums = parts.groupBy("bucket").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children"))
        whole = buckets.join(sums, "bucket", "left").join(ends, "bucket", "left").withColumn("size", F.size("chain"))
        own = F.aggregate("chain", F.lit(0).cast("long"), lambda a, w: a + w) * (F.col("n") - 1)
        whole = tables.cut(whole.withColumn("leaves", F.coalesce("leaves", F.lit(1).cast("long"))).withColumn("total", F.coalesce("saved", F.lit(0)) + own))
        below = whole.where("before >= 0").select(F.col("up").alias("bucket"), "leaves", F.col("total").alias("saved"))
        # What the first node of a chain saves, less what the nodes before this one add. Only the last one branches.
        before = Window.partitionBy("bucket").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        chain = whole.select("*", F.posexplode("chain").alias("i", "word")).withColumn("passed", F.coalesce(F.sum("word").over(before), F.lit(0)))
        first, last = F.col("i") == 0, F.col("i") == F.col("size") - 1
        nodes = chain.select(
            F.col("conv").alias("conv_id"),
            (F.col("before") + 1 + F.col("i")).cast("long").alias("depth"),
            F.when(first, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("total") - (F.col("n") - 1) * F.col("passed")).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
        )
        out += [nodes, local.select(nodes.columns)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result

"""Fuzzy line dedup.

A line's normal form is its lower-cased words joined by one space (ASCII punctuation separates words).
Lines of one normal form are copies. Among the distinct forms, SimHash fingerprints of ``BITS`` bits
are cut into ``BLOCKS`` blocks; two lines meet if a block is equal, which by the pigeonhole principle
is so for all pairs that differ in fewer bits than there are blocks. One altered word moves far more
bits, so the words are cut into blocks too, and lines also meet

* if their first, middle or last third is equal (lines of ``THIRDS`` words or more): by the same principle
  two altered words leave one third as it is, and one inserted or deleted word leaves the first or the last;
* if they are equal without one word (lines of 3 to ``WITHOUT_ONE`` words) or two (5 to ``WITHOUT_TWO``);
* by MinHash of their features (lines of ``SKETCHED`` words or more): ``TABLES`` tables of ``ROWS`` minima.

Met pairs are verified: edit similarity, 1 - distance / longer length in characters, of
at least ``SIMILARITY``. Connected lines form a group; of all occurrences of a group's lines
the first (least doc_id, then line number) stays and the others go.

Fingerprint features are the words of five bytes or more, or all words where there are fewer than three
such. Lines without a word (blank, rules of dashes) are left alone. Null texts are empty and stay
null-safe: their result is "". Rows of a null doc_id keep all lines; rows that repeat a doc_id are
each judged as occurrences of the same (doc_id, line): the line stays in all of them or in none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast
from .decontaminate import LANES
from .linking import link, packed
from .text_arrays import U64, Words, mix, raw, sequence_hash, signed, slices, strings, words

BITS, BLOCKS = 128, 4
SIMILARITY = 0.8
SALTS = 16
GRAMS = 512
LONG_WORD = 5
#: Lines of a large bucket that are compared with each other in one task.
BLOCK = 64
#: Tasks that such blocks are dealt to at most, and the pairs of blocks that are worth a task.
TASKS, EACH = 512, 16
WITHOUT_ONE, WITHOUT_TWO, THIRDS = 14, 9, 10
SKETCHED, TABLES, ROWS = 16, 2, 4
#: Words passed over on both sides, the fewest first.
NEAREST = sorted(((s, t) for s in range(9) for t in range(9) if s + t), key=lambda p: (sum(p), abs(p[0] - p[1])))
_SALTS = np.array([0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127], U64)


def line_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that have words: row, line number in the row, and first and end word."""
    breaks = np.flatnonzero(w.data == 10)
    row = w.row_of()
    line = np.searchsorted(breaks, w.starts) + row
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    return row[first], line[first], first, np.append(first[1:], len(line))


def features(w: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' features, and the line of each."""
    long = (w.ends - w.starts) >= LONG_WORD
    total = np.zeros(len(long) + 1, np.int64)
    np.cumsum(long, out=total[1:])
    n = end - first
    line = np.repeat(np.arange(len(first)), n)
    word = np.arange(len(line)) + np.repeat(first - np.cumsum(n) + n, n)
    use = long[word] | ((total[end] - total[first]) < 3)[line]
    return w.hashes[word[use]], line[use]


def fingerprints(w: Words, first: np.ndarray, end: np.ndarray, step: int = 1 << 15, made: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(lines, BITS / 8) bytes; ``made`` are the lines' features, if at hand. Bits are counted in byte lanes, at most 255 words at a time."""
    h, line = made or features(w, first, end)
    counts = np.bincount(line, minlength=len(first))
    ones = np.zeros((len(first), BITS), np.int32)
    for a in range(0, len(h), step):
        own = line[a : a + step]
        bits = mix(h[a : a + step, None] ^ _SALTS[None, : BITS // 64])
        lanes = LANES[bits.view(np.uint8).reshape(len(own), -1)]
        place = np.arange(len(own))
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        within = place - np.repeat(starts, np.diff(np.append(starts, len(own))))
        cuts = np.flatnonzero(within % 255 == 0)
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), -1)
        # A line of more words than fit has several sums.
        ones[own[starts]] += np.add.reduceat(sums, np.searchsorted(cuts, starts), axis=0, dtype=np.int32) if len(cuts) > len(starts) else sums
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little")


def minima(h: np.ndarray, line: np.ndarray, lines: int, step: int = 1 << 15) -> np.ndarray:
    """(lines, TABLES) keys of the MinHash tables, from features()."""
    least = np.full((lines, TABLES * ROWS), 2**32 - 1, np.uint32)
    salts = mix(np.arange(1, (TABLES * ROWS + 1) // 2 + 1).astype(U64))
    for a in range(0, len(h), step):
        own = line[a : a + step]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        got = np.minimum.reduceat(mix(h[a : a + step, None] ^ salts[None, :]).view(np.uint32)[:, : TABLES * ROWS], starts, axis=0)
        least[own[starts]] = np.minimum(least[own[starts]], got)
    key = np.broadcast_to(mix(np.arange(1, TABLES + 1).astype(U64)), (lines, TABLES))
    for r in range(ROWS):
        key = mix(key ^ least[:, r * TABLES : (r + 1) * TABLES].astype(U64))
    return key.astype(np.uint32)


def shortened(w: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and keys: hashes of each line of few words and of what is left of it without one or two of them."""
    lines, keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], end - first
    for size in range(2, WITHOUT_ONE + 1):
        own = np.flatnonzero(n == size)
        if not len(own):
            continue
        h = w.hashes[first[own][:, None] + np.arange(size)[None, :]]
        for less in range(3):
            left = size - less
            if less and (left <= less or size > (WITHOUT_ONE, WITHOUT_TWO)[less - 1]):
                break
            kept = np.array(list(combinations(range(size), left)))
            got = np.full((len(own), len(kept)), left, U64)
            for i in range(left):
                got = mix(got ^ h[:, kept[:, i]]) + U64(i)
            lines.append(np.repeat(own, len(kept)))
            keys.append(got.astype(np.uint32).ravel())
    return np.concatenate(lines), np.concatenate(keys)


def thirds(w: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and keys: each line's middle third, and its first and last ones as cut in lines of its length and of a word more or less."""
    n = end - first
    own = np.flatnonzero(n >= THIRDS)
    a, z, n = first[own], end[own], n[own]
    # Lengths 2i - 1 to 2i + 1 share the label i, so that odd lengths have two labels and even ones one.
    up, odd = (n + 1) // 2, np.flatnonzero(n % 2)
    parts = [(2, n, own, a + n // 3, z - n // 3)]
    for label, which in ((up, slice(None)), (up - 1, odd)):
        label = label[which]
        third = (2 * label - 1) // 3
        parts += [(0, label, own[which], a[which], a[which] + third), (1, label, own[which], z[which] - third, z[which])]
    at, stop = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
    label = np.concatenate([x[1].astype(U64) * U64(4) + U64(x[0]) for x in parts])
    return np.concatenate([x[2] for x in parts]), mix(sequence_hash(w.hashes, at, stop, 7) ^ mix(label)).astype(np.uint32)


def prints(w: Words, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """Each line's fingerprint, and behind it its other keys of four bytes."""
    h, of = features(w, first, end)
    blocks = np.ascontiguousarray(fingerprints(w, first, end, made=(h, of))).view(np.uint32)
    long = end - first >= SKETCHED
    sketched, use = np.flatnonzero(long), long[of]
    sketches = minima(h[use], (np.cumsum(long) - 1)[of[use]], len(sketched))
    less, keys = shortened(w, first, end)
    third, equal = thirds(w, first, end)
    line = np.concatenate([np.repeat(np.arange(len(first)), BLOCKS), np.repeat(sketched, TABLES), less, third])
    value = np.concatenate([blocks.ravel(), sketches.ravel(), keys, equal])[np.argsort(line, kind="stable")]
    at = np.zeros(len(first) + 1, np.int32)
    np.cumsum(4 * np.bincount(line, minlength=len(first)), out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(value)])


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each line that has words."""
    for batch in batches:
        for part in slices(batch, "text"):
            text = strings(part.column("text"), lower=True)
            w = words(text)
            if not len(w.starts):
                continue
            row, line, first, end = line_words(w)
            base = np.searchsorted(np.flatnonzero(w.data == 10), raw(text)[1][:-1]) + np.arange(w.rows)
            yield pa.record_batch([pa.array(signed(sequence_hash(w.hashes, first, end, 1))), pa.array(signed(sequence_hash(w.hashes, first, end, 2))), part.column("doc_id").take(pa.array(row)), pa.array((line - base[row]).astype(np.int32)), prints(w, first, end)], ["h1", "h2", "doc_id", "line", "print"])


def block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("print").to_pylist()
        n = np.array([len(x) // 4 for x in column], np.int64)
        value = np.frombuffer(b"".join(column), np.uint32).astype(U64)
        node = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)
        # Blocks count by their place; the other keys have what tells them apart inside, and may repeat.
        key = mix(value ^ mix(np.minimum(place, BLOCKS).astype(U64) + U64(1)))
        order = np.lexsort((key, node))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        yield pa.record_batch([pa.array(signed(key[new])), batch.column("node").take(pa.array(node[new]))], ["key", "node"])


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most``.

    Common ends are cut off; if what is left is longer, it is worked off bit-parallel, one column of
    the distance table at a time.
    """
    n = min(len(a), len(b))
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    head = np.flatnonzero(x[:n] != y[:n])
    head = int(head[0]) if len(head) else n
    rest = n - head
    tail = np.flatnonzero(x[len(x) - rest :][::-1] != y[len(y) - rest :][::-1])
    tail = int(tail[0]) if len(tail) else rest
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return False
    return max(len(a), len(b)) <= most or _bit_parallel(a, b, most) <= most


def aligned(a: str, b: str, most: int) -> bool:
    """Whether words matched in passing prove a distance of at most ``most``; False leaves it open.

    Words are matched as long as they are equal, and from the nearest place where two go on alike; what lies
    between is an edit of at most its longer side. Each word counts with the space behind it.
    """
    x, y = a.split(" "), b.split(" ")
    x, y, i, j, cost = [*x, "", ""], [*y, "", ""], 0, 0, 0
    m, n = len(x) - 2, len(y) - 2
    while cost <= most:
        while i < m and j < n and x[i] == y[j]:
            i, j = i + 1, j + 1
        if i == m and j == n:
            return True
        for s, t in NEAREST:
            if i + s <= m and j + t <= n and x[i + s] == y[j + t] and x[i + s + 1] == y[j + t + 1]:
                break
        else:
            return False
        cost += sum(max(len(p), len(q)) + 1 for p, q in zip(x[i : i + s], y[j : j + t], strict=True)) if s == t else max(sum(map(len, x[i : i + s])) + s, sum(map(len, y[j : j + t])) + t)
        i, j = i + s, j + t
    return False


def _bit_parallel(a: str, b: str, most: int) -> int:
    """The edit distance, or a number over ``most`` as soon as it must be over it."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        score += bool(up & top) - bool(down & top)
        if score - left > most:
            return score
        up = up << 1 | 1
        plus, minus = ((down << 1) | ~(diagonal | up)) & full, up & diagonal & full
    return score


def similar(a: str, b: str) -> bool:
    most = math.floor(max(len(a), len(b)) * (1 - SIMILARITY) + 1e-9)
    return aligned(a, b, most) or within(a, b, most)


def grams(column: pa.Array) -> np.ndarray:
    """(rows, GRAMS) counts of the strings' hashed byte pairs."""
    data, at = raw(strings(column))
    row = np.repeat(np.arange(len(column)), np.diff(at))
    pair = (data[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) ^ data[1:].astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(22)
    inside = row[1:] == row[:-1]
    return np.bincount(row[1:][inside] * GRAMS + (pair[inside] % GRAMS), minlength=len(column) * GRAMS).reshape(-1, GRAMS)


def may_be_similar(a: pa.Array, b: pa.Array) -> np.ndarray:
    """False only where two strings are too far apart: an edit of a character of at most 4 bytes changes at most 10 of their byte pairs, one of a byte 4."""
    sizes, plain = lengths(a, b)
    near = np.flatnonzero(alike_in_length(*sizes))
    most = np.floor(np.maximum(*sizes) * (1 - SIMILARITY) + 1e-9)
    got = np.zeros(len(a), bool)
    # The counts of a whole batch would be over 100 MB.
    for own in (near[i : i + 1024] for i in range(0, len(near), 1024)):
        x, y = (z.take(pa.array(own)) for z in (a, b))
        got[own] = np.abs(grams(x) - grams(y)).sum(1) <= most[own] * np.where(plain[own], 4, 10)
    return got


def lengths(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The strings' characters, and where all of them are of one byte in all columns."""
    sizes, plain = [], np.ones(len(columns[0]), bool)
    for x in columns:
        sizes.append(pa.compute.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64))
        plain &= pa.compute.binary_length(x).to_numpy(zero_copy_only=False) == sizes[-1]
    return sizes, plain


def alike_in_length(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.abs(n - m) <= np.floor(np.maximum(n, m) * (1 - SIMILARITY) + 1e-9)


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "xa"):
            part = part.filter(pa.array(may_be_similar(part.column("xa"), part.column("xb"))))
            keep = pa.array([similar(x, y) for x, y in zip(part.column("xa").to_pylist(), part.column("xb").to_pylist(), strict=True)], pa.bool_())
            yield pa.record_batch([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def block_links(table: pa.Table) -> pa.Table:
    """Similar pairs (a, b) of two blocks of lines, as far as they still join groups (key, keys, node, comp, place, own, form).

    Pairs are looked at where their places are the two of the table, one of them is in its own class of lengths, and
    the table's key is the least of those that they share.
    """
    node, comp, place, own = (table.column(x).to_numpy() for x in ("node", "comp", "place", "own"))
    form = table.column("form").combine_chunks()
    (n,), plain = lengths(form)
    most, text, counts, links = np.floor(n * (1 - SIMILARITY) + 1e-9), form.to_pylist(), grams(form).astype(np.int32), []
    key, lesser = table.column("key")[0].as_py(), table.column("keys").to_pylist()
    lesser = [{y for y in x if y < key} for x in lesser]
    _, comp = np.unique(comp, return_inverse=True)
    whole = place.min() == place.max()
    for i in range(1, len(node)):
        j = np.flatnonzero((own[:i] | own[i]) & (comp[:i] != comp[i]) & (whole | (place[:i] != place[i])) & alike_in_length(n[:i], n[i]))
        if len(j):
            j = j[np.abs(counts[j] - counts[i]).sum(1) <= np.maximum(most[j], most[i]) * np.where(plain[j] & plain[i], 4, 10)]
        for k in j.tolist():
            if comp[k] != comp[i] and lesser[k].isdisjoint(lesser[i]) and similar(text[k], text[i]):
                links.append((min(node[k], node[i]), max(node[k], node[i])))
                comp[comp == comp[k]] = comp[i]
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def large_links(lines: DataFrame, tables: Tables) -> DataFrame:
    """Distinct links (a, b) that join the groups of each bucket of ``lines`` (key, keys, node, comp, form), without writing out a bucket's pairs.

    Similar lines are at most a quarter longer than each other, so a line is compared with those of its class of
    lengths and the next shorter one, and that in one bucket only: ``keys`` are all that a line has. The lines of a bucket and class are dealt to blocks, and each two blocks are one group of rows.
    """
    # A little over a quarter, so that rounding does not part two classes.
    kind = F.floor(F.log(F.char_length("form")) / math.log(1 / SIMILARITY + 1e-4))
    both = lines.withColumn("kind", kind).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).select("key", (F.col("kind") + F.col("up")).alias("kind"), (F.col("up") == 0).alias("own"), "keys", "node", "comp", "form")
    sizes = both.groupBy("key", "kind").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where("owned > 0 and n > 1").select("key", "kind", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = tables.cut(sizes)
    dealt = both.join(maybe_broadcast(sizes, 24), ["key", "kind"]).withColumn("place", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"p": F.least("place", "other"), "q": F.greatest("place", "other")})
    # The rows are few bytes and much work: without a number of tasks they would be gathered in one.
    tasks = sizes.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(1))).first()[0]
    pairs = dealt.repartition(max(1, min(int(tasks) // EACH, TASKS)), "key", "kind", "p", "q").groupBy("key", "kind", "p", "q")
    return tables.cut(pairs.applyInArrow(block_links, "a long, b long").distinct(), sizes)


def chosen_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal forms of the lines asked for: (node, form) from (text, wanted array<struct<line, node>>)."""
    for batch in batches:
        for part in slices(batch, "text"):
            nodes, got = [], []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for x in wanted:
                    nodes.append(x["node"])
                    got.append(lines[x["line"]])
            w = words(strings(pa.array(got, pa.large_string()), lower=True), hashed=False)
            data = w.data.tobytes()
            ranges = list(zip(w.starts.tolist(), w.ends.tolist(), strict=True))
            forms = [b" ".join([data[s:e] for s, e in ranges[i:j]]).decode() for i, j in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(forms, pa.string())], ["node", "form"])


def removals(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, removed array<int>): the line numbers, from 0, that go from each document that loses some."""
    tables = Tables(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    lines = tables.cut(docs.mapInArrow(line_rows, "h1 long, h2 long, doc_id long, line int, print binary"))
    forms = tables.cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), F.first("print").alias("print")).select(F.col("h1").alias("node"), "h2", "first", "n", "print"))
    buckets = packed(forms.select("node", "print"), block_keys, 16)

    def texts(ids: DataFrame) -> DataFrame:
        wanted = tables.cut(forms.select("node", "first").join(maybe_broadcast(ids, 16), "node", "left_semi").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("wanted")))
        rows = docs.join(maybe_broadcast(wanted, 32, array="wanted"), "doc_id").select("text", "wanted")
        # A doc_id on several rows is read from each; forms of one node agree, for its hash does.
        return tables.cut(rows.mapInArrow(pick_existing, "node long, form string").dropDuplicates(["node"]), wanted)

    def verify(pairs: DataFrame) -> DataFrame:
        form = texts(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        near = maybe_broadcast(form, 64, blob="form")
        both = pairs.join(near.toDF("a", "xa"), "a").join(near.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
        return tables.cut(both.mapInArrow(exact, "a long, b long"), form)

    def narrow(large: DataFrame) -> DataFrame:
        keys = tables.cut(large.groupBy("node").agg(F.collect_set("key").alias("keys")))
        form = tables.cut(texts(keys.select("node")).join(keys, "node"), keys)
        links = large_links(large.join(form, "node"), tables)
        tables.drop(form)
        return links

    comp = link(buckets, verify, narrow, tables)
    known = tables.cut(forms.select("node", "h2", "first", "n").join(maybe_broadcast(comp, 16), "node", "left").where("n > 1 or comp is not null").select("node", "h2", "first", F.coalesce("comp", "node").alias("comp")), forms, comp)
    firsts = known.groupBy("comp").agg(F.min("first").alias("keep"))
    # A group may hold a third of all forms: its rows are dealt to SALTS places.
    salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    copies = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    groups = tables.cut(salted.join(copies, ["comp", "salt"]).select(F.col("node").alias("h1"), "h2", "keep"), known)
    gone = lines.select("h1", "h2", "doc_id", "line").join(maybe_broadcast(groups, 64), ["h1", "h2"]).where("doc_id <> keep.doc_id or line <> keep.line")
    return tables.cut(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed")), lines, groups)


def pick_existing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chosen_lines, where a row that repeats a doc_id may lack the line."""

    def cleaned() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            wanted = [[x for x in w if x["line"] <= (t or "").count("\n")] for t, w in zip(texts, batch.column("wanted").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("text"), pa.array(wanted, batch.column("wanted").type)], ["text", "wanted"])

    return chosen_lines(cleaned())


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with the text less its removed lines, and ``n_lines`` and ``removed_lines`` beside.

    Columns of those two names in the input give way.
    """
    gone = removals(documents, id_col, text_col)
    gone = maybe_broadcast(gone, 8, array="removed").withColumnsRenamed({"doc_id": "_id", "removed": "_removed"})
    out = documents.drop("n_lines", "removed_lines").join(gone, F.col(id_col).cast("long") == F.col("_id"), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    # The lines are a field of the outer lambda's variable, so that they are split once for each text.
    both = F.array(F.struct(lines.alias("l"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_removed").alias("i")))
    kept = F.transform(both, lambda x: F.array_join(F.transform(x["i"], lambda i: F.get(x["l"], i)), "\n"))[0]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    return out.withColumns({"n_lines": n_lines, "removed_lines": F.coalesce("_removed", F.array().cast("array<int>")), text_col: F.when(F.col("_removed").isNull(), text).otherwise(kept)}).drop("_id", "_removed")

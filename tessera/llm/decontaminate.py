"""Benchmark decontamination: SimHash over item-sized windows.

For each benchmark item of n words, the windows of n words of every text are its candidates. A
window's fingerprint is the 64-bit SimHash of its weighted five-word shingles (weight: occurrences).
Window and item meet if their fingerprints differ in at most ``RADIUS`` bits: with ``BLOCKS`` blocks
of eight bits, some block of such a pair differs in at most RADIUS // BLOCKS bits, so an index from
each block's value to all items within that distance of it misses none. Met pairs are then verified
by the exact weighted Jaccard similarity of their shingles, 0.8 or more.

Windows that share no shingle with any item have similarity 0 and are not fingerprinted. That and
the radius aside nothing is skipped: every position of every text is looked at.

Words are lower-cased; ASCII punctuation separates them. Items without words match nothing; items of
1 to 4 words match only a text that consists of them. Null texts are empty; a text shorter than an
item is compared whole with it. Repeated items each match. The item index is broadcast in
parts of at most ``PART_BYTES``; a larger benchmark takes more passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import U64, mix, shingles, slices, strings, words

RADIUS, BLOCKS = 23, 8
SIMILARITY = 0.8
K = 5
PART_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"

_lanes = np.zeros((256, 8), np.uint8)
for _b in range(8):
    _lanes[:, _b] = (np.arange(256) >> _b) & 1
#: Each byte's bits spread over the eight byte lanes of a 64-bit number.
LANES = np.ascontiguousarray(_lanes).view(U64).ravel()
POPCOUNT8 = _lanes.sum(1)
#: For each byte, the bytes within RADIUS // BLOCKS bits of it.
NEAR = [[x for x in range(256) if POPCOUNT8[x ^ b] <= RADIUS // BLOCKS] for b in range(256)]


def simhash(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of hashes[f:f + n] for each (f, n): repeats weigh as often as they occur."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[firsts + counts] - total[firsts]
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(U64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class ItemIndex:
    """Items by size, with their fingerprints' block index. Built in each worker from (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]]):
        w = words(strings(pa.array([t or "" for _, t in items], pa.large_string()), lower=True))
        sh, bounds = shingles(w, K)
        sizes = np.diff(w.bounds)
        self.all = np.unique(sh)
        self.sizes: dict[int, list[int]] = {}
        self.items = []
        for i, (item, _) in enumerate(items):
            if sizes[i]:
                self.sizes.setdefault(int(sizes[i]), []).append(len(self.items))
                self.items.append((item, sh[bounds[i] : bounds[i + 1]]))
        # Sizes that a shingle belongs to, so that only windows of those sizes are looked at.
        pairs = sorted({(int(h), size) for size, found in self.sizes.items() for i in found for h in self.items[i][1].tolist()})
        self.pair_hash = np.array([h for h, _ in pairs], U64)
        self.pair_size = np.array([s for _, s in pairs], np.int64)
        self.prints, self.blocks = {}, {}
        for size, found in self.sizes.items():
            prints = np.concatenate([simhash(s, np.zeros(1, int), np.array([len(s)])) for s in (self.items[i][1] for i in found)])
            self.prints[size] = prints
            lists: list[list[list[int]]] = [[[] for _ in range(256)] for _ in range(BLOCKS)]
            for i, p in enumerate(prints.tolist()):
                for b in range(BLOCKS):
                    for x in NEAR[(p >> 8 * b) & 255]:
                        lists[b][x].append(i)
            self.blocks[size] = [(np.cumsum([0, *map(len, row)]), np.array([i for x in row for i in x], np.int64)) for row in lists]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of this size) pairs within the radius."""
        n, keys = len(self.prints[size]), []
        for b, (start, items) in enumerate(self.blocks[size]):
            value = ((prints >> U64(8 * b)) & U64(255)).astype(np.int64)
            many = start[value + 1] - start[value]
            at = np.repeat(start[value] - np.cumsum(many) + many, many) + np.arange(many.sum())
            keys.append(np.repeat(np.arange(len(prints)), many) * n + items[at])
        pairs = np.unique(np.concatenate(keys))
        i, j = pairs // n, pairs % n
        near = np.bitwise_count(prints[i] ^ self.prints[size][j]) <= RADIUS
        return i[near], j[near]

    def find(self, h: np.ndarray, n_words: int) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of verified windows of one text's shingles; the best window of each item and stretch."""
        left = np.searchsorted(self.pair_hash, h)
        right = np.searchsorted(self.pair_hash, h, side="right")
        hit = np.flatnonzero(right > left)
        out = []
        for size in sorted({int(s) for i in hit for s in self.pair_size[left[i] : right[i]]}):
            places = np.array([i for i in hit if size in self.pair_size[left[i] : right[i]]])
            per, last = max(1, size - K + 1), max(0, n_words - size)
            # All windows that hold a hit, without repeats.
            begin = np.unique(np.clip((places[:, None] - np.arange(per)[None, :]).ravel(), 0, last))
            count = np.minimum(per, len(h) - begin)
            i, j = self.candidates(size, simhash(h, begin, count))
            best: dict[int, list[tuple[int, int, float]]] = {}
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                item, own = self.items[self.sizes[size][b]]
                f, n = int(begin[a]), int(count[a])
                s = similarity(h[f : f + n], own)
                if s >= SIMILARITY:
                    runs = best.setdefault(item, [])
                    if runs and f < runs[-1][0] + size:
                        if s > runs[-1][2]:
                            runs[-1] = (f, min(size, n_words - f), s)
                    else:
                        runs.append((f, min(size, n_words - f), s))
            out += [(item, f, n, s) for item, runs in best.items() for f, n, s in runs]
        return out


def item_parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``limit`` bytes (or one item), read one partition at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull()).toLocalIterator():
        n = len((row[1] or "").encode())
        if part and size + n > limit:
            yield part
            part, size = [], 0
        part.append((row[0], row[1] or ""))
        size += n
    if part:
        yield part


def found_in(part: pa.RecordBatch, index: ItemIndex) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """Rows of the part that may hold an item, with what index.find() says of them."""
    w = words(strings(part.column("text"), lower=True))
    h, bounds = shingles(w, K)
    near = np.minimum(np.searchsorted(index.all, h), max(0, len(index.all) - 1))
    hit = index.all[near] == h if len(index.all) else np.zeros(len(h), bool)
    for r in np.unique(np.searchsorted(bounds, np.flatnonzero(hit), side="right") - 1).tolist():
        yield r, index.find(h[bounds[r] : bounds[r + 1]], int(w.bounds[r + 1] - w.bounds[r]))


def clean_rows(documents: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", limit: int = PART_BYTES) -> DataFrame:
    """The rows whose text has no match, with their own columns. Each row is judged by its own text, whatever its id, null or repeated."""
    for items in item_parts(benchmark, item_col, item_text, limit):
        shared = documents.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    stay = np.ones(len(part), bool)
                    stay[[r for r, found in found_in(part, index) if found]] = False
                    yield part.filter(pa.array(stay))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the verified windows of every text."""
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in item_parts(benchmark, item_col, item_text, limit):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, rows = part.column("doc_id").to_pylist(), []
                    for r, found in found_in(part, index):
                        rows += [(ids[r], *x) for x in found]
                    if rows:
                        yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        got = texts.mapInArrow(run, SCHEMA)
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def flags(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: doc_id, its items and its matches.

    A document has a handful of matches at most: one per item and stretch of its own text.
    """
    return matches(documents, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_matches"), F.round(F.max("similarity"), 6).alias("similarity"))

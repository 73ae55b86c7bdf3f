"""Repeated passages by De Bruijn compaction of token k-mers.

Tokens are the words `[^\\x20\\x09-\\x0D]+`, unchanged. An edge is a k-mer of ``EDGE`` consecutive words of a
document, from its first ``EDGE - 1`` words to its last. Only edges that two documents share matter:

1. Sparse graph. Each edge has a minimiser: the least-hashed run of ``SEED`` words inside it. Equal edges
   have equal minimisers. Consecutive edges of one minimiser form a segment, a path that is
   shuffled as one row with the hash of all its words; a fifth as many rows as edges. Segments of a
   minimiser that stays in one document are dropped: none of their edges is shared.
2. Repeated segments. Segments of equal words have their source in the document of least doc_id, and
   so have all their edges. Only where a minimiser has several different segments (at the ends of
   passages, mostly) are the edges of each segment's source looked at one by one.
3. Compaction. Segments and edges that follow one another in a document and whose sources follow one
   another too are a nonbranching path; a path becomes one span with one source coordinate.

4. Verification. The words of a span and those at its source coordinates are read again and must be
   the same, by 128 bits of blake2b over the words: a span that met its source by a collision of
   the hashes above goes.

A span is a repeat of an earlier document if its source document has a smaller doc_id. Null texts have
no words. Rows of a null doc_id take no part and keep everything; rows that repeat a doc_id are
one document that is looked at row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster_io import Tables, maybe_broadcast
from .text_arrays import RAW_SEPARATORS, U64, Words, sequence_hash, signed, sliding_min, slices, strings, window_hashes, words

EDGE, SEED = 13, 7
#: A seed in HOT_DOCS documents of a sample of HOT_SAMPLE of them is in more than one for certain; its rows are
#: dealt to SALTS parts. What the sample misses is only slower.
HOT_SAMPLE, HOT_DOCS, SALTS = 0.02, 8, 256
_SECOND = 0xA24BAED4963EE407
LONGEST = 15  # edges of a segment; its first word is below 2**28
SPANS = "doc_id long, start long, n_edges long, source_doc long, source_start long"


def edge_minimisers(w: Words, edge: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each edge of the slice: row, first word within the row, minimiser hash."""
    n = np.diff(w.bounds)
    per = np.maximum(n - edge + 1, 0)
    row = np.repeat(np.arange(w.rows), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    least = sliding_min(window_hashes(w.hashes, seed), edge - seed + 1)
    return row, start, least[w.bounds[:-1][row] + start]


def segments(batches: Iterator[pa.RecordBatch], edge: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(seed, g, place, doc_id): minimiser, 64 bits of hash, and 32 bits more, first word and number of edges in one number."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(strings(part.column("text")), RAW_SEPARATORS)
            row, start, least = edge_minimisers(w, edge, seed)
            new = np.ones(len(row), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            # A segment is cut where its length would not fit.
            n = np.diff(np.append(at, len(row)))
            pieces = -(-n // LONGEST)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            n = np.minimum(np.repeat(n, pieces) - within * LONGEST, LONGEST)
            at = np.repeat(at, pieces) + within * LONGEST
            first = w.bounds[:-1][row[at]] + start[at]
            end = first + n + edge - 1
            more = sequence_hash(w.hashes, first, end, _SECOND) & ~U64(0xFFFFFFFF)
            place = more | (start[at] * (LONGEST + 1) + n).astype(U64)
            yield pa.record_batch([pa.array(signed(least[at])), pa.array(signed(sequence_hash(w.hashes, first, end, 3))), pa.array(signed(place)), part.column("doc_id").take(pa.array(row[at]))], ["seed", "g", "place", "doc_id"])


def edges(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, start) of the edges of the text's wanted segments; runs beyond a text's end are cut."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(strings(part.column("text")), RAW_SEPARATORS)
            wanted = part.column("wanted")
            row = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
            flat = wanted.flatten()
            start, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "n"))
            row, offset = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(start, n) + offset
            inside = start + edge <= np.diff(w.bounds)[row]
            row, start = row[inside], start[inside]
            first = w.bounds[:-1][row] + start
            h1 = sequence_hash(w.hashes, first, first + edge, 5)
            h2 = (sequence_hash(w.hashes, first, first + edge, _SECOND + 2) >> U64(33)).astype(np.int32)
            yield pa.record_batch([pa.array(signed(h1)), pa.array(h2), part.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int32))], ["h1", "h2", "doc_id", "start"])


def with_source(frame: DataFrame, tables: Tables, *key: str) -> DataFrame:
    """Adds the first coordinate of the least doc_id among equal keys.

    Minima are taken before their shuffle and written, so that the join's own shuffle can be split where a
    key is very common.
    """
    first = tables.cut(frame.groupBy(*key).agg(F.min(F.struct("doc_id", "start")).alias("source")))
    return frame.join(maybe_broadcast(first, 96), list(key)).withColumns({"source_doc": F.col("source.doc_id"), "source_start": F.col("source.start")}).drop("source")


def digests_at(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_edges, digest) of the wanted runs of each text: 128 bits of blake2b over the words themselves."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(strings(part.column("text")), RAW_SEPARATORS, hashed=False)
            ids, places, sizes, got = [], [], [], []
            for r, (doc, wanted) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("wanted").to_pylist(), strict=True)):
                a, z = int(w.bounds[r]), int(w.bounds[r + 1])
                for x in wanted:
                    i, j = a + x["start"], a + x["start"] + x["n_edges"] + edge - 1
                    if j > z:  # another row of the same doc_id has this run
                        continue
                    h = hashlib.blake2b(digest_size=16)
                    for s, e in zip(w.starts[i:j].tolist(), w.ends[i:j].tolist(), strict=True):
                        h.update(w.data[s:e])
                        h.update(b" ")
                    ids.append(doc)
                    places.append(x["start"])
                    sizes.append(x["n_edges"])
                    got.append(h.digest())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(got, pa.binary())], ["doc_id", "start", "n_edges", "digest"])


def verified(found: DataFrame, docs: DataFrame, edge: int, tables: Tables) -> DataFrame:
    """The spans whose words equal those at their source coordinates."""
    own, source = found.select("doc_id", "start", "n_edges"), found.select(F.col("source_doc").alias("doc_id"), F.col("source_start").alias("start"), "n_edges")
    run = F.struct("start", "n_edges")
    # A source may be named very often: its runs come in parts.
    wanted = tables.cut(own.unionByName(source).distinct().groupBy("doc_id", F.pmod(F.xxhash64("start"), F.floor(F.col("start") / 4096) + 1).alias("part")).agg(F.collect_list(run).alias("wanted")).drop("part"))
    read = docs.join(maybe_broadcast(wanted, 16, array="wanted"), "doc_id").select("doc_id", "text", "wanted").mapInArrow(lambda b: digests_at(b, edge), "doc_id long, start long, n_edges long, digest binary")
    read = tables.cut(read.distinct(), wanted)
    at = maybe_broadcast(read, 160)
    there = at.select(F.col("doc_id").alias("source_doc"), F.col("start").alias("source_start"), "n_edges", F.col("digest").alias("source_digest"))
    both = found.join(at, ["doc_id", "start", "n_edges"]).join(there, ["source_doc", "source_start", "n_edges"]).where("digest = source_digest")
    return tables.cut(both.select(*found.columns).distinct(), found, read)


def spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """Compacted paths (SPANS): ``n_edges`` edges from word ``start`` of a document repeat its source from ``source_start``."""
    tables = Tables(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kind = "seed long, g long, place long, doc_id long"
    found = docs.mapInArrow(lambda b: segments(b, edge, seed), kind)
    sample = docs.sample(HOT_SAMPLE, seed=1).mapInArrow(lambda b: segments(b, edge, seed), kind)
    hot = tables.cut(sample.groupBy("seed").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= HOT_DOCS).select("seed", F.lit(True).alias("hot")))
    salted = found.join(maybe_broadcast(hot, 32), "seed", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS - 1)) + 1).otherwise(0)).drop("hot")
    # One shuffle: a seed's rows meet in a sorted stream, and a hot seed's need not meet.
    meet = Window.partitionBy("seed", "salt")
    shared = salted.withColumns({"x": F.min("doc_id").over(meet), "y": F.max("doc_id").over(meet)}).where("salt > 0 or x < y")
    low = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    shared = tables.cut(shared.select("seed", "g", F.shiftright("place", 32).cast("int").alias("more"), "doc_id", F.shiftright(low, 4).cast("int").alias("start"), low.bitwiseAND(F.lit(LONGEST)).cast("int").alias("n")), hot)
    left = tables.cut(with_source(shared, tables, "g", "more").select("seed", "doc_id", "start", "n", "source_doc", "source_start"), shared)
    runs = left.where("source_doc < doc_id").select("doc_id", "start", "n", "source_doc", "source_start")
    own = left.where("source_doc = doc_id")
    # A source stands for one content: a seed of several sources has segments of different words.
    source = F.struct("source_doc", "source_start")
    several = tables.cut(own.groupBy("seed").agg(F.min(source).alias("x"), F.max(source).alias("y")).where("x <> y").select("seed"))
    wanted = tables.cut(own.join(maybe_broadcast(several, 16), "seed").groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("wanted")), several)
    texts = docs.join(maybe_broadcast(wanted, 16, array="wanted"), "doc_id").select("doc_id", "text", "wanted")
    single = tables.cut(texts.mapInArrow(lambda b: edges(b, edge), "h1 long, h2 int, doc_id long, start int"), wanted)
    repeats = with_source(single, tables, "h1", "h2").where("source_doc < doc_id").select("doc_id", "start", F.lit(1).alias("n"), "source_doc", "source_start")
    runs = runs.unionByName(repeats).distinct()
    order = Window.partitionBy("doc_id").orderBy("start")
    last = lambda c: F.lag(c).over(order)
    step = (F.col("start") == last("start") + last("n")) & (F.col("source_doc") == last("source_doc")) & (F.col("source_start") == last("source_start") + last("n"))
    path = runs.withColumn("new", F.when(step, 0).otherwise(1)).withColumn("path", F.sum("new").over(order))
    paths = tables.cut(path.groupBy("doc_id", "path").agg(F.min("start").cast("long").alias("start"), F.sum("n").alias("n_edges"), F.min("source_doc").alias("source_doc"), F.min("source_start").cast("long").alias("source_start")).drop("path"), left, single)
    return verified(paths, docs, edge, tables)


def kept(batches: Iterator[pa.RecordBatch], edge: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(strings(part.column("text")), RAW_SEPARATORS, hashed=False)
            n_words, removed, digest = np.diff(w.bounds), [], []
            for r, spans in enumerate(part.column("spans").to_pylist()):
                stay = np.ones(n_words[r], bool)
                for s in spans or []:
                    stay[s["start"] : s["start"] + s["n_edges"] + edge - 1] = False
                a = int(w.bounds[r])
                at = np.flatnonzero(stay) + a
                raw = w.data[w.starts[a] : w.ends[w.bounds[r + 1] - 1]].tobytes() if n_words[r] else b""
                shift = int(w.starts[a]) if n_words[r] else 0
                text = b" ".join([raw[s:e] for s, e in zip((w.starts[at] - shift).tolist(), (w.ends[at] - shift).tolist(), strict=True)])
                removed.append(int(n_words[r] - len(at)))
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch([part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", edge: int = EDGE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, its repeats of earlier documents removed."""
    by_doc = Tables(documents.sparkSession).cut(spans(documents, id_col, text_col, edge, seed).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_edges")).alias("spans")))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.join(maybe_broadcast(by_doc, 16, array="spans"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(lambda b: kept(b, edge), "doc_id long, n_words long, n_removed long, kept_sha256 string")

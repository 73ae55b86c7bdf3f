"""Byte-level BPE by overlapping chunks.

A text is cut into overlapping chunks of characters. Each chunk is pre-tokenised by itself; neighbours are
stitched at the first place in their overlap where both have a pre-token boundary, for from there on their
pre-tokens are the same. The pieces between stitches are then encoded, in parallel threads for texts of many
pieces. Decoding joins the raw bytes of the ids. A text of at most one chunk is one piece.

A boundary is used for a stitch only if the pre-token before it does not end in white space:
white space is the only thing the pattern looks beyond a match for, so a piece that ends in
another character has the same pre-tokens alone as inside its text. Where an overlap has no such
place (one run of a single class, say), the pre-tokens of the text itself are followed from the last stitch to the
first safe boundary beyond the chunk's start, and the chunks that lie within are passed over: each character is
looked at a bounded number of times, whatever the text.

Null texts encode as empty ones; an empty text has no ids. Ids are those of one tiktoken encoding
of the whole text without special tokens; tests check that against every chunk size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text_arrays import slices

CHUNK_CHARS = 1 << 12
OVERLAP_CHARS = 1 << 8
MANY_PIECES = 64
SLICE_BYTES = 4 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Ranks of a tiktoken file, loaded once in each worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("tessera", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]

    def encode(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, threads: int = 2) -> list[int]:
        if len(text) <= chunk:
            return self.encoding.encode_ordinary(text)
        pieces = self.pieces(text, chunk, overlap)
        if len(pieces) < MANY_PIECES:
            return [i for piece in pieces for i in self.encoding.encode_ordinary(piece)]
        with ThreadPoolExecutor(threads) as pool:
            return [i for ids in pool.map(self.encoding.encode_ordinary, pieces) for i in ids]

    def boundaries(self, text: str, start: int, stop: int, low: int, high: int) -> set[int]:
        """Safe boundaries in [low, high] that pre-tokens of text[start:stop] end at."""
        found = set()
        for m in self.pattern.finditer(text, start, stop):
            end = m.end()
            if end > high or (end == stop and stop < len(text)):  # the last one may be cut short
                break
            if end >= low and not text[end - 1].isspace():
                found.add(end)
        return found

    def pieces(self, text: str, chunk: int, overlap: int) -> list[str]:
        """The text cut at stitches of neighbouring chunks."""
        starts = list(range(0, len(text), chunk))

        def zones(i: int) -> tuple[set[int], set[int]]:
            """Boundaries of chunk i at its head and in its overlap with the next one."""
            a, b = starts[i], min(len(text), starts[i] + chunk)
            stop = min(len(text), b + overlap)
            return self.boundaries(text, a, min(len(text), a + overlap + 1), a, a + overlap), self.boundaries(text, a, stop, b, stop)

        found = [zones(i) for i in range(len(starts))]
        cuts, synced = [0], True  # synced: chunk i - 1 keeps the text's own boundaries from starts[i] on
        for i in range(1, len(starts)):
            if starts[i] < cuts[-1]:  # inside of what the last stitch went past
                synced = False
                continue
            at = min(found[i - 1][1] & found[i][0], default=None) if synced else None
            if at is None:
                low = max(starts[i], cuts[-1] + 1)
                at = next((m.end() for m in self.pattern.finditer(text, cuts[-1]) if m.end() >= low and not text[m.end() - 1].isspace()), None)
                if at is None:  # no safe place is left
                    break
            synced = at in found[i][0]
            if at > cuts[-1]:
                cuts.append(at)
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if b > a]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(frame: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = [c.encode(t or "", chunk, overlap) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return frame.select(frame[id_col].cast("long").alias("doc_id"), frame[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digests(frame: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, ids and bytes made in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n, a, b = [], [], []
                for t in part.column("text").to_pylist():
                    ids = c.encode(t or "", chunk, overlap)
                    n.append(len(ids))
                    a.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.select(frame[id_col].cast("long").alias("doc_id"), frame[text_col].alias("text")).mapInArrow(run, SCHEMA)


def decode(frame: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary), the raw bytes of the ids; the caller's other columns stay."""
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            got = pa.array([c.decode(x or []) for x in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.record_batch([*[batch.column(x) for x in names], got], [*names, "decoded"])

    from pyspark.sql import types as T

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField("decoded", T.BinaryType())]))


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of an installed public vocabulary, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN

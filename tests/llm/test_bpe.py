import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe

from .helpers import docs, empty

PATH, PATTERN = bpe.tokenizer_file()


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (33, 20), (50, 7), (200, 60)])
def test_chunks_encode_like_the_whole_text(chunk, overlap):
    c, rng = bpe.codec(PATH, PATTERN), random.Random(chunk)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "!", "?!", "日本", "\r\n ", "\u00a0"]
    for k in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 500))) + ("x" * 300 + " y" * 40 + " " * 90) * (k % 9 == 0)
        ids = c.encode(text, chunk, overlap)
        assert ids == c.encoding.encode_ordinary(text)
        assert c.decode(ids).decode() == text


def test_rows(spark):
    texts = ["Hello world", "", None, "x" * 150_000 + " end", "same", "same"]
    rows = bpe.digests(docs(spark, texts), PATH, PATTERN).orderBy("doc_id").collect()
    c = bpe.codec(PATH, PATTERN)
    for r, t in zip(rows, texts, strict=True):
        ids = c.encoding.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty(spark), PATH, PATTERN).count() == 0


def test_round_trip_of_frames(spark):
    out = bpe.decode(bpe.encode(docs(spark, ["añb c", None]), PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").select(F.col("decoded").cast("string")).collect()
    assert [r[0] for r in out] == ["añb c", ""]


def test_long_texts_of_the_data_are_stitched(spark):
    c = bpe.codec(*bpe.tokenizer_file())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text and len(r.text) > 2 * bpe.CHUNK_CHARS]
    pieces = [c.pieces(t, bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS) for t in texts]
    assert len(texts) > 20 and sum(len(p) > 1 for p in pieces) > 0.9 * len(texts)
    assert all("".join(p) == t for p, t in zip(pieces, texts, strict=True))
    assert all(c.encode(t) == c.encoding.encode_ordinary(t) for t in texts)


def test_runs_of_one_class_take_linear_time():
    c = bpe.codec(PATH, PATTERN)
    for text in (" " * 10_000_000, "a" * 10_000_000, " " * 3_000_000 + "hello world " * 50_000):
        start = time.monotonic()
        assert "".join(c.pieces(text, bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS)) == text
        assert time.monotonic() - start < 10
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", " ", "\n", "1", "中", "a" * 30, " " * 40, "hello"]) for _ in range(rng.randint(0, 60)))
        assert c.encode(text, rng.randint(1, 40), rng.randint(0, 50)) == c.encoding.encode_ordinary(text)

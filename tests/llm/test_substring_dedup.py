import hashlib
import random
import re

from tessera.llm import substring_dedup as S

from .helpers import docs, empty, sentence


def expected(texts, k=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, w in enumerate(words):
        gone = {j + d for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for d in range(k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    pool = [sentence(rng, n) for n in (13, 14, 20, 60, 200)] + ["a b " * 30, "x " * 40]
    texts = []
    for _ in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.6 else sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        t = rng.choice([" ", "\n", "\t ", "\u00a0"]).join(parts)
        if rng.random() < 0.3:
            w = t.split(" ")
            del w[rng.randrange(len(w))]
            t = " ".join(w)
        texts.append(t)
    texts += ["", None, "short", texts[0], texts[1] + " " + texts[1]]
    got = sorted(tuple(r) for r in S.digests(docs(spark, texts)).collect())
    assert got == expected(texts)


def test_spans_point_at_their_source(spark):
    rng = random.Random(2)
    passage = sentence(rng, 50)
    texts = [sentence(rng, 7) + " " + passage + " tail", "head " + passage]
    (row,) = S.spans(docs(spark, texts)).collect()
    assert (row.doc_id, row.start, row.n_edges, row.source_doc, row.source_start) == (1, 1, 38, 0, 7)


def test_awkward_rows(spark):
    t = " ".join(f"w{i}" for i in range(20))
    out = S.digests(docs(spark, ["NULLID", t, t, t]).unionByName(docs(spark, [t], 1))).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 0, 20, 20]
    assert S.digests(empty(spark)).count() == 0


def test_words_at_the_source_decide(spark):
    # A span that met a wrong source, as after a collision of hashes, does not pass.
    from tessera.llm.cluster_io import Tables

    rng = random.Random(3)
    a, b = sentence(rng, 30), sentence(rng, 30)
    d = docs(spark, [a, b, a]).select("doc_id", "text")
    tables = Tables(spark)
    found = tables.cut(spark.createDataFrame([(1, 0, 18, 0, 0), (2, 0, 18, 0, 0), (2, 3, 10, 0, 4)], S.SPANS))
    assert [tuple(r) for r in S.verified(found, d, 13, tables).collect()] == [(2, 0, 18, 0, 0)]

import random
from collections import Counter

import numpy as np
from tessera.llm import near_dedup as N

from .helpers import docs, empty, sentence


def weights(text, k=5):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in keys) for d in set(a) & set(b))


def test_similarity_is_the_definition():
    rng = random.Random(1)
    for _ in range(40):
        a = {i: rng.randint(1, 3) for i in rng.sample(range(30), 15)}
        b = {i: rng.randint(1, 3) for i in rng.sample(range(30), 15)}
        pack = lambda x: (np.array(sorted(x), np.uint64), np.array([x[i] for i in sorted(x)], np.uint32))
        assert abs(N.similarity(*pack(a), *pack(b)) - jp(Counter(a), Counter(b))) < 1e-9


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    common, own = rng.integers(1, 2**63, 160).astype(np.uint64), rng.integers(1, 2**63, 80).astype(np.uint64)
    a, b = np.sort(np.concatenate([common, own[:40]])), np.sort(np.concatenate([common, own[40:]]))
    h, bounds = np.concatenate([a, b]), np.array([0, 200, 400])
    got = N.sketches(h, np.ones(400, np.int64), bounds, 2000)
    assert abs((got[0] == got[1]).mean() - 160 / 240) < 0.04
    # Doubled weights change nothing.
    again = N.sketches(h, np.full(400, 2), bounds, 2000)
    assert (again == got).all()


def expected(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    w = [weights(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if w[i] == w[j] or (w[i] and w[j] and jp(w[i], w[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_against_brute_force(spark):
    rng, texts = random.Random(7), []
    for k in range(14):
        base = sentence(rng, rng.randint(30, 90)).split()
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper() + "!", "one two", "one two", "three", "", None, sentence(rng, 40) + " again" * 60]
    rng.shuffle(texts)
    rows = N.classes(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    want = expected(texts)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    size = Counter(want)
    assert all(r.class_size == size[r.class_id] for r in rows)
    kept = {r.doc_id for r in N.survivors(docs(spark, texts)).collect()}
    assert kept == set(want)


def test_chain_of_copies_is_one_class(spark):
    # Each text is near its neighbour only: links must carry over, whatever the leader of a bucket is.
    rng = random.Random(11)
    words, texts = sentence(rng, 120).split(), []
    for k in range(25):
        texts.append(" ".join(words))
        for j in range(3):
            words[(k * 5 + j) % 120] = f"step{k}x{j}"
    got = {r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert got == set(expected(texts))


def test_repetitive_text_with_an_addition(spark):
    # One distinct shingle of weight 1001 against over 20 shingles: J_P is near 1 all the same.
    long = "w " * 1005
    texts = [long, long + sentence(random.Random(5), 20), long + sentence(random.Random(6), 30), sentence(random.Random(8), 40)]
    want = expected(texts)
    assert want == [0, 0, 0, 3]
    assert {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()} == dict(enumerate(want))


def test_awkward_rows(spark):
    d = docs(spark, ["NULLID", None, "", "a b c d e f", "a b c d e f"]).unionByName(docs(spark, ["a b c d e f"], 3))
    rows = N.classes(d).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows if r.doc_id is not None) == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    assert N.classes(empty(spark)).count() == 0
    assert N.survivors(d).count() == 4 and set(N.survivors(d).columns) == set(d.columns)


def looked_at(monkeypatch, module):
    """The numbers of pairs that each call of verify is given."""
    got, link = [], module.link

    def counted(buckets, verify, narrow, tables):
        return link(buckets, lambda pairs: got.append(pairs.count()) or verify(pairs), narrow, tables)

    monkeypatch.setattr(module, "link", counted)
    return got


def test_texts_of_one_heavy_shingle_are_not_paired(spark, monkeypatch):
    """Template texts share buckets, but no two of them are alike: their pairs would be a third of all."""
    rng = random.Random(21)
    texts = ["buy now " * 30 + sentence(rng, 30) for _ in range(500)]
    texts += [texts[7] + " end", texts[8].replace("buy", "buy now", 1)]
    got = looked_at(monkeypatch, N)
    classes = {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()}
    assert sum(got) < 12 * len(texts)
    assert classes == {i: i for i in range(500)} | {500: 7, 501: 8}


def test_copies_too_far_from_each_other(spark, monkeypatch):
    """Copies of one text with some words altered: some are linked to it, most to nothing, a few to each other only."""
    rng = random.Random(22)
    base, texts = sentence(rng, 150).split(), []
    for k in range(240):
        copy = list(base)
        for i in rng.sample(range(150), rng.randint(1, 12)):
            copy[i] = sentence(rng, 1)
        texts.append(" ".join(copy))
        if k % 20 == 0:
            texts.append(" ".join([*copy, "more"]))
    want = expected(texts)
    assert 40 < len(set(want)) < 220
    got = looked_at(monkeypatch, N)
    assert {r.doc_id: r.class_id for r in N.classes(docs(spark, texts)).collect()} == dict(enumerate(want))
    assert sum(got) < 12 * len(texts)


def test_few_links_are_joined_without_a_shuffle(spark, monkeypatch):
    """Repeated and reversed edges, and nulls: one table is written, and the groups are right."""
    written, cut = [], N.Tables.cut
    monkeypatch.setattr(N.Tables, "cut", lambda self, frame, *spent: written.append(frame) or cut(self, frame, *spent))
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 2), (5, 6), (7, 7), (None, 1)], "a long, b long")
    got = {(r.node, r.comp) for r in N.components(edges, N.Tables(spark)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert len(written) == 1 and "Exchange hashpartitioning" not in written[0]._jdf.queryExecution().toString()


def test_repeated_ids_with_several_texts_are_one_document(spark):
    """A doc_id on many rows, with equal and with different texts: linked to what any of its texts is linked to, one row for each row."""
    rng = random.Random(31)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (1, b), (2, a + " end"), (3, b + " end"), (4, c), (5, c), (5, c), (6, sentence(rng, 60)), (None, a)]
    got = sorted(map(tuple, N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 2), 5: (4, 2), 6: (6, 1), None: (None, None)}
    assert got == sorted(((d, *want[d]) for d, _ in rows), key=str)

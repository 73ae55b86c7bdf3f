import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import quality_net as Q

from .helpers import docs, empty, sentence


def tokens_of(text):
    return [m[0] for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|([^A-Za-z0-9\x80-\xff\x20\x09-\x0d])\1*", text.encode())]


TEXTS = ["one two, two !!! three", "", "  ", "a b a b a", "é!!?? $$", "x", "one two"]


def test_tokens_and_neighbours_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 3)
    bucket, bounds = Q.tokens(pa.array(TEXTS, pa.large_string()))
    assert [len(tokens_of(t)) for t in TEXTS] == np.diff(bounds).tolist()
    name = {}
    for row, text in enumerate(TEXTS):
        for t, b in zip(tokens_of(text), bucket[bounds[row] : bounds[row + 1]], strict=True):
            assert name.setdefault(t, b) == b
    index = Q.index_vectors()
    assert (np.abs(index).sum(1) == Q.NONZERO).all()
    want, got = np.zeros((Q.BUCKETS, Q.WIDTH), np.int64), np.zeros((Q.BUCKETS, Q.WIDTH), np.int64)
    for text in TEXTS:
        t = tokens_of(text)
        for i, x in enumerate(t):
            for j in range(max(0, i - Q.REACH), min(len(t), i + Q.REACH + 1)):
                want[name[x]] += (i != j) * index[name[t[j]]].astype(np.int64)
    Q.neighbour_sums(bucket, bounds, index, got)
    assert (got == want).all() and want.any()


def test_pooling_equals_means_of_vectors(monkeypatch):
    table = np.random.default_rng(1).normal(size=(Q.BUCKETS, 6)).astype(np.float32)
    bucket, bounds = Q.tokens(pa.array(TEXTS, pa.large_string()))
    for block in (2, 3, 1 << 17):
        monkeypatch.setattr(Q, "BLOCK", block)
        got = Q.pool(bucket, bounds, table)
        for row in range(len(TEXTS)):
            v = table[bucket[bounds[row] : bounds[row + 1]]].astype(float)
            if len(v):
                alike = [sum(a[h] @ b[h] for a, b in zip(v, v[d:], strict=False)) / len(v) for d in (1, 2) for h in (slice(0, 3), slice(3, 6))]
                np.testing.assert_allclose(got[row], [*v.mean(0), *v.std(0), *alike], atol=1e-3)
            else:
                assert not got[row].any()


def test_contexts_are_those_of_all_rows(spark):
    texts = [sentence(random.Random(i), 40) for i in range(60)]
    want = np.zeros((Q.BUCKETS, Q.WIDTH), np.int64)
    Q.neighbour_sums(*Q.tokens(pa.array(texts, pa.large_string())), Q.index_vectors(), want)
    assert (Q.contexts(docs(spark, texts).repartition(7)) == want).all()


def corpus(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = sentence(rng, rng.randint(10, 80)).split()
        bad = i % 5 == 0
        if bad:
            words = [w + rng.choice(["***", "&&&"]) for w in words] if i % 10 else [w for w in words[:6] for _ in range(9)]
        out.append((" ".join(words), int(not bad)))
    return out


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus(900, 3)
    d = docs(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = Q.train(d, labels)
    got = {r.doc_id: r for r in Q.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == rows[i][1] for i in held]) > 0.95
    p, y = np.array([got[i].score for i in held]), np.array([rows[i][1] for i in held])
    loss = -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)))
    assert loss < 0.15 and abs(p.mean() - y.mean()) < 0.05
    # Labels of rows that are held out, and repeats with two labels, change nothing.
    other = labels.where(Q.held_out(labels.doc_id)).selectExpr("doc_id", "1 - quality quality")
    both = spark.createDataFrame([(10_000, 0), (10_000, 1)], labels.schema)
    again = Q.train(d, labels.where(~Q.held_out(labels.doc_id)).unionByName(other).unionByName(both))
    assert (again.net.w1 == model.net.w1).all() and again.net.temperature == model.net.temperature


def test_temperature_is_the_best_divisor():
    rng = np.random.default_rng(2)
    logit = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(int)
    assert abs(Q.temperature(3 * logit, y, np.ones(4000)) - 3) < 0.4


def test_gradient_descends_to_a_separating_net():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no linear rule
    net = Q.fit_net(x, y, np.ones(600))
    assert ((net.probability(x) > 0.5) == (y == 1)).mean() > 0.95


def test_awkward_rows(spark):
    rows = corpus(200, 5)
    d = docs(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = Q.train(d, labels)
    odd = docs(spark, [None, "", " \n", "NULLID", "same text here", "same text here", "x***" * 200_000, "wort " * 100_000])
    got = {r.doc_id: r for r in Q.score(odd, model).collect()}
    assert len(got) == 8 and got[0].score == got[1].score == got[2].score == 0 and got[4].score == got[5].score
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert Q.score(empty(spark), model).count() == 0
    none = Q.train(empty(spark), labels)
    assert {r.score for r in Q.score(d, none).collect()} == {0.0}
    one = Q.train(d, labels.where("quality = 1"))
    assert {r.score for r in Q.score(d, one).collect()} == {1.0}

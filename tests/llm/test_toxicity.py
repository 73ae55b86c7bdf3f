import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import toxicity as T

from .helpers import docs, empty, sentence


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = T.Field(np.zeros(T.BUCKETS), rng.normal(size=4), np.zeros(3))
    lengths = [1, 2, 3, 5, 5, 8, 0, 4]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    e = np.exp(rng.normal(size=bounds[-1]))
    pairs = np.zeros(4)
    got = field.marginals(e, bounds, pairs)
    start, enter, leave, stay = np.exp(field.chain)
    expected = np.zeros(4)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        total, hits, counts = 0.0, np.zeros(b - a), np.zeros(4)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = (start if y[0] else 1.0) * np.prod([e[a + i] for i in range(b - a) if y[i]])
            steps = list(zip(y[:-1], y[1:], strict=True))
            for s in steps:
                p *= {(0, 0): 1.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}[s]
            total += p
            hits += p * np.array(y)
            counts += p * np.array([y[0], steps.count((0, 1)), steps.count((1, 0)), steps.count((1, 1))])
        np.testing.assert_allclose(got[a:b], hits / total, rtol=1e-9)
        expected += counts / total
    np.testing.assert_allclose(pairs, expected, rtol=1e-9)


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(5, 80)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["vileness", "Vile", "rotgut", "scumly"]) + rng.choice(["", "est", "ish"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_offsets(spark):
    texts, labels = corpus()
    d = docs(spark, texts)
    l = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    field = T.train(d, l)
    rows = T.score(d, field).orderBy("doc_id").collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out]
    assert len(held) > 20 and sum(p == y for p, y in held) / len(held) > 0.95
    for r in rows:
        for s in r.spans or []:
            assert texts[r.doc_id][s.start : s.stop].lower().startswith(("vile", "rot", "scum"))
    assert sum(bool(r.spans) for r in rows) > 40


def test_sample_is_refilled(spark):
    # Rows that are too long or have no document take no place in the sample.
    texts, labels = corpus(200)
    texts = [t if i % 5 else t + " word" * 3000 for i, t in enumerate(texts)]
    got = []
    whole, T.fit = T.fit, lambda texts, labels: got.extend(labels)
    try:
        T.train(docs(spark, texts), spark.createDataFrame([(i, labels[i % 200]) for i in range(1000)], "doc_id long, toxic int"), per_class=25)
    finally:
        T.fit = whole
    assert got.count(0) == got.count(1) == 25


def test_lexicon_of_rare_words():
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(100)]
    texts, labels = [], []
    for i in range(2200):
        words = sentence(rng, rng.randint(10, 30)).split()
        if i % 2:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(lexicon))
        texts.append(" ".join(words))
        labels.append(i % 2)
    # Each word is in about 20 of 1000 toxic texts.
    field = T.fit(texts[:2000], labels[:2000])
    w, features = T.tokens(pa.array(texts[2000:], pa.large_string()))
    p = field.marginals(field.emissions(features), w.bounds)
    got = field.score(*T.summary(p, w.bounds)) >= 0.5
    assert (got == np.array(labels[2000:])).mean() > 0.95


def test_awkward_rows(spark):
    field = T.fit(*corpus(120))
    rows = T.score(docs(spark, [None, "", "NULLID", "vile é vileness", "a b", "a b", "x " * 50_000]), field).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score < 0.5 and by[4].score == by[5].score and by[3].predicted == 1
    assert T.score(empty(spark), field).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(docs(spark, ["a"]), T.train(docs(spark, ["a"]), none)).first().score < 0.5


def test_held_out_rule(spark):
    import zlib

    got = spark.range(50).select("id", T.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_features_fold_case():
    _, a = T.tokens(pa.array(["Idiot idiot IDIOT"], pa.large_string()))
    assert (a[0] == a[1]).all() and (a[1] == a[2]).all()

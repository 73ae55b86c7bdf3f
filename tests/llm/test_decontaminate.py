import random

import numpy as np
from tessera.llm import decontaminate as D

from .helpers import docs, empty, sentence


def shingle_set(words, k=5):
    out = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    return out


def brute(text, item):
    """Best weighted Jaccard of the item with the text's windows of its size."""
    from collections import Counter

    w, v = text.lower().split(), item.lower().split()
    own, best = Counter(shingle_set(v)), 0.0
    for i in range(max(1, len(w) - len(v) + 1)):
        c = Counter(shingle_set(w[i : i + len(v)]))
        best = max(best, sum((c & own).values()) / max(1, sum((c | own).values())))
    return best


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [sentence(rng, n) for n in (8, 15, 30, 30, 60)]
    texts = []
    for k in range(60):
        words = sentence(rng, rng.randint(5, 120)).split()
        if k % 2:
            item = rng.choice(items).split()
            for _ in range(rng.randint(0, 3)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs(spark, texts), bench).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if brute(t, x) >= 0.8}
    assert got == want and want


def test_block_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    index = D.ItemIndex([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(30)])
    own = index.prints[12]
    masks = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(2000)]
    prints = np.array([int(own[rng.integers(30)]) ^ m for m in masks], np.uint64)
    got = set(zip(*(x.tolist() for x in index.candidates(12, prints)), strict=True))
    want = {(i, j) for i in range(len(prints)) for j in range(30) if int(prints[i] ^ own[j]).bit_count() <= D.RADIUS}
    assert got == want


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "short item"), (None, "x y z"), (5, "one two three four five six seven eight")], "item_id long, text string")
    texts = [None, "", "One, two three FOUR five six seven eight!", "short item", "NULLID", "one two three four five six seven eight " * 3]
    got = {(r.doc_id, tuple(r.item_ids)) for r in D.flags(docs(spark, texts), bench).collect()}
    assert got == {(2, (1, 5)), (3, (4,)), (5, (1, 5))}
    assert D.flags(empty(spark), bench).count() == 0
    assert D.flags(docs(spark, texts), bench.limit(0)).count() == 0
    # A benchmark over the limit takes more passes and finds the same.
    again = {(r.doc_id, r.item_id) for r in D.matches(docs(spark, texts), bench, limit=10).collect()}
    assert again == {(r.doc_id, r.item_id) for r in D.matches(docs(spark, texts), bench).collect()}

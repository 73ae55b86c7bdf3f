"""Text search and text columns against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import neighbours, screening
from tessera.operators.predictor import EvidenceRegressor
from tessera.operators.profile import ColumnSpec
from tessera.operators.text_index import TextIndex
from tessera.operators.text_svd import TextSVD, TooFewGrams

WORDS = "amber basil cedar delta ember fable grove hazel ivory jolly karma lemon mango north ocean pearl quiet river solar tulip".split()


def texts(spark, n, seed=0, common="the shop "):
    draw = np.random.default_rng(seed)
    rows = [(i, common + " ".join(draw.choice(WORDS, 4)), float(draw.integers(0, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, x double")


def vectors(frame):
    counts = neighbours.gram_counts(frame, "id", F.col("text"))
    return neighbours.sparse_vectors(counts, neighbours.gram_weights(counts, frame.count()))


def matrix(v):
    rows = v.collect()
    grams, ids = sorted({r["gram"] for r in rows}), sorted({r["id"] for r in rows})
    out = np.zeros((len(ids), len(grams)))
    place = {g: i for i, g in enumerate(grams)}
    for r in rows:
        out[ids.index(r["id"]), place[r["gram"]]] = r["w"]
    return ids, grams, out


def test_text_search_equals_all_pairs_and_skips_long_lists(spark):
    v = vectors(texts(spark, 400)).cache()
    ids, _, a = matrix(v)
    index = TextIndex(digits=9).fit(v)
    found = {(r["id"], r["rank"]): (r["train_id"], r["similarity"]) for r in index.nearest(v.where("id % 20 = 0"), 5).collect()}
    for i in ids[::20]:
        s = np.round(a[ids.index(i)] @ a.T, 9)
        for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:5], 1):  # noqa: B023
            assert found[i, rank][1] == pytest.approx(s[j], abs=2e-9) and found[i, rank][0] == ids[j]
    # The words that all texts share are never joined.
    assert 0 < index.joined < 0.5 * index.all


def test_equal_texts_are_compared_once(spark):
    one = texts(spark, 30, 5)
    copies = one.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).select((F.col("id") * 12 + (F.col("copy") * 7 + F.col("id")) % 12).alias("id"), "text").repartition(4)
    v = vectors(copies).cache()
    ids, _, a = matrix(v)
    index = TextIndex(digits=9).fit(v)
    found = {(r["id"], r["rank"]): r["train_id"] for r in index.nearest(v.where("id % 20 = 0"), 15).collect()}
    s = np.round(a @ a.T, 9)
    assert found == {(i, rank): ids[j] for n, i in enumerate(ids) if i % 20 == 0 for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[n, j], ids[j]))[:15], 1)}  # noqa: B023
    # 18 queries of 30 texts: as many list rows as their different texts have among 30, not among 360.
    assert index.size == 30 and 0 < index.all <= v.where("id % 20 = 0").count() * 30
    pairs = spark.createDataFrame([(0, ids[1]), (0, ids[40]), (20, ids[41])], "id long, train_id long")
    got = {(r["id"], r["train_id"]): r["similarity"] for r in index.similarities(pairs, v).collect()}
    assert all(abs(x - s[ids.index(i), ids.index(j)]) < 2e-9 for (i, j), x in got.items()) and len(got) == 3


def test_text_search_edges(spark):
    kind = "id long, gram string, w double"
    v = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.6), (2, "b", 0.8), (3, None, 1.0), (None, "a", 1.0), (4, "a", 1.0)], kind)
    index = TextIndex().fit(v)
    got = [(r["id"], r["train_id"], r["rank"]) for r in index.nearest(spark.createDataFrame([(9, "a", 1.0), (8, "z", 1.0), (7, None, 1.0)], kind), 2).orderBy("id", "rank").collect()]
    assert got == [(9, 1, 1), (9, 4, 2)]
    assert index.nearest(v.limit(0), 3).count() == 0
    assert TextIndex().fit(v.limit(0)).nearest(v, 3).count() == 0
    with pytest.raises(TesseraError):
        TextIndex().fit(v.withColumn("w", -F.col("w")))


def test_cases_by_text_and_numbers_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 0)
    frame = texts(spark, 240, 3).withColumn("y", F.col("x") * 2)
    train, test = frame.where("id >= 12"), frame.where("id < 12")
    model = EvidenceRegressor("y", "id", spec=ColumnSpec(numeric=["x"], text="text"), models=[], n_examples=3, check_leakage=False, neighbour_weight=2.0).fit(train)
    found = {(r["id"], r["rank"]): r["similarity"] for r in model.examples(test).collect()}
    counts = neighbours.gram_counts(train, "id", F.col("text"))
    weights = neighbours.gram_weights(counts, train.count()).cache()
    sides = [{}, {}]
    for side, rows in zip(sides, (test, train), strict=True):
        for r in neighbours.sparse_vectors(neighbours.gram_counts(rows, "id", F.col("text")), weights).collect():
            side.setdefault(r["id"], {})[r["gram"]] = r["w"]
    x = {r["id"]: r["x"] for r in frame.collect()}
    spread = np.std([x[i] for i in sides[1]])
    for i, a in sides[0].items():
        every = sorted((sum(w * b.get(g, 0.0) for g, w in a.items()) - 2.0 * abs(x[i] - x[j]) / spread for j, b in sides[1].items()), reverse=True)
        assert [found[i, r] for r in (1, 2, 3)] == pytest.approx(every[:3], abs=1e-9)


def test_svd_equals_numpy(spark):
    frame = texts(spark, 150, 5)
    model = TextSVD(components=6, passes=12).fit(frame, "id", "text")
    v = vectors(frame)
    _, grams, a = matrix(v)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert [g for g, _, _ in model.grams] == grams
    assert model.singular == pytest.approx(s[:6], rel=1e-3)
    assert np.abs((model.loadings * vt[:6].T).sum(axis=0))[:3] == pytest.approx(np.ones(3), abs=1e-3)
    got = {r["id"]: r["x"] for r in model.transform(frame, "id", "text").collect()}
    assert np.abs(np.array([got[i] for i in sorted(got)])[:, 0]) == pytest.approx(np.abs(a @ vt[0]), abs=1e-3)


def test_svd_edges(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, ""), (5, "zz")], "id long, text string")
    model = TextSVD(components=64).fit(frame, "id", "text")
    out, names = model.columns(frame, "id", "text")
    rows = {r["id"]: [r[c] for c in names] for r in out.collect()}
    assert len(rows) == 5 and rows[1] == rows[2] and rows[3] == rows[4] == [0.0] * len(names) and any(rows[1])
    with pytest.raises(TooFewGrams):
        TextSVD().fit(frame.where("id > 2"), "id", "text")


def test_screen_fits_the_text_on_training_rows_only(spark, monkeypatch):
    """Each fold's vocabulary comes from its other folds; a text that tells the target is found."""
    seen = []

    class Watched(TextSVD):
        def fit_counts(self, counts, n_rows):
            seen.append({r[0] for r in counts.select("id").distinct().collect()})
            return super().fit_counts(counts, n_rows)

    monkeypatch.setattr(screening, "TextSVD", Watched)
    frame = spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "cheap rusty").otherwise("shiny rare").alias("text"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(9.0).alias("y"))
    row = screening.screen(frame, "y", "text", "id", folds=3).first()
    assert row["verdict"] == "worth_trying" and row["wins"] == 3 and row["score_with"] < 0.5 * row["score_without"]
    assert len(seen) == 3 and all(len(s) < 90 for s in seen) and set.union(*seen) == set(range(90)) and not set.intersection(*seen)


def test_document_frequencies_shuffle_no_row_a_gram(spark):
    draw = np.random.default_rng(7)
    odd = [(None, "one Two"), (None, "two"), (7, "x 日本語 𝒳𝒴 a"), (7, "日本 x"), (9001, None), (9002, " \t"), (9003, "İx ab cd")]
    rows = [(i, " ".join(draw.choice(WORDS, 12))) for i in range(400)] + odd
    frame = spark.createDataFrame(rows, "id long, text string").repartition(4)
    spark.sparkContext.setJobGroup("frequencies", "frequencies")
    got = {r["gram"]: r["df"] for r in neighbours.gram_frequencies(frame, "id", F.col("text")).collect()}
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("frequencies") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s)) < 6000  # 400 ids have over 40,000 grams
    want = {r["gram"]: r["df"] for r in neighbours.gram_counts(frame, "id", F.col("text")).groupBy("gram").agg(F.count("*").alias("df")).collect()}
    assert got == want and got["日本"] == 1

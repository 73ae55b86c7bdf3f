"""Operators that must not hold a group, a column or all pairs in one task."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import neighbour_index, neighbours, profile, quantiles, routing, sampling
from tessera.operators.models import Neighbours
from tessera.operators.neighbour_index import QUERY_ROWS, NeighbourIndex


def test_quantiles_of_awkward_columns(spark):
    rng = random.Random(1)
    columns = {
        "skewed": [rng.lognormvariate(0, 6) for _ in range(900)],
        "ties": [float(rng.randint(-2, 2)) for _ in range(900)],
        "wide": [rng.choice([-1.7e308, 1.7e308, 1e-300, -0.0, 0.0, 5e-324]) for _ in range(899)] + [float("inf")],
        "some": [rng.gauss(0, 1) if i % 3 else None for i in range(899)] + [float("nan")],
        "none": [None] * 900,
        "one": [None] * 899 + [7.5],
    }
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = [0.0, 0.25, 0.5, 0.995, 1.0]
    got = quantiles.quantiles(frame, {c: F.col(c) for c in columns}, shares)
    for name, values in columns.items():
        held = np.array(sorted(x for x in values if x is not None and x == x))
        if not len(held):
            assert got[name] == [None] * 5
            continue
        for x, s in zip(got[name], shares, strict=True):
            at = (len(held) - 1) * s
            low, high = held[math.floor(at)], held[math.ceil(at)]
            assert x == low if low == high else math.isclose(x, low + (high - low) * (at - math.floor(at)), rel_tol=1e-12)
    assert quantiles.medians(frame.select("ties"), ["ties"]) == {"ties": statistics.median(columns["ties"])}
    # A small number of parts a pass takes more passes to the same values.
    assert quantiles.order_statistics(frame, {"x": F.col("skewed")}, {"x": [0, 450, 899]}, parts=16) == {("x", r): sorted(columns["skewed"])[r] for r in (0, 450, 899)}


def points(spark, n, seed, start=0):
    rng = random.Random(seed)
    centres = [(rng.gauss(0, 30), rng.gauss(0, 30)) for _ in range(12)]
    rows = []
    for i in range(n):
        a, b = rng.choice(centres)
        rows.append((start + i, None if i % 37 == 0 else round(a + rng.gauss(0, 1), 1), round(b + rng.gauss(0, 1), 1), "x") if i % 5 else (start + i, 1.0, 2.0, "hot"))
    return spark.createDataFrame(rows, "id long, a double, b double, train_id string")


def brute(queries, train, columns, k, weight, ids=("id", "id")):
    med = [statistics.median([r[c] for r in train if r[c] is not None]) for c in columns]
    fill = lambda r: [m if r[c] is None else r[c] for c, m in zip(columns, med, strict=True)]
    t = [(r["id"], fill(r)) for r in train]
    sd = [statistics.pstdev([x[1][i] for x in t]) or 1.0 for i in range(len(columns))]
    out = {}
    for r in queries:
        x = fill(r)
        near = sorted((sum(abs(p - q) / s for p, q, s in zip(x, y, sd, strict=True)) / len(sd), i) for i, y in t)[:k]
        out[r["id"]] = [i for _, i in near]
    return out


def listed(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["train_id"])
    return out


@pytest.mark.parametrize("whole", [60, 10_000])
def test_index_finds_the_nearest_numbers(spark, whole, tmp_path):
    train, queries = points(spark, 900, 2), points(spark, 150, 2, 5000)
    index = NeighbourIndex("id", ["a", "b"], whole=whole, pivots=20).fit(train)
    want = brute(queries.collect(), train.collect(), ["a", "b"], 4, 0.15)
    assert listed(index.nearest(queries, 4)) == want
    seen = dict(index.visited)
    assert seen["queries"] == 150 and (whole > 900 or seen["visits"] < 0.5 * seen["queries"] * seen["blocks"])
    # More neighbours than rows, an empty side, a second search and a loaded index.
    assert all(len(x) == 900 for x in listed(index.nearest(queries.limit(2), 1000)).values())
    assert index.nearest(queries.limit(0), 3).count() == 0
    index.save(str(tmp_path / "index"))
    again = NeighbourIndex.load(spark, str(tmp_path / "index"))
    assert listed(again.nearest(queries, 4)) == want and again.visited == seen


def test_one_number_is_sought_among_next_values(spark):
    """Frequent and rare values, ties, numbers too large to tell apart, nulls; the work grows with the distinct values."""
    rng = random.Random(8)
    value = lambda i: None if i % 50 == 0 else 3.0 if i % 3 else rng.choice([float(rng.randint(-40, 40)), rng.gauss(0, 30)])
    train = spark.createDataFrame([(i, value(i)) for i in range(700)] + [(700 + i, float(i)) for i in range(60)], "id long, a double")
    queries = spark.createDataFrame([(5000 + i, value(i + 1)) for i in range(200)] + [(6000, 1e19), (6001, 1000.0), (6002, None)], "id long, a double")
    want = brute(queries.collect(), train.collect(), ["a"], 5, 0.15)
    for rows in (4, QUERY_ROWS):
        neighbour_index.QUERY_ROWS = rows
        index = NeighbourIndex("id", ["a"], whole=50).fit(train)
        try:
            assert listed(index.nearest(queries, 5)) == want
        finally:
            neighbour_index.QUERY_ROWS = QUERY_ROWS
        assert index.visited["queries"] == 203 and index.visited["visits"] < 203 and (index.visited["blocks"] > 1) == (rows == 4)
    assert listed(index.nearest(queries.limit(0), 5)) == {}


def test_many_top_rows_are_not_gathered_in_one_task(spark, monkeypatch):
    rows = [(i, None if i % 9 == 0 else float(i * 7 % 5)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, signal double").repartition(5)
    for down in (True, False):
        want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if down else r[1], r[0]))  # noqa: B023
        for n in (0, 1, 120, 290, 400):
            got = [routing.top_rows(frame, "signal", "id", n, down)]
            monkeypatch.setattr(routing, "TAKEN", 10)
            got.append(routing.top_rows(frame, "signal", "id", n, down))
            monkeypatch.undo()
            assert n <= 10 or "Limit" not in got[1]._jdf.queryExecution().optimizedPlan().toString()
            assert all(sorted(tuple(r) for r in g.collect()) == sorted(want[:n]) for g in got)


def test_visits_grow_slower_than_the_pairs(spark):
    share = []
    for n in (1000, 4000):
        index = NeighbourIndex("id", ["a", "b"], whole=100, pivots=64).fit(points(spark, n, 7))
        index.nearest(points(spark, 100, 7, 90_000), 3)
        share.append(index.visited["visits"] / (index.visited["queries"] * index.visited["blocks"]))
    assert share[1] <= share[0] and share[1] < 0.2


def test_index_finds_the_nearest_directions(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    vectors = centres[rng.integers(0, 9, 700)] + rng.normal(size=(700, 6)) * 0.1
    vectors[::7] = vectors[0]
    vectors[5] = 0
    frame = spark.createDataFrame([(i, v.tolist(), "y") for i, v in enumerate(vectors)] + [(900, None, "y")], "id long, x array<double>, y string")
    index = NeighbourIndex("id", vector="x", whole=80, pivots=16).fit(frame)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    near = np.round(unit @ unit.T, 12)
    got = {}
    for r in index.nearest(frame.where("id % 20 = 0 or id = 5"), 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(round(r["similarity"], 9))
    for i, values in got.items():
        held = [j for j in range(700) if j != 5] if 5 not in got or i != 5 else list(range(700))
        assert np.allclose(values, sorted(near[i][held], reverse=True)[:5], atol=1e-8)
    assert index.visited["visits"] < 0.6 * index.visited["queries"] * index.visited["blocks"]
    with pytest.raises(TesseraError):
        NeighbourIndex("id")


def test_the_neighbour_model_keeps_its_index(spark):
    train, queries = points(spark, 300, 4), points(spark, 40, 4, 900)
    model = Neighbours(["a", "b"], "id", k=3).fit(train.withColumn("price", F.col("id") * 1.0), "price")
    want = brute(queries.collect(), train.collect(), ["a", "b"], 3, 0.15)
    for _ in range(2):
        held = model.index
        assert {r["id"]: r["out"] for r in model.predict(queries, "out").collect()} == {i: statistics.median(map(float, x)) for i, x in want.items()}
        assert model.index is held


def test_places_within_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), "p") for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, label string, place string")
    got = {r["id"]: r["rank"] for r in sampling.places_within(frame, "label", [F.col("id")], "rank").collect()}
    seen = {}
    for i, label, _ in rows:
        seen[label] = seen.get(label, 0) + 1
        assert got[i] == seen[label]
    folds = sampling.stratified_folds(frame, "label", "id", 5)
    assert folds.columns == ["id", "label", "place", "fold"]
    counts = {(r["label"], r["fold"]): r["n"] for r in folds.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for label in ("hot", "a", "b", None):
        sizes = [counts.get((label, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    plan = folds._jdf.queryExecution().toString()
    assert "Window [row_number" in plan and "__part" in plan


def test_unseen_words_with_a_hot_one(spark):
    rng = random.Random(6)
    train = spark.createDataFrame([(i, " ".join(rng.choice(["red", "blue", "Green"]) for _ in range(5))) for i in range(40)], "id long, text string")
    texts = [(i, "the RED  cat sat" if i % 2 else rng.choice(["blue", "", None, "zebra red", "green green one two"])) for i in range(300)]
    got = {r["id"]: r["unseen_words"] for r in routing.unseen_words(spark.createDataFrame(texts, "id long, text string"), train, "id", "text").collect()}
    for i, text in texts:
        words = (text or "").lower().split()
        assert math.isclose(got[i], sum(w not in ("red", "blue", "green") for w in words) / len(words) if words else 0.0)


def test_profile_counts_distinct_values_without_copies(spark):
    rows = [(i % 7, float("nan") if i % 11 == 0 else -0.0 if i % 2 else 0.0, None if i % 3 else f"s{i % 5}", [i % 4], i % 2 == 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "a int, b double, c string, d array<int>, e boolean")
    got = {r["name"]: (r["n_values"], r["n_unique"]) for r in profile.statistics(frame).collect()}
    assert got == {"a": (200, 7), "b": (200, 2), "c": (67, 5), "d": (200, 4), "e": (200, 2)}
    assert {r["n_unique"] for r in profile.statistics(frame.limit(0)).collect()} == {0}
    assert "Expand" not in profile.statistics(frame)._jdf.queryExecution().toString()


def test_standards_of_columns_with_nulls(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else float(i), None) for i in range(9)], "id long, a double, b double")
    known = neighbours.standards(frame, ["a", "b"]).first()
    assert known["m_a"] == 4.0 and known["m_b"] is None and known["s_b"] == 1.0
    filled = [4.0 if i % 2 else float(i) for i in range(9)]
    assert math.isclose(known["s_a"], statistics.pstdev(filled))

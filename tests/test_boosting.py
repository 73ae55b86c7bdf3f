import json
import random

import numpy as np
import pytest

from tessera.errors import TesseraError
from tessera.operators import boosting as B
from tessera.operators.models import Trees
from tessera.plans import catalogue


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y string, z double")


def rows(n, seed, classes=3):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b, c = rng.choice([None, *range(12)]), rng.gauss(0, 1), rng.choice(["p", "q", "r", None])
        k = int((a or 0) > 5) + (c == "q") * (classes > 2)
        out.append((i, None if a is None else float(a), b, c, "xyz"[k if rng.random() > 0.1 else 0], (a or 0) * 2 + (c == "r") * 5 + rng.gauss(0, 0.1)))
    return out


def plain(bins, category, y, start, loss, growth, rounds, rate, scale):
    """The same boosting one split at a time, every sum taken over rows."""
    scores = np.tile(start, (len(y), 1))
    for _ in range(rounds):
        g, h = B.slopes(y, scores, loss, scale)
        g, h = g / B.UNIT, h / B.UNIT
        change = np.zeros_like(scores)
        for k in range(scores.shape[1]):
            leaves = [(np.arange(len(y)), 0)]

            def best(rows, k=k, g=g, h=h):
                found = (B.LEAST_GAIN, None)
                worth = lambda r: g[r, k].sum() ** 2 / (h[r, k].sum() + growth.penalty) if len(r) and h[r, k].sum() + growth.penalty > 0 else 0.0
                for c in range(bins.shape[1]):
                    v = bins[rows, c]
                    if category[c]:
                        order = sorted(set(v), key=lambda x: (g[rows[v == x], k].sum() / (h[rows[v == x], k].sum() + growth.penalty + 1e-12), x))
                        sides = [order[: i + 1] for i in range(len(order) - 1)]
                    else:
                        sides = [range(1, t + 1) for t in range(1, B.BINS - 1)] + [range(t + 1) for t in range(1, B.BINS - 1)]
                    for side in sides:
                        go = np.isin(v, list(side))
                        left, right = rows[go], rows[~go]
                        if min(len(left), len(right)) < growth.least_rows or min(h[left, k].sum(), h[right, k].sum()) < growth.least_curvature:
                            continue
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, (left, right))
                return found

            known = [(*best(leaves[0][0]), *leaves[0])]
            while len(known) < growth.leaves:
                pick = max(range(len(known)), key=lambda i: known[i][0] if known[i][1] and known[i][3] < growth.depth else 0)
                _, split, _, depth = known[pick]
                if split is None or depth >= growth.depth:
                    break
                known.pop(pick)
                known += [(*best(side), side, depth + 1) for side in split]
            for _, _, mine, _ in known:
                change[mine, k] = -rate * scale * g[mine, k].sum() / (h[mine, k].sum() + growth.penalty)
        scores += change
    return scores


@pytest.mark.parametrize("task,growth", [("classification", B.Growth(6, 4, 0.0, 10, 1e-3)), ("classification", B.Growth(8, 3, 1.0, 1, 1.0)), ("regression", B.Growth(7, 9, 0.0, 5, 1e-3)), ("two", B.Growth(5, 3, 1.0, 3, 0.1))])
def test_equals_one_split_at_a_time(spark, task, growth):
    data = rows(160, 1, 2 if task == "two" else 3)
    if task == "two":
        data = [(*r[:4], "x" if r[4] == "x" else "y", r[5]) for r in data]
    target, kind = ("z", "regression") if task == "regression" else ("y", "classification")
    model = B.Boosted(["a", "b"], ["c"], growth, kind, rounds=3, rate=0.3, columns_share=1.0).fit(table(spark, data).repartition(3), target)
    columns = [np.array([np.nan if r[1] is None else r[1] for r in data]), np.array([r[2] for r in data])]
    bins = np.stack([*(np.where(np.isnan(x), 0, np.searchsorted(c, x) + 1) for x, c in zip(columns, model.binner.cuts, strict=True)), np.array([model.binner.levels[0].get(r[3], 0) for r in data])], 1)
    y = np.array([r[5] for r in data]) if task == "regression" else np.array([float(model.classes.index(r[4])) for r in data])
    want = plain(bins, model.binner.category, y, model.start, model.loss, growth, 3, 0.3, model.scale)
    got = np.array([r[0] for r in model.predict(table(spark, data), "out").orderBy("id").select("out").collect()])
    if task == "regression":
        np.testing.assert_allclose(got, want[:, 0], rtol=1e-5)
    else:
        z = want if want.shape[1] > 1 else np.concatenate([np.zeros_like(want), want], 1)
        e = np.exp(z - z.max(1, keepdims=True))
        np.testing.assert_allclose(got, e / e.sum(1, keepdims=True), rtol=1e-5)


def test_many_classes_are_learned_and_differ_from_the_forest(spark):
    train, test = table(spark, rows(500, 2)), table(spark, rows(200, 3))
    truth = {r[0]: r[4] for r in rows(200, 3)}
    said = {}
    for model in (Trees(["a", "b"], ["c"], "boosted", "classification", trees=8), B.Boosted(["a", "b"], ["c"], "leaf", "classification", rounds=8), Trees(["a", "b"], ["c"], "forest", "classification", trees=8)):
        got = model.fit(train, "y").predict(test, "out")
        assert got.columns == [*test.columns, "out"]
        said[model.name] = {r["id"]: np.array(r["out"]) for r in got.collect()}
        assert all(len(p) == 3 and abs(p.sum() - 1) < 1e-9 for p in said[model.name].values())
        assert np.mean([model.classes[p.argmax()] == truth[i] for i, p in said[model.name].items()]) > 0.8
    assert max(np.abs(said["boosted"][i] - said["forest"][i]).max() for i in truth) > 0.01
    assert max(np.abs(said["boosted"][i] - said["leafwise"][i]).max() for i in truth) > 0.001


def test_awkward_columns(spark):
    frame = spark.createDataFrame([(i, None, None, "bins", "y", float(i % 3), "s") for i in range(60)] + [(60, float("nan"), float("inf"), None, None, None, None)], "id long, a double, scores double, bins string, y string, z double, cell string")
    model = B.Boosted(["a", "scores"], ["bins", "cell"], "leaf", rounds=2).fit(frame, "z")
    assert {round(r[0], 9) for r in model.predict(frame, "out").select("out").collect()} == {1.0}
    with pytest.raises(TesseraError):
        B.Boosted(["a"], [], "leaf", "classification").fit(frame, "y")
    with pytest.raises(TesseraError):
        B.Boosted([], [])
    with pytest.raises(TesseraError):
        B.Boosted(["a"]).fit(frame.limit(0), "z")


SF = "/root/testdata/sf0.01"


def test_query_of_four_classes(spark):
    got = catalogue.queries()["h1b_multiclass"](spark, SF).where("doc_id % 5 = 0").collect()
    classes = sorted({r.lang for r in got})
    shares = [dict(zip(classes, json.loads(r.shares), strict=True)) for r in got]
    # On documents that were not learned from; shares of the languages alone have a log loss of about 1.
    loss = -np.mean([np.log(max(1e-6, p[r.lang])) for p, r in zip(shares, got, strict=True)])
    assert len(got) == 200 and loss < 0.35 and np.mean([r.lang == r.predicted for r in got]) > 0.9
    assert all(abs(sum(p.values()) - 1) < 1e-4 for p in shares)


def test_query_of_two_growths(spark):
    got = catalogue.queries()["h2_boosted_leafwise"](spark, SF).collect()
    price, leaf, level = (np.array([getattr(r, c) for r in got if r.p_partkey % 5 == 0]) for c in ("p_retailprice", "leafwise", "levelwise"))
    mean = np.mean([r.p_retailprice for r in got if r.p_partkey % 5])
    for said in (leaf, level):
        assert np.abs(said - price).mean() < 0.5 * np.abs(mean - price).mean()
    assert np.abs(leaf - level).max() > 0.01

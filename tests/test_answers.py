import glob
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import profile
from tessera.operators.models import GroupMean, Linear, Trees
from tessera.operators.predictor import EvidenceClassifier, EvidenceRegressor
from tessera.operators.typed_column import llm_stage, settle
from tessera.sources import clients
from tessera.sources.answers import AnswerCache


def requests(spark, n, client):
    rows = spark.range(n).select(F.col("id"), F.to_json(F.struct(F.col("id").alias("n"))).alias("request"))
    return clients.keyed(rows, client)


def asked_log(path, **more):
    """A client that notes each call in a file."""

    def answer(request):
        with open(path, "a") as f:
            f.write(f"{request['n']}\n")
        return {"value": request["n"]}

    return clients.FunctionClient(answer, **more)


def test_answers_belong_to_who_was_asked(spark, tmp_path):
    cache = str(tmp_path / "cache")
    said = {}
    for name, model, effort in (("a", None, None), ("b", None, None), ("a", "large", None), ("a", "large", "high")):
        client = clients.FunctionClient(lambda r, x=(name, model, effort): {"value": str(x)}, name, 1.0, model=model, effort=effort)
        got = clients.kept_answers(requests(spark, 5, client), client, cache).collect()
        assert sum(r.cost for r in got) == 5.0
        said[name, model, effort] = {r.answer for r in got}
    assert len(set(map(tuple, said.values()))) == 4
    again = clients.FunctionClient(lambda r: 1 / 0, "b", 1.0)
    got = clients.kept_answers(requests(spark, 5, again), again, cache).collect()
    assert all(r.from_cache and r.cost == 0 and r.error is None for r in got) and {r.answer for r in got} == said["b", None, None]
    held = AnswerCache(spark, cache).rows().where("client = 'b'").collect()
    assert {json.loads(r.request)["n"] for r in held} == set(range(5)) and all(r.cost == 1.0 and r.asked for r in held)


def test_cache_parts_broken_files_and_compaction(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "calls"
    client, cache = asked_log(log), AnswerCache(spark, path)
    assert cache.compact() == 0
    for n in (40, 80, 120):
        clients.kept_answers(requests(spark, n, client), client, path)
    assert len(log.read_text().split()) == 120 and cache.rows().count() == 120
    # A lookup reads the parts of its keys only.
    few = requests(spark, 3, client)
    parts = {r[0][:2] for r in few.select("key").collect()}
    plan = cache.held(few)._jdf.queryExecution().toString()
    assert len(parts) <= 3 and "PartitionFilters: [" in plan and all(f"k{p}" in plan for p in parts)
    files = lambda: glob.glob(f"{path}/part=*/*.parquet")
    before = len(files())
    assert cache.compact() > 0 and len(files()) < before and cache.rows().count() == 120
    assert len(files()) == len(glob.glob(f"{path}/part=*"))
    # One broken file costs its own rows.
    broken = max(files(), key=os.path.getsize)
    lost = spark.read.parquet(broken).count()
    with open(broken, "wb") as f:
        f.write(b"no parquet at all")
    for crc in glob.glob(f"{os.path.dirname(broken)}/.*.crc"):
        os.remove(crc)
    got = clients.kept_answers(requests(spark, 120, client), client, path)
    assert 0 < lost < 120 and got.where("error is null").count() == 120 and len(log.read_text().split()) == 120 + lost


def test_repeated_requests_are_paid_once(spark):
    client = clients.FunctionClient(lambda r: {"value": "x"}, "one", 0.5)
    rows = spark.createDataFrame([(i, None, None, "same" if i < 6 else "other") for i in range(8)], "id long, value string, confidence double, text string")
    got = settle(rows, [llm_stage(client, ["x", "y"])]).orderBy("id").collect()
    assert [r.cost for r in got] == [0.5, 0, 0, 0, 0, 0, 0.5, 0] and all(r.value == "x" for r in got)


def test_calls_at_a_time_are_bounded_and_the_first_is_alone(spark, tmp_path):
    log = tmp_path / "calls"

    def answer(request):
        began = time.time()
        time.sleep(0.05)
        with open(log, "a") as f:
            f.write(f"{began} {time.time()} {os.getpid()} {threading.get_ident()}\n")
        return {"value": 1}

    client = clients.FunctionClient(answer, workers=3, most_calls=2, warm=True)
    got = clients.kept_answers(requests(spark.range(0).sparkSession, 24, client).repartition(4), client)
    assert got.count() == 24 and got.where("error is not null").count() == 0
    calls = sorted(tuple(map(float, x.split()[:2])) for x in log.read_text().splitlines())
    assert len(calls) == 24 and calls[0][1] <= calls[1][0]
    assert max(sum(a <= t < b for a, b in calls) for t, _ in calls) == 2


def test_models_are_routed_by_name():
    makers = {"one": lambda m: clients.FunctionClient(len, f"one:{m}"), "two": lambda m: clients.FunctionClient(len, f"two:{m}")}
    assert clients.routed("two/big", makers).name == "two:big" and clients.routed("small", makers, "one").name == "one:small"
    for model in ("three/x", "bare"):
        with pytest.raises(ValueError):
            clients.routed(model, makers)


NAMES = ["description", "key", "answer", "cost", "signal", "sent", "value", "tier", "reason", "fingerprint", "approved", "origin", "confidence", "request", "cases", "prediction", "probability", "features", "rawPrediction", "train_id", "similarity", "label"]


def crowded(spark, n=60):
    """A text column and a number whose names an estimator uses itself, and all others of the kind as plain columns."""
    rng = random.Random(1)
    rows = [(i, float(i % 7), rng.choice("xyz"), *[f"{name} {i % 5}" for name in NAMES], 3.0 * (i % 7) + rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, age double, grade string, " + ", ".join(f"{n} string" for n in NAMES) + ", price double")


@pytest.mark.parametrize("text,signal", [("description", "similarity"), ("key", "unseen"), ("answer", "disagreement"), ("description", lambda f: F.col("age"))])
def test_any_name_may_be_the_users(spark, text, signal):
    frame = crowded(spark)

    def answer(request):
        assert f"{text}: {text} " in request["row"]
        assert request["cases"][0]["similarity"] > 0
        return {"value": 1.5, "confidence": 0.75, "reason": "r"}

    spec = profile.ColumnSpec(numeric=[], categorical=["grade", "cost", "signal"], text=text, long_text=None)
    model = EvidenceRegressor("price", "id", spec=spec, models=[GroupMean("grade"), Linear("age"), Trees(["age"], ["prediction"], "forest", trees=2, depth=2)], client=clients.FunctionClient(answer, cost_per_call=0.1), tier=clients.FunctionClient(lambda r: {"choice": "linear", "confidence": 0.4}, "tier"), escalate_rate=0.5, check_leakage=False, signal=signal).fit(frame.where("id < 45"))
    got = model.predict(frame.where("id >= 45")).frame.collect()
    assert len(got) == 15 and sum(r.origin == "llm" for r in got) == 8 and sum(r.origin == "jev" for r in got) == 7
    assert all(r.value == 1.5 and r.cost == 0.1 and r.reason == "r" for r in got if r.origin == "llm")
    assert model.plan(frame.where("id >= 45"))["n_sent"] == 8


def test_names_that_a_result_needs_are_refused(spark):
    with pytest.raises(TesseraError):
        EvidenceRegressor("price", "value")
    spec = profile.ColumnSpec(numeric=["age"], categorical=["grade"])
    model = EvidenceRegressor("price", "id", spec=spec, models=[GroupMean("grade"), Linear("age")], check_leakage=False).fit(crowded(spark))
    with pytest.raises(TesseraError):
        model.predict(crowded(spark).withColumn("evidence_linear", F.lit(1)))


def test_three_classes_have_doubt(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 40)), float(rng.randint(0, 9)), rng.choice("ab")) for i in range(240)]
    frame = spark.createDataFrame([(*r, "low" if r[1] < 14 else "mid" if r[1] < 28 or rng.random() < 0.2 else "high") for r in rows], "id long, age double, photos double, grade string, speed string")
    model = EvidenceClassifier("speed", "id", spec=profile.ColumnSpec(numeric=["age", "photos"], categorical=["grade"]), check_leakage=False, escalate_rate=0.2).fit(frame.where("id < 180"))
    got = model.predict(frame.where("id >= 180")).frame.collect()
    assert len({round(r.signal, 6) for r in got}) > 10 and any(r.evidence_boosted != r.evidence_forest for r in got)
    truth = {r.id: r.speed for r in frame.collect()}
    assert sum(r.value == truth[r.id] for r in got) > 48

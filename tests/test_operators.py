import json
import warnings

import pytest
from pyspark.sql import functions as F

from tessera.errors import LeakWarning, TesseraError
from tessera.operators import diagnose, leakage, lookup, neighbours, profile, routing, sampling
from tessera.operators.key_lookup import KeyLookup, column_name
from tessera.operators.models import GroupMean, Linear, Trees
from tessera.operators.predictor import EvidenceClassifier, EvidenceRegressor
from tessera.operators.typed_column import TypedColumn, drop_constant_tokens, queue_only
from tessera.sources import caches, clients


@pytest.fixture(scope="module")
def cars(spark):
    rows = [(i, i % 15, 5000 + 977 * i % 90000, "GXZ"[i % 3], f"grade {'GXZ'[i % 3]} with {['sunroof', 'winch', 'tow bar'][i % 3]}", 250.0 - 12 * (i % 15) - (5000 + 977 * i % 90000) / 8000 + (i * 37 % 7 - 3)) for i in range(80)]
    return spark.createDataFrame(rows, "id long, age int, mileage int, grade string, note string, price double").cache()


def test_leakage(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", None)], "id int, x string, y int")
    report = leakage.check_duplicates(t, ignore=["id"])
    assert (report.n_rows, report.n_duplicate_rows, report.n_groups, report.largest_group) == (4, 2, 1, 3) and not report.ok and "2 of 4" in str(report)
    assert leakage.check_duplicates(t.limit(0)).ok
    with pytest.warns(LeakWarning):
        assert leakage.check_overlap(t.where("id < 3").drop("id"), t.where("id = 4").drop("id"), warn=True).n_leaked_rows == 1
    with pytest.raises(TesseraError):
        leakage.check_overlap(t.select("x"), t.select("y"))
    with pytest.raises(TesseraError):
        leakage.check_duplicates(t, keys=["nope"])
    assert sorted(r.id for r in leakage.first_of_each(t, "id").collect()) == [1, 3]


def test_kinds(spark):
    rows = [(i, f"http://x/{i}", f"2020-01-{i % 28 + 1:02d}", i % 2, "yes" if i % 2 else "no", f"word{i % 7}", "long " * 30 + str(i), f"code{i * 7919}x", 1.5 * i, 1, "k") for i in range(120)]
    t = spark.createDataFrame(rows, "car_id long, link string, day string, flag int, word string, cat string, body string, vin string, x double, one int, const string")
    kinds = {c.name: c.kind for c in profile.profile(t, "car_id")}
    assert kinds == {"car_id": "id", "link": "id", "day": "datetime", "flag": "boolean", "word": "categorical", "cat": "categorical", "body": "long_text", "vin": "id", "x": "numeric", "one": "constant", "const": "constant"}
    spec = profile.spec_of(profile.profile(t, "car_id"), "x")
    assert spec.long_text == "body" and list(spec.categorical) == ["word", "cat"] and list(spec.boolean) == ["flag"]
    assert not profile.id_like("Paid") and not profile.id_like("Idle") and profile.id_like("RescuerID") and profile.id_like("user_id")


@pytest.mark.parametrize("rate,n", [(0, 0), (0.25, 5), (0.5, 10), (1, 20)])
def test_exact_number_of_rows_is_sent(spark, rate, n):
    t = spark.range(20).withColumn("s", F.lit(1.0))
    assert [r.id for r in routing.selected(t, "s", "id", rate=rate).orderBy("id").collect()] == list(range(n))


def test_routing_rules(spark):
    t = spark.range(10).withColumn("s", F.col("id").cast("double"))
    approved = spark.createDataFrame([(9,)], "id long")
    assert sorted(r.id for r in routing.selected(t, "s", "id", rate=0.2, approved=approved).collect()) == [8]
    assert routing.selected(t, "s", "id", threshold=7).count() == 3
    assert routing.selected(t, "s", "id").count() == 10
    with pytest.raises(TesseraError):
        routing.selected(t, "s", "id", rate=2)
    assert {r.place - 1 for r in routing.places(t, "s", "id").collect()} == set(range(10))
    assert all(r.place == 10 - r.id for r in routing.places(t, "s", "id").collect())
    assert [sampling.half_even(x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert {r.confidence for r in routing.confidence(t.withColumn("s", F.lit(3.0)), "s").collect()} == {1.0}
    assert routing.seconds(20) == pytest.approx(23.85 + 3 * 4.6) and routing.unit_cost(2.0, 5, 1) == 0.5


def test_trees(cars):
    model = Trees(["age", "mileage"], ["grade"], trees=5, depth=3).fit(cars.where("id < 60"), "price")
    out = model.predict(cars.where("id >= 60").withColumn("grade", F.lit("new")).withColumn("age", F.when(F.col("id") % 2 == 0, F.col("age"))), "p")
    assert out.count() == 20 and out.where("p is null").count() == 0
    classes = Trees(["mileage"], ["note"], task="classification", trees=5, depth=3).fit(cars, "grade")
    rows = classes.predict(cars, "p").collect()
    assert classes.classes == ["G", "X", "Z"] and all(abs(sum(r.p) - 1) < 1e-6 for r in rows)
    with pytest.raises(TesseraError):
        Trees()


def test_predict_with_four_origins(cars):
    client = clients.FunctionClient(lambda r: {"value": 100.0, "confidence": 0.9, "reason": "ok"} if "Z" not in r["row"] else 1 / 0, cost_per_call=0.01)
    spec = profile.ColumnSpec(numeric=["age", "mileage"], categorical=["grade"], text="note")
    model = EvidenceRegressor("price", "id", spec=spec, models=[GroupMean("grade"), Linear("age")], client=client, escalate_rate=0.5, check_leakage=False).fit(cars.where("id < 60"))
    test = cars.where("id >= 60")
    result = model.predict(test)
    rows = {r.id: r for r in result.frame.collect()}
    assert len(rows) == 20 and sum(r.sent for r in rows.values()) == 10
    assert {r.origin for r in rows.values()} <= {"llm", "fallback", "model"} and all(r.confidence == 0 for r in rows.values() if r.origin == "fallback")
    llm = [i for i, r in rows.items() if r.origin == "llm"]
    assert result.cost()["cost_usd"] == pytest.approx(0.01 * len(llm))
    assert model.approve(result, test.where(F.col("id") == llm[0])) == 1
    again = {r.id: r for r in model.predict(test).frame.collect()}
    assert again[llm[0]].origin == "human" and again[llm[0]].confidence == 1.0 and sum(r.sent for r in again.values()) == 9
    assert model.examples(test).groupBy("id").count().where("count <> 5").count() == 0
    assert "value" in result.explain(60) and result.route().count() == 20 and result.provenance().count() == 20
    plan = model.plan(test)
    assert plan["n_rows"] == 20 and plan["n_sent"] == 9
    curve = model.curve(test, test.select("id", F.col("price").alias("answer")), [0, 0.5, 1]).collect()
    assert curve[0].error >= curve[1].error >= curve[2].error == 0


def test_classifier_limits(spark, cars):
    with pytest.raises(TesseraError):
        EvidenceClassifier("grade", "id", spec=profile.ColumnSpec(numeric=["age"]), models=[]).fit(cars.withColumn("grade", F.lit("G")))
    with pytest.raises(TesseraError):
        EvidenceClassifier("grade", "id", spec=profile.ColumnSpec(numeric=["age"]), models=[]).fit(cars.withColumn("grade", F.when(F.col("id") > 3, F.col("grade"))))


def test_typed_column_from_texts(spark):
    rows = [(i, ["football match goal", "stock market shares", "stock price fall", "goal in football"][i % 4] + " news", ["sport", "money", "money", "sport"][i % 4] if i < 12 else None) for i in range(20)]
    t = spark.createDataFrame(rows, "id long, text string, label string")
    model = TypedColumn("text", "id", labels="label", threshold=0.6, stages=[queue_only()]).fit(t)
    assert model.stop == ["news"] and model.classes_ == ["money", "sport"] and model.k_ == 5
    out = {r.id: r for r in model.transform(t).collect()}
    assert all(out[i].value == ["sport", "money", "money", "sport"][i % 4] for i in range(20))
    names = TypedColumn("text", "id", values=["football", "stock"]).fit(t)
    assert {r.id: r.value for r in names.transform(t).collect()}[13] == "stock"
    with pytest.raises(TesseraError):
        TypedColumn("text", "id", kind="numeric")
    kept, stop = drop_constant_tokens(t, "text", threshold=0.9)
    assert stop == ["news"] and kept.where("text like '%news%'").count() == 0


def test_key_lookup_asks_each_key_once(spark, tmp_path):
    asked = []

    def answer(request):
        asked.append(len(request["keys"]))
        return {"answers": [{"key": k.upper(), "value": " B ", "confidence": 0.9} for k in request["keys"] if k != "c"]}

    t = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "A ", "b", "c", None, ""])], "id long, k string")
    client = clients.FunctionClient(answer, cost_per_call=0.4)
    lookup_ = KeyLookup(["k"], "Body type", values=["B", "D"], client=client, cache=str(tmp_path / "cache")).fit(t)
    assert lookup_.cost()["n_to_ask"] == 3 and lookup_.name == "body_type"
    out = {r.id: r for r in lookup_.transform(t).collect()}
    assert [out[i].body_type for i in range(6)] == ["B", "B", "B", None, None, None]
    assert [out[i].body_type_source for i in range(6)] == ["llm", "llm", "llm", "rejected", "skipped", "skipped"]
    again = KeyLookup(["k"], "Body type", values=["B", "D"], client=client, cache=str(tmp_path / "cache")).fit(t)
    assert again.cost()["n_to_ask"] == 0
    assert column_name("Body type!", ["body_type"]) == "body_type_2"
    with pytest.raises(TesseraError):
        KeyLookup(["k"], "x", values=["one"])


def test_clients():
    waits, tries = [], []

    def transport(request):
        tries.append(1)
        if len(tries) < 3:
            raise clients.TransportError(429, 9.0 if len(tries) == 1 else None)
        return {"ok": True}

    client = clients.HttpClient(transport, "http", sleep=waits.append)
    assert client.ask({}) == {"ok": True} and waits == [5.0, 1.0]
    with pytest.raises(clients.TransportError):
        clients.HttpClient(lambda r: (_ for _ in ()).throw(clients.TransportError(400)), "http", sleep=waits.append).ask({})
    with pytest.raises(ValueError):
        clients.choice("s", "q", ["only"])
    assert clients.choice("s", "q", ["a", "b", "a"])["options"] == ["a", "b"]
    with pytest.raises(ValueError):
        clients.score("s", "q", 2, 1)


def test_failed_calls_become_rows(spark):
    requests = spark.createDataFrame([(str(i), json.dumps({"i": i})) for i in range(4)] + [("0", json.dumps({"i": 0}))], "key string, request string")
    client = clients.FunctionClient(lambda r: {"v": 1 / r["i"]}, cost_per_call=0.5)
    first = clients.answered(requests, client).cache()
    assert first.count() == 4 and first.where("error is not null").count() == 1
    second = clients.usage(clients.answered(requests, client, first)).first()
    assert (second.n_calls, second.cache_hits, second.errors) == (4, 3, 1)


def test_caches(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TESSERA_CACHE", str(tmp_path))
    assert caches.cache_dir("x") == f"{tmp_path}/x"
    (tmp_path / ".env").write_text("# c\nexport A='b c'\nB=2\n")
    assert caches.read_settings(caches.find_settings(str(tmp_path))) == {"A": "b c", "B": "2"}
    t = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "s string")
    make = lambda f: f.withColumn("vector", F.array(F.lit(1.0).cast("float")))
    path = str(tmp_path / "vectors")
    assert [caches.add_vectors(t, path, "s", make) for _ in range(2)] == [2, 0]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part.parquet").write_text("no")
    assert caches.load(spark, str(tmp_path / "broken"), "key string").count() == 0
    with pytest.raises(TesseraError):
        caches.with_vectors(t, "s", spark.createDataFrame([("a", [1.0])], "text string, vector array<double>"))
    assert caches.request_key({"b": 1, "a": 2}) == caches.request_key({"a": 2, "b": 1})


def test_lookup_rules(spark):
    t = spark.createDataFrame([("1,200",), ("abc",), ("9",), (None,), ("Blue ",)], "v string")
    got = t.select(lookup.validated(F.col("v"), "numeric", low=10, high=2000).alias("n"), lookup.validated(F.col("v"), "category", ["blue", "red"]).alias("c")).collect()
    assert [r.n for r in got] == ["1200.0", None, None, None, None] and [r.c for r in got] == [None] * 4 + ["blue"]
    assert neighbours.k_auto(10, 4) == 2 and neighbours.k_auto(3, 4) == 1 and neighbours.k_auto(99, 4) == 5


def test_diagnosis_and_code(cars):
    rule = diagnose.diagnose(cars, "price", "id", screen_text=False)
    assert rule.task == "regression" and rule.escalate_rate == 0.0 and "age" in rule.spec.numeric
    compile(rule.to_code(), "recommended", "exec")
    assert "price" in str(rule) and rule.diagnosis.as_dict()["n_rows"] == 80
    with pytest.raises(TesseraError):
        diagnose.diagnose(cars, "price", "id", llm=True)
    client = clients.FunctionClient(lambda r: {"numeric": ["age", "nope"], "categorical": ["grade", "age"], "escalate_rate": 0.3})
    better = diagnose.diagnose(cars, "price", "id", client=client, screen_text=False)
    assert list(better.spec.numeric) == ["age"] and list(better.spec.categorical) == ["grade"] and better.escalate_rate == 0.3 and better.source == "llm"
    broken = diagnose.diagnose(cars, "price", "id", client=clients.FunctionClient(lambda r: 1 / 0), screen_text=False)
    assert broken.source == "rules"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert diagnose.run_diagnosis(cars, "grade", "id", screen_text=False).task == "classification"


def test_answers_are_paid_once(cars, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "answers")

    def answer(request):
        with open(calls, "a") as f:
            f.write("x")
        assert request["cases"] and {"label", "row", "similarity"} <= set(request["cases"][0]) and "number" in request["answer"]
        return {"value": 1.0}

    spec = profile.ColumnSpec(numeric=["age", "mileage"], categorical=["grade"])
    model = EvidenceRegressor("price", "id", spec=spec, models=[GroupMean("grade"), Linear("age")], client=clients.FunctionClient(answer, cost_per_call=0.5), escalate_rate=0.5, check_leakage=False, cache=cache).fit(cars.where("id < 60"))
    test = cars.where("id >= 60")
    result = model.predict(test)
    for _ in range(2):
        assert result.values().count() == 20 and len(result.route().collect()) == 20 and result.cost()["cost_usd"] == 5.0
    assert len(calls.read_text()) == 10
    again = model.predict(test)
    assert len(calls.read_text()) == 10 and again.cost()["cost_usd"] == 0.0
    assert again.frame.where("origin = 'llm'").count() == 10
    with pytest.raises(TesseraError):
        model.fit(cars.where("id < 60")).approve(again, test)


def test_middle_tier_weighs_the_models(cars):
    def choose(request):
        assert request["options"] == ["group_mean", "linear"]
        return {"choice": "linear", "probabilities": {"group_mean": 0.25, "linear": 0.75}, "confidence": 0.5 if "age: 3" in request["row"] else 0.9}

    spec = profile.ColumnSpec(numeric=["age", "mileage"], categorical=["grade"])
    tier, models = clients.FunctionClient(choose, "tier", 0.001), [GroupMean("grade"), Linear("age")]
    test = cars.where("id >= 60")
    model = EvidenceRegressor("price", "id", spec=spec, models=models, tier=tier, signal="tier", check_leakage=False).fit(cars.where("id < 60"))
    for r in model.predict(test).frame.collect():
        assert r.origin == "jev" and abs(r.value - (0.25 * r.evidence_group_mean + 0.75 * r.evidence_linear)) < 1e-6
        assert abs(r.signal - (1 - r.confidence)) < 1e-9 and r.cost == 0.001
    client = clients.FunctionClient(lambda r: {"value": 5.0})
    mixed = EvidenceRegressor("price", "id", spec=spec, models=models, tier=tier, client=client, escalate_rate=0.25, check_leakage=False).fit(cars.where("id < 60")).predict(test)
    assert {r.origin: r.n for r in mixed.report().collect()} == {"llm": 5, "jev": 15}


def test_an_answer_outside_the_classes_falls_back(cars):
    client = clients.FunctionClient(lambda r: {"value": "nonsense"})
    classed = cars.withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    model = EvidenceClassifier("kind", "id", spec=profile.ColumnSpec(numeric=["age", "mileage"]), models="default", n_examples=3, client=client, escalate_rate=1.0, check_leakage=False).fit(classed.where("id < 60"))
    assert [m.name for m in model.models_] == ["boosted", "forest", "neighbours"]
    rows = model.predict(classed.where("id >= 70")).frame.collect()
    assert all(r.origin == "fallback" and r.value in ("a", "b") and abs(sum(r.probabilities) - 1) < 1e-6 for r in rows)


def test_proposed_columns_are_scored(spark):
    from tessera.operators.key_lookup import AutoLookup

    def answer(request):
        if request.get("kind") == "propose":
            return {"columns": [{"attribute": "factor", "kind": "numeric", "keys": ["model"]}, {"attribute": "noise", "kind": "numeric", "keys": ["serial"]}]}
        return {"answers": [{"key": k, "value": str(int(k[1:]) ** 2 if request["attribute"] == "factor" else hash(k) % 7), "confidence": 0.9} for k in request["keys"]]}

    rows = [(i, f"m{i % 9}", f"s{i * 7919 % 240}", float((i % 9) ** 2) + i % 3) for i in range(240)]
    cars = spark.createDataFrame(rows, "id long, model string, serial string, price double")
    auto = AutoLookup("price", "id", clients.FunctionClient(answer)).fit(cars)
    out = auto.transform(cars)
    assert out.where("factor <> power(cast(substring(model, 2) as int), 2)").count() == 0 and out.where("noise is null").count() == 0
    assert auto.kept() == ["factor"]


def test_stages_over_clients_ask_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def answer(request):
        with open(calls, "a") as f:
            f.write("x")
        return {"value": "money"}

    rows = [(i, ["football match goal", "stock market shares"][i % 2] + f" word{i}", ["sport", "money"][i % 2] if i < 12 else None) for i in range(20)]
    t = spark.createDataFrame(rows, "id long, text string, label string")
    from tessera.operators.typed_column import llm_stage

    model = TypedColumn("text", "id", labels="label", escalate_rate=0.25, stages=[llm_stage(clients.FunctionClient(answer), ["sport", "money"])]).fit(t)
    out = model.transform(t)
    assert out.where("source = 'llm' and value = 'money'").count() == 5 and out.count() == 20
    assert len(calls.read_text()) == 5 and model.review_queue(out).count() == 5

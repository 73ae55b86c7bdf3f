import math

import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import neighbours, profile
from tessera.operators.key_lookup import AutoLookup
from tessera.operators.models import GroupMean, Linear
from tessera.operators.predictor import EvidenceRegressor
from tessera.operators.typed_column import TypedColumn, llm_stage
from tessera.sources import clients


def test_a_prediction_tells_its_cases(spark):
    frame = spark.createDataFrame([(i, float(i), "xyz"[i % 3], 10.0 * i) for i in range(30)], "id long, age double, grade string, price double")
    client = clients.FunctionClient(lambda r: {"value": 5.0, "confidence": 0.5, "reason": "told so"}, cost_per_call=0.25)
    model = EvidenceRegressor("price", "id", spec=profile.ColumnSpec(numeric=["age"], categorical=["grade"]), models=[GroupMean("grade"), Linear("age")], client=client, escalate_rate=0.5, n_examples=2, check_leakage=False).fit(frame.where("id < 20"))
    result = model.predict(frame.where("id >= 20"))
    near = {r["id"]: (r["label"], r["row"]) for r in result.examples().where("rank = 1").collect()}
    assert set(near) == set(range(20, 30)) and all(label == "190.0" and "age: 19" in row for label, row in near.values())
    sent = result.frame.where("sent").first()
    text = result.explain(sent["id"])
    for part in (f"price of id {sent['id']}: value 5, from an external answer", "confidence 0.5", "sent, 0.2500 USD", "reason: told so", "model group_mean: ", "model linear: ", "similar case 1, at ", ": 190.0 (", "similar case 2, at "):
        assert part in text
    assert "from the first model" in result.explain(result.frame.where("not sent").first()["id"])
    with pytest.raises(TesseraError):
        result.explain(99)


def test_a_typed_column_takes_labels_of_a_frame_and_tells_its_references(spark):
    frame = spark.createDataFrame([(i, ["red round apple", "yellow long banana", "green sour lime"][i % 3] + f" no{i}", "q") for i in range(12)], "id long, text string, label string")
    y = spark.createDataFrame([(i, ["apple", "banana", "lime"][i % 3]) for i in range(9)], "number long, said string")
    column = TypedColumn("text", "id", stages=[llm_stage(clients.FunctionClient(lambda r: {"value": "lime"}, cost_per_call=0.5), ["lime", "apple"])]).fit(frame, y)
    result = column.transform(frame)
    got = {r["id"]: r["value"] for r in result.collect()}
    assert column.classes_ == ["apple", "banana", "lime"] and all(got[i] == ["apple", "banana", "lime"][i % 3] for i in (9, 10, 11))
    text = column.explain(result, frame, 10)
    assert "row 10: banana, from the vote of its nearest references" in text and "reference 1, at " in text and ": banana" in text
    assert sum(x["n"] for x in column.cost(result).values()) == 12
    with pytest.raises(TesseraError):
        column.explain(result, frame, 77)
    with pytest.raises(TesseraError):
        TypedColumn("text", "id").fit(frame)


def test_scored_lookups_add_what_stays(spark, monkeypatch):
    from tessera.operators import screening

    def answer(request):
        if request.get("kind") == "propose":
            return {"columns": [{"attribute": "factor", "kind": "numeric", "keys": ["model"]}, {"attribute": "noise", "kind": "numeric", "keys": ["serial"]}]}
        return {"answers": [{"key": k, "value": k[1:], "confidence": 0.9} for k in request["keys"]]}

    calls = []

    def score(frame, target, id_col, column, *rest):
        calls.append(column)
        return frame.sparkSession.createDataFrame([(column, 0.5 if column == "factor" else -0.1, column == "factor")], "column string, contribution double, accepted boolean")

    monkeypatch.setattr(screening, "score_column", score)
    cars = spark.createDataFrame([(i, f"m{i % 5}", f"s{i}", float(i % 5)) for i in range(20)], "id long, model string, serial string, price double")
    auto = AutoLookup("price", "id", clients.FunctionClient(answer), scored=True).fit(cars)
    out = auto.transform(cars)
    assert "factor" in out.columns and not any(c.startswith("noise") for c in out.columns) and out.where("factor = cast(substring(model, 2) as int)").count() == 20
    assert auto.transform(cars).count() == 20 and calls == ["factor", "noise"]
    assert auto.explain().splitlines() == ["factor (numeric, by model): stays, contribution 0.5", "noise (numeric, by serial): goes, contribution -0.1"]


def test_a_looked_up_column_is_scored_on_unseen_keys(spark):
    """Copies of a few rows: numbers by name go along with the price by chance of those rows, and say nothing of other names."""

    def answer(request):
        if request.get("kind") == "propose":
            return {"columns": [{"attribute": a, "kind": "numeric", "keys": [k]} for a, k in (("square", "size"), ("noise", "name"))]}
        return {"answers": [{"key": k, "value": str(int(k) ** 2 if request["attribute"] == "square" else int(k[1:]) * 7 % 12), "confidence": 0.9} for k in request["keys"]]}

    rows = spark.createDataFrame([(i, i % 80 * 13 % 23, f"n{i % 80 * 5 % 12}", float((i % 80 * 13 % 23) ** 2)) for i in range(800)], "id long, size int, name string, price double")
    auto = AutoLookup("price", "id", clients.FunctionClient(answer), folds=2, scored=True).fit(rows)
    assert auto.kept() == ["square"]


def test_most_frequent_grams_and_the_target_again(spark):
    frame = spark.createDataFrame([(1, "abab"), (2, "abc"), (3, "bcd")], "id long, text string")
    counts = neighbours.gram_counts(frame, "id", F.col("text"), 2, 2)
    every = neighbours.gram_weights(counts, 3, 1)
    totals = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    few = [r["gram"] for r in neighbours.gram_weights(counts, 3, 1, 2).collect()]
    assert every.count() == len(totals) and sorted(few) == sorted(sorted(totals, key=lambda g: (-totals[g], g))[:2])
    got = frame.select(profile.unlogged(F.log1p(F.col("id"))).alias("x"), profile.unlogged(F.lit(-3.0)).alias("y")).collect()
    assert all(math.isclose(r["x"], i + 1) and r["y"] == 0 for i, r in enumerate(got))

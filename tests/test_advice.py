import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.operators import advice, contracts, diagnose
from tessera.operators.key_lookup import KeyLookup
from tessera.sources import clients

KINDS = {"age": "numeric", "sold": "boolean", "grade": "categorical", "note": "text", "story": "long_text", "code": "id"}


def test_slots_take_each_column_once_and_name_what_does_not_fit():
    notes = []
    answer = {"numeric": ["age", "nope", "age", "grade"], "boolean": ["sold", "grade"], "categorical": ["age", "note"], "text": "note", "long_text": "story"}
    spec = advice.slots(answer, KINDS, notes)
    assert (list(spec.numeric), list(spec.boolean), list(spec.categorical), spec.text, spec.long_text) == (["age"], ["sold"], ["note", "grade"], None, "story")
    assert notes == ["numeric: no such column as nope", "not boolean, so categorical: grade", "numeric: cannot take grade (categorical)"]
    assert not advice.slots({"numeric": "age", "boolean": None, "text": 3}, KINDS, notes).all_columns()


def test_lookups_that_can_be_run():
    notes = []
    items = [
        {"name": "maker", "keys": ["grade"], "attribute": "maker", "type": "category", "values": ["a", "b", "a"], "why": "w"},
        {"name": "bad key", "keys": ["code"], "attribute": "x", "type": "numeric"},
        {"name": "long", "keys": ["story"], "attribute": "x", "type": "numeric"},
        {"keys": ["grade"], "attribute": " ", "type": "numeric"},
        {"keys": [], "attribute": "x"},
        {"keys": ["grade"], "attribute": "none", "values": []},
        {"keys": ["grade", "age"], "attribute": "three", "type": "binary", "values": ["a", "b", "c"]},
        {"keys": ["note"], "attribute": "weight", "type": "numeric", "values": ["1"], "unit": "kg"},
        "no object",
    ]
    got = advice.knowledge_columns(items, KINDS, notes)
    assert [(x["attribute"], x["type"], x["values"]) for x in got] == [("maker", "category", ["a", "b"]), ("three", "category", ["a", "b", "c"]), ("weight", "numeric", [])]
    assert len(notes) == 5 and got[2]["unit"] == "kg"
    assert advice.knowledge_columns(None, KINDS, notes) == []


def test_words():
    assert [advice.bare_role(x) for x in ("You are a wine judge.", "you're an analyst!", "a clerk", " ", None)] == ["a wine judge", "an analyst", "a clerk", "an analyst", "an analyst"]
    d = advice.domain({"role": "You are a judge.", "subject": "wine", "hints": ["a", "b", "c", "d"], "class_names": [{"label": 1, "meaning": "good"}, {"label": "9", "meaning": "?"}]}, "stars", ["0", "1"])
    assert (d.role, d.subject, d.target_name, d.hints, d.class_names) == ("a judge", "wine", "stars", ("a", "b", "c"), {"1": "good"})
    assert [advice.share(x, 0.2) for x in (2, -1, "0.5", None, "x", float("nan"))] == [1.0, 0.0, 0.5, 0.2, 0.2, 0.2]


def test_schemas_are_json_and_closed():
    for s in (contracts.settled(["a", "b", "a"]), contracts.looked_up("numeric"), contracts.proposed(["k"], 3), contracts.advised(["age", "note"])):
        assert json.loads(json.dumps(s)) == s and s["required"] == list(s["properties"]) and s["additionalProperties"] is False
    assert contracts.settled(["a", "b", "a"])["properties"]["value"]["enum"] == ["a", "b"]


def test_refined_recommendation(spark):
    rows = [(i, float(i % 9), "abc"[i % 3], f"maker {i % 4}", "yes" if i % 2 else "no") for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, age double, grade string, maker string, sold string")
    asked = []

    def answer(request):
        asked.append(request)
        return {
            "task": "classification", "role": "You are a dealer.", "subject": "car", "class_names": [{"label": "yes", "meaning": "sold"}],
            "numeric": ["age"], "categorical": ["grade", "maker", "other"], "target_transform": "log1p", "escalate_rate": 7,
            "dedup_ignore": ["id", "gone"], "warnings": ["few rows"], "reasons": [{"topic": "age", "reason": "old cars sell badly"}],
            "knowledge_columns": [{"name": "", "keys": ["maker"], "attribute": "Country of the maker", "type": "category", "values": ["DE", "JP"]}, {"keys": ["sold"], "attribute": "x", "type": "numeric"}],
            "typed_columns": [{"name": "t", "source": "maker", "type": "binary", "values": ["a", "b"]}, {"name": "u", "source": "none"}],
        }

    got = diagnose.diagnose(frame, "sold", "id", client=clients.FunctionClient(answer), screen_text=False)
    assert got.source == "llm" and got.task == "classification" and got.target_transform is None and got.escalate_rate == 1.0
    assert got.domain.role == "a dealer" and got.domain.class_names == {"yes": "sold"} and got.dedup_ignore == ["id"]
    assert [k["attribute"] for k in got.knowledge_columns] == ["Country of the maker"] and [c["name"] for c in got.typed_columns] == ["t"]
    for part in ("few rows", "other", "gone", "unusable keys sold", "none"):
        assert any(part in w for w in got.warnings), part
    assert got.reasons[-1] == "age: old cars sell badly"
    code = got.to_code()
    compile(code, "recommended", "exec")
    assert "country_of_the_maker" in code and "Domain(role='a dealer'" in code
    # The answerer sees the profile and the draft, and no row.
    assert asked[0]["schema"]["additionalProperties"] is False and set(asked[0]["columns"]) == {"age", "grade", "maker"} and "draft" in asked[0]
    odd = diagnose.diagnose(frame, "sold", "id", client=clients.FunctionClient(lambda r: ["no object"]), screen_text=False)
    assert odd.source == "rules"


def test_answers_of_each_kind_of_question(spark):
    said = ['{"choice": "a", "confidence": 2, "probabilities": {"a": 0.75, "b": 0.25}}', '{"choice": "z", "confidence": 0.9}', '{"choice": "b"}', "no json", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "id long, answer string")
    got = [r["c"] for r in t.orderBy("id").select(clients.chosen(F.col("answer"), ["a", "b"]).alias("c")).collect()]
    assert [(r["value"], r["confidence"], r["probability"]) for r in got] == [("a", 1.0, 0.75), (None, 0.9, None), ("b", 0.0, None), (None, 0.0, None), (None, 0.0, None)]
    other = spark.createDataFrame([('{"score": 3.5, "confidence": 0.5}', '{"answer": true, "confidence": 0.6}'), ('{"score": 9}', "{}")], "s string, y string")
    got = other.select(clients.rated(F.col("s"), 0, 5).alias("s"), clients.affirmed(F.col("y")).alias("y")).collect()
    assert [(r["s"]["value"], r["s"]["confidence"], r["y"]["value"]) for r in got] == [(3.5, 0.5, True), (None, 0.0, None)]


def test_the_tier_of_a_lookup_is_asked_by_key(spark, tmp_path):
    calls = tmp_path / "calls"
    seen = lambda: [json.loads(x) for x in calls.read_text().splitlines()]

    def choose(request):
        with open(calls, "a") as f:
            f.write(json.dumps(request) + "\n")
        return {"choice": {"a": "B", "b": "(unknown)", "c": "D", "e": "other"}[json.loads(request["state"])["k"]], "confidence": 0.6 if json.loads(request["state"])["k"] == "c" else 0.9}

    t = spark.createDataFrame([(i, k, "x") for i, k in enumerate("abce")], "id long, k string, l string")
    tier = clients.FunctionClient(choose, "tier", cost_per_call=0.5)
    out = {r.k: r for r in KeyLookup(["k", "l"], "type", values=["B", "D", "unknown"], tier=tier).fit(t).transform(t).collect()}
    assert [(out[k]["type"], out[k]["type_source"]) for k in "abce"] == [("B", "jev"), (None, "unknown"), (None, "rejected"), (None, "rejected")]
    assert len(seen()) == 4 and json.loads(seen()[0]["state"])["l"] == "x" and seen()[0]["options"] == ["B", "D", "unknown", "(unknown)"] and list(seen()[0]["descriptions"]) == ["(unknown)"]
    client = clients.FunctionClient(lambda r: {"answers": [{"key": k, "value": "D", "confidence": 0.9} for k in r["keys"]]}, "llm", cost_per_call=1.0)
    both = {r.k: r for r in KeyLookup(["k"], "type", values=["B", "D"], tier=clients.FunctionClient(lambda r: {"choice": "B" if json.loads(r["state"])["k"] == "a" else "unknown", "confidence": 0.9}, "tier", 0.5), client=client, batch_size=1).fit(t).transform(t).collect()}
    assert [(both[k]["type"], both[k]["type_source"], both[k]["type_cost"]) for k in "abce"] == [("B", "jev", 0.5)] + [("D", "llm", 1.5)] * 3
    # Numbers are no closed set: the tier is passed by.
    number = clients.FunctionClient(lambda r: {"answers": [{"key": k, "known": k != "a", "value": 3, "confidence": 0.9} for k in r["keys"]]}, "llm")
    got = {r.k: (r["n"], r["n_source"]) for r in KeyLookup(["k"], "n", "numeric", tier=tier, client=number).fit(t).transform(t).collect()}
    assert got["a"] == (None, "unknown") and got["b"] == (3.0, "llm") and len(seen()) == 4
    with pytest.raises(TesseraError):
        KeyLookup(["k"], "type", values=[str(i) for i in range(255)], tier=tier)

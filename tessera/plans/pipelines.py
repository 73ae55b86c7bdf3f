"""Queries of the estimators: typed column, key lookup, evidence prediction, screening, diagnosis."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import diagnose, profile, screening
from ..operators.key_lookup import AutoLookup, KeyLookup
from ..operators.models import GroupMean, Linear
from ..operators.predictor import EvidenceRegressor
from ..operators.typed_column import Stage, TypedColumn, llm_stage, settle, tier_stage
from ..sources.clients import FunctionClient
from .evidence import MODELS_SQL, VOTES_SQL
from .registry import Tables, query
from .rows import KEY_SQL


def typed(t: Tables, **options):
    e = t("embeddings").withColumn("known", F.when(F.col("vec_id") % 5 != 0, F.col("label")))
    model = TypedColumn("embedding", "vec_id", labels="known", k=5, vector=True, **options).fit(e)
    return model, e.where("vec_id % 5 = 0")


@query("j2_reference_frame", "SELECT vec_id AS train_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def j2(t: Tables):
    return typed(t)[0].references.select("train_id", "label")


@query("j3_typed_column", f"WITH {VOTES_SQL} SELECT id, CAST(value AS VARCHAR) AS value, round(confidence, 6) AS confidence FROM c")
def j3(t: Tables):
    model, rows = typed(t)
    return model.transform(rows).select("id", "value", F.round("confidence", 6).alias("confidence"))


@query("j4_fallback_chain", """
SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'first' WHEN vec_id % 4 <> 0 THEN 'second' ELSE 'needs_review' END AS source,
CASE WHEN vec_id % 3 = 0 THEN 'a' WHEN vec_id % 4 <> 0 THEN 'b' ELSE CAST(label AS VARCHAR) END AS value, CASE WHEN vec_id % 3 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS cost FROM embeddings""")
def j4(t: Tables):
    open_rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("value"), F.lit(0.3).alias("confidence"))
    first = Stage("first", lambda f: f.select("id", F.lit("a").alias("value"), F.when(F.col("id") % 3 == 0, 0.9).otherwise(0.1).alias("confidence")), 0.7, 0.25)
    second = Stage("second", lambda f: f.select("id", F.when(F.col("id") % 4 != 0, "b").alias("value"), F.lit(0.2).alias("confidence")), None, 0.5)
    return settle(open_rows, [first, second]).select("id", "source", "value", "cost")


@query("j8_typed_status", f"WITH {VOTES_SQL} SELECT CASE WHEN confidence < 0.7 THEN 'needs_review' ELSE 'model' END AS source, count(*) AS n FROM c GROUP BY 1")
def j8(t: Tables):
    model, rows = typed(t, threshold=0.7)
    return model.status(model.transform(rows))


@query("j9_embedding_column", "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id, unnest(embedding[1:3]) AS x, unnest([0, 1, 2]) AS i FROM embeddings)")
def j9(t: Tables):
    out = TypedColumn("embedding", "vec_id", kind="embedding", vector=True).fit(t("embeddings")).transform(t("embeddings"))
    return out.select(F.col("id").alias("vec_id"), F.posexplode(F.slice("value", 1, 3)).alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def looked_up(t: Tables, **options):
    """A lookup whose client answers the length of a key, and does not know keys of "ring"."""

    def answer(request):
        return {"answers": [{"key": k, "value": "unknown" if "ring" in k else str(len(k)), "confidence": (len(k) % 10) / 10, "reason": "counted"} for k in request["keys"]]}

    lookup = KeyLookup(["p_name", "p_brand"], "length", "numeric", low=0, high=24, client=FunctionClient(answer, "length", 0.2), name="length", **options)
    return lookup.fit(t("part"))


@query("k6_looked_up_column", f"""
SELECT p_partkey, CASE WHEN key NOT LIKE '%ring%' AND n <= 24 AND (n % 10) / 10.0 >= 0.4 THEN CAST(n AS DOUBLE) END AS length, CASE WHEN key LIKE '%ring%' THEN 'unknown' WHEN n > 24 OR (n % 10) / 10.0 < 0.4 THEN 'rejected' ELSE 'llm' END AS source
FROM (SELECT p_partkey, {KEY_SQL} AS key, length({KEY_SQL}) AS n FROM part)""")
def k6(t: Tables):
    return looked_up(t).transform(t("part")).select("p_partkey", "length", F.col("length_source").alias("source"))


@query("k8_agreement", f"SELECT count(*) AS n, CAST(1.0 AS DOUBLE) AS agreement FROM (SELECT {KEY_SQL} AS key, length({KEY_SQL}) AS n FROM part) WHERE key NOT LIKE '%ring%' AND n <= 24 AND (n % 10) / 10.0 >= 0.4")
def k8(t: Tables):
    lookup = looked_up(t, check_against="truth")
    return lookup.agreement(lookup.transform(t("part").withColumn("truth", F.length(F.concat_ws(" | ", "p_name", "p_brand")))))


@query("k11_lookup_status", f"SELECT CASE WHEN key LIKE '%ring%' THEN 'unknown' WHEN n > 24 OR (n % 10) / 10.0 < 0.4 THEN 'rejected' ELSE 'llm' END AS source, count(*) AS n FROM (SELECT {KEY_SQL} AS key, length({KEY_SQL}) AS n FROM part) GROUP BY 1")
def k11(t: Tables):
    lookup = looked_up(t)
    return lookup.status(lookup.transform(t("part")))


def predicted(t: Tables, client=None):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    spec = profile.ColumnSpec(numeric=["o_custkey"], categorical=["o_orderpriority"])
    model = EvidenceRegressor("o_totalprice", "o_orderkey", spec=spec, models=[GroupMean("o_orderpriority"), Linear("o_custkey")], client=client, escalate_rate=0.3, check_leakage=False, signal=lambda f: F.round(A.disagreement([F.col("evidence_group_mean"), F.col("evidence_linear")]), 3))
    return model.fit(o.where("o_orderkey % 5 <> 0")).predict(o.where("o_orderkey % 5 = 0"))


SENT_SQL = f"{MODELS_SQL}, t AS (SELECT o_orderkey FROM s ORDER BY round(signal, 3) DESC, o_orderkey LIMIT (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM s))"


@query("i13_provenance", f"WITH {SENT_SQL} SELECT o_orderkey, CASE WHEN o_orderkey IN (FROM t) THEN 'llm' ELSE 'fast' END AS route, CASE WHEN o_orderkey IN (FROM t) THEN 'llm' ELSE 'model' END AS source, round(CASE WHEN o_orderkey IN (FROM t) THEN linear ELSE group_mean END, 3) AS prediction, round(group_mean, 3) AS evidence_group_mean FROM s")
def i13(t: Tables):
    client = FunctionClient(lambda r: {"value": r["evidence"]["linear"], "confidence": 0.8, "reason": "linear"}, cost_per_call=0.01)
    return predicted(t, client).provenance().select("o_orderkey", "route", "source", F.round("prediction", 3).alias("prediction"), F.round("evidence_group_mean", 3).alias("evidence_group_mean"))


@query("d23_cost_summary", f"WITH {SENT_SQL} SELECT (SELECT count(*) FROM s) AS n_rows, count(*) AS n_sent, round(count(*) * 0.01, 6)::DOUBLE AS cost_usd FROM t")
def d23(t: Tables):
    client = FunctionClient(lambda r: {"value": r["evidence"]["linear"]}, cost_per_call=0.01)
    c = predicted(t, client).cost()
    return t.spark.createDataFrame([(c["n_rows"], c["n_sent"], round(c["cost_usd"], 6))], "n_rows long, n_sent long, cost_usd double")


@query("i5_custom_signal", f"WITH {MODELS_SQL} SELECT o_orderkey, round(signal, 3) AS signal FROM s")
def i5(t: Tables):
    return predicted(t).frame.select("o_orderkey", "signal")


@query("h12_screen")
def h12(t: Tables):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("price", F.col("n_chars") % 97 + F.when(F.col("quality") == 1, 50.0).otherwise(0.0))
    return screening.screen(rows, "price", "text", "doc_id", ["n_chars"])


@query("h13_score_column")
def h13(t: Tables):
    o = t("orders").withColumn("looked_up", F.col("o_totalprice") * 1.01)
    return screening.score_column(o, "o_totalprice", "o_orderkey", "looked_up", "numeric", ["o_custkey"], folds=2)


@query("l3_infer_spec")
def l3(t: Tables):
    rows = profile.profile(t("orders"), "o_orderkey")
    return t.spark.createDataFrame([(c.name, c.kind) for c in rows], "name string, kind string")


@query("l4_diagnosis_table", "SELECT count(*) AS n_rows, CAST(count(*) - count(DISTINCT (p_name, p_brand, p_type, p_size, p_retailprice)) AS BIGINT) AS n_duplicate_rows, 'regression' AS task FROM part")
def l4(t: Tables):
    d = diagnose.run_diagnosis(t("part"), "p_retailprice", "p_partkey", screen_text=False)
    return t.spark.createDataFrame([(d.n_rows, d.duplicates.n_duplicate_rows, d.task)], "n_rows long, n_duplicate_rows long, task string")


def asked(t: Tables, **more) -> EvidenceRegressor:
    """An estimator over orders whose requests tell the keys, fitted to four fifths of them."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    spec = profile.ColumnSpec(categorical=["o_orderkey", "o_custkey", "o_orderpriority"])
    models = [GroupMean("o_orderpriority"), Linear("o_custkey")]
    return EvidenceRegressor("o_totalprice", "o_orderkey", spec=spec, models=models, check_leakage=False, **more).fit(o.where("o_orderkey % 5 <> 0"))


def told(request, name: str) -> int:
    return int(re.search(rf"^- {name}: ([\d,]+)$", request["row"], re.MULTILINE)[1].replace(",", ""))


def apart(f):
    return F.round(A.disagreement([F.col("evidence_group_mean"), F.col("evidence_linear")]), 3)


@query("i4_tier_signal", "SELECT o_orderkey, round(1 - coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 10) / 10.0 END, 0), 6) AS signal FROM orders")
def i4(t: Tables):
    def choose(request):
        if told(request, "o_orderkey") % 3 == 0:
            raise ValueError("no answer")
        return {"choice": "linear", "confidence": (told(request, "o_custkey") % 10) / 10}

    model = asked(t, tier=FunctionClient(choose, "tier"), signal="tier")
    return model.predict(t("orders")).frame.select("o_orderkey", F.round("signal", 6).alias("signal"))


@query("i9_predict_merge", f"""WITH {MODELS_SQL}, t AS (SELECT o_orderkey FROM s ORDER BY round(signal, 3) DESC, o_orderkey LIMIT (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM s))
SELECT o_orderkey, CASE WHEN o_orderkey % 35 = 0 THEN 'human' WHEN o_orderkey IN (FROM t) THEN CASE WHEN o_custkey % 7 = 0 THEN 'fallback' ELSE 'llm' END WHEN o_custkey % 4 = 0 THEN 'jev' ELSE 'model' END AS origin,
round(CASE WHEN o_orderkey % 35 = 0 THEN o_totalprice WHEN o_orderkey IN (FROM t) THEN CASE WHEN o_custkey % 7 = 0 THEN group_mean ELSE linear END WHEN o_custkey % 4 = 0 THEN (group_mean + linear) / 2 ELSE group_mean END, 3) AS value FROM s""")
def i9(t: Tables):
    def choose(request):
        if told(request, "o_custkey") % 4:
            raise ValueError("no answer")
        return {"choice": "linear", "probabilities": {"group_mean": 0.5, "linear": 0.5}, "confidence": 0.9}

    def answer(request):
        if told(request, "o_custkey") % 7 == 0:
            raise ValueError("no answer")
        return {"value": request["evidence"]["linear"]}

    rows = t("orders").where("o_orderkey % 5 = 0")
    model = asked(t, client=FunctionClient(answer), tier=FunctionClient(choose, "tier"), escalate_rate=0.3, signal=apart)
    model.approve_values(rows.where("o_orderkey % 35 = 0"), "o_totalprice")
    return model.predict(rows).frame.select("o_orderkey", "origin", F.round("value", 3).alias("value"))


@query("i10_oracle_fallback", f"WITH {MODELS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN round(group_mean, 3) ELSE round(linear, 3) END AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'fallback' ELSE 'llm' END AS origin FROM e")
def i10(t: Tables):
    def answer(request):
        if told(request, "o_orderkey") % 7 == 0:
            raise ValueError("no answer")
        return {"value": request["evidence"]["linear"]}

    model = asked(t, client=FunctionClient(answer), signal=apart)
    return model.predict(t("orders").where("o_orderkey % 5 = 0")).frame.select("o_orderkey", F.round("value", 3).alias("value"), "origin")


@query("j7_client_stages", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'small' WHEN p_partkey % 4 <> 0 THEN 'large' ELSE 'unknown' END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'jev' WHEN p_partkey % 4 <> 0 THEN 'llm' ELSE 'needs_review' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS cost FROM part")
def j7(t: Tables):
    sizes = ["small", "large"]
    tier = FunctionClient(lambda r: {"choice": "small", "confidence": 0.9 if int(r["state"]) % 3 == 0 else 0.5}, "tier", 0.25)
    llm = FunctionClient(lambda r: {"value": "large" if int(r["state"]) % 4 else "huge"}, "llm", 0.5)
    rows = t("part").select(F.col("p_partkey").alias("id"), F.lit("unknown").alias("value"), F.lit(0.1).alias("confidence"), F.col("p_partkey").cast("string").alias("text"))
    return settle(rows, [tier_stage(tier, sizes), llm_stage(llm, sizes)]).select("id", "value", "source", "cost")


@query("k2_proposals", "SELECT * FROM (VALUES ('maker', 'category', 'p_type'), ('weight_kg', 'numeric', 'p_name,p_brand'), ('maker_2', 'binary', 'p_brand')) t(name, kind, keys)")
def k2(t: Tables):
    said = {"columns": [
        {"attribute": "maker", "kind": "category", "keys": ["p_type"], "values": ["a", "b", "a"]},
        {"attribute": "one value", "kind": "category", "keys": ["p_type"], "values": ["a", "a"]},
        {"attribute": "no such key", "kind": "binary", "keys": ["p_other"]},
        {"attribute": "weight (kg)", "kind": "numeric", "keys": ["p_name", "p_brand", "p_name"], "range": [0, 9]},
        {"attribute": "empty range", "kind": "numeric", "keys": ["p_name"], "range": [9, 9]},
        {"attribute": "Maker!", "kind": "binary", "keys": ["p_brand"]},
        {"attribute": "one too many", "kind": "binary", "keys": ["p_brand"]},
    ]}
    auto = AutoLookup("p_retailprice", "p_partkey", FunctionClient(lambda r: said)).fit(t("part"))
    return t.spark.createDataFrame([(p["name"], p["kind"], ",".join(p["keys"])) for p in auto.proposals_], "name string, kind string, keys string")


@query("k6_tier_per_key", """
WITH k AS (SELECT p_partkey, p_size % 3 AS a, p_size % 4 AS b, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
SELECT p_partkey, CASE WHEN a = 0 THEN 'small' WHEN b <> 0 THEN 'large' END AS size_class, CASE WHEN a = 0 THEN 'jev' WHEN b <> 0 THEN 'llm' ELSE 'unknown' END AS source, round(CASE WHEN a = 0 THEN 0.25 ELSE 0.75 END / n, 6)::DOUBLE AS cost FROM k""")
def k6_tier(t: Tables):
    """The tier settles a third of the keys, does not know a third and is unsure of the rest; what it cost goes on to the answers."""

    def choose(request):
        by_size = [("small", 0.9), (request["options"][-1], 0.95), ("large", 0.5)]
        choice, confidence = by_size[int(json.loads(request["state"])["p_size"]) % 3]
        return {"choice": choice, "confidence": confidence}

    def answer(request):
        return {"answers": [{"key": k, "known": int(k.rsplit(" | ", 1)[1]) % 4 != 0, "value": "large", "confidence": 0.8} for k in request["keys"]]}

    lookup = KeyLookup(["p_brand", "p_size"], "size class", values=["small", "large"], tier=FunctionClient(choose, "tier", 0.25), client=FunctionClient(answer, "llm", 0.5), batch_size=1)
    return lookup.fit(t("part")).transform(t("part")).select("p_partkey", "size_class", F.col("size_class_source").alias("source"), F.round("size_class_cost", 6).alias("cost"))


@query("k9_scored_columns", "SELECT p_partkey, CAST(p_size * p_size AS DOUBLE) AS square, 'square' AS added FROM part")
def k9(t: Tables):
    """Of two proposed columns the one that makes the folds' errors smaller is added."""

    def answer(request):
        if request.get("kind") == "propose":
            return {"columns": [{"attribute": "square", "kind": "numeric", "keys": ["p_size"]}, {"attribute": "noise", "kind": "numeric", "keys": ["p_name"]}]}
        value = (lambda k: int(k) ** 2) if request["attribute"] == "square" else (lambda k: int(hashlib.md5(k.encode()).hexdigest()[:4], 16))
        return {"answers": [{"key": k, "known": True, "value": str(value(k)), "confidence": 0.9} for k in request["keys"]]}

    rows = t("part").select("p_partkey", "p_name", "p_size", (F.col("p_size") * F.col("p_size") + F.col("p_partkey") % 3).cast("double").alias("price"))
    out = AutoLookup("price", "p_partkey", FunctionClient(answer), folds=2, scored=True).fit(rows).transform(rows)
    added = ",".join(c for c in ("square", "noise") if c in out.columns)
    return out.select("p_partkey", "square", F.lit(added).alias("added"))

"""Queries of profiles, neighbours, votes, models, signals, routing and looked-up columns."""

from functools import lru_cache  # noqa: F401

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import lookup, neighbours, profile, routing, sampling, scores
from ..operators.boosting import Boosted
from ..operators.models import GroupMean, Linear, Trees
from ..operators.text_index import TextIndex
from ..operators.text_svd import TextSVD
from ..sources import caches, clients
from ..sources.checkpoints import cut
from .registry import Tables, query
from .rows import KEY_SQL, part_answers


@query("d3_column_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_unique, round(avg(length({c})), 6) AS mean_chars FROM documents" for c in ("text", "lang", "source")))
def d3(t: Tables):
    return profile.statistics(t("documents").select("text", "lang", "source")).select("name", "n_rows", "n_values", "n_unique", F.round("mean_chars", 6).alias("mean_chars"))


@query("d3_numeric_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n_values, count(DISTINCT {c}) AS n_unique, bool_and({c} % 1 = 0) AS integral FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")))
def d3n(t: Tables):
    return profile.statistics(t("lineitem").select("l_quantity", "l_discount", "l_linenumber")).select("name", "n_values", "n_unique", "integral")


@query("d4_token_novelty", "SELECT round(count(DISTINCT w) / count(*), 6) AS novelty FROM (SELECT unnest(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) AS w FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500))")
def d4(t: Tables):
    return profile.token_novelty(t("part"), "p_name", "p_partkey").select(F.round("novelty", 6).alias("novelty"))


@query("d5_target_profile", """
SELECT n, round(mean, 4) AS mean, round(median, 4) AS median, least, greatest, round(p995, 4) AS p995, n_not_positive, round(mean / median, 6) AS mean_over_median, mean / median >= 1.5 AND least >= 0 AS log_suggested, p995 > 0 AND greatest > 10 * p995 AS clip_suggested
FROM (SELECT count(*) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median, min(o_totalprice) AS least, max(o_totalprice) AS greatest, quantile_cont(o_totalprice, 0.995) AS p995, count(*) FILTER (o_totalprice <= 0) AS n_not_positive FROM orders)""")
def d5(t: Tables):
    out = profile.number_target(t("orders"), "o_totalprice")
    return out.withColumns({**{c: F.round(c, 4) for c in ("mean", "median", "p995")}, "mean_over_median": F.round("mean_over_median", 6)})


@query("d6_class_profile", "SELECT quality AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1")
def d6(t: Tables):
    return profile.class_target(t("labels"), "quality").select("label", "n", F.round("share", 6).alias("share"))


@query("d8_constant_tokens", """
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(text, '[\\s/・,、|｜]+'), lambda x: x <> ''))) AS token FROM documents)
SELECT token, count(*) AS df FROM w GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM documents) >= 0.3""")
def d8(t: Tables):
    from ..operators.typed_column import constant_tokens

    return constant_tokens(t("documents"), F.col("text"), 0.3)


@query("d9_ngram_df_idf", """
WITH d AS (SELECT doc_id, text AS t FROM documents), w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')) AS w FROM d),
g AS (SELECT DISTINCT doc_id, unnest(flatten([[substring(' ' || w || ' ', i, n) for i in generate_series(1, length(w) + 3 - n)] for n in [2, 3, 4]])) AS gram FROM w)
SELECT gram, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1, 6) AS idf FROM g WHERE length(gram) >= 2 GROUP BY 1 HAVING count(*) >= 2""")
def d9(t: Tables):
    d = t("documents").select("doc_id", F.col("text").alias("t"))
    return neighbours.gram_frequencies(d, "doc_id", F.col("t")).where("df >= 2").select("gram", "df", F.round(neighbours.idf(d.count()), 6).alias("idf"))


PAIRS_SQL = """p AS (SELECT a.vec_id AS id, b.vec_id AS train_id, b.label, list_sum([CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE) for x in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in a.embedding])) * sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in b.embedding]))) AS s
FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, train_id) AS rank FROM p QUALIFY rank <= 5)"""
VOTES_SQL = f"{PAIRS_SQL}, v AS (SELECT id, label, sum(greatest(s, 0)) AS score, min(rank) AS first_rank FROM k GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_rank) AS place FROM v), e AS (SELECT id, max(CASE WHEN place = 1 THEN label END) AS value, max(CASE WHEN place = 1 THEN score END) AS s1, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS s2 FROM o GROUP BY 1), c AS (SELECT id, value, CASE WHEN s1 + s2 > 0 THEN s1 / (s1 + s2) ELSE 0.0 END AS confidence FROM e)"


def voted(t: Tables):
    e = t("embeddings")
    refs = e.where("vec_id % 5 <> 0")
    found = neighbours.nearest_vectors(e.where("vec_id % 5 = 0"), refs, "vec_id", "embedding", 5)
    return found, refs.select(F.col("vec_id").alias("train_id"), "label")


@query("d10_weighted_vote", f"WITH {VOTES_SQL} SELECT id, value, round(confidence, 6) AS confidence FROM c")
def d10(t: Tables):
    return neighbours.elected(neighbours.votes(*voted(t))).select("id", "value", F.round("confidence", 6).alias("confidence"))


@query("d13_knn_class_rates", f"WITH {PAIRS_SQL} SELECT id, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS p0, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS p1, round(avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END), 6) AS p2 FROM k GROUP BY 1")
def d13(t: Tables):
    found, labels = voted(t)
    p = neighbours.rates_of(found, labels, "train_id", "label", list(range(10)))
    return p.select("id", *(F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)))


@query("e2_nearest_references", f"WITH {PAIRS_SQL} SELECT id, train_id, round(s, 6) AS similarity, rank FROM k")
def e2(t: Tables):
    return voted(t)[0].select("id", "train_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("e5_least_confident", f"WITH {VOTES_SQL} SELECT id FROM c ORDER BY round(confidence, 6), id LIMIT (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM c)")
def e5(t: Tables):
    one = neighbours.elected(neighbours.votes(*voted(t))).withColumn("confidence", F.round("confidence", 6))
    return routing.top_rows(one, "confidence", "id", sampling.half_even(one.count() * 0.3), descending=False).select("id")


@query("d22_status_counts", f"WITH {VOTES_SQL} SELECT CASE WHEN round(confidence, 6) < 0.6 THEN 'needs_review' ELSE 'model' END AS source, count(*) AS n FROM c GROUP BY 1")
def d22(t: Tables):
    one = neighbours.elected(neighbours.votes(*voted(t)))
    return lookup.status(one.withColumn("source", F.when(F.round("confidence", 6) < 0.6, "needs_review").otherwise("model")))


@query("d32_k_auto", "SELECT greatest(1, least(5, CAST(floor(count(*) / count(DISTINCT label)) AS INT))) AS k FROM embeddings WHERE vec_id % 5 <> 0")
def d32(t: Tables):
    n, classes = t("embeddings").where("vec_id % 5 <> 0").agg(F.count("*"), F.count_distinct("label")).first()
    return t.spark.createDataFrame([(neighbours.k_auto(n, classes),)], "k int")


CUSTOMER_SQL = """m AS (SELECT median(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer),
p AS (SELECT a.c_custkey AS id, b.c_custkey AS train_id, b.c_acctbal AS y, -0.15 * abs(a.c_acctbal - b.c_acctbal) / (CASE WHEN s > 0 THEN s ELSE 1 END) AS s FROM customer a, customer b, m WHERE a.c_custkey % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, train_id) AS rank FROM p QUALIFY rank <= 5)"""


def customer_neighbours(t: Tables):
    c = t("customer")
    return neighbours.nearest_numeric(c.where("c_custkey % 20 = 0"), c, "c_custkey", ["c_acctbal"], 5)


@query("c2_knn_numeric", f"WITH {CUSTOMER_SQL} SELECT id, round(median(y), 4) AS prediction FROM k GROUP BY 1")
def c2(t: Tables):
    return neighbours.median_of(customer_neighbours(t), t("customer"), "c_custkey", "c_acctbal").select("id", F.round("prediction", 4).alias("prediction"))


@query("e3_ranked_examples", f"WITH {CUSTOMER_SQL} SELECT id, train_id, round(s, 6) + 0.0 AS similarity, rank FROM k")
def e3(t: Tables):
    return customer_neighbours(t).select("id", "train_id", (F.round("similarity", 6) + 0.0).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("i2_similarity_signal", f"WITH {CUSTOMER_SQL} SELECT id, round(-max(s), 6) + 0.0 AS signal FROM k GROUP BY 1")
def i2(t: Tables):
    return customer_neighbours(t).groupBy("id").agg((F.round(-F.max("similarity"), 6) + 0.0).alias("signal"))


TFIDF_SQL = """w AS (SELECT p_partkey AS id, unnest(list_filter(string_split(lower(p_name || ' ' || p_brand), ' '), lambda x: x <> '')) AS w FROM part),
g AS (SELECT id, unnest(flatten([[substring(' ' || w || ' ', i, n) for i in generate_series(1, length(w) + 3 - n)] for n in [2, 3, 4]])) AS gram FROM w),
c AS (SELECT id, gram, count(*) AS n FROM g WHERE length(gram) >= 2 GROUP BY 1, 2), d AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT id, gram, n * idf AS w FROM c JOIN d USING (gram)), v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x)"""


def part_vectors(t: Tables):
    p = t("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("s"))
    counts = cut(neighbours.gram_counts(p, "p_partkey", F.col("s")))
    return neighbours.sparse_vectors(counts, neighbours.gram_weights(counts, p.count()))


@query("h7_sparse_tfidf", f"WITH {TFIDF_SQL} SELECT id, gram, round(w, 6) AS w FROM v")
def h7(t: Tables):
    return part_vectors(t).select("id", "gram", F.round("w", 6).alias("w"))


@query("c2_knn_text", f"WITH {TFIDF_SQL}, s AS (SELECT a.id, b.id AS train_id, round(sum(a.w * b.w), 6) AS similarity FROM v a JOIN v b USING (gram) WHERE a.id % 20 = 0 GROUP BY 1, 2) SELECT id, train_id, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, train_id) AS rank FROM s QUALIFY rank <= 5")
def c2_text(t: Tables):
    v = cut(part_vectors(t))
    return TextIndex(digits=6).fit(v).nearest(v.where("id % 20 = 0"), 5).withColumn("rank", F.col("rank").cast("long"))


@query("h7_text_svd")
def h7_svd(t: Tables):
    """The columns that every name becomes."""
    p = t("part")
    found = TextSVD().fit(p, "p_partkey", "p_name").transform(p, "p_partkey", "p_name")
    return found.select(F.col("id").alias("p_partkey"), F.posexplode("x").alias("component", "value"))


MODELS_SQL = """g AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1), r AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0),
e AS (SELECT o_orderkey, o_totalprice, o_custkey, coalesce(g.m, r.m) AS group_mean, b + a * o_custkey AS linear FROM orders LEFT JOIN g USING (o_orderpriority), r WHERE o_orderkey % 5 = 0), s AS (SELECT *, round(greatest(group_mean, linear) - least(group_mean, linear), 6) AS signal FROM e)"""


def evidence(t: Tables):
    """Test orders with the outputs of two fitted models, and how far they are apart."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    train, out = o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0")
    for model in (GroupMean("o_orderpriority"), Linear("o_custkey")):
        out = model.fit(train, "o_totalprice").predict(out, model.name)
    return out.withColumn("signal", F.round(A.disagreement([F.col("group_mean"), F.col("linear")]), 6))


@query("h6_linear_and_group_models", f"WITH {MODELS_SQL} SELECT o_orderkey, round(group_mean, 4) AS group_mean, round(linear, 4) AS linear FROM e")
def h6(t: Tables):
    return evidence(t).select("o_orderkey", F.round("group_mean", 4).alias("group_mean"), F.round("linear", 4).alias("linear"))


@query("c11_evidence_frame", f"WITH {MODELS_SQL} SELECT o_orderkey, round(group_mean, 4) AS base, greatest(round(group_mean, 4), round(linear, 4)) AS largest FROM e")
def c11(t: Tables):
    e = evidence(t).withColumns({"group_mean": F.round("group_mean", 4), "linear": F.round("linear", 4)})
    return e.select("o_orderkey", F.col("group_mean").alias("base"), F.greatest("group_mean", "linear").alias("largest"))


@query("d15_disagreement", f"WITH {MODELS_SQL} SELECT o_orderkey, round(signal, 3) AS signal FROM s")
def d15(t: Tables):
    return evidence(t).select("o_orderkey", F.round("signal", 3).alias("signal"))


@query("d16_tv_distance", """
SELECT doc_id, round(greatest((abs(a - b) + abs(b - a)) / 2, (abs(a - c) + abs(c - a)) / 2, (abs(b - c) + abs(c - b)) / 2), 6) AS distance
FROM (SELECT doc_id, (doc_id % 5) / 5.0 AS a, (doc_id % 7) / 7.0 AS b, (doc_id % 11) / 11.0 AS c FROM labels)""")
def d16(t: Tables):
    p = lambda n: F.array((F.col("doc_id") % n) / n, 1 - (F.col("doc_id") % n) / n)
    return t("labels").select("doc_id", F.round(A.disagreement([p(5), p(7), p(11)], classification=True), 6).alias("distance"))


@query("d17_mae_accuracy", f"WITH {MODELS_SQL} SELECT round(avg(abs(group_mean - o_totalprice)), 4) AS mae, round(avg(CASE WHEN (group_mean > 250000) = (o_totalprice > 250000) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e")
def d17(t: Tables):
    return evidence(t).agg(F.round(scores.mean_absolute_error(F.col("o_totalprice"), F.col("group_mean")), 4).alias("mae"), F.round(scores.accuracy(F.col("o_totalprice") > 250000, F.col("group_mean") > 250000), 6).alias("accuracy"))


@query("d18_log_loss", "SELECT round(avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM (SELECT quality, (doc_id % 9 + 0.5) / 9.5 AS p FROM labels)")
def d18(t: Tables):
    p = (F.col("doc_id") % 9 + 0.5) / 9.5
    return t("labels").agg(F.round(scores.log_loss(F.col("quality"), F.array(1 - p, p)), 6).alias("log_loss"))


@query("d19_fold_contribution", f"""WITH {MODELS_SQL}, f AS (SELECT o_orderkey % 4 AS fold, avg(abs(linear - o_totalprice)) AS a, avg(abs((linear + o_totalprice) / 2 - o_totalprice)) AS b FROM e GROUP BY 1)
SELECT round((avg(a) - avg(b)) / avg(a), 6) AS contribution, count(*) FILTER (a > b) AS wins, 'worth_trying' AS verdict FROM f""")
def d19(t: Tables):
    e = evidence(t).groupBy(F.col("o_orderkey") % 4).agg(scores.mean_absolute_error(F.col("o_totalprice"), F.col("linear")).alias("a"), scores.mean_absolute_error(F.col("o_totalprice"), (F.col("linear") + F.col("o_totalprice")) / 2).alias("b"))
    return scores.contribution(e, "a", "b").select(F.round("contribution", 6).alias("contribution"), "wins", "verdict")


@query("d26_weighted_models", f"WITH {MODELS_SQL} SELECT o_orderkey, round(CASE WHEN greatest(o_orderkey % 3 - 1, 0) + 0.5 > 0 THEN (group_mean * greatest(o_orderkey % 3 - 1, 0) + linear * 0.5) / (greatest(o_orderkey % 3 - 1, 0) + 0.5) END, 3) AS value FROM e")
def d26(t: Tables):
    return evidence(t).select("o_orderkey", F.round(A.weighted_average([F.col("group_mean"), F.col("linear")], [(F.col("o_orderkey") % 3 - 1).cast("double"), F.lit(0.5)]), 3).alias("value"))


@query("d27_signal_confidence", f"WITH {MODELS_SQL} SELECT o_orderkey, round(1 - (signal - min(signal) OVER ()) / (max(signal) OVER () - min(signal) OVER ()), 6) AS confidence FROM s")
def d27(t: Tables):
    return routing.confidence(evidence(t), "signal").select("o_orderkey", F.round("confidence", 6).alias("confidence"))


@query("e4_route_top_rate", f"WITH {MODELS_SQL} SELECT o_orderkey FROM s ORDER BY round(signal, 3) DESC, o_orderkey LIMIT (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) FROM s)")
def e4(t: Tables):
    return routing.selected(evidence(t).withColumn("signal", F.round("signal", 3)), "signal", "o_orderkey", rate=0.3).select("o_orderkey")


@query("e7_curve", f"""WITH {MODELS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY round(signal, 3) DESC, o_orderkey) AS place, count(*) OVER () AS n FROM s), rr AS (SELECT unnest([0.0, 0.1, 0.3, 1.0]) AS rate)
SELECT CAST(rate AS DOUBLE) AS rate, CAST(round_even(max(n) * rate, 0) AS BIGINT) AS n_sent, round(avg(abs(CASE WHEN place <= round_even(n * rate, 0) THEN linear ELSE group_mean END - o_totalprice)), 4) AS error FROM o, rr GROUP BY rate""")
def e7(t: Tables):
    e = evidence(t).withColumn("signal", F.round("signal", 3))
    return routing.curve(e, "signal", "o_orderkey", "o_totalprice", "group_mean", "linear", [0.0, 0.1, 0.3, 1.0]).select("rate", "n_sent", F.round("error", 4).alias("error"))


@query("i8_plan", "SELECT count(*) AS n_rows, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n_sent, CAST(round(round_even(count(*) * 0.2, 0) * 0.0086, 6) AS DOUBLE) AS cost_usd, CAST(round(23.85 + ceil(round_even(count(*) * 0.2, 0) / 8) * 4.6, 6) AS DOUBLE) AS seconds FROM orders")
def i8(t: Tables):
    p = routing.plan(t("orders"), "o_totalprice", "o_orderkey", rate=0.2)
    return t.spark.createDataFrame([(p["n_rows"], p["n_sent"], round(p["cost_usd"], 6), round(p["seconds"], 6))], "n_rows long, n_sent long, cost_usd double, seconds double")


@query("e13_first_samples", "SELECT DISTINCT substring(p_type, 1, 60) AS value FROM part ORDER BY 1 LIMIT 3")
def e13(t: Tables):
    return profile.first_samples(t("part"), "p_type")


@query("e14_text_slot", "SELECT c AS name, round(m * u, 4) AS weight FROM (SELECT 'p_name' AS c, avg(length(p_name)) AS m, count(DISTINCT p_name) AS u FROM part UNION ALL SELECT 'p_brand', avg(length(p_brand)), count(DISTINCT p_brand) FROM part) ORDER BY weight DESC LIMIT 1")
def e14(t: Tables):
    rows = profile.statistics(t("part").select("p_name", "p_brand"))
    return rows.select("name", F.round(F.col("mean_chars") * F.col("n_unique"), 4).alias("weight")).orderBy(F.col("weight").desc(), "name").limit(1)


@query("e15_folds", "SELECT o_orderkey, CAST(('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 5 AS INT) AS fold FROM orders")
def e15(t: Tables):
    return t("orders").select("o_orderkey", sampling.fold(F.col("o_orderkey"), 5).alias("fold"))


@query("e15_stratified_folds", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels")
def e15s(t: Tables):
    return sampling.stratified_folds(t("labels"), "quality", "doc_id", 5).select("doc_id", "fold")


@query("e10_review_queue", f"WITH k AS (SELECT {KEY_SQL} AS key, count(*) AS count FROM part GROUP BY 1) SELECT key, count, 'error' AS source FROM k WHERE length(key) % 4 = 0")
def e10(t: Tables):
    counts = lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand"))
    return lookup.review_queue(part_answers(t), counts)


@query("k4_lookup_plan", f"WITH k AS (SELECT {KEY_SQL} AS key, count(*) AS count FROM part GROUP BY 1) SELECT count(*) AS n_keys, count(*) FILTER (length(key) % 4 = 0) AS n_to_ask, CAST(sum(count) FILTER (length(key) % 4 = 0) AS BIGINT) AS n_rows FROM k")
def k4(t: Tables):
    counts = lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand"))
    ask = lookup.to_ask(counts, part_answers(t)).select("key", F.lit(True).alias("ask"))
    return counts.join(ask, "key", "left").agg(F.count("*").alias("n_keys"), F.count("ask").alias("n_to_ask"), F.sum(F.when(F.col("ask"), F.col("count"))).alias("n_rows"))


@query("k5_batches", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM part), p AS (SELECT key, CAST(('0x' || substring(md5(key), 1, 4))::BIGINT % 64 AS INT) AS part FROM k), b AS (SELECT part, key, CAST(floor((row_number() OVER (PARTITION BY part ORDER BY key) - 1) / 20) AS BIGINT) AS batch FROM p) SELECT part || '-' || batch AS batch, count(*) AS n, min(key) AS first_key FROM b GROUP BY part, b.batch")
def k5(t: Tables):
    out = lookup.batches(lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand")), 20)
    return out.select("batch", F.size("keys").cast("long").alias("n"), F.col("keys")[0].alias("first_key"))


@query("k7_resolve", """
WITH a AS (SELECT p_partkey, upper(p_name) AS value, (length(p_name) % 10) / 10.0 AS confidence FROM part)
SELECT p_partkey, CASE WHEN confidence >= 0.4 THEN value END AS value, CASE WHEN confidence < 0.4 THEN 'rejected' ELSE 'llm' END AS source FROM a""")
def k7(t: Tables):
    answers = lookup.thresholded(part_answers(t).withColumn("source", F.lit("llm")), 0.4)
    return lookup.resolved(lookup.keyed(t("part"), "p_name", "p_brand").select("p_partkey", "key"), answers).select("p_partkey", "value", "source")


@query("k10_cost", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM part) SELECT count(*) AS n_keys, round(count(*) * ((60 + 15 * 20) * 5.0 + 600 * 5.0 * 0.1 + 70 * 20 * 25.0) / 1e6 / 20, 6) AS cost_usd FROM k")
def k10(t: Tables):
    n = lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand"))
    return n.agg(F.count("*").alias("n_keys"), F.round(F.count("*") * lookup.cost_per_key(20, 5.0, 25.0), 6).alias("cost_usd"))


def _request(t: Tables):
    return lookup.keyed(t("part"), "p_name", "p_brand").select("key", F.to_json(F.struct("p_name", "p_brand")).alias("request"))


def _client():
    return clients.FunctionClient(lambda r: {"length": len(r["p_name"])} if "ring" not in r["p_name"] else 1 / 0, "length", 0.25)


@query("m1_cached_oracle", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM part) SELECT count(*) AS n_calls, count(*) FILTER (key NOT LIKE '%ring%') AS cache_hits, count(*) FILTER (key LIKE '%ring%') AS errors, CAST(0.0 AS DOUBLE) AS cost_usd FROM k")
def m1(t: Tables):
    first = clients.answered(_request(t), _client())
    return clients.usage(clients.answered(_request(t), _client(), first))


@query("d24_usage_totals", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM part) SELECT count(*) AS n_calls, CAST(0 AS BIGINT) AS cache_hits, count(*) FILTER (key LIKE '%ring%') AS errors, round(0.25 * count(*) FILTER (key NOT LIKE '%ring%'), 6)::DOUBLE AS cost_usd FROM k")
def d24(t: Tables):
    return clients.usage(clients.answered(_request(t), _client())).withColumn("cost_usd", F.round("cost_usd", 6))


@query("a4_embedding_cache_roundtrip", "SELECT count(DISTINCT text) AS first_pass, CAST(0 AS BIGINT) AS second_pass FROM documents")
def a4(t: Tables):
    import uuid

    path = f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-vectors-{uuid.uuid4().hex}"
    d = t("documents").select(F.col("text").alias("s"))
    length = lambda f: f.withColumn("vector", F.array(F.char_length("text").cast("float")))
    passes = [caches.add_vectors(d, path, "s", length) for _ in range(2)]
    return t.spark.createDataFrame([tuple(passes)], "first_pass long, second_pass long")


@query("a5_knowledge_cache_roundtrip", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM part) SELECT count(*) AS asked_first, count(*) FILTER (length(key) % 4 = 0) AS asked_second FROM k")
def a5(t: Tables):
    import uuid

    path = f"{t.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-answers-{uuid.uuid4().hex}"
    counts = lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand"))
    schema, passes = "key string, value string, confidence double, source string, cost double", []
    for _ in range(2):
        ask = lookup.to_ask(counts, caches.load(t.spark, path, schema))
        passes.append(ask.count())
        caches.save_answers(part_answers(t).join(ask.select("key"), "key", "left_semi"), path)
    return t.spark.createDataFrame([tuple(passes)], "asked_first long, asked_second long")


@query("h1_tree_models")
def h1(t: Tables):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    model = Trees(["o_custkey"], ["o_orderpriority", "o_orderstatus"], trees=5, depth=3).fit(o.where("o_orderkey % 5 <> 0"), "o_totalprice")
    return model.predict(o.where("o_orderkey % 5 = 0"), "prediction").select("o_orderkey", "prediction")


@query("h1b_multiclass")
def h1b(t: Tables):
    """Shares of the languages of each document by trees over how often it has each of some letters, learned from four fifths of them."""
    letters = "etaoinshrdluäéñóßçüè"
    size = F.nullif(F.char_length("text"), F.lit(0))
    often = [((size - F.char_length(F.replace("text", F.lit(x)))) / size).alias(f"x{i}") for i, x in enumerate(letters)]
    rows = t("documents").select("doc_id", "lang", *often)
    model = Boosted([f"x{i}" for i in range(len(letters))], [], "leaf", "classification", rounds=8, rate=0.3).fit(rows.where("lang is not null and doc_id % 5 <> 0"), "lang")
    likeliest = F.element_at(F.array(*map(F.lit, model.classes)), A.argmax(F.col("shares")) + 1)
    return model.predict(rows, "shares").select("doc_id", "lang", likeliest.alias("predicted"), F.to_json(F.transform("shares", lambda p: F.round(p, 6))).alias("shares"))


@query("h2_boosted_leafwise")
def h2(t: Tables):
    """The retail price of each part by leaf-wise and by level-wise trees, learned from four fifths of them."""
    p = t("part").select("p_partkey", "p_retailprice", "p_size", "p_brand", "p_type")
    out = p
    for growth in ("leaf", "level"):
        model = Boosted(["p_partkey", "p_size"], ["p_brand", "p_type"], growth, rounds=10, rate=0.2).fit(p.where("p_partkey % 5 <> 0"), "p_retailprice")
        out = model.predict(out, f"{growth}wise")
    return out.select("p_partkey", "p_retailprice", F.round("leafwise", 4).alias("leafwise"), F.round("levelwise", 4).alias("levelwise"))

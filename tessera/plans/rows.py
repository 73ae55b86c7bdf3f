"""Queries of projections, filters, joins by key, and text functions."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import leakage, lookup, neighbours, profile, routing, sampling
from .registry import Tables, query


@query("b1_spec_projection", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders")
def b1(t: Tables):
    return profile.ColumnSpec(numeric=["o_custkey", "o_totalprice"], categorical=["o_orderpriority"]).project(t("orders"), "o_orderkey")


@query("b2_join_text_columns", "SELECT p_partkey, coalesce(p_name,'') || ' ' || coalesce(p_brand,'') || ' ' || coalesce(p_type,'') AS joined FROM part")
def b2(t: Tables):
    return t("part").select("p_partkey", X.join_columns("p_name", "p_brand", "p_type").alias("joined"))


@query("b3_eligible_rows", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND trim(d.text) <> ''")
def b3(t: Tables):
    return t("documents").join(t("labels"), "doc_id", "left").where(F.col("quality").isNotNull() & (F.trim("text") != "")).select("doc_id", "quality")


@query("b5_seeded_cap", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def b5(t: Tables):
    return sampling.capped(t("orders").select("o_orderkey"), "o_orderkey", 500)


@query("b6_clip_log_target", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(ln(1 + l_extendedprice), 6) AS log_target FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.995) FROM lineitem) AND l_extendedprice >= 0""")
def b6(t: Tables):
    return profile.clip_and_log(t("lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round("log_target", 6).alias("log_target"))


@query("b7_uncertain_to_null", "SELECT vec_id, CASE WHEN (vec_id % 10) / 10.0 >= 0.5 THEN label END AS value FROM embeddings")
def b7(t: Tables):
    return t("embeddings").withColumn("confidence", (F.col("vec_id") % 10) / 10).select("vec_id", F.when(F.col("confidence") >= 0.5, F.col("label")).alias("value"))


@query("b9_threshold_route", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000")
def b9(t: Tables):
    return routing.selected(t("orders"), "o_totalprice", "o_orderkey", threshold=250000.0).select("o_orderkey", "o_totalprice")


@query("b10_unseen_level_to_null", """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey % 5 <> 0 AND k.c_nationkey < 20 AND k.c_nationkey = c.c_nationkey) THEN c_nationkey END AS level
FROM customer c WHERE c_custkey % 5 = 0""")
def b10(t: Tables):
    c = t("customer")
    known = c.where("c_custkey % 5 <> 0 and c_nationkey < 20").select(F.col("c_nationkey").alias("level")).distinct()
    return c.where("c_custkey % 5 = 0").join(neighbours.small(known), F.col("c_nationkey") == F.col("level"), "left").select("c_custkey", "level")


@query("b12_boolean_text", """
SELECT p_partkey, CASE WHEN lower(trim(w)) IN ('1','true','yes','y','t') THEN 1.0 WHEN lower(trim(w)) IN ('0','false','no','n','f') THEN 0.0 END::DOUBLE AS flag
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'f' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' END AS w FROM part)""")
def b12(t: Tables):
    n = F.col("p_partkey") % 6
    word = F.when(n == 0, " Yes ").when(n == 1, "f").when(n == 2, "TRUE").when(n == 3, "0").when(n == 4, "maybe")
    return t("part").select("p_partkey", X.boolean_number(word).alias("flag"))


@query("b13_median_impute", """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS x FROM customer),
m AS (SELECT median(x) AS m FROM c WHERE c_custkey % 5 <> 0)
SELECT c_custkey, round(coalesce(x, m), 4) AS x FROM c, m""")
def b13(t: Tables):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"))
    return neighbours.imputed(c, ["x"], neighbours.standards(c.where("c_custkey % 5 <> 0"), ["x"])).select("c_custkey", F.round("x", 4).alias("x"))


@query("b14_key_min_count", "SELECT lower(p_name) || ' | ' || lower(p_brand) AS key, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 2")
def b14(t: Tables):
    return lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand"), 2)


@query("b16_validate_answers", """
SELECT p_partkey, CASE WHEN p_retailprice % 10 < 5 AND p_retailprice BETWEEN 900 AND 1500 THEN round(p_retailprice, 2) END AS price,
CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type END AS type FROM part""")
def b16(t: Tables):
    p = t("part")
    given = F.when(F.col("p_retailprice") % 10 < 5, F.format_number("p_retailprice", 2)).otherwise("no idea")
    category = F.concat(F.lit("  "), F.lower("p_type"), F.lit(" "))
    price = lookup.validated(given, "numeric", low=900, high=1500)
    return p.select("p_partkey", F.round(price.cast("double"), 2).alias("price"), lookup.validated(category, "category", ["ECONOMY", "STANDARD"]).alias("type"))


@query("c1_overlap_semi", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders a WHERE o_orderkey % 5 = 0 AND EXISTS (
SELECT 1 FROM orders b WHERE b.o_orderkey % 5 <> 0 AND b.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus AND b.o_orderpriority IS NOT DISTINCT FROM a.o_orderpriority AND b.o_orderdate IS NOT DISTINCT FROM a.o_orderdate)""")
def c1(t: Tables):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return leakage.overlap_rows(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), ignore=["o_orderkey"])


KEY_SQL = "lower(p_name) || ' | ' || lower(p_brand)"
ANSWERS_SQL = f"SELECT DISTINCT {KEY_SQL} AS key, upper(p_name) AS value, (length(p_name) % 10) / 10.0 AS confidence, CASE WHEN length({KEY_SQL}) % 4 = 0 THEN 'error' ELSE 'llm' END AS source, 0.5 AS cost FROM part"


def part_answers(t: Tables):
    """Answers that SQL can make up too: one for each key."""
    keyed = lookup.keyed(t("part"), "p_name", "p_brand")
    return keyed.select("key", F.upper("p_name").alias("value"), ((F.length("p_name") % 10) / 10).alias("confidence"), F.when(F.length("key") % 4 == 0, "error").otherwise("llm").alias("source"), F.lit(0.5).alias("cost")).distinct()


@query("c4_key_lookup_join", f"""
WITH a AS ({ANSWERS_SQL}), r AS (SELECT p_partkey, {KEY_SQL} AS key FROM part), n AS (SELECT key, count(*) AS n FROM r GROUP BY 1)
SELECT p_partkey, key, value, source, round(cost / n, 6) AS cost FROM r JOIN a USING (key) JOIN n USING (key)""")
def c4(t: Tables):
    out = lookup.resolved(lookup.keyed(t("part"), "p_name", "p_brand").select("p_partkey", "key"), part_answers(t))
    return out.select("p_partkey", "key", "value", "source", F.round("cost", 6).alias("cost"))


@query("c5_unknown_keys_anti", f"SELECT DISTINCT {KEY_SQL} AS key FROM part WHERE length({KEY_SQL}) % 4 = 0")
def c5(t: Tables):
    return lookup.to_ask(lookup.key_counts(lookup.keyed(t("part"), "p_name", "p_brand")), part_answers(t)).select("key")


@query("c7_approved_rows", """
WITH top AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM orders))
SELECT o_orderkey, o_totalprice FROM top WHERE o_orderkey % 3 <> 0""")
def c7(t: Tables):
    o = t("orders")
    return routing.selected(o, "o_totalprice", "o_orderkey", rate=0.1, approved=o.where("o_orderkey % 3 = 0")).select("o_orderkey", "o_totalprice")


@query("c8_unseen_levels", """
WITH k AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 40 = 1), s AS (SELECT DISTINCT p_type FROM part WHERE p_partkey % 40 = 1)
SELECT p_partkey, CAST((p_brand NOT IN (SELECT p_brand FROM k)) AS INT) + CAST((p_type NOT IN (SELECT p_type FROM s)) AS INT) AS unseen_levels FROM part WHERE p_partkey % 40 <> 1""")
def c8(t: Tables):
    p = t("part")
    return routing.unseen_levels(p.where("p_partkey % 40 <> 1"), p.where("p_partkey % 40 = 1"), "p_partkey", ["p_brand", "p_type"])


WORDS_SQL = "SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents"


@query("c9_unseen_words", f"""
WITH w AS ({WORDS_SQL}), k AS (SELECT DISTINCT w FROM w WHERE doc_id % 10 <> 0)
SELECT d.doc_id, round(coalesce(s, 0), 6) AS unseen_words FROM documents d LEFT JOIN (
SELECT doc_id, avg(CASE WHEN k.w IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM w LEFT JOIN k USING (w) WHERE doc_id % 10 = 0 GROUP BY 1) USING (doc_id) WHERE d.doc_id % 10 = 0""")
def c9(t: Tables):
    d = t("documents")
    out = routing.unseen_words(d.where("doc_id % 10 = 0"), d.where("doc_id % 10 <> 0"), "doc_id", "text")
    return out.select("doc_id", F.round("unseen_words", 6).alias("unseen_words"))


@query("i3_unseen_signal", """
WITH k AS (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 40 = 1),
w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '')) AS w FROM part), v AS (SELECT DISTINCT w FROM w WHERE p_partkey % 40 = 1),
s AS (SELECT p_partkey, avg(CASE WHEN v.w IS NULL THEN 1.0 ELSE 0.0 END) AS s FROM w LEFT JOIN v USING (w) GROUP BY 1)
SELECT p_partkey, round(CAST((p_brand NOT IN (SELECT p_brand FROM k)) AS INT) + coalesce(s, 0), 6) AS signal FROM part LEFT JOIN s USING (p_partkey) WHERE p_partkey % 40 <> 1""")
def i3(t: Tables):
    p = t("part")
    return routing.unseen_signal(p.where("p_partkey % 40 <> 1"), p.where("p_partkey % 40 = 1"), "p_partkey", ["p_brand"], "p_name").select("p_partkey", F.round("signal", 6).alias("signal"))


@query("c10_batch_answers_first_wins", f"SELECT {KEY_SQL} AS key, arg_min(p_type, p_partkey) AS value FROM part GROUP BY 1")
def c10(t: Tables):
    answers = lookup.keyed(t("part"), "p_name", "p_brand").select("key", F.col("p_type").alias("value"), "p_partkey")
    return lookup.first_wins(answers, "p_partkey").select("key", "value")


@query("c12_precomputed_lookup", """
SELECT e.vec_id, round(coalesce(list_sum([CAST(x AS DOUBLE) for x in t.embedding]), 0), 5) AS total FROM embeddings e LEFT JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0) t USING (vec_id)""")
def c12(t: Tables):
    from ..sources import caches

    e = t("embeddings").withColumn("text", F.col("vec_id").cast("string"))
    out = caches.with_vectors(e.select("vec_id", "text"), "text", e.where("vec_id % 2 = 0"), vector="embedding", missing="zero", size=64)
    return out.select("vec_id", F.round(A.total(F.col("vector").cast("array<double>")), 5).alias("total"))


@query("c14_agreement", "SELECT count(*) AS n, round(avg(CASE WHEN abs(p_retailprice * (1 + (p_partkey % 5) / 10.0) - p_retailprice) <= 0.2 * abs(p_retailprice) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM part WHERE p_partkey % 5 <> 2")
def c14(t: Tables):
    p = t("part").where("p_partkey % 5 <> 2").withColumn("got", F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5) / 10))
    return lookup.agreement(p, "got", "p_retailprice", numeric=True).select("n", F.round("agreement", 6).alias("agreement"))


@query("d1_duplicates", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicate_rows, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest_group FROM (SELECT text, lang, n_chars, count(*) AS n FROM documents GROUP BY 1, 2, 3)")
def d1(t: Tables):
    return leakage.duplicate_counts(t("documents"), ignore=["doc_id", "source"])


@query("d1_duplicate_groups", "SELECT md5(text) AS text_md5, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def d1_groups(t: Tables):
    return leakage.duplicate_groups(t("documents"), keys=["text"]).select(F.md5("text").alias("text_md5"), "n_rows")


@query("f5_drop_duplicates", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def f5(t: Tables):
    return leakage.first_of_each(t("documents").select("doc_id", "text", "lang"), "doc_id").select("doc_id")


@query("f1_union_provenance", """
SELECT p_partkey, 'brand' AS "column", p_brand AS value, CAST(NULL AS DOUBLE) AS cost FROM part UNION ALL SELECT p_partkey, 'price', CAST(p_size AS VARCHAR), 0.5 FROM part""")
def f1(t: Tables):
    p = t("part")
    a = p.select("p_partkey", F.lit("brand").alias("column"), F.col("p_brand").alias("value"))
    b = p.select("p_partkey", F.lit("price").alias("column"), F.col("p_size").cast("string").alias("value"), F.lit(0.5).alias("cost"))
    return a.unionByName(b, allowMissingColumns=True)


@query("f2_class_union", "SELECT DISTINCT label FROM (SELECT CAST(label AS VARCHAR) AS label FROM embeddings UNION ALL SELECT unnest(['3', '77', 'other']))")
def f2(t: Tables):
    declared = t.spark.createDataFrame([("3",), ("77",), ("other",)], "label string")
    return t("embeddings").select(F.col("label").cast("string").alias("label")).union(declared).distinct()


@query("f3_drop_tokens", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(p_name, '[\\s/・,、|｜]+'), lambda x: x <> '' AND x NOT IN ('small', 'red')), ' ') AS kept FROM part")
def f3(t: Tables):
    stop = F.array(F.lit("small"), F.lit("red"))
    return t("part").select("p_partkey", F.array_join(X.without(X.tokens(F.col("p_name")), stop), " ").alias("kept"))


@query("g3_mask_money", "SELECT doc_id, md5(regexp_replace(text, '(?i)(?:[$＄]\\s?[0-9][0-9,.]*)|(?:\\b[0-9][0-9,.]*\\s?(?:dollars?|usd|万円|円)\\b)', '<AMOUNT>', 'g')) AS masked FROM documents")
def g3(t: Tables):
    return t("documents").select("doc_id", F.md5(X.mask_money(F.col("text"))).alias("masked"))


@query("g4_mask_numbers")
def g4(t: Tables):
    return t("documents").select("doc_id", X.mask_amounts(F.col("text")).alias("masked"))


@query("g5_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '... (' || format('{:,}', length(text) - 200) || ' more characters omitted)' ELSE text END AS short FROM documents")
def g5(t: Tables):
    return t("documents").select("doc_id", X.truncated(F.col("text"), 200).alias("short"))


@query("g6_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed FROM documents")
def g6(t: Tables):
    return t("documents").select("doc_id", F.md5(X.collapsed(F.col("text"))).alias("collapsed"))


@query("g7_clip_text", "SELECT doc_id, substring(coalesce(text, ''), 1, 500) AS clipped FROM documents")
def g7(t: Tables):
    return t("documents").select("doc_id", X.clipped(F.col("text")).alias("clipped"))


@query("g8_normalise_key", "SELECT p_partkey, lower(trim(regexp_replace(coalesce(p_name, ''), '\\s+', ' ', 'g'))) AS key FROM part")
def g8(t: Tables):
    return t("part").select("p_partkey", X.normalised(F.col("p_name")).alias("key"))


@query("g9_composite_key", f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE {KEY_SQL} END AS key FROM part")
def g9(t: Tables):
    return t("part").select("p_partkey", X.composite_key(F.col("p_name"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand"))).alias("key"))


@query("g10_split_key", "SELECT p_partkey, lower(p_name) AS name, lower(p_brand) AS brand FROM part")
def g10(t: Tables):
    parts = X.split_key(X.composite_key(F.col("p_name"), F.col("p_brand")), ["name", "brand"])
    return t("part").select("p_partkey", parts["name"].alias("name"), parts["brand"].alias("brand"))


@query("g11_char_ngrams", """
WITH w AS (SELECT p_partkey, unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS w FROM part), p AS (SELECT p_partkey, ' ' || w || ' ' AS w FROM w),
g AS (SELECT p_partkey, unnest(flatten([[substring(w, i, n) for i in generate_series(1, length(w) - n + 1)] for n in [2, 3, 4]])) AS gram FROM p)
SELECT p_partkey, gram, count(*) AS n FROM g WHERE length(gram) >= 2 GROUP BY 1, 2""")
def g11(t: Tables):
    return neighbours.gram_counts(t("part"), "p_partkey", F.col("p_name")).select(F.col("id").alias("p_partkey"), "gram", "n")


@query("g13_describe_row", "SELECT p_partkey, '- name: ' || p_name || chr(10) || '- size: ' || format('{:,}', p_size * 1000) || chr(10) || '- large: ' || CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS description FROM part")
def g13(t: Tables):
    return t("part").select("p_partkey", X.described([("name", F.col("p_name"), "text"), ("size", F.col("p_size") * 1000, "integer"), ("large", F.col("p_size") > 25, "boolean")]).alias("description"))


@query("g19_fingerprint", "SELECT o_orderkey, substring(sha1('=' || o_custkey || chr(31) || '=' || o_orderstatus || chr(31) || CASE WHEN o_orderkey % 4 = 0 THEN '~' ELSE '=' || o_orderpriority END), 1, 16) AS fingerprint FROM orders")
def g19(t: Tables):
    return t("orders").select("o_orderkey", X.fingerprint(F.col("o_custkey"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))).alias("fingerprint"))


@query("g20_date_sniff", "SELECT avg(CASE WHEN regexp_matches(s, '[-/:]') AND try_cast(s AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS date_share FROM (SELECT CAST(ts AS VARCHAR) AS s FROM events ORDER BY event_id LIMIT 20)")
def g20(t: Tables):
    e = t("events").select("event_id", F.col("ts").cast("string").alias("s"))
    return profile.first_values(e, "s", "event_id").agg(F.avg(X.looks_like_date(F.col("value")).cast("double")).alias("date_share"))


@query("g22_parse_number", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def g22(t: Tables):
    return t("orders").select("o_orderkey", F.round(X.parsed_number(F.concat(F.lit(" "), F.format_number("o_totalprice", 2))), 2).alias("price"))


@query("g23_cosine", """
SELECT a.vec_id, b.vec_id AS other, round(list_sum([CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE) for x in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in a.embedding])) * sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in b.embedding]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def g23(t: Tables):
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", "other", F.round(A.cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine"))


@query("g25_probability_repair", """
SELECT doc_id, CASE WHEN a + b > 0 THEN round(a / (a + b), 6) ELSE CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS p0, CASE WHEN a + b > 0 THEN round(b / (a + b), 6) ELSE CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END::DOUBLE AS p1
FROM (SELECT doc_id, quality, greatest((doc_id % 5 - 2) / 4.0, 0) AS a, greatest((doc_id % 7 - 4) / 4.0, 0) AS b FROM labels)""")
def g25(t: Tables):
    p = A.repaired(F.array((F.col("doc_id") % 5 - 2) / 4, (F.col("doc_id") % 7 - 4) / 4), 2, F.col("quality"))
    return t("labels").withColumn("p", p).select("doc_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


@query("g26_weight_maps", "SELECT o_orderkey, k AS model, v AS weight FROM (SELECT o_orderkey, unnest(['linear', 'group']) AS k, unnest([(o_orderkey % 4) / 4.0, 1 - (o_orderkey % 4) / 4.0]) AS v FROM orders)")
def g26(t: Tables):
    w = (F.col("o_orderkey") % 4) / 4
    return t("orders").select("o_orderkey", F.explode(F.map_from_arrays(F.array(F.lit("linear"), F.lit("group")), F.array(w, 1 - w))).alias("model", "weight"))


@query("g27_parse_answers", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def g27(t: Tables):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("g29_canonical_json", """SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' AS request FROM part""")
def g29(t: Tables):
    return t("part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("request"))

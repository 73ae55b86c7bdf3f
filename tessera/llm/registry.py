"""Queries of the corpus operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.protect(read(spark, sf_dir, "documents").select("doc_id", "text"), key="tessera")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    docs = read(spark, sf_dir, "documents")
    found = decontaminate.flags(docs, read(spark, sf_dir, "benchmark"))
    return found


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(read(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2("text", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.digests(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(read(spark, sf_dir, "documents"), *bpe.tokenizer_file())


def op11_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_net

    docs = read(spark, sf_dir, "documents")
    return quality_net.score(docs, quality_net.train(docs, read(spark, sf_dir, "labels")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_codes

    return vector_codes.encode(read(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_substring_dedup": SUBSTRINGS, "op8_url_filter": URLS, "op12_vector_codes": CODES, "op13_prefix_trie": TRIE}


SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13), h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
f AS (SELECT s, min(doc_id) AS first FROM h GROUP BY 1), r AS (SELECT h.doc_id, i FROM h JOIN f USING (s) WHERE first < h.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM r), n AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string([w[k] for k in generate_series(1, len(w)) if NOT list_contains(coalesce(gone, []), k)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)""".strip()

URLS = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, h, p)),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM s, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)""".strip()


#: A round: nearest entry by the least distance * 64 + index, then floored means; sums of integers, so floors are exact.
_NEAR = "SELECT vec_id, part, any_value(v) AS v, min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) * 64 + e) AS m FROM p JOIN {c} USING (part) GROUP BY 1, 2"
_MOVE = """SELECT part, e, coalesce(n.c, {c}.c) AS c FROM {c} LEFT JOIN (SELECT part, e, list(f ORDER BY i) AS c FROM (
SELECT part, m % 64 AS e, i, (sum(v[i])::BIGINT - ((sum(v[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS f FROM {a}, unnest(range(1, len(v) + 1)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (part, e)"""
CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS v FROM k, range(16) t(part)),
i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
c0 AS MATERIALIZED (SELECT part, e, v AS c FROM p JOIN i USING (vec_id)), a0 AS MATERIALIZED ({_NEAR.format(c="c0")}),
c1 AS MATERIALIZED ({_MOVE.format(c="c0", a="a0")}), a1 AS MATERIALIZED ({_NEAR.format(c="c1")}),
c2 AS MATERIALIZED ({_MOVE.format(c="c1", a="a1")}), a2 AS MATERIALIZED ({_NEAR.format(c="c2")}),
r AS (SELECT vec_id, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM r JOIN k USING (vec_id)""".strip()

#: crc32 of a decimal number, bit by bit; it has the polynomial of the zip format.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
TRIE = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i > h),
s AS (SELECT conv_id, row_number() OVER w AS d, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
m AS MATERIALIZED (SELECT conv_id, 0 AS d, 0 AS words, 'root' AS k, CAST(NULL AS VARCHAR) AS up FROM c UNION ALL SELECT conv_id, d, words, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY d), 'root') FROM s),
n AS MATERIALIZED (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(up) AS up FROM m GROUP BY 1),
f AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
b AS (SELECT m.k, CAST(sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens FROM n LEFT JOIN f USING (k) JOIN m ON m.conv_id = n.conv_id AND m.d <= n.depth GROUP BY 1),
e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(d) AS d FROM m GROUP BY 1) JOIN m USING (conv_id, d) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n p ON p.k = n.up LEFT JOIN f ON f.k = n.k JOIN b ON b.k = n.k LEFT JOIN e ON e.k = n.k""".strip()

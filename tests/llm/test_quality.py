import random
import re

from pyspark.sql import functions as F

from tessera.llm import quality as Q

from .helpers import docs, empty, sentence

AWKWARD = [None, "", " \n\t", "a", "a b", "a b c a b c", "a b c\na b c\n\n \na b c", "x # y* $%&|<> é \u00a0z", "w " * 70, "x y " * 4000]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for v in where.values() if len(v) > 1 for i in v for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts(spark):
    rng = random.Random(1)
    texts = AWKWARD + ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 20))) for _ in range(80)]
    rows = Q.base_counts(docs(spark, texts)).drop("words").orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == [base(t) for t in texts]


def test_score_is_the_mean_log_ratio(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 60).translate(str.maketrans("dehjk", "abcbc")) for _ in range(30)] + [" ".join(f"{x}***" for x in sentence(rng, 60).split()) for _ in range(6)] + AWKWARD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (33, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(d, labels)
    bucket = lambda x: spark.range(1).select(F.pmod(F.xxhash64(F.lit(x)), F.lit(Q.BUCKETS))).first()[0]
    w = texts[3].split()[:2]
    one = docs(spark, [" ".join(w)])
    grams = [x[i : i + 3] for x in w for i in range(0, len(x), 3)]
    want = sum(model.ratios[bucket(g)] for g in grams) / len(grams)
    assert abs(Q.judge(one, model).first().score - want) < 1e-6
    rows = Q.judge(d, model).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].kept for i in range(30)) and not any(by[i].kept for i in range(30, 36))
    assert by[36].score is None and not by[36].kept
    kept = Q.kept_rows(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in rows)


def test_every_ngram_counts(spark):
    """All offsets and word borders, in the counts and in the verdict."""
    rng = random.Random(4)
    texts = AWKWARD[1:8] + [sentence(rng, 30) + " 日本語 𝒳𝒴𝒵𝒲\u00a0é " + "q" * 50 for _ in range(5)]
    d = docs(spark, texts)
    marked = d.withColumn("trusted", F.when(F.col("doc_id") % 2 == 0, True))

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = f" {' '.join(w)} "
        return [s[i : i + 3] for i in range(len(s) - 2) if w] + [x[len(x) // 3 * 3 :] for x in w if len(x) % 3]

    every = sorted({g for t in texts for g in grams(t)})
    place = dict(spark.createDataFrame([(g,) for g in every], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(Q.BUCKETS)).cast("int")).collect())
    corpus, trusted = Q.bucket_counts(marked, Q.word_counts(marked))
    for counts, held in ((corpus, texts), (trusted, texts[::2])):
        want = [0] * Q.BUCKETS
        for t in held:
            for g in grams(t):
                want[place[g]] += 1
        assert counts == want
    ratios = [round(rng.uniform(-1, 1), 6) for _ in range(Q.BUCKETS)]
    for t, r in zip(texts, Q.judge(d, Q.QualityModel(ratios, -0.01)).orderBy("doc_id").collect(), strict=True):
        g = [ratios[place[x]] for x in grams(t)]
        assert (r.ngram_score is None and not g) or abs(r.ngram_score - sum(g) / len(g)) < 1e-8
        assert r.kept == (not r.base_failed and r.ngram_score is not None and r.ngram_score >= -0.01)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.fit(empty(spark), none)
    assert Q.judge(empty(spark), model).count() == 0
    rows = Q.judge(docs(spark, ["NULLID", "a b"]), Q.fit(docs(spark, ["a b"]), none)).collect()
    assert len(rows) == 2 and all(not r.kept for r in rows)


def test_main_path_is_native(spark):
    plan = Q.judge(docs(spark, ["a"]), Q.QualityModel([0.0] * Q.BUCKETS, 0.0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = Q.fit(docs, labels.where(~held))
    rows = Q.judge(docs, model).where("not base_failed").join(labels.where(held), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n[1, True] > 50
    assert n.get((0, True), 0) <= n.get((0, False), 0)

import random

import corpus_pipeline
from tessera.llm import bpe

from .helpers import DOCS

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() <= n, name
        n = docs.count()
    out = corpus_pipeline.run(spark, SF)
    rows = {r.doc_id: r.n_tokens for r in out.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} and len(rows) > 50
    c = bpe.codec(*bpe.tokenizer_file())
    for r in docs.limit(20).collect():
        assert rows[r.doc_id] == len(c.encoding.encode_ordinary(r.text))


def test_contaminated_rows_of_a_null_id_go(spark, tmp_path):
    item = "one two three four five six seven eight"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(None, item), (None, "clean words of a row without id"), (3, item), (4, None), (5, "clean"), (5, item)]
    rows = spark.createDataFrame([(i, t, "en", None, None, "x", None, "y") for i, t in texts], DOCS)
    out = corpus_pipeline.decontaminate_stage(spark, rows, str(tmp_path))
    assert out.columns == rows.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("4", "None"), ("5", "clean"), ("None", "clean words of a row without id")]


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(90))
    texts = [(None, long + " own end"), (1, None), (2, ""), (3, long), (3, long), (4, long), (5, "short")]
    spark.createDataFrame([(i, t, "en", None, None, "x", None, "y") for i, t in texts], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # The copy loses its one line in stage 2 and goes; short, empty and null texts go in stage 1.
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

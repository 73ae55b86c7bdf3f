"""The screening queries judge the whole of their tables."""

from pyspark.sql import functions as F

from tessera.operators import screening
from tessera.plans import catalogue


def watched(monkeypatch):
    """Rows and folds that fold_scores() gets; its scores are made up."""
    seen = {}

    def fold_scores(frame, *args, folds=3, **options):
        seen.update(rows=frame.count(), folds=folds)
        return frame.sparkSession.createDataFrame([(i, 2.0, 1.0) for i in range(folds)], "fold int, without double, with double")

    monkeypatch.setattr(screening, "fold_scores", fold_scores)
    return seen


def test_score_column_takes_all_orders(spark, tmp_path, monkeypatch):
    seen = watched(monkeypatch)
    rows = spark.range(500).select((F.col("id") * 40).alias("o_orderkey"), F.col("id").alias("o_custkey"), F.col("id").cast("double").alias("o_totalprice"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.queries()["h13_score_column"](spark, str(tmp_path)).count() == 1
    assert seen["rows"] == 500


def test_screen_takes_its_defaults(spark, tmp_path, monkeypatch):
    seen = watched(monkeypatch)
    spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    assert catalogue.queries()["h12_screen"](spark, str(tmp_path)).first()["n_rows"] == 500
    assert seen == {"rows": 500, "folds": 5}

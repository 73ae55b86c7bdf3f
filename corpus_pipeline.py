"""A corpus pipeline of five stages, each over everything its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again.

1. quality: documents that fail the base rules or the likelihood ratio go.
2. lines: lines that repeat an earlier line, exactly or nearly, go; documents left without a word go with them.
3. near_dedup: the first document of each group of near-duplicates stays.
4. decontaminate: documents with a passage of the benchmark go.
5. tokens: ids of the byte-level BPE, with the digest of what they decode to.

Null and empty texts fail the base rules, so stage 1 drops them. Rows of a null doc_id pass stages 2 and 3 as they
are and are judged by their own text in 1 and 4. Rows that repeat a doc_id are judged row by row in 1 and 4, keep or
lose the same lines in 2, and stay or go together in 3. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from tessera.llm.cluster_io import checkpoint_folder, remove

#: SQL cannot express SimHash, ProbMinHash or BPE merges; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows judged as kept; the judgement is joined to its row by carrying the row along."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_rows(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs)
    changed = F.size("removed_lines") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.survivors(docs).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows judged by their own text: those of a null doc_id go too."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *bpe.tokenizer_file())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one is written; the last one stays for the caller."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs

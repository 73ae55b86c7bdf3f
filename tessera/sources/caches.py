"""Parquet caches of vectors and answers, the cache's place, settings files, precomputed vectors."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TesseraError


def cache_dir(name: str, spark: SparkSession | None = None) -> str:
    """TESSERA_CACHE, else spark.tessera.cacheDir, else a folder of the user; the name is added."""
    root = os.environ.get("TESSERA_CACHE") or (spark.conf.get("spark.tessera.cacheDir", None) if spark else None) or str(Path.home() / ".cache" / "tessera")
    return f"{root.rstrip('/')}/{name}"


def find_settings(start: str | None = None, name: str = ".env") -> Path | None:
    """The nearest settings file from ``start`` upwards."""
    here = Path(start or os.getcwd()).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def read_settings(path: str | Path | None) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and quotes go."""
    out = {}
    for line in Path(path).read_text().splitlines() if path else []:
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def setting(key: str, start: str | None = None) -> str | None:
    """The environment's value, else the settings file's."""
    return os.environ.get(key) or read_settings(find_settings(start)).get(key)


def request_key(request: Mapping) -> str:
    """Hash of a request in canonical JSON."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def question_fingerprint(question: Mapping) -> str:
    return hashlib.sha1(json.dumps(question, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cached table, or an empty one if there is none or it cannot be read."""
    try:
        frame = spark.read.schema(schema).parquet(path)
        frame.limit(1).collect()
        return frame
    except Exception:  # a broken cache is no cache
        return spark.createDataFrame([], schema)


def add_vectors(frame: DataFrame, path: str, text: str, vectorise, schema: str = "text string, vector array<float>") -> int:
    """Vectors of the distinct texts that the cache lacks are computed and appended; returns how many."""
    spark = frame.sparkSession
    missing = frame.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().join(load(spark, path, schema).select("text"), "text", "left_anti").cache()
    n = missing.count()
    if n:
        vectorise(missing).select("text", F.col("vector").cast("array<float>")).write.mode("append").parquet(path)
    missing.unpersist()
    return n


def save_answers(answers: DataFrame, path: str) -> None:
    """Appends answers as text; errors are not cached, so that they are asked again."""
    answers.where(F.col("source") != "error").withColumn("value", F.col("value").cast("string")).write.mode("append").parquet(path)


def with_vectors(frame: DataFrame, text: str, table: DataFrame, key: str = "text", vector: str = "vector", missing: str = "error", size: int | None = None) -> DataFrame:
    """Joins precomputed vectors by text; a text without one is an error, or takes zeros."""
    known = table.select(F.col(key).alias("_text"), F.col(vector).alias("vector")).dropDuplicates(["_text"])
    out = frame.join(known, F.col(text) == F.col("_text"), "left").drop("_text")
    if missing == "zero":
        return out.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0).cast("float"), size or 0)))
    if n := out.where("vector is null").count():
        raise TesseraError(f"{n} texts have no precomputed vector")
    return out

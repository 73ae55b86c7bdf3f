"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, spans string, words string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def docs(spark, texts, first=0):
    """Documents of these texts; the extra columns have names that operators use."""
    rows = [(None if t == "NULLID" else i + first, None if t == "NULLID" else t, "en", None, None, "x", None, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)

"""Vectors and probability arrays, as higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    """Sum of products in double, in array order."""
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalised(x: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    n = norm(x)
    return F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    d = norm(x) * norm(y)
    return F.when(d > 0, dot(x, y) / d).otherwise(0.0)


def repaired(p: Column, size: int, label: Column) -> Column:
    """Probabilities clipped at 0 and scaled to sum 1; without any mass, one-hot at ``label`` (from 0)."""
    clean = F.transform(p, lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    mass = total(clean)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))
    return F.when(mass > 0, F.transform(clean, lambda v: v / mass)).otherwise(one_hot)


def argmax(p: Column) -> Column:
    """Index from 0 of the first largest entry."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def total_variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def disagreement(outputs: Sequence[Column], classification: bool = False) -> Column:
    """How far models are apart: range of numbers, or largest total variation of probability arrays."""
    if classification:
        return F.greatest(*(far := [total_variation(p, q) for p, q in combinations(outputs, 2)]), far[0])
    return F.greatest(*outputs) - F.least(*outputs)


def weighted_average(outputs: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Average by weights clipped at 0; with no weight at all the first output counts."""
    clean = [F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for w in weights]
    mass = sum(clean[1:], clean[0])
    return F.when(mass > 0, sum((x * w for x, w in zip(outputs[1:], clean[1:], strict=True)), outputs[0] * clean[0]) / mass).otherwise(outputs[0])

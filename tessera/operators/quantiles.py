"""Exact quantiles of many columns by passes over histograms: no task and no driver ever holds a column's values.

The first pass counts the values by sign and power of two, the later ones those in equal parts of the range that still holds
an order statistic; counts and ends of the parts are combined in each task before the shuffle. The part that holds the
statistic is the next pass's range. It ends where a part holds one distinct value: after 8 passes at most with 256
parts, as a double has 53 bits, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 256


def order_statistics(frame: DataFrame, columns: Mapping[str, Column], ranks: Mapping[str, Sequence[int]], parts: int = PARTS) -> dict[tuple[str, int], float]:
    """The value of each rank, from 0, among a column's values without nulls and NaN; ranks are of existing values."""
    values = frame.select(*(F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns.values())))
    # Sought statistics: column, rank within the range, range (none at first).
    sought = {(name, r): (i, r, None, None) for i, name in enumerate(columns) for r in set(ranks.get(name, ()))}
    out: dict[tuple[str, int], float] = {}
    while sought:
        ranges = sorted({(i, low, high) for i, _, low, high in sought.values()}, key=lambda x: (x[0], x[1] or 0.0, x[2] or 0.0))
        inside = []
        for j, (i, low, high) in enumerate(ranges):
            v = F.col(f"v{i}")
            if low is None:
                place, there = octave(v), v.isNotNull()
            else:
                place, there = F.least(F.floor((v - low) / (high - low) * parts), F.lit(parts - 1)), v.between(low, high)
            inside.append(F.when(there, F.struct(F.lit(j).alias("j"), place.cast("int").alias("place"), v.alias("v"))))
        found = values.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.j", "x.place").agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        counts: dict[tuple, list] = {}
        for r in found.orderBy("j", "place").collect():  # the parts of each range
            counts.setdefault(ranges[r["j"]], []).append(r)
        for key, (i, rank, low, high) in list(sought.items()):
            for r in counts[i, low, high]:
                if rank < r["n"]:
                    break
                rank -= r["n"]
            if r["low"] == r["high"]:
                out[key] = sought.pop(key) and r["low"]
            else:
                sought[key] = (i, rank, r["low"], r["high"])
    return out


def octave(v: Column) -> Column:
    """An int that ascends with the value: its sign and its power of two. Later ranges are within an octave, so equal parts serve."""
    power = F.when(F.abs(v) == float("inf"), 5000).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
    return F.when(v == 0, 0).when(v > 0, power).otherwise(-power)


def quantiles(frame: DataFrame, columns: Mapping[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column at ``shares``, between two values by their distance; None for a column without values."""
    sizes = frame.agg(*(F.count(F.nanvl(c.cast("double"), F.lit(None).cast("double"))).alias(str(i)) for i, c in enumerate(columns.values()))).first()
    n = dict(zip(columns, sizes, strict=True))
    at = {name: [(n[name] - 1) * s for s in shares] for name in columns if n[name]}
    got = order_statistics(frame, columns, {name: [r for x in places for r in (math.floor(x), math.ceil(x))] for name, places in at.items()})

    def between(name: str, x: float) -> float:
        low, high = got[name, math.floor(x)], got[name, math.ceil(x)]
        return low if low == high else low + (high - low) * (x - math.floor(x))

    return {name: [between(name, x) for x in at[name]] if n[name] else [None] * len(shares) for name in columns}


def medians(frame: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(frame, {c: F.col(c) for c in columns}, [0.5]).items()} if columns else {}

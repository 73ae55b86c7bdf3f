"""Gradient boosting: trees grown from histograms that tasks count and Spark adds up.

Columns are cut into bins once: a number by up to ``BINS`` - 2 quantiles, a category by its most frequent levels; bin 0 is a
missing number, or a level that is missing, unseen or beyond them. Rows are kept as their bins, their target and their
scores so far. Each round grows one tree for each class (one tree for numbers and for two classes) from the gradients of its
loss: squared error, logistic or softmax. Trees of a round grow side by side, so a pass over the rows makes the histograms of
all nodes that wait for one, whatever their class.

A tree grows best first: the leaf of the largest gain is split next, until there are ``leaves`` leaves. To need few passes,
every leaf that would be split with what is known so far gets its children's histograms in one pass, and the order is replayed
with what they say; the finished tree is that of one split at a time, in about as many passes as the tree is deep. With
``depth`` 6 and 64 leaves the same rule grows level by level, as no leaf is left out.

Gradients are whole numbers (2 ** -24 of the target's widest distance from its mean), so sums do not depend on
partitions. A histogram has (trees of the round) x (waiting nodes) x (columns) x (bins) cells, in passes of at most
``CELLS``; only those sums reach the driver. Splits of categories order levels by their mean gradient.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..sources.checkpoints import Tables
from .models import Model

BINS = 64
UNIT = float(1 << 24)
CELLS = 1 << 21
#: Least gain of a split, in squared gradients of the scaled target.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Growth:
    """When a tree stops: leaves, depth, penalty on leaf values, least rows and least curvature of a leaf."""

    leaves: int
    depth: int
    penalty: float
    least_rows: int
    least_curvature: float


#: The usual settings of leaf-wise and of level-wise boosters.
LEAFWISE, LEVELWISE = Growth(31, 16, 0.0, 20, 1e-3), Growth(64, 6, 1.0, 1, 1.0)


@dataclass
class Node:
    depth: int
    split: tuple | None = None  # gain, column, bins that go left; a gain of 0: none
    value: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes as arrays: column (-1 in a leaf), which bins go left, children, value."""

    column: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[self.column[at[rows]] >= 0]
            here = at[rows]
            at[rows] = np.where(self.goes_left[here, bins[rows, self.column[here]]], self.left[here], self.right[here])
        return at


def frozen(nodes: list[Node], inner: set[int], width: int) -> Tree:
    """The tree whose nodes in ``inner`` are split."""
    size = len(nodes)
    out = Tree(np.full(size, -1), np.zeros((size, width), bool), np.full(size, -1), np.full(size, -1), np.array([x.value for x in nodes]))
    for i in inner:
        _, out.column[i], out.goes_left[i] = nodes[i].split
        out.left[i], out.right[i] = nodes[i].left, nodes[i].right
    return out


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, category: np.ndarray, growth: Growth, allowed: np.ndarray) -> tuple:
    """(gain, column, bins that go left) of histograms (columns, bins); ties go to numbers, then to the first column, then to the first cut."""
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
    worth = lambda a, b: np.divide(a * a, b + growth.penalty, out=np.zeros_like(a), where=b + growth.penalty > 0)
    whole = worth(np.array([total_g]), np.array([total_h]))[0]

    def gains(gl: np.ndarray, hl: np.ndarray, nl: np.ndarray) -> np.ndarray:
        gr, hr, nr = total_g - gl, total_h - hl, total_n - nl
        legal = (nl >= growth.least_rows) & (nr >= growth.least_rows) & (hl >= growth.least_curvature) & (hr >= growth.least_curvature)
        return np.where(legal, worth(gl, hl) + worth(gr, hr) - whole, 0.0)

    best = (LEAST_GAIN, -1, np.zeros(g.shape[1], bool))
    places = np.arange(g.shape[1])
    numbers = np.flatnonzero(allowed & ~category)
    if len(numbers):
        # All numbers at once; missing ones (bin 0) go right, then left.
        sums = [x[numbers, 1:].cumsum(1)[:, :-1] for x in (g, h, n)]
        right = gains(*sums)
        left = np.where(n[numbers, :1] > 0, gains(*(s + x[numbers, :1] for s, x in zip(sums, (g, h, n), strict=True))), 0.0)
        both = np.concatenate([right, left], 1)
        at = both.argmax(1)
        top = both[np.arange(len(numbers)), at]
        i = int(top.argmax())
        if top[i] > best[0]:
            cut, missing = at[i] % right.shape[1], at[i] >= right.shape[1]
            best = (float(top[i]), int(numbers[i]), (places <= cut + 1) & (missing | (places > 0)))
    for c in np.flatnonzero(allowed & category):
        there = np.flatnonzero(n[c])
        order = there[np.lexsort((there, g[c, there] / (h[c, there] + growth.penalty + 1e-12)))]
        got = gains(g[c, order].cumsum()[:-1], h[c, order].cumsum()[:-1], n[c, order].cumsum()[:-1])
        if len(got) and got.max() > best[0]:
            i = int(got.argmax())
            best = (float(got[i]), int(c), np.isin(places, order[: i + 1]))
    return best if best[1] >= 0 else (0.0, -1, best[2])


def replay(nodes: list[Node], growth: Growth) -> set[int]:
    """Nodes that are split when the best known leaf is split again and again; they get children."""
    inner, ready = set(), []

    def known(i: int) -> None:
        if nodes[i].split and nodes[i].split[0] > 0 and nodes[i].depth < growth.depth:
            heapq.heappush(ready, (-nodes[i].split[0], i))

    known(0)
    while ready and len(inner) + 1 < growth.leaves:
        i = heapq.heappop(ready)[1]
        inner.add(i)
        if nodes[i].left < 0:
            nodes[i].left, nodes[i].right = len(nodes), len(nodes) + 1
            nodes += [Node(nodes[i].depth + 1), Node(nodes[i].depth + 1)]
        known(nodes[i].left)
        known(nodes[i].right)
    return inner


def slopes(y: np.ndarray, scores: np.ndarray, loss: str, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole gradients and curvatures of each row and tree."""
    if loss == "squared":
        g, h = (scores - y[:, None]) / scale, np.ones(scores.shape)
    elif loss == "logistic":
        p = 1 / (1 + np.exp(-scores))
        g, h = p - y[:, None], p * (1 - p)
    else:
        e = np.exp(scores - scores.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        g, h = p - (np.arange(scores.shape[1]) == y[:, None]), p * (1 - p)
    return np.rint(g * UNIT), np.rint(h * UNIT)


def rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long binaries as rows of a matrix."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def binaries(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(data.tobytes())])


@dataclass
class Binner:
    """Cuts of each number and levels of each category."""

    numeric: list[str]
    categorical: list[str]
    cuts: list[np.ndarray] = field(default_factory=list)
    levels: list[dict[str, int]] = field(default_factory=list)

    def fit(self, frame: DataFrame) -> Binner:
        if self.numeric:
            asked = [F.percentile_approx(F.col(c).cast("double"), [i / (BINS - 1) for i in range(1, BINS - 1)], 10_000).alias(str(i)) for i, c in enumerate(self.numeric)]
            self.cuts = [np.unique(np.array([x for x in (r or []) if x == x])) for r in frame.agg(*asked).first()]
        for c in self.categorical:
            # BINS - 1 levels at most.
            top = frame.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(BINS - 1)
            self.levels.append({r["level"]: i + 1 for i, r in enumerate(top.collect())})
        return self

    @property
    def category(self) -> np.ndarray:
        return np.array([False] * len(self.numeric) + [True] * len(self.categorical))

    def inputs(self) -> list:
        return [*(F.col(c).cast("double") for c in self.numeric), *(F.col(c).cast("string") for c in self.categorical)]

    def bins(self, columns: Sequence) -> np.ndarray:
        """Bins of pandas or Arrow columns in the order of inputs()."""
        out = np.zeros((len(columns[0]), len(columns)), np.uint8)
        for i, cut in enumerate(self.cuts):
            x = np.asarray(columns[i].to_numpy(zero_copy_only=False) if isinstance(columns[i], pa.Array) else columns[i].to_numpy(dtype=float), float)
            out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left") + 1)
        for i, level in enumerate(self.levels, len(self.cuts)):
            values = columns[i].to_pylist() if isinstance(columns[i], pa.Array) else columns[i]
            out[:, i] = [level.get(v, 0) for v in values]
        return out


class Boosted(Model):
    """Boosted trees for a number or for 2 to 20 classes. ``growth``: "leaf" (best first to 31 leaves) or "level" (to depth 6)."""

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), growth: str | Growth = "leaf", task: str = "regression", name: str | None = None, rounds: int = 20, rate: float = 0.1, columns_share: float = 0.9, seed: int = 42):
        if not numeric and not categorical:
            raise TesseraError("a tree model needs a structured column")
        if isinstance(growth, str) and growth not in ("leaf", "level"):
            raise TesseraError(f"growth is leaf or level, not {growth}")
        self.growth = growth if isinstance(growth, Growth) else LEAFWISE if growth == "leaf" else LEVELWISE
        self.numeric, self.categorical, self.task = list(numeric), list(categorical), task
        self.name = name or (f"{growth}wise" if isinstance(growth, str) else "boosted")
        self.rounds, self.rate, self.share, self.seed = rounds, rate, columns_share, seed

    def fit(self, frame: DataFrame, target: str) -> Boosted:
        rows = frame.where(F.col(target).isNotNull())
        self.classes: list[str] | None = None
        if self.task == "classification":
            counts = {r[0]: r[1] for r in rows.groupBy(F.col(target).cast("string")).count().orderBy(F.col(target).cast("string")).limit(21).collect()}
            self.classes = sorted(counts)
            if not 2 <= len(self.classes) <= 20:
                raise TesseraError("classification takes 2 to 20 classes")
            y = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(self.classes) for x in (c, float(i)))), F.col(target).cast("string"))
            share = np.array([counts[c] for c in self.classes]) / sum(counts.values())
            self.loss, self.scale = ("logistic", 1.0) if len(share) == 2 else ("softmax", 1.0)
            self.start = np.log(share) if len(share) > 2 else np.array([np.log(share[1] / share[0])])
        else:
            y = F.col(target).cast("double")
            rows = rows.where(~F.isnan(y))
            mean, low, high = rows.agg(F.avg(y), F.min(y), F.max(y)).first()
            if mean is None:
                raise TesseraError("no row has a target")
            self.loss, self.start, self.scale = "squared", np.array([mean]), max(high - mean, mean - low) or 1.0
        self.binner = Binner(self.numeric, self.categorical).fit(rows)
        self.trees: list[list[Tree]] = []
        tables, rng = Tables(frame.sparkSession), np.random.default_rng(self.seed)
        state = tables.cut(self._binned(rows, y))
        width = len(self.binner.category)
        for _ in range(self.rounds):
            allowed = [self._columns(rng, width) for _ in self.start]
            grown = self._grow(state, allowed)
            if all(len(t.value) == 1 and not t.value[0] for t in grown):
                break
            self.trees.append(grown)
            if len(self.trees) < self.rounds:
                state = tables.cut(self._scored(state, grown), state)
        tables.drop_others()
        return self

    def _columns(self, rng: np.random.Generator, width: int) -> np.ndarray:
        """The columns that a tree may split on."""
        out = np.zeros(width, bool)
        out[rng.permutation(width)[: max(1, round(self.share * width))]] = True
        return out

    def _binned(self, rows: DataFrame, y) -> DataFrame:
        binner, start = self.binner, self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binner.bins([batch.column(i) for i in range(batch.num_columns - 1)])
                yield pa.record_batch([binaries(bins), batch.column(batch.num_columns - 1), binaries(np.tile(start, (len(bins), 1)))], ["bins", "y", "scores"])

        inputs = [c.alias(str(i)) for i, c in enumerate(self.binner.inputs())]
        return rows.select(*inputs, y.alias("y")).mapInArrow(run, "bins binary, y double, scores binary")

    def _scored(self, state: DataFrame, trees: list[Tree]) -> DataFrame:
        width, outputs = len(self.binner.category), len(self.start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, scores = rows_of(batch.column("bins"), np.uint8, width), rows_of(batch.column("scores"), np.float64, outputs).copy()
                for k, t in enumerate(trees):
                    scores[:, k] += t.value[t.leaf(bins)]
                yield pa.record_batch([batch.column("bins"), batch.column("y"), binaries(scores)], ["bins", "y", "scores"])

        return state.mapInArrow(run, "bins binary, y double, scores binary")

    def _histograms(self, state: DataFrame, trees: list[Tree], waiting: list[tuple[int, int]]) -> np.ndarray:
        """(waiting nodes, columns, bins, 3): sums of gradients, curvatures and rows."""
        width, outputs, loss, scale = len(self.binner.category), len(self.start), self.loss, self.scale
        slot = [np.full(len(t.value), -1) for t in trees]
        for i, (k, node) in enumerate(waiting):
            slot[k][node] = i
        cells = len(waiting) * width * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, cells), np.int64)
            for batch in batches:
                bins, y, scores = rows_of(batch.column("bins"), np.uint8, width).astype(np.int64), batch.column("y").to_numpy(), rows_of(batch.column("scores"), np.float64, outputs)
                g, h = slopes(y, scores, loss, scale)
                for k, t in enumerate(trees):
                    if (slot[k] < 0).all():
                        continue
                    at = slot[k][t.leaf(bins)]
                    mine = np.flatnonzero(at >= 0)
                    base, gk, hk = at[mine] * (width * BINS), g[mine, k], h[mine, k]
                    for c in range(width):
                        cell = base + (c * BINS + bins[mine, c])
                        used, place = np.unique(cell, return_inverse=True)
                        # Sums of a batch are whole numbers below 2 ** 53.
                        total[0, used] += np.bincount(place, gk, len(used)).astype(np.int64)
                        total[1, used] += np.bincount(place, hk, len(used)).astype(np.int64)
                        total[2, used] += np.bincount(place, minlength=len(used))
            used = np.flatnonzero(total[2])
            yield pa.record_batch([pa.array(used), *(pa.array(x[used]) for x in total)], ["cell", "g", "h", "n"])

        sums = state.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()  # CELLS rows at most
        out = np.zeros((cells, 3))
        out[sums["cell"].to_numpy()] = np.stack([sums[c].to_numpy() for c in ("g", "h", "n")], 1)
        return out.reshape(len(waiting), width, BINS, 3)

    def _grow(self, state: DataFrame, allowed: list[np.ndarray]) -> list[Tree]:
        """The trees of one round."""
        category, width = self.binner.category, len(self.binner.category)
        forest: list[list[Node]] = [[Node(0)] for _ in self.start]
        at_once = max(1, CELLS // (width * BINS))
        while True:
            inner = [replay(nodes, self.growth) for nodes in forest]
            waiting = [(k, i) for k, nodes in enumerate(forest) for i, x in enumerate(nodes) if x.split is None]
            if not waiting:
                return [frozen(nodes, chosen, BINS) for nodes, chosen in zip(forest, inner, strict=True)]
            trees = [frozen(nodes, {i for i, x in enumerate(nodes) if x.left >= 0}, BINS) for nodes in forest]
            for start in range(0, len(waiting), at_once):
                part = waiting[start : start + at_once]
                for (k, i), cells in zip(part, self._histograms(state, trees, part), strict=True):
                    g, h, n = cells[..., 0] / UNIT, cells[..., 1] / UNIT, cells[..., 2]
                    node, below = forest[k][i], h[0].sum() + self.growth.penalty
                    node.split = best_split(g, h, n, category, self.growth, allowed[k])
                    node.value = -float(g[0].sum() / below) * self.rate * self.scale if below > 0 else 0.0

    def predict(self, frame: DataFrame, out: str) -> DataFrame:
        binner, trees, start, loss = self.binner, self.trees, self.start, self.loss

        def scores(columns: Sequence) -> np.ndarray:
            bins = binner.bins(columns)
            total = np.tile(start, (len(bins), 1))
            for grown in trees:
                for k, t in enumerate(grown):
                    total[:, k] += t.value[t.leaf(bins)]
            return total

        def number(*columns: pd.Series) -> pd.Series:
            return pd.Series(scores(columns)[:, 0])

        def shares(*columns: pd.Series) -> pd.Series:
            z = scores(columns)
            if loss == "logistic":
                z = np.concatenate([np.zeros_like(z), z], 1)
            e = np.exp(z - z.max(1, keepdims=True))
            return pd.Series(list(e / e.sum(1, keepdims=True)))

        # One Arrow column: the frame's other columns never leave the JVM and no name can clash.
        said = F.pandas_udf(number, "double") if self.task == "regression" else F.pandas_udf(shares, "array<double>")
        return frame.withColumn(out, said(*self.binner.inputs()))

"""A typed column out of text or vectors: references, votes, and stages for the uncertain rest."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import text as X
from ..sources.checkpoints import cut
from ..sources.clients import Client, charged, kept_answers, keyed
from . import contracts, neighbours, routing
from .lookup import status
from .sampling import half_even
from .text_index import TextIndex

# Fixed value: confidence below which a value is uncertain.
THRESHOLD = 0.9


def constant_tokens(frame: DataFrame, text: Column, threshold: float = 0.9) -> DataFrame:
    """(token, df) of tokens in at least that share of the rows."""
    n = frame.count()
    words = frame.select(F.explode(F.array_distinct(X.tokens(text))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") / F.lit(max(n, 1)) >= threshold)


def drop_constant_tokens(frame: DataFrame, text_col: str, stop: Sequence[str] | None = None, threshold: float = 0.9) -> tuple[DataFrame, list[str]]:
    """The text without its constant tokens, and the list; a given list is used as it is."""
    if stop is None:
        stop = sorted(r["token"] for r in constant_tokens(frame, F.col(text_col), threshold).collect())
    kept = X.without(X.tokens(F.col(text_col)), F.array(*map(F.lit, stop)).cast("array<string>"))
    return frame.withColumn(text_col, F.array_join(kept, " ")), list(stop)


@dataclass
class Stage:
    """Answers open rows: frame (id, value, confidence, text) in, frame (id, value, confidence) out, with ``cost`` where a row's
    cost isn't ``cost_per_call`` (an answer out of a cache costs nothing).

    A row is settled if its value is not null and reaches ``threshold``, where there is one.
    """

    source: str
    answer: Callable[[DataFrame], DataFrame] | None = None
    threshold: float | None = None
    cost_per_call: float = 0.0

    def can_answer(self) -> bool:
        return self.answer is not None


def queue_only() -> Stage:
    """Leaves everything to review."""
    return Stage("needs_review")


def llm_stage(client: Client, candidates: Sequence[str], question: str = "", cache: str | None = None) -> Stage:
    """A stage that asks a client for each open row's text; a value that is none of the candidates leaves the row open.

    Its answers are kept, so that later actions pay nothing; they go to the review queue too.
    """
    return Stage("llm", lambda rows: _asked(rows, client, candidates, question, "value", cache), None, client.cost_per_call) if client.available() else Stage("llm")


def tier_stage(client: Client, candidates: Sequence[str], question: str = "", threshold: float = 0.7, cache: str | None = None) -> Stage:
    """A stage over a cheaper client that chooses one of the candidates; it settles rows it is sure enough of."""
    if len(set(candidates)) < 2:
        raise TesseraError("a choice needs two candidates")
    return Stage("jev", lambda rows: _asked(rows, client, candidates, question, "choice", cache), threshold, client.cost_per_call) if client.available() else Stage("jev")


def _asked(rows: DataFrame, client: Client, candidates: Sequence[str], question: str, field: str, cache: str | None) -> DataFrame:
    options = list(dict.fromkeys(candidates))
    text = F.col("text") if "text" in rows.columns else F.col("value")
    request = F.to_json(F.struct(F.lit("choice").alias("kind"), text.alias("state"), F.lit(question).alias("question"), F.array(*map(F.lit, options)).alias("options"), *([F.lit(json.dumps(contracts.settled(options))).alias("schema")] if field == "value" else [])))
    requests = cut(keyed(rows.select("id", request.alias("request")), client))
    said = F.from_json("answer", f"{field} string, confidence double")
    got = kept_answers(requests, client, cache).select("key", F.when(said[field].isin(options), said[field]).alias("value"), said["confidence"].alias("confidence"), "cost")
    return charged(requests.select("id", "key"), got, "id").select("id", "value", "confidence", "cost")


def settle(open_rows: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """(id, value, confidence, source, cost): each stage takes what the ones before it left open; costs add up."""
    done, left = None, open_rows.withColumn("cost", F.lit(0.0))
    for stage in stages:
        if not stage.can_answer():
            continue
        got = stage.answer(left)
        paid = F.coalesce("cost", F.lit(0.0)) if "cost" in got.columns else F.lit(stage.cost_per_call)
        got = got.select("id", F.col("value").alias("_v"), F.col("confidence").alias("_c"), paid.alias("_paid"))
        both = left.join(got, "id", "left").withColumn("cost", F.col("cost") + F.coalesce("_paid", F.lit(stage.cost_per_call))).drop("_paid")
        ok = F.col("_v").isNotNull() if stage.threshold is None else F.col("_v").isNotNull() & (F.coalesce(F.col("_c"), F.lit(0.0)) >= stage.threshold)
        settled = both.where(ok).select("id", F.col("_v").alias("value"), F.col("_c").alias("confidence"), F.lit(stage.source).alias("source"), "cost")
        done = settled if done is None else done.unionByName(settled)
        left = both.where(~ok).drop("_v", "_c")
    rest = left.select("id", "value", "confidence", F.lit("needs_review").alias("source"), "cost")
    return rest if done is None else done.unionByName(rest)


class TypedColumn:
    """Fits references and turns a source column into values with confidence and provenance.

    ``source`` is text columns (joined, then compared by character n-grams) or one vector column.
    References come from a label column, from (text, value) examples, or from the value names.
    """

    def __init__(self, source: str | Sequence[str], id_col: str, kind: str = "category", values: Sequence[str] | None = None, labels: str | None = None, k: int | str = "auto", threshold: float = THRESHOLD, escalate_rate: float | None = None, on_uncertain: str = "keep", preprocess: bool = True, stages: Sequence[Stage] = (), vector: bool = False, min_df: int = 1):
        if kind not in ("category", "binary", "embedding"):
            raise TesseraError("a typed column is a category, binary or embedding")
        if vector and not labels and kind != "embedding":
            raise TesseraError("vectors need a label column")
        self.source = [source] if isinstance(source, str) else list(source)
        self.id_col, self.kind, self.values, self.labels, self.k = id_col, kind, list(values or ()), labels, k
        self.threshold, self.rate, self.on_uncertain = threshold, escalate_rate, on_uncertain
        self.preprocess, self.stages, self.vector, self.min_df = preprocess, list(stages), vector, min_df

    def _texts(self, frame: DataFrame) -> DataFrame:
        out = frame.select(F.col(self.id_col).alias("id"), X.join_columns(*self.source).alias("text"))
        return drop_constant_tokens(out, "text", self.stop)[0] if self.preprocess else out

    def fit(self, frame: DataFrame, y: DataFrame | None = None) -> TypedColumn:
        """``y``, a frame (id, label), takes the place of a label column; rows that it lacks are no references."""
        self.stop: list[str] = []
        if y is not None:
            if self.kind == "embedding":
                raise TesseraError("an embedding column has no labels")
            self.labels = "__label"
            frame = frame.drop("__label").join(y.toDF(self.id_col, "__label"), self.id_col, "left")
        if self.kind == "embedding":
            return self
        if not self.values and not self.labels:
            raise TesseraError("a typed column needs labels or values")
        if self.vector:
            self.references = frame.where(F.col(self.labels).isNotNull()).select(F.col(self.id_col).alias("train_id"), F.col(self.labels).alias("label"), F.col(self.source[0]).alias("x"))
        else:
            if self.preprocess:
                joined = frame.select(X.join_columns(*self.source).alias("text"))
                self.stop = sorted(r["token"] for r in constant_tokens(joined, F.col("text")).collect())
            texts = self._texts(frame)
            if self.labels:
                known = frame.where(F.col(self.labels).isNotNull() & (F.col(self.labels).cast("string") != ""))
                refs = texts.join(known.select(F.col(self.id_col).alias("id"), F.col(self.labels).cast("string").alias("label")), "id").select(F.concat(F.lit("r"), "id").alias("train_id"), "label", "text")
            else:
                refs = frame.sparkSession.createDataFrame([(f"v{i}", v, v) for i, v in enumerate(self.values)], "train_id string, label string, text string")
            counts = neighbours.gram_counts(texts, "id", F.col("text"))
            self.weights = neighbours.gram_weights(counts, texts.count(), self.min_df)
            own = neighbours.gram_counts(refs.withColumnRenamed("train_id", "id"), "id", F.col("text"))
            self.index, self.references = TextIndex().fit(neighbours.sparse_vectors(own, self.weights)), refs
        n, classes = self.references.agg(F.count("*"), F.collect_set(F.col("label").cast("string"))).first()
        self.classes_ = sorted({*classes, *self.values})
        self.k_ = neighbours.k_auto(n, len(self.classes_)) if self.k == "auto" else int(self.k)
        self.n_ = n
        return self

    def neighbours(self, frame: DataFrame) -> DataFrame:
        """The nearest references of each row, two at least."""
        if self.vector:
            q, r = (f.select(F.col(i).alias("id"), F.col(x).alias("x")) for f, i, x in ((frame, self.id_col, self.source[0]), (self.references, "train_id", "x")))
            return neighbours.nearest_vectors(q, r, "id", "x", min(max(self.k_, 2), self.n_))
        counts = neighbours.gram_counts(self._texts(frame), "id", F.col("text"))
        return self.index.nearest(neighbours.sparse_vectors(counts, self.weights), min(max(self.k_, 2), self.n_))

    def transform(self, frame: DataFrame) -> DataFrame:
        """(id, value, confidence, source, cost) of each row; a row like no reference has confidence 0."""
        if self.kind == "embedding":
            return frame.select(F.col(self.id_col).alias("id"), F.col(self.source[0]).alias("value"))
        labels = self.references.select("train_id", F.col("label").cast("string").alias("label"))
        voted = neighbours.elected(neighbours.votes(self.neighbours(frame), labels))
        rows = frame.select(F.col(self.id_col).alias("id")).join(voted, "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        rows = cut(rows)
        if self.rate is not None:
            weak = routing.top_rows(rows, "confidence", "id", half_even(rows.count() * self.rate), descending=False)
        else:
            weak = rows.where(F.col("confidence") < self.threshold)
        if not self.vector and self.stages:
            weak = weak.join(self._texts(frame), "id", "left")
        sure = rows.join(weak.select("id"), "id", "left_anti").select("id", "value", "confidence", F.lit("model").alias("source"), F.lit(0.0).alias("cost"))
        out = sure.unionByName(settle(weak, self.stages))
        if self.on_uncertain == "null":
            out = out.withColumn("value", F.when(F.col("source") != "needs_review", F.col("value")))
        return out

    def examples(self, frame: DataFrame) -> DataFrame:
        """(id, rank, similarity, label): the references that each row's vote came from."""
        labels = self.references.select("train_id", F.col("label").cast("string").alias("label"))
        return self.neighbours(frame).join(labels, "train_id").select("id", "rank", "similarity", "label", "train_id")

    def explain(self, result: DataFrame, frame: DataFrame, row_id) -> str:
        """How one row came to its value, with the references nearest to it."""
        row = result.where(F.col("id") == row_id).first()
        if row is None:
            raise TesseraError(f"no row {row_id}")
        if self.kind == "embedding":
            return f"row {row_id}: the vector of {self.source[0]}"
        origins = {"model": "the vote of its nearest references", "needs_review": "nobody sure enough: it waits for review"}
        lines = [f"row {row_id}: {row['value']}, from {origins.get(row['source'], 'the stage ' + row['source'])}", f"confidence {row['confidence'] or 0.0:.4f} (sure from {self.threshold}), {row['cost']:.4f} USD"]
        near = self.examples(frame.where(F.col(self.id_col) == row_id)).orderBy("rank").collect()
        return "\n".join([*lines, *(f"reference {r['rank']}, at {r['similarity']:.4f}: {r['label']}" for r in near)])

    def cost(self, result: DataFrame) -> dict:
        """Rows by where their value came from, and what they cost."""
        return {r["source"]: {"n": r["n"], "cost_usd": r["cost_usd"]} for r in result.groupBy("source").agg(F.count("*").alias("n"), F.sum("cost").alias("cost_usd")).collect()}

    def review_queue(self, result: DataFrame) -> DataFrame:
        return result.where(F.col("source").isin("needs_review", "llm")).orderBy("confidence", "id")

    def status(self, result: DataFrame) -> DataFrame:
        return status(result)

"""Evidence prediction: models and similar cases for every row, an external answer for the most doubtful."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import arrays as A
from ..functions import text as X
from ..sources.checkpoints import cut
from ..sources.clients import Client, kept_answers, keyed
from . import leakage, neighbours, routing
from .models import Model, Neighbours, Trees
from .neighbour_index import NeighbourIndex
from .text_index import TextIndex, nearest_together
from .profile import ColumnSpec, profile, spec_of


#: The row's id in the estimator's own tables, which hold no column of the user's.
ID = "__id"
#: Columns of a result beside the id and the models' outputs.
RESULT = ("value", "confidence", "origin", "signal", "sent", "cost", "reason", "fingerprint", "probabilities")


@dataclass(frozen=True)
class Domain:
    """Words of the question for an external answerer."""

    role: str = "an analyst"
    subject: str = "row"
    target_name: str = "target"
    hints: tuple[str, ...] = ()
    class_names: dict = field(default_factory=dict)

    def label(self, value) -> str:
        name = self.class_names.get(value) or self.class_names.get(str(value))
        return f"{value} ({name})" if name else str(value)

    def system_prompt(self, unit: str = "") -> str:
        lines = [f"You work as {self.role}.", f"Estimate {self.target_name}{f' in {unit}' if unit else ''} of the {self.subject} described below.", "Weigh the outputs of the statistical models and the similar known cases.", *self.hints]
        return "\n".join(lines)

    def tier_prompt(self) -> str:
        return f"You work as {self.role}. Each option is a statistical model with its output for {self.target_name} of one {self.subject}. Choose the one that is most likely right, by the similar known cases and the attributes."


@dataclass
class Prediction:
    """The result of predict(); frames keyed by the id column."""

    frame: DataFrame
    id_col: str
    unit_cost: float
    fit_id: str = ""
    target: str = "value"
    cases: Callable[[], DataFrame] | None = None

    def values(self) -> DataFrame:
        return self.frame.select(self.id_col, "value")

    def probabilities(self) -> DataFrame:
        """Class probabilities, in the order of the estimator's ``classes_``; null for numbers."""
        return self.frame.select(self.id_col, "probabilities")

    def confidence(self) -> DataFrame:
        return self.frame.select(self.id_col, "confidence")

    def route(self) -> DataFrame:
        lane = F.when(F.col("origin").isin("llm", "fallback"), "llm").when(F.col("origin") == "jev", "jev").otherwise("fast")
        return self.frame.select(self.id_col, lane.alias("route"), F.col("origin").alias("source"), "signal", F.col("value").alias("prediction"), "confidence", F.col("cost").alias("cost_usd"))

    def provenance(self) -> DataFrame:
        kept = [c for c in self.frame.columns if c.startswith("evidence_")]
        return self.route().join(self.frame.select(self.id_col, "reason", *kept), self.id_col)

    def report(self) -> DataFrame:
        return self.frame.groupBy("origin").agg(F.count("*").alias("n"), F.sum("cost").alias("cost_usd"), F.avg("confidence").alias("mean_confidence"))

    def cost(self) -> dict:
        n, sent, paid = self.frame.agg(F.count("*"), F.count_if("sent"), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
        return {"n_rows": n, "n_sent": sent, "cost_usd": paid, "saved_usd": (n - sent) * self.unit_cost}

    def review_queue(self) -> DataFrame:
        return self.frame.where(F.col("origin") == "llm").orderBy("confidence", self.id_col).select(self.id_col, "fingerprint", "value", "confidence", "signal", "reason")

    def examples(self) -> DataFrame:
        """(id, rank, similarity, label, row): the similar known cases of each row, nearest first."""
        if self.cases is None:
            raise TesseraError("this result keeps no similar cases")
        return self.cases().select(self.id_col, F.inline("cases"))

    def explain(self, row_id) -> str:
        """How one row came to its value: its origin, doubt and price, what the models said, and its similar known cases."""
        row = self.frame.where(F.col(self.id_col) == row_id).first()
        if row is None:
            raise TesseraError(f"no row {row_id}")
        origins = {"human": "a person's answer for a row of the same content", "llm": "an external answer", "jev": "the models' outputs, weighted by the middle tier", "fallback": "the first model, as no external answer came", "model": "the first model"}
        number = lambda x: "none" if x is None else f"{x:.6g}" if isinstance(x, float) else ", ".join(f"{y:.3f}" for y in x) if isinstance(x, list) else str(x)
        lines = [f"{self.target} of {self.id_col} {row_id}: value {number(row['value'])}, from {origins[row['origin']]}", f"confidence {number(row['confidence'])}, signal of doubt {number(row['signal'])}, {'sent' if row['sent'] else 'not sent'}, {row['cost']:.4f} USD"]
        if row["reason"]:
            lines.append(f"reason: {row['reason']}")
        lines += [f"model {c.removeprefix('evidence_')}: {number(row[c])}" for c in self.frame.columns if c.startswith("evidence_")]
        if self.cases is not None:
            near = self.examples().where(F.col(self.id_col) == row_id).orderBy("rank").collect()
            lines += [f"similar case {r['rank']}, at {r['similarity']:.4f}: {r['label']} ({'; '.join(x.removeprefix('- ') for x in r['row'].splitlines())})" for r in near]
        return "\n".join(lines)


class EvidenceEstimator:
    """Fits models and a neighbour index; predict() merges approved, external, middle-tier and model answers."""

    task = "regression"

    def __init__(self, target: str, id_col: str, unit: str = "", spec: ColumnSpec | None = None, domain: Domain | None = None, models: Sequence[Model] | str = "default", n_examples: int = 5, neighbour_weight: float = 0.15, client: Client | None = None, tier: Client | None = None, fallback: str = "best_model", check_leakage: bool = True, escalate_rate: float | None = None, threshold: float | None = None, signal: str | Callable[[DataFrame], Column] = "disagreement", cache: str | None = None):
        if fallback not in ("best_model", "error"):
            raise TesseraError("fallback is best_model or error")
        if id_col in RESULT or id_col.startswith("evidence_"):
            raise TesseraError(f"an id column can't be called {id_col}: the result has such a column")
        self.target, self.id_col, self.unit, self.spec = target, id_col, unit, spec
        self.domain, self.models, self.n_examples, self.weight = domain or Domain(target_name=target), models, n_examples, neighbour_weight
        self.client, self.tier, self.fallback, self.check = client, tier, fallback, check_leakage
        self.rate, self.threshold, self.signal, self.cache = escalate_rate, threshold, signal, cache
        if signal == "tier" and tier is None:
            raise TesseraError("the signal of the middle tier needs one")
        self.approved: DataFrame | None = None
        self.warned, self.fit_id = False, ""

    def fit(self, train: DataFrame) -> EvidenceEstimator:
        self.spec = self.spec or spec_of([c for c in profile(train, self.id_col) if c.name != self.id_col], self.target)
        self.spec.check(train)
        self.train = train.where(F.col(self.target).isNotNull())
        self.index: NeighbourIndex | None = None  # of similar cases by numbers and by text, fitted when first asked for
        self.texts: TextIndex | None = None
        self.classes_: list[str] | None = None
        if self.task == "classification":
            if train.where(F.col(self.target).isNull()).limit(1).count():
                raise TesseraError("a class label is missing")
            self.classes_ = [r[0] for r in self.train.select(F.col(self.target).cast("string")).distinct().orderBy(self.target).limit(21).collect()]
            if not 2 <= len(self.classes_) <= 20:
                raise TesseraError("classification takes 2 to 20 classes")
        numeric, categorical = [*self.spec.numeric, *self.spec.boolean], [*self.spec.categorical]
        given, chosen = ([self.models] if isinstance(self.models, str) else list(self.models)), []
        for m in given:
            if m == "default":
                chosen += [Trees(numeric, categorical, "boosted", self.task), Trees(numeric, categorical, "forest", self.task)]
                chosen += [Neighbours(self.spec.numeric, self.id_col, self.n_examples, self.task, weight=self.weight)] if self.spec.numeric else []
            else:
                chosen.append(m)
        if len({m.name for m in chosen}) < len(chosen):
            raise TesseraError("models need names of their own")
        self.models_, self.fit_id = [m.fit(self.train, self.target) for m in chosen], uuid.uuid4().hex
        return self

    def evidence(self, frame: DataFrame) -> DataFrame:
        """The frame with ``evidence_<model>`` of each model: a number, or class probabilities."""
        if clash := {f"evidence_{m.name}" for m in self.models_} & set(frame.columns):
            raise TesseraError(f"the frame has columns of the models' names already: {', '.join(sorted(clash))}")
        for m in self.models_:
            frame = m.predict(frame, f"evidence_{m.name}")
        return frame

    def examples(self, frame: DataFrame) -> DataFrame:
        """(id, train_id, similarity, rank, label) of similar known cases."""
        neighbours.require_features(self.spec.text, self.spec.numeric)
        if self.spec.text and self.spec.numeric and self.train.limit(neighbours.BROADCAST_ROWS + 1).count() <= neighbours.BROADCAST_ROWS:
            return self._few_examples(frame)
        if self.spec.numeric and self.index is None:
            self.index = NeighbourIndex(self.id_col, self.spec.numeric, weight=self.weight).fit(self.train)
        if self.spec.text and self.texts is None:
            counts = neighbours.gram_counts(self.train, self.id_col, F.col(self.spec.text))
            self.gram_weights = neighbours.gram_weights(counts, self.train.count())
            self.texts = TextIndex().fit(neighbours.sparse_vectors(counts, self.gram_weights))
        vectors = lambda rows: neighbours.sparse_vectors(neighbours.gram_counts(rows, self.id_col, F.col(self.spec.text)), self.gram_weights)
        if not self.spec.text:
            found = self.index.nearest(frame, self.n_examples)
        elif not self.spec.numeric:
            found = self.texts.nearest(vectors(frame), self.n_examples)
        else:
            rows = frame.select(self.id_col, *dict.fromkeys([self.spec.text, *self.spec.numeric]))

            def scores(pairs: DataFrame) -> DataFrame:
                far = neighbours.numeric_similarities(pairs, rows, self.train, self.id_col, self.spec.numeric, self.weight)
                near = self.texts.similarities(pairs, vectors(rows)).withColumnRenamed("similarity", "cosine")
                return far.join(near, ["id", "train_id"], "left").select("id", "train_id", (F.col("similarity") + F.coalesce("cosine", F.lit(0.0))).alias("similarity"))

            found = nearest_together(rows, self.id_col, self.train.count(), self.n_examples, lambda x, m: self.texts.nearest(vectors(x), m), self.index.nearest, scores)
        return found.join(self.train.select(F.col(self.id_col).alias("train_id"), F.col(self.target).alias("label")), "train_id")

    def _few_examples(self, frame: DataFrame) -> DataFrame:
        """examples() by text and numbers where the training rows are counted few: each row streams past all of them."""
        pairs = neighbours.numeric_pairs(frame, self.train, self.id_col, self.spec.numeric, self.weight)
        counts = neighbours.gram_counts(self.train, self.id_col, F.col(self.spec.text))
        weights = neighbours.gram_weights(counts, self.train.count())
        text = neighbours.sparse_pairs(neighbours.sparse_vectors(neighbours.gram_counts(frame, self.id_col, F.col(self.spec.text)), weights), neighbours.sparse_vectors(counts, weights))
        pairs = pairs.join(text.withColumnRenamed("similarity", "cosine"), ["id", "train_id"], "left").select("id", "train_id", (F.col("similarity") + F.coalesce("cosine", F.lit(0.0))).alias("similarity"))
        return neighbours.nearest(pairs, self.n_examples).join(self.train.select(F.col(self.id_col).alias("train_id"), F.col(self.target).alias("label")), "train_id")

    def _signal(self, evidence: DataFrame) -> DataFrame:
        """The frame with ``__signal``."""
        voices = [F.col(f"evidence_{m.name}") for m in self.models_ if m.in_disagreement]
        if callable(self.signal):
            return evidence.withColumn("__signal", self.signal(evidence).cast("double"))
        if self.signal == "disagreement":
            if len(voices) < 2:
                if self.rate is not None or self.threshold is not None:
                    raise TesseraError("disagreement needs two models")
                return evidence.withColumn("__signal", F.lit(None).cast("double"))
            return evidence.withColumn("__signal", A.disagreement(voices, self.task == "classification"))
        if self.signal == "similarity":
            near = self.examples(evidence).groupBy("id").agg((-F.max("similarity")).alias("__signal"))
            return evidence.join(near.withColumnRenamed("id", self.id_col), self.id_col, "left")
        if self.signal == "tier":
            return evidence.withColumn("__signal", F.lit(None).cast("double"))  # known once the tier has answered
        if self.signal == "unseen":
            return evidence.join(routing.unseen_signal(evidence, self.train, self.id_col, list(self.spec.categorical), self.spec.text).withColumnRenamed("signal", "__signal"), self.id_col)
        raise TesseraError(f"no such signal: {self.signal}")

    def _judged(self, frame: DataFrame) -> DataFrame:
        """(__id, evidence_*, signal, fingerprint, description): all that later steps need, and no column of the user's."""
        voices = [f"evidence_{m.name}" for m in self.models_]
        return self._signal(self.evidence(frame)).select(F.col(self.id_col).alias(ID), *voices, F.col("__signal").alias("signal"), self._fingerprint().alias("fingerprint"), self.describe(frame).alias("description"))

    def _plain(self, value: Column) -> Column:
        return value if self.task == "regression" else F.element_at(F.array(*map(F.lit, self.classes_)), A.argmax(value) + 1)

    def _fingerprint(self) -> Column:
        return X.fingerprint(*(F.col(c) for c in self.spec.all_columns()))

    def describe(self, frame: DataFrame) -> Column:
        """The row as text for an answerer; long text is cut and, for numbers, masked."""
        kinds = [(c, F.col(c), "integer" if dict(frame.dtypes)[c] in ("int", "bigint") else "boolean" if dict(frame.dtypes)[c] == "boolean" else "text") for c in self.spec.all_columns() if c != self.spec.long_text]
        if self.spec.long_text:
            mask = self.task == "regression" if self.spec.mask_amounts_in_long_text is None else self.spec.mask_amounts_in_long_text
            text = X.mask_amounts(F.col(self.spec.long_text)) if mask else F.col(self.spec.long_text)
            kinds.append((self.spec.long_text, X.truncated(text, self.spec.long_text_chars), "text"))
        return X.described(kinds)

    def cases(self, frame: DataFrame) -> DataFrame:
        """(id, cases): for each row its similar known cases, nearest first, as an array of (similarity, label, row)."""
        if not self.spec.numeric and not self.spec.text:
            return frame.select(self.id_col, F.array().cast("array<struct<rank:int,similarity:double,label:string,row:string>>").alias("cases"))
        told = self.train.select(F.col(self.id_col).alias("train_id"), self.describe(self.train).alias("row"))
        case = F.struct("rank", F.round("similarity", 6).alias("similarity"), F.col("label").cast("string").alias("label"), "row")
        return self.examples(frame).join(told, "train_id").groupBy(F.col("id").alias(self.id_col)).agg(F.array_sort(F.collect_list(case)).alias("cases"))

    def answer_schema(self) -> dict:
        """What an answer must look like."""
        value = {"type": "number"} if self.task == "regression" else {"type": "string", "enum": list(self.classes_)}
        return {"type": "object", "required": ["value"], "properties": {"value": value, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "reason": {"type": "string"}}}

    def _requests(self, frame: DataFrame, rows: DataFrame, client: Client, prompt: str, **more: Column) -> DataFrame:
        """(__id, request, key): the question for each of the judged rows of a frame."""
        own = frame.join(rows.select(F.col(ID).alias(self.id_col)), self.id_col, "left_semi")
        voices = F.struct(*(F.col(f"evidence_{m.name}").alias(m.name) for m in self.models_))
        asked = rows.join(self.cases(own).withColumnRenamed(self.id_col, ID), ID, "left")
        request = F.to_json(F.struct(F.lit(prompt).alias("system"), F.col("description").alias("row"), voices.alias("evidence"), F.col("cases"), *(c.alias(n) for n, c in more.items())))
        return keyed(asked.select(ID, request.alias("request")), client)

    def _tiered(self, frame: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows with tier_value, tier_confidence and tier_cost: the models' outputs weighted by the tier's probabilities."""
        names = [m.name for m in self.models_]
        requests = cut(self._requests(frame, rows, self.tier, self.domain.tier_prompt(), options=F.array(*map(F.lit, names))))
        said = F.from_json("answer", "choice string, probabilities map<string, double>, confidence double")
        got = kept_answers(requests, self.tier, self.cache).select("key", said.alias("said"), "cost").where(F.col("said.choice").isin(names))
        got = requests.select(ID, "key").join(got, "key").select(ID, "said", F.col("cost").alias("tier_cost"))
        drawn = [F.coalesce(F.col("said.probabilities")[n], F.lit(0.0)) for n in names]
        none = sum((F.greatest(d, F.lit(0.0)) for d in drawn), F.lit(0.0)) <= 0
        weights = [F.when(none, (F.col("said.choice") == n).cast("double")).otherwise(d) for d, n in zip(drawn, names, strict=True)]
        out = rows.join(got, ID, "left")
        voices = [F.col(f"evidence_{n}") for n in names]
        if self.task == "regression":
            value = A.weighted_average(voices, weights)
        else:
            value = F.array(*(A.weighted_average([v[i] for v in voices], weights) for i in range(len(self.classes_))))
        answered = F.col("said").isNotNull()
        return out.withColumns({"tier_value": F.when(answered, value), "tier_confidence": F.when(answered, F.coalesce("said.confidence", F.lit(0.0))), "tier_cost": F.coalesce("tier_cost", F.lit(0.0))}).drop("said")

    def plan(self, frame: DataFrame) -> dict:
        cost = self.client.cost_per_call if self.client else routing.COST_A_ROW
        if self.signal == "tier":
            raise TesseraError("the tier's signal is known only after it has been asked")
        rows = self._judged(frame)
        return routing.plan(rows, "signal", ID, self.rate, self.threshold, None if self.approved is None else rows.join(self.approved, "fingerprint").select(ID), cost)

    def predict(self, frame: DataFrame) -> Prediction:
        if self.check:
            leakage.check_overlap(self.train.drop(self.target, self.id_col), frame.drop(self.target, self.id_col), warn=True)
        kind = "double" if self.task == "regression" else "string"
        none = {"tier_value": F.lit(None).cast(kind if self.task == "regression" else "array<double>"), "tier_confidence": F.lit(None).cast("double"), "tier_cost": F.lit(0.0)}
        fast = cut(self._judged(frame))
        if self.signal == "tier":
            # A row that the tier could not answer is the least certain of all.
            fast = cut(self._tiered(frame, fast).withColumn("signal", 1.0 - F.coalesce("tier_confidence", F.lit(0.0))))
        cost = self.client.cost_per_call if self.client else routing.COST_A_ROW
        approved = None if self.approved is None else fast.join(self.approved, "fingerprint").select(ID, F.col("approved_value"))
        routed = self.rate is not None or self.threshold is not None
        if self.client is None:
            sent = fast.limit(0)
        else:
            sent = cut(routing.selected(fast, "signal", ID, self.rate, self.threshold, approved))
            if not routed and not self.warned and sent.count() * cost > routing.WARN_DOLLARS:
                self.warned = True
                warnings.warn(f"every row goes to {self.client.name}, at about {sent.count() * cost:.2f} USD", stacklevel=2)
        out = fast
        if self.client is not None:
            requests = cut(self._requests(frame, sent, self.client, self.domain.system_prompt(self.unit), answer=F.lit(json.dumps(self.answer_schema()))))
            # Each row bears the price of its answer, also where several rows ask the same.
            got = requests.select(ID, "key").join(kept_answers(requests, self.client, self.cache), "key")
            said = F.from_json("answer", f"value {kind}, confidence double, reason string")
            valid = F.lit(True) if self.task == "regression" else said["value"].isin(self.classes_)
            wrong = F.when(F.col("error").isNull() & ~F.coalesce(valid & said["value"].isNotNull(), F.lit(False)), "the answer is no valid value")
            got = got.select(ID, F.lit(True).alias("sent"), F.when(valid, said["value"]).alias("answer"), F.greatest(F.least(F.coalesce(said["confidence"], F.lit(0.5)), F.lit(1.0)), F.lit(0.0)).alias("answer_confidence"), said["reason"].alias("answer_reason"), F.col("cost").alias("answer_cost"), F.coalesce("error", wrong).alias("answer_error"))
            out = out.join(got, ID, "left")
        else:
            out = out.withColumns({"sent": F.lit(False), "answer": F.lit(None).cast(kind), "answer_confidence": F.lit(None).cast("double"), "answer_reason": F.lit(None).cast("string"), "answer_cost": F.lit(0.0), "answer_error": F.lit(None).cast("string")})
        out = out.withColumn("sent", F.coalesce("sent", F.lit(False))).withColumn("answer", F.when(F.col("sent"), F.col("answer")))
        out = out.join(approved, ID, "left").withColumnRenamed("approved_value", "approved") if approved is not None else out.withColumn("approved", F.lit(None).cast(kind))
        if self.signal != "tier" and self.tier is not None:
            left = out.where("not sent and approved is null")
            out = self._tiered(frame, left).unionByName(out.join(left.select(ID), ID, "left_anti").withColumns(none))
        elif self.tier is None:
            out = out.withColumns(none)
        out = out.withColumn("tier", F.col("tier_value"))
        if self.fallback == "error" and out.where("sent and answer is null and approved is null").limit(1).count():
            raise TesseraError("an external answer failed")
        out = routing.confidence(out.withColumn("origin", routing.merged(out)), "signal").withColumnRenamed("confidence", "_fast")
        first = F.col(f"evidence_{self.models_[0].name}")
        is_from = lambda x: F.col("origin") == x
        value = F.when(is_from("human"), F.col("approved")).when(is_from("llm"), F.col("answer")).when(is_from("jev"), self._plain(F.col("tier"))).otherwise(self._plain(first))
        sure = F.when(is_from("human"), 1.0).when(is_from("llm"), F.col("answer_confidence")).when(is_from("jev"), F.col("tier_confidence")).when(is_from("fallback"), 0.0).otherwise(F.col("_fast") if routed else F.lit(0.0))
        paid = F.when(F.col("sent"), F.coalesce("answer_cost", F.lit(0.0))).otherwise(0.0) + F.coalesce("tier_cost", F.lit(0.0))
        out = out.withColumns({"value": value, "confidence": sure, "cost": paid, "reason": F.coalesce("answer_reason", F.col("answer_error"))})
        if self.task == "regression":
            probabilities = F.lit(None).cast("array<double>")
        else:
            # An external or human class takes its confidence; the others share the rest.
            spread = F.array(*(F.when(F.col("value") == c, F.col("confidence")).otherwise((1.0 - F.col("confidence")) / (len(self.classes_) - 1)) for c in self.classes_))
            probabilities = F.when(is_from("human") | is_from("llm"), spread).when(is_from("jev"), F.col("tier")).otherwise(first)
        keep = [F.col(ID).alias(self.id_col), *RESULT, *(f"evidence_{m.name}" for m in self.models_)]
        return Prediction(cut(out.withColumn("probabilities", probabilities).select(*keep)), self.id_col, cost, self.fit_id, self.target, lambda: self.cases(frame))

    def approve(self, result: Prediction, ids: DataFrame) -> int:
        """Keeps external answers of these ids by content; they are not asked again. A result of an earlier fit is refused."""
        if result.fit_id != self.fit_id:
            raise TesseraError("this result is of an earlier fit")
        new = result.frame.where(F.col("origin") == "llm").join(ids.select(self.id_col), self.id_col).select("fingerprint", F.col("value").alias("approved_value")).distinct()
        self.approved = new if self.approved is None else self.approved.unionByName(new).dropDuplicates(["fingerprint"])
        return new.count()

    def approve_values(self, frame: DataFrame, value_col: str) -> None:
        """Keeps a person's answers by content, as approve() does."""
        new = frame.select(self._fingerprint().alias("fingerprint"), F.col(value_col).alias("approved_value")).dropDuplicates(["fingerprint"])
        self.approved = new if self.approved is None else self.approved.unionByName(new).dropDuplicates(["fingerprint"])

    def curve(self, frame: DataFrame, answers: DataFrame, rates: Sequence[float] = (0, 0.1, 0.2, 0.3, 0.5, 0.75, 1)) -> DataFrame:
        """Error by share of rows that take ``answers`` (id, answer)."""
        base = self._plain(F.col(f"evidence_{self.models_[0].name}"))
        known = frame.select(F.col(self.id_col).alias(ID), F.col(self.target).alias("truth"))
        rows = self._judged(frame).withColumn("base", base).join(known, ID).join(answers.select(F.col(self.id_col).alias(ID), "answer"), ID)
        if rows.where(F.col("signal").isNull()).limit(1).count():
            raise TesseraError("a row has no signal")
        return routing.curve(rows, "signal", ID, "truth", "base", "answer", list(rates), classification=self.task == "classification")


class EvidenceRegressor(EvidenceEstimator):
    task = "regression"


class EvidenceClassifier(EvidenceEstimator):
    task = "classification"

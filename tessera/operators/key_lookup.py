"""A column answered once for each distinct key, with cache, tiers, review and scoring."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import text as X
from ..sources import caches
from ..sources.checkpoints import cut
from ..sources.clients import MOST_OPTIONS, Client, chosen, kept_answers
from . import contracts, lookup, screening

ANSWERS = "key string, value string, confidence double, source string, reason string, cost double"


class KeyLookup:
    """fit() counts keys and loads the cache; transform() asks what is missing and joins back."""

    def __init__(self, keys: Sequence[str], attribute: str, kind: str = "category", values: Sequence[str] = (), unit: str = "", low: float | None = None, high: float | None = None, client: Client | None = None, tier: Client | None = None, threshold: float | None = None, min_count: int = 1, batch_size: int = 20, check_against: str | None = None, cache: str | None = None, name: str | None = None):
        if kind not in lookup.LEAST_CONFIDENCE:
            raise TesseraError("a looked-up column is a category, binary or numeric")
        if kind == "category" and len(set(values)) < 2:
            raise TesseraError("a category needs two values")
        if low is not None and high is not None and low >= high:
            raise TesseraError("the range is empty")
        self.keys, self.attribute, self.kind, self.unit, self.low, self.high = list(keys), attribute, kind, unit, low, high
        self.values = list(values) if kind != "binary" else list(values) or ["yes", "no"]
        self.client, self.tier, self.min_count, self.batch_size, self.check_against = client, tier, min_count, batch_size, check_against
        if tier is not None and self.values and len(self.options()) > MOST_OPTIONS:
            raise TesseraError(f"a choice has {MOST_OPTIONS} options at most, one of which is not to know")
        self.threshold = lookup.LEAST_CONFIDENCE[kind] if threshold is None else threshold
        self.name = name or column_name(attribute)
        self.fingerprint = caches.question_fingerprint({"attribute": attribute, "type": kind, "values": self.values, "unit": unit, "range": [low, high], "keys": self.keys})
        self.path = f"{cache.rstrip('/')}/fingerprint={self.fingerprint}" if cache else None

    def fit(self, frame: DataFrame) -> KeyLookup:
        self.counts = lookup.key_counts(lookup.keyed(frame, *self.keys), self.min_count).cache()
        empty = frame.sparkSession.createDataFrame([], ANSWERS)
        self.answers = caches.load(frame.sparkSession, self.path, ANSWERS) if self.path else empty
        return self

    def cost(self) -> dict:
        """Keys to ask and what that costs, without a call."""
        n = lookup.to_ask(self.counts, self.answers).count()
        return {"n_keys": self.counts.count(), "n_to_ask": n, "cost_usd": n * (self.client.cost_per_call if self.client else 0.0)}

    def _ask(self, keys: DataFrame, client: Client) -> DataFrame:
        """A batch of keys is one request; each key's answer is checked and takes its share of the cost."""
        question = F.struct(F.lit(self.attribute).alias("attribute"), F.lit(self.kind).alias("type"), F.array(*map(F.lit, self.values)).cast("array<string>").alias("values"), F.lit(self.unit).alias("unit"), F.lit(json.dumps(contracts.looked_up(self.kind))).alias("schema"), F.col("keys"))
        sets = lookup.batches(keys, self.batch_size)
        got = kept_answers(sets.select(F.col("batch").alias("key"), F.to_json(question).alias("request")), client).withColumnRenamed("key", "batch")
        rows = sets.join(got, "batch").withColumn("cost", F.col("cost") / F.size("keys")).select("batch", "cost", "error", F.explode("keys").alias("key"), F.from_json("answer", "answers array<struct<key: string, known: boolean, value: string, confidence: double, reason: string>>")["answers"].alias("a"))
        mine = F.get(F.filter("a", lambda x: X.normalised(x["key"]) == F.col("key")), F.lit(0))
        rows = rows.withColumn("m", mine)
        unknown = (X.normalised(F.col("m.value")) == "unknown") | ~F.coalesce("m.known", F.lit(True))
        value = lookup.validated(F.col("m.value"), "numeric" if self.kind == "numeric" else "category", self.values, self.low, self.high)
        state = F.when(F.col("error").isNotNull(), "error").when(unknown, "unknown").when(value.isNull(), "rejected").otherwise("llm")
        return rows.select("key", F.when(~unknown, value).alias("value"), F.greatest(F.least(F.coalesce("m.confidence", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("confidence"), state.alias("source"), F.coalesce("m.reason", "error").alias("reason"), "cost")

    def options(self) -> list[str]:
        """What the tier chooses from: the values, then not to know."""
        return [*dict.fromkeys(self.values), "(unknown)" if "unknown" in self.values else "unknown"]

    def _choose(self, keys: DataFrame) -> DataFrame:
        """The tier's choice for each key, one request a key, which tells the key's parts by column. Only for closed sets."""
        *known, unknown = self.options()
        state = F.to_json(X.split_key(F.col("key"), self.keys))
        asked = f"What is the {self.attribute} of what these columns name? Choose {unknown} if that is not common knowledge or the columns do not settle it."
        request = F.struct(F.lit("choice").alias("kind"), state.alias("state"), F.lit(asked).alias("question"), F.array(*map(F.lit, [*known, unknown])).alias("options"), F.create_map(F.lit(unknown), F.lit("not common knowledge, or not settled by the key")).alias("descriptions"))
        got = kept_answers(keys.select("key", F.to_json(request).alias("request")), self.tier).withColumn("m", chosen(F.col("answer"), [*known, unknown]))
        value = F.when(F.col("m.value") != unknown, F.col("m.value"))
        state = F.when(F.col("error").isNotNull(), "error").when(F.col("m.value") == unknown, "unknown").when(value.isNull(), "rejected").otherwise("jev")
        sure = F.coalesce("m.probability", "m.confidence")
        reason = F.when(value.isNotNull(), F.concat(F.lit("chosen with probability "), F.format_number(sure, 2))).otherwise(F.col("error"))
        return got.select("key", value.alias("value"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), state.alias("source"), reason.alias("reason"), "cost")

    def transform(self, frame: DataFrame) -> DataFrame:
        """The frame with the new column, and <name>_confidence, _source, _cost and _reason."""
        new = lookup.to_ask(self.counts, self.answers)
        got = None
        if self.tier is not None and self.values:
            first = self._choose(new)
            got = first if self.client is None else first.where((F.col("source") == "jev") & (F.col("confidence") >= self.threshold))
            left = new.join(got.select("key"), "key", "left_anti")
            spent = first.select("key", F.col("cost").alias("_spent"))
            if self.client is not None:
                rest = self._ask(left, self.client).join(spent, "key", "left").withColumn("cost", F.col("cost") + F.coalesce("_spent", F.lit(0.0))).drop("_spent")
                got = got.unionByName(rest)
        elif self.client is not None:
            got = self._ask(new, self.client)
        if got is not None:
            if self.path:
                caches.save_answers(got, self.path)
            # Answers held before stay; errors among them are replaced.
            self.answers = self.answers.where("source <> 'error'").unionByName(got.select(*self.answers.columns))
        self.read = lookup.thresholded(self.answers, self.threshold)
        out = lookup.resolved(lookup.keyed(frame, *self.keys), self.read)
        value = F.col("value").cast("double") if self.kind == "numeric" else F.col("value")
        return out.withColumns({self.name: value, f"{self.name}_confidence": F.col("confidence"), f"{self.name}_source": F.col("source"), f"{self.name}_cost": F.col("cost"), f"{self.name}_reason": F.col("reason")}).select(*frame.columns, self.name, *(f"{self.name}_{x}" for x in ("confidence", "source", "cost", "reason")))

    def agreement(self, result: DataFrame) -> DataFrame:
        if not self.check_against:
            raise TesseraError("nothing to check against")
        return lookup.agreement(result, self.name, self.check_against, self.kind == "numeric")

    def review_queue(self) -> DataFrame:
        return lookup.review_queue(self.read, self.counts)

    def status(self, result: DataFrame) -> DataFrame:
        return lookup.status(result.withColumnRenamed(f"{self.name}_source", "source"))


class AutoLookup:
    """Looked-up columns that an answerer proposes; those that carry signal stay.

    fit() asks once for proposals, keeps the usable ones (proposals()), and makes a KeyLookup of each.
    transform() adds the columns of all of them, or with ``scored`` only of those that stay; kept() scores each on folds of the
    training rows, once.
    """

    def __init__(self, target: str, id_col: str, client: Client, numeric: Sequence[str] = (), categorical: Sequence[str] = (), max_columns: int = 3, folds: int = 3, scored: bool = False, **options):
        self.target, self.id_col, self.client, self.max_columns, self.folds = target, id_col, client, max_columns, folds
        self.numeric, self.categorical, self.scored, self.options = list(numeric), list(categorical), scored, options

    def fit(self, frame: DataFrame) -> AutoLookup:
        usable = [c for c in frame.columns if c not in (self.target, self.id_col)]
        said = self.client.ask({"kind": "propose", "target": self.target, "columns": usable, "max_columns": self.max_columns, "schema": contracts.proposed(usable, self.max_columns)})
        self.proposals_ = proposals(said, usable, self.max_columns, frame.columns)
        self.lookups_ = [KeyLookup(p["keys"], p["attribute"], p["kind"], p["values"], p["unit"], p["low"], p["high"], client=self.client, name=p["name"], **self.options).fit(frame) for p in self.proposals_]
        self.train, self.scores_ = frame, None
        return self

    def _added(self, frame: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        for one in self.lookups_:
            if names is None or one.name in names:
                frame = one.transform(frame)
        return frame

    def transform(self, frame: DataFrame) -> DataFrame:
        return self._added(frame, self.kept() if self.scored else None)

    def kept(self) -> list[str]:
        """Names of the columns that make the folds' errors smaller, for keys that the trees have not seen, and clearly so."""
        if self.scores_ is None:
            known = cut(self._added(self.train))
            self.scores_ = {one.name: screening.score_column(known, self.target, self.id_col, one.name, "numeric" if one.kind == "numeric" else "category", self.numeric, self.categorical, self.folds, one.keys).first().asDict() for one in self.lookups_}
        return [name for name, row in self.scores_.items() if row["accepted"]]

    def explain(self) -> str:
        """Each proposed column: its keys, what it did to the folds' errors, and whether it stays."""
        self.kept()
        said = {p["name"]: p for p in self.proposals_}
        return "\n".join(f"{name} ({said[name]['kind']}, by {', '.join(said[name]['keys'])}): {'stays' if row['accepted'] else 'goes'}, contribution {row['contribution']:.6g}" for name, row in self.scores_.items())


def proposals(said: Mapping, usable: Sequence[str], max_columns: int, taken: Sequence[str] = ()) -> list[dict]:
    """The usable ones of an answerer's proposals, in its order: known keys, two values of a category, a range that is not empty; names that are taken get a number."""
    out: list[dict] = []
    for p in said.get("columns", []) if isinstance(said, Mapping) else []:
        kind, keys = p.get("kind", "category"), list(dict.fromkeys(p.get("keys", [])))
        values = list(dict.fromkeys(map(str, p.get("values", []))))
        low, high = (p.get("range") or (None, None))[:2]
        fine = bool(str(p.get("attribute", "")).strip()) and kind in lookup.LEAST_CONFIDENCE and bool(keys) and set(keys) <= set(usable)
        fine = fine and (kind != "category" or len(values) >= 2) and (low is None or high is None or low < high)
        if fine and len(out) < max_columns:
            name = column_name(p.get("name") or p["attribute"], [*taken, *(x["name"] for x in out)])
            out.append({"name": name, "attribute": p["attribute"], "kind": kind, "keys": keys, "values": values, "unit": p.get("unit", ""), "low": low, "high": high})
    return out


def column_name(attribute: str, taken: Sequence[str] = ()) -> str:
    """A column name for an attribute; _2, _3 and so on where it is taken."""
    import re

    base = re.sub(r"\W+", "_", attribute.strip().lower()).strip("_") or "value"
    name, n = base, 2
    while name in taken:
        name, n = f"{base}_{n}", n + 1
    return name

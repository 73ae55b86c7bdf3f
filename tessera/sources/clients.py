"""External answerers: a client protocol, a bounded-retry transport, and answers as a table.

Clients are objects that the user passes in; nothing here opens a connection by itself. A frame of
requests (key, request) is answered partition by partition, after the cache and duplicates are out of
it. A failed request gives a row with its error, never a failed task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import AnswerCache
from .checkpoints import cut

ANSWERS = "key string, answer string, cost double, error string"
# Statuses worth a second try, the longest wait, the most options of one choice.
RETRIED, LONGEST_WAIT, MOST_OPTIONS = (408, 409, 429, 500, 502, 503, 504, 529), 5.0, 255


class Client(Protocol):
    """Answers one request; raises on failure.

    ``name`` and, where there are such, ``model`` and ``effort`` go into cache keys. Optional too: ``workers``, calls at a
    time in one partition; ``most_calls``, calls at a time over all partitions; ``warm``, whether one request is
    answered before the others start, so that a provider's own cache of the common prompt is there for them.
    """

    name: str
    cost_per_call: float

    def available(self) -> bool: ...

    def ask(self, request: Mapping) -> Mapping: ...


@dataclass
class FunctionClient:
    """A client around a function, for tests and for answers that code can give."""

    function: Callable[[Mapping], Mapping]
    name: str = "function"
    cost_per_call: float = 0.0
    workers: int = 1
    model: str | None = None
    effort: str | None = None
    most_calls: int | None = None
    warm: bool = False

    def available(self) -> bool:
        return True

    def ask(self, request: Mapping) -> Mapping:
        return self.function(request)


class TransportError(RuntimeError):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


@dataclass
class HttpClient:
    """A client over an injected transport, with a bounded number of tries."""

    transport: Callable[[Mapping], Mapping]
    name: str
    cost_per_call: float = 0.0
    max_retries: int = 2
    sleep: Callable[[float], None] = time.sleep
    workers: int = 8
    model: str | None = None
    effort: str | None = None
    most_calls: int | None = None
    warm: bool = False

    def available(self) -> bool:
        return self.transport is not None

    def ask(self, request: Mapping) -> Mapping:
        for k in range(self.max_retries + 1):
            try:
                return self.transport(request)
            except (TransportError, ConnectionError) as error:
                if k == self.max_retries or (isinstance(error, TransportError) and error.status not in RETRIED):
                    raise
                wait = getattr(error, "retry_after", None)
                self.sleep(min(LONGEST_WAIT, wait if wait is not None else 0.5 * 2**k))
        raise AssertionError


def routed(model: str, makers: Mapping[str, Callable[[str], Client]], default: str | None = None) -> Client:
    """The client of a model string, "provider/name" or a bare name, whose provider is then ``default``."""
    provider, sep, name = model.partition("/")
    if not sep:
        provider, name = default, model
    if provider not in makers:
        raise ValueError(f"no client for {model}: there are {', '.join(sorted(makers)) or 'none'}")
    return makers[provider](name)


def identity(client: Client) -> str:
    """Who is asked, for cache keys: answers of another client, model or effort are other answers."""
    return json.dumps([client.name, getattr(client, "model", None), getattr(client, "effort", None)], ensure_ascii=False)


def keyed(requests: DataFrame, client: Client) -> DataFrame:
    """Adds ``key``, the hash of who is asked and of ``request``."""
    return requests.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(identity(client)), "request"), 256))


def choice(state: str, question: str, options: list[str], descriptions: Mapping[str, str] | None = None) -> dict:
    """A request to choose one of the options, with a probability for each."""
    options = list(dict.fromkeys(options))
    if not 2 <= len(options) <= MOST_OPTIONS:
        raise ValueError(f"a choice has 2 to {MOST_OPTIONS} options")
    return {"kind": "choice", "state": state, "question": question, "options": options, "descriptions": dict(descriptions or {})}


def score(state: str, question: str, low: float, high: float) -> dict:
    if not low < high:
        raise ValueError("a score's range is empty")
    return {"kind": "score", "state": state, "question": question, "range": [low, high]}


def yes_no(state: str, question: str) -> dict:
    return {"kind": "yes_no", "state": state, "question": question}


def chosen(answer: Column, options: Sequence[str]) -> Column:
    """struct(value, confidence, probability) of an answer to choice(): the value is null unless it is one of the options;
    a confidence that is missing or no number is 0."""
    said = F.from_json(answer, "choice string, confidence double, probabilities map<string,double>")
    value = F.when(said["choice"].isin(list(options)), said["choice"])
    return F.struct(value.alias("value"), _sure(said["confidence"]).alias("confidence"), F.try_element_at(said["probabilities"], said["choice"]).alias("probability"))


def rated(answer: Column, low: float, high: float) -> Column:
    """struct(value, confidence) of an answer to score(); a value out of the range is null."""
    said = F.from_json(answer, "score double, confidence double")
    return F.struct(F.when(said["score"].between(low, high), said["score"]).alias("value"), _sure(said["confidence"]).alias("confidence"))


def affirmed(answer: Column) -> Column:
    """struct(value, confidence) of an answer to yes_no()."""
    said = F.from_json(answer, "answer boolean, confidence double")
    return F.struct(said["answer"].alias("value"), _sure(said["confidence"]).alias("confidence"))


def _sure(confidence: Column) -> Column:
    return F.greatest(F.least(F.coalesce(F.nanvl(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def answered(requests: DataFrame, client: Client, cache: DataFrame | None = None) -> DataFrame:
    """(key, answer, cost, error, from_cache) of requests (key, request): cached ones first, each other key asked once."""
    distinct = requests.dropDuplicates(["key"])
    if cache is None:
        left, known = distinct, None
    else:
        held = cache.where("error is null").dropDuplicates(["key"]).select("key", "answer", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
        known, left = distinct.select("key").join(held, "key"), distinct.join(held.select("key"), "key", "left_anti")

    workers = max(1, getattr(client, "workers", 1))

    def one(request: str) -> tuple:
        try:
            return json.dumps(client.ask(json.loads(request)), ensure_ascii=False), client.cost_per_call, None
        except Exception as error:  # an answerer's failure is an answer too
            return None, 0.0, str(error) or type(error).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                said = list(pool.map(one, frame["request"]))
                yield pd.DataFrame([(key, *x) for key, x in zip(frame["key"], said, strict=True)], columns=["key", "answer", "cost", "error"])

    if most := getattr(client, "most_calls", None):
        # No more partitions than calls, and their workers share them out.
        workers = min(workers, most)
        left = left.repartition(max(1, most // workers))
    new = left.select("key", "request").mapInPandas(run, ANSWERS).withColumn("from_cache", F.lit(False))
    return new if known is None else known.unionByName(new)


def usage(answers: DataFrame) -> DataFrame:
    """One row: n_calls, cache_hits, errors, cost_usd. Summed over the answer table, so that retries do not count twice."""
    return answers.agg(F.count("*").alias("n_calls"), F.count_if("from_cache").alias("cache_hits"), F.count("error").alias("errors"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"))


def kept_answers(requests: DataFrame, client: Client, path: str | None = None) -> DataFrame:
    """answered(), run once and written: later actions read the table and pay nothing.

    With ``path``, an AnswerCache: requests whose key (see keyed()) it holds are not asked and new answers without an
    error are added. Rows of a task that is lost while it asks are asked again.
    """
    cache = AnswerCache(requests.sparkSession, path) if path else None
    requests = requests.select("key", "request")
    known = cut(cache.held(requests).select("key", "answer", F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("error"))) if cache else None
    first = None
    if getattr(client, "warm", False):
        left = requests if known is None else requests.join(known, "key", "left_anti")
        first = cut(answered(left.dropDuplicates(["key"]).orderBy("key").limit(1), client))
        requests = requests.join(first.select("key"), "key", "left_anti")
    got = answered(requests, client, known)
    got = cut(got if first is None else got.unionByName(first))
    if cache:
        asked = requests if first is None else requests.unionByName(first.join(left.dropDuplicates(["key"]), "key").select("key", "request"))
        cache.add(got.where("not from_cache and error is null").join(asked.dropDuplicates(["key"]), "key"), client.name)
    return got


def charged(rows: DataFrame, answers: DataFrame, row_id: str) -> DataFrame:
    """``rows`` (row_id, key, ...) with the columns of ``answers``; of rows that share a request, the least id bears its cost."""
    payer = rows.groupBy("key").agg(F.min(row_id).alias("__payer"))
    both = rows.join(answers.join(payer, "key"), "key", "left")
    return both.withColumn("cost", F.when(F.col(row_id) == F.col("__payer"), F.col("cost")).otherwise(0.0)).drop("__payer")

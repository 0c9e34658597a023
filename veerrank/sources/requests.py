"""Requests of split queries to a client that may fail: bounded attempts with growing pauses, answers and dead letters committed as they come."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import NONE
from . import caches
from .readers import DUAL
from .shared import stash

#: Answers a query and its instruction with JSON text that holds Q_plus and Q_minus, or raises.
Client = Callable[[str, str], str]
ANSWER = "qid string, query_type string, query string, q_plus string, q_minus string, attempts int, waited double, error string"


@dataclass(frozen=True)
class Retry:
    """Most attempts of a request, seconds before the second one, how pauses grow, and the longest."""

    attempts: int = 3
    delay: float = 1.0
    factor: float = 2.0
    most: float = 30.0

    def pauses(self) -> list[float]:
        """The pause before each further attempt."""
        return [min(self.delay * self.factor**i, self.most) for i in range(self.attempts - 1)]


def parsed(answer: str | None) -> tuple[str, str]:
    """Both sides of an answer; what is missing is empty, or no constraint."""
    if not answer:
        raise ValueError("the answer is empty")
    found = json.loads(answer)
    if not isinstance(found, dict):
        raise ValueError("the answer is no object")
    return str(found.get("Q_plus") or ""), str(found.get("Q_minus") or NONE)


def answered(client: Client, query: str, instruction: str, retry: Retry, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int, float, str | None]:
    """q_plus, q_minus, attempts, seconds waited and the last error of one request; the sides are null where every attempt failed."""
    waited, error = 0.0, None
    for attempt, pause in enumerate([0.0, *retry.pauses()], 1):
        if pause:
            sleep(pause)
            waited += pause
        try:
            return *parsed(client(query, instruction)), attempt, waited, None
        except Exception as e:  # whatever a client raises is a failed attempt, and its text is kept
            error = f"{type(e).__name__}: {e}"
    return None, None, retry.attempts, waited, error


def ask(requests: DataFrame, make: Callable[[], Client], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """ANSWER of each request (qid, query_type, query, instruction). make: a client of its own for each task.

    Store the result before it is used twice: each reading asks again."""
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in ANSWER.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            for row in batch.to_pylist():  # a row leaves as soon as it is answered
                q_plus, q_minus, attempts, waited, error = answered(client, row["query"] or "", row["instruction"] or "", retry, sleep)
                yield pa.RecordBatch.from_pylist([{**row, "q_plus": q_plus, "q_minus": q_minus, "attempts": attempts, "waited": waited, "error": error}], schema)

    return requests.select("qid", "query_type", "query", "instruction").mapInArrow(run, ANSWER)


def fill(requests: DataFrame, log: str, dead: str, make: Callable[[], Client], retry: Retry = Retry(), sleep: Callable[[float], None] = time.sleep, chunks: int = 16) -> DataFrame:
    """Requests with q_plus, q_minus and hit, after what the log of split queries lacks has been asked for.

    Misses are asked in chunks of a hash of their id; a chunk's answers are appended to the log, and its failures to the dead letters, when it is
    through, so an interrupted job asks only for the rest. Failed requests fall back to their own text and no constraint,
    and are asked again by the next job.
    """
    spark = requests.sparkSession

    def known() -> DataFrame:
        rows = caches.read_or_empty(spark, log, DUAL, "json")
        return caches.last_wins(rows, ("qid", "query_type"), F.struct("created_at", "idx", "q_plus"))

    left = requests.join(known().select("qid", "query_type"), ["qid", "query_type"], "left_anti")
    dealt = stash(left.withColumn("_chunk", F.pmod(F.xxhash64("qid", "query_type"), F.lit(chunks)).cast("int")), "requests", ["_chunk"])
    for chunk in [r._chunk for r in dealt.groupBy("_chunk").count().orderBy("_chunk").collect()]:
        answers = stash(ask(dealt.where(F.col("_chunk") == chunk), make, retry, sleep), "answers")
        good = answers.where("q_plus is not null").withColumns({f.name: F.lit(None).cast(f.dataType) for f in DUAL if f.name not in answers.columns})
        caches.append_split_queries(good, log)
        failed = answers.where("q_plus is null").withColumn("hit", F.lit(False))
        if not failed.isEmpty():
            letters = caches.failures(failed, retry.attempts, F.col("error"))
            letters.withColumn("attempts", F.lit(retry.attempts)).write.mode("append").json(dead)
    return caches.with_fallback(requests, known())

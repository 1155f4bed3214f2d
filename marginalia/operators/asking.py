"""Answers of a slow, unreliable function: bounded calls, and a store of answers by request, so that nothing is asked twice.

A request is the set of columns that the function sees; prompts with equal requests share one call. Requests without an
answer in the store are asked in waves. A wave's answers are written as files and merged into the store as its next
version, so what a failure costs is the tasks that were lost, or the wave at hand if the driver goes; a rerun asks for what is missing.
"""

from __future__ import annotations

import heapq
import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.shared import shared_path
from marginalia.sources.stores import Store, merge, read

ANSWERS = "request string, response string, error string, tries int"


class Refused(Exception):
    """Raised by an answer function for a request that must not be tried again; its text is the row's error."""


@dataclass(frozen=True)
class Calls:
    """at_once: calls at a time within a task; timeout: seconds of a call; wait: seconds before the second try, doubled for each
    one after it; task_rows: requests of a task; wave_rows: requests between two versions of the store; hot_rows: prompts of one
    request beyond which its answer is broadcast."""

    at_once: int = 8
    timeout: float = 60.0
    tries: int = 3
    wait: float = 0.5
    task_rows: int = 500
    wave_rows: int = 1_000_000
    hot_rows: int = 100_000


def answer_store(path: str, buckets: int = 64) -> Store:
    return Store(path, ANSWERS, ["request"], buckets)


def request_id(*columns: str) -> Column:
    """A digest of the values of columns, nulls and empty texts apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def call_all(requests: list[dict], answer: Callable[[dict], str], calls: Calls) -> list[tuple[str | None, str | None, int]]:
    """(response, error, tries) of each request, in order, with at most calls.at_once calls that are not given up yet.

    A call beyond its time is given up: its thread is left behind and what it returns later is ignored. It counts as a failed
    try, as do exceptions other than Refused and answers that aren't text. The error of the last try stays: TIMEOUT, the text of
    Refused, or the exception's name.
    """
    done: list[tuple[str | None, str | None, int]] = [(None, None, 0)] * len(requests)
    ready = [(0.0, i, 1) for i in range(len(requests))]  # a heap: time, request, number of the try
    running: dict[tuple[int, int], float] = {}  # (request, number of the try) -> the time at which it is given up
    returned: queue.SimpleQueue = queue.SimpleQueue()

    def call(i: int, n: int) -> None:
        try:
            text = answer(requests[i])
            returned.put((i, n, text, None, False) if isinstance(text, str) else (i, n, None, "NO_TEXT", False))
        except Refused as e:
            returned.put((i, n, None, str(e) or "REFUSED", True))
        except Exception as e:
            returned.put((i, n, None, type(e).__name__, False))

    def settle(i: int, n: int, text: str | None, error: str | None, final: bool) -> None:
        done[i] = (text, error, n)
        if error and not final and n < calls.tries:
            heapq.heappush(ready, (time.monotonic() + calls.wait * 2 ** (n - 1), i, n + 1))

    while ready or running:
        now = time.monotonic()
        while ready and ready[0][0] <= now and len(running) < calls.at_once:
            _, i, n = heapq.heappop(ready)
            running[i, n] = now + calls.timeout
            threading.Thread(target=call, args=(i, n), daemon=True).start()
        until = min([*running.values(), *([ready[0][0]] if ready and len(running) < calls.at_once else [])])
        try:
            i, n, *outcome = returned.get(timeout=max(until - now, 0.001))
            if running.pop((i, n), None) is not None:
                settle(i, n, *outcome)
        except queue.Empty:
            for i, n in [k for k, end in running.items() if end <= time.monotonic()]:
                del running[i, n]
                settle(i, n, None, "TIMEOUT", False)
    return done


def _ask(todo: DataFrame, columns: list[str], answer: Callable[[dict], str], calls: Calls, path: str) -> DataFrame:
    """Written answers of requests, each once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = rows[columns].astype(object)
            found = call_all(own.where(own.notna(), None).to_dict("records"), answer, calls)
            yield pd.DataFrame({"request": rows["request"], "response": [x[0] for x in found], "error": [x[1] for x in found], "tries": [x[2] for x in found]})

    todo.mapInPandas(ask, ANSWERS).write.parquet(path)
    return todo.sparkSession.read.schema(ANSWERS).parquet(path)


def with_stored_answers(prompts: DataFrame, columns: list[str], answer: Callable[[dict], str], store: Store, version: int, calls: Calls | None = None) -> tuple[DataFrame, int]:
    """prompts with response, error (null where there is a response) and tries, and the store's version that they are from.

    `answer` gets a request, a dict of `columns`, and returns its text. Requests with a response in `version` aren't asked; those
    with an error are asked again. Every prompt stays, equal ones as often as they are there; a prompt whose columns are all null is not asked and gets
    the error NO_PROMPT. Without prompts nothing is written. The prompts are read more than once, so they should be a table or cheap to plan again.
    """
    calls, spark = calls or Calls(), prompts.sparkSession
    path = shared_path(spark, "asked")
    blank = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNull()
    own = prompts.withColumn("request", F.when(~blank, request_id(*columns)))
    distinct = own.where("request is not null").groupBy("request").agg(*(F.first(c).alias(c) for c in columns), F.count("*").alias("_n"))
    distinct.write.parquet(f"{path}/requests")
    distinct = spark.read.schema(distinct.schema).parquet(f"{path}/requests")
    answered = read(spark, store, version).where("error is null").select("request")
    distinct.join(answered, "request", "left_anti").write.parquet(f"{path}/missing")
    missing = spark.read.schema(distinct.schema).parquet(f"{path}/missing")
    n = missing.count()
    waves = -(-n // calls.wave_rows)
    wave = F.pmod(F.xxhash64("request"), F.lit(max(waves, 1)))
    for w in range(waves):
        todo = missing.where(wave == w).repartition(max(1, -(-n // (waves * calls.task_rows))))
        found = _ask(todo, columns, answer, calls, f"{path}/wave-{w}")
        merge(spark, store, version, found, {c: lambda old, new: new for c in ("response", "error", "tries")})
        version += 1
    answers = read(spark, store, version)
    hot = distinct.where(F.col("_n") > calls.hot_rows).select("request", F.lit(True).alias("_hot"))
    marked = own.join(F.broadcast(hot), "request", "left")  # at most a row for each hot_rows prompts
    often = marked.where("_hot").join(F.broadcast(answers.join(F.broadcast(hot.select("request")), "request", "left_semi")), "request", "left")
    others = marked.where("_hot is null").join(answers, "request", "left")
    out = often.unionByName(others).withColumn("error", F.when(F.col("request").isNull(), "NO_PROMPT").otherwise(F.col("error")))
    return out.select(*prompts.columns, "response", "error", "tries"), version


def unanswered(spark, store: Store, version: int) -> DataFrame:
    """error, n: requests of a version by why they have no response."""
    return read(spark, store, version).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))

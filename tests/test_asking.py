"""Bounded calls, and answers that are asked for once."""

import threading
import time

import pytest
from marginalia.operators import asking as K
from marginalia.sources.stores import create, read
from pyspark.sql import functions as F


def test_calls_are_bounded_tried_again_and_given_up():
    held, most, lock, tried = [0], [0], threading.Lock(), {}

    def answer(r):
        with lock:
            held[0] += 1
            most[0] = max(most[0], held[0])
            n = tried[r["i"]] = tried.get(r["i"], 0) + 1
        try:
            time.sleep(0.02)
            if r["i"] == 1:
                raise ValueError
            if r["i"] == 2 and n == 1:
                raise OSError
            if r["i"] == 3:
                raise K.Refused("too long")
            if r["i"] == 5:
                return None
        finally:
            with lock:
                held[0] -= 1
        if r["i"] == 4 and n < 3:
            time.sleep(3)
        return f"a{r['i']}"

    began = time.monotonic()
    got = K.call_all([{"i": i} for i in range(30)], answer, K.Calls(at_once=4, timeout=0.3, tries=3, wait=0.01))
    assert time.monotonic() - began < 2.5
    assert got[1] == (None, "ValueError", 3) and got[2] == ("a2", None, 2) and got[3] == (None, "too long", 1)
    assert got[4] == ("a4", None, 3) and got[5] == (None, "NO_TEXT", 3)
    assert all(got[i] == (f"a{i}", None, 1) for i in (0, *range(6, 30)))
    assert most[0] <= 4
    assert K.call_all([], answer, K.Calls()) == []
    assert K.call_all([{"i": 4}], lambda r: time.sleep(1), K.Calls(timeout=0.05, tries=2, wait=0.01)) == [(None, "TIMEOUT", 2)]


@pytest.mark.parametrize("sizes", [{}, {"wave_rows": 7, "task_rows": 2, "hot_rows": 10}])
def test_each_request_is_asked_until_it_is_answered(spark, tmp_path, sizes):
    log = tmp_path / "log"
    log.mkdir()
    broken = tmp_path / "broken"
    broken.touch()

    def answer(r):
        (log / f"{time.time_ns()}-{r['q']}-{threading.get_ident()}").touch()
        if r["q"] == "q3":
            raise K.Refused("FILTERED")
        if r["q"] in ("q1", "q2") and broken.exists():
            raise OSError
        return f"{r['q']} in {r['c']}"

    def asked():
        found = sorted(f.name.split("-")[1] for f in log.iterdir())
        for f in log.iterdir():
            f.unlink()
        return found

    rows = [(i, f"q{i % 12}" if i < 60 else "q0", "c" if i % 2 else None) for i in range(100)] + [(100, None, None), (101, None, None)]
    prompts = spark.createDataFrame(rows, "id long, q string, c string")
    store = K.answer_store(f"file://{tmp_path}/answers", buckets=4)
    create(store, spark.createDataFrame([], store.schema))
    calls = K.Calls(tries=2, wait=0.001, timeout=10, **sizes)
    out, v = K.with_stored_answers(prompts, ["q", "c"], answer, store, 0, calls)
    got = {r.id: r for r in out.collect()}
    assert sorted(got) == list(range(102)) and out.columns == ["id", "q", "c", "response", "error", "tries"]
    for i, q, c in rows:
        want = "NO_PROMPT" if q is None else {"q1": "OSError", "q2": "OSError", "q3": "FILTERED"}.get(q)
        assert (got[i].error, got[i].response) == (want, None if want else f"{q} in {c}")
    pairs = {(q, c) for _, q, c in rows if q}
    assert asked() == sorted(q for q, _ in pairs for _ in range(2 if q in ("q1", "q2") else 1))
    assert {r.error: r.n for r in K.unanswered(spark, store, v).collect()} == {"OSError": 2, "FILTERED": 1}

    broken.unlink()
    out, v = K.with_stored_answers(prompts, ["q", "c"], answer, store, v, calls)
    assert asked() == ["q1", "q2", "q3"] and out.where("error is null").count() == sum(q not in (None, "q3") for _, q, _ in rows)
    fine = prompts.where("q <> 'q3'")
    out, again = K.with_stored_answers(fine, ["q", "c"], answer, store, v, calls)
    assert again == v and asked() == [] and out.where("response is null").count() == 0
    assert read(spark, store, v).count() == len(pairs)
    none, again = K.with_stored_answers(prompts.where("false"), ["q", "c"], answer, store, v, calls)
    assert again == v and none.count() == 0


def test_requests_differ_by_null_and_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("", "a")], "x string, y string")
    assert rows.select(F.count_distinct(K.request_id("x", "y")).alias("n")).first().n == 4

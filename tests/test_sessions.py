"""The streamed fold of session actions against a plain one over the whole log."""

import random

import pytest
from marginalia.streaming import sessions as Q
from marginalia.streaming import streams as S
from pyspark.sql import functions as F

LOG = "seq long, s long, session_id long, action string, doc_id string"
IDLE = 100


def fold(rows):
    """(live sessions at the end, refused actions) of a log."""
    live, refused, end = {}, set(), max(r[1] for r in rows)
    for seq, s, session, action, doc in sorted(rows, key=lambda r: (r[1], r[0])):
        if session in live and s - live[session]["last"] > IDLE:
            del live[session]
        own = live.get(session)
        if action == "create":
            live[session] = {"last": s, "n": 0, "docs": [doc] if doc else [], "seq": seq}
            continue
        if own is None:
            refused.add((seq, f"session not found: {session}"))
            continue
        if action == "attach" and doc in own["docs"]:
            refused.add((seq, f"document already exists in session: {doc}"))
            continue
        if action == "detach" and doc not in own["docs"]:
            refused.add((seq, f"document not found in session: {doc}"))
            continue
        if action == "delete":
            del live[session]
            continue
        if action == "message":
            own["n"] += 1
        elif action == "clear":
            own["n"] = 0
        elif action == "attach":
            own["docs"].append(doc)
        elif action == "detach":
            own["docs"].remove(doc)
        own["last"], own["seq"] = s, seq
    return {(k, v["seq"], v["n"], tuple(v["docs"]), v["last"]) for k, v in live.items() if end - v["last"] <= IDLE}, refused


def log(seed, n=240):
    rng, out, s = random.Random(seed), [], 1000
    for seq in range(n):
        s += rng.choice([1, 1, 2, 5, 60])
        action = rng.choices(["create", "message", "clear", "attach", "detach", "delete"], [2, 4, 1, 5, 4, 1])[0]
        doc = rng.choice("abc") if action in ("attach", "detach") or action == "create" and rng.random() < 0.7 else None
        out.append((seq, s, rng.randint(1, 4), action, doc))
    return out


def streamed(spark, folder, batches):
    """Runs once for each batch of files, as if started anew each time."""
    seen = None
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(LOG).parquet(f"{folder}/in").withColumn("ts", F.timestamp_seconds("s"))
        with Q.rocksdb(spark):
            seen = S.drained(Q.stream_session_state(stream, idle_seconds=IDLE), "update", f"file://{folder}/out", f"file://{folder}/progress")
    return seen


@pytest.mark.parametrize("cuts", [[], [100], [60, 61, 200]])
def test_any_split_in_batches(spark, tmp_path, cuts):
    rows = log(4)
    bounds = [0, *cuts, len(rows)]
    seen = streamed(spark, tmp_path, [rows[a:b] for a, b in zip(bounds, bounds[1:])])
    want, refused = fold(rows)
    end = spark.range(1).select(F.timestamp_seconds(F.lit(rows[-1][1])).alias("end"))
    live = Q.live_sessions(seen, end, IDLE).selectExpr("session_id", "seq", "n_messages", "documents", "unix_seconds(last_activity) s").collect()
    assert {(r.session_id, r.seq, r.n_messages, tuple(r.documents), r.s) for r in live} == want
    got = [(r.seq, r.reason) for r in seen.where("kind = 'refused'").collect()]
    assert set(got) == refused and len(got) == len(refused)
    assert {x.split(":")[0] for _, x in refused} == {"session not found", "document already exists in session", "document not found in session"}


def test_timers_end_idle_sessions(spark, tmp_path):
    seen = streamed(spark, tmp_path, [[(0, 1000, 1, "create", "a"), (1, 1050, 2, "create", None)], [(2, 1140, 2, "message", None)], [(3, 1150, 1, "message", None)]])
    rows = {(r.kind, r.session_id, r.seq, r.reason) for r in seen.collect()}
    assert ("expired", 1, None, None) in rows and ("refused", 1, 3, "session not found: 1") in rows
    assert not any(k == "expired" and i == 2 for k, i, *_ in rows)

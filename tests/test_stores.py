"""Stores in buckets: merges by version, and the streams that write them."""

import random

import pytest
from marginalia.operators import tables as B
from marginalia.sources import stores
from marginalia.sources.stores import Store, create, manifest, merge, read
from marginalia.streaming import streams as S
from pyspark.sql import functions as F

SESSIONS = "session_id long, user_id long, title string, created_at timestamp, last_activity timestamp"


def sessions(spark, ids, title="old", user=1, seq=None):
    rows = spark.createDataFrame([(i,) for i in ids], "session_id long").select("session_id", F.lit(user).cast("long").alias("user_id"), F.lit(title).alias("title"), F.timestamp_seconds(F.lit(0)).alias("created_at"), F.timestamp_seconds(F.col("session_id")).alias("last_activity"))
    return rows if seq is None else rows.withColumn("seq", F.lit(seq))


def files(spark, store, version):
    return {f.split("/data/")[1] for f in read(spark, store, version).inputFiles()}


@pytest.mark.parametrize("most", [stores.BROADCAST_ROWS, 0])
def test_upsert_writes_the_touched_buckets_only(spark, tmp_path, monkeypatch, most):
    store = Store(f"file://{tmp_path}/t", SESSIONS, ["session_id"], buckets=8)
    create(store, sessions(spark, range(400)))
    before, plans = files(spark, store, 0), []
    write = stores._write
    monkeypatch.setattr(stores, "_write", lambda s, v, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(s, v, rows)))
    batch = sessions(spark, [3, 5, 1000], "new", 2).withColumn("seq", F.lit(1)).unionByName(sessions(spark, [3], "newest", 3, 2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what was counted is broadcast
    where = merge(spark, store, 0, B.latest(batch, store.keys, "seq"), {"title": B.newer, "last_activity": B.newer}, most)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("hashpartitioning" in plans[0]) == (most == 0)
    after = files(spark, store, 1)
    assert 1 <= len(where) <= 3 and {b for b, v in manifest(spark, store, 1).items() if v == 1} == where
    assert {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in where} == {f for f in after if f.startswith("0/")}
    got = {r.session_id: (r.title, r.user_id) for r in read(spark, store, 1).collect()}
    assert len(got) == 401 and (got[3], got[5], got[1000], got[4]) == (("newest", 1), ("new", 1), ("new", 2), ("old", 1))
    assert {r.title for r in read(spark, store, 0).collect()} == {"old"}


def test_insert_ignore_leaves_buckets_without_a_new_row(spark, tmp_path):
    store = Store(f"file://{tmp_path}/t", "doc_id long, name string", ["doc_id"], buckets=8)
    create(store, spark.createDataFrame([], store.schema))
    assert read(spark, store, 0).count() == 0
    rows = [(1, "a", 2), (1, "b", 1), (2, "c", 1), (None, "n", 1), (None, "m", None)]
    batch = spark.createDataFrame(rows, "doc_id int, name string, at int")
    assert len(B.insert_ignore(spark, store, 0, batch, "at")) >= 2
    got = sorted((str(r.doc_id), r.name) for r in read(spark, store, 1).collect())
    assert got == [("1", "b"), ("2", "c"), ("None", "m")]
    assert B.insert_ignore(spark, store, 1, batch.where("doc_id = 1"), "at") == set()
    assert manifest(spark, store, 2) == manifest(spark, store, 1)
    assert B.insert_ignore(spark, store, 2, batch.where("doc_id = 7"), "at") == set()


def test_late_messages_are_merged_once(spark, tmp_path, monkeypatch):
    """Many batches: each id is there once, a repeated batch changes nothing, and what a batch reads doesn't grow with their number."""
    store = Store(f"file://{tmp_path}/m", "id string, created_at timestamp", ["id"], buckets=4)
    create(store, spark.createDataFrame([], store.schema))
    monkeypatch.setattr(stores, "MOST_FILES", 2)
    sink, rng, seen, held = S.merge_messages(store), random.Random(2), {}, []
    for n in range(8):
        rows = [(f"m{rng.randint(0, 30)}", rng.randint(0, 999)) for _ in range(20)]
        batch = spark.createDataFrame(rows, "id string, s int").select("id", F.timestamp_seconds("s").alias("created_at")).coalesce(1)
        sink(batch, n)
        first = files(spark, store, n + 1)
        for i, at in sorted(rows, key=lambda x: x[1]):
            seen.setdefault(i, at)
        for again in range(2 - n % 2):
            assert {r.id: int(r.created_at.timestamp()) for r in read(spark, store, n + 1).select("id", "created_at").collect()} == {i: at for i, at in seen.items()}
            if not again and not n % 2:
                sink(batch, n)
        held.append(len(first))
    assert max(held) <= (2 + 1) * 4 and held[-1] <= max(held[:4])  # those kept and a new one of each bucket


def test_last_activity_writes_changed_keys(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = [[(1, 10), (2, 20), (1, 15)], [(1, 30)], [(2, 5), (3, 7)]]
    got = []
    for batch in rows:
        spark.createDataFrame(batch, "session_id long, s int").select("session_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id long, ts timestamp").parquet(source)
        changes = S.drained(S.stream_last_activity(stream), "update", f"file://{tmp_path}/out", f"file://{tmp_path}/progress")
        got.append(changes.count())
    assert got == [2, 3, 5]  # 2 is named again: its group had a row, though an older one
    assert {(r.session_id, int(r.s)) for r in S.latest_versions(changes).selectExpr("session_id", "unix_seconds(last_activity) s").collect()} == {(1, 30), (2, 20), (3, 7)}

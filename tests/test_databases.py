"""Conflict rules and partitions that are applied once, in an embedded database."""

import os
import sqlite3
import subprocess
import sys
import textwrap
from functools import partial

import pytest
from marginalia.sources import databases as D
from marginalia.streaming import streams as S
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SESSIONS = D.Target("sessions", ["session_id", "title", "seen"], ["session_id"], {"title": "excluded.title", "seen": "max(sessions.seen, excluded.seen)", "writes": "sessions.writes + 1"})


def connect(path):
    return sqlite3.connect(path, timeout=30)


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "t.db")
    con = connect(path)
    con.execute("CREATE TABLE sessions (session_id BIGINT PRIMARY KEY, title TEXT, seen BIGINT, writes INT DEFAULT 1)")
    con.execute("CREATE TABLE documents (doc_id BIGINT PRIMARY KEY, name TEXT NOT NULL)")
    D.create_applied(con)
    D.create_applied(con)
    con.close()
    return path


def rows(path, sql):
    con = connect(path)
    try:
        return con.execute(sql).fetchall()
    finally:
        con.close()


def batch(spark, ids, title, seen):
    return spark.createDataFrame([(i, title, seen) for i in ids], "session_id long, title string, seen long")


def test_conflict_rules(spark, db):
    new = partial(connect, db)
    D.write_batch(batch(spark, range(50), "a", 5), new, SESSIONS, "q", 0, parts=3, size=7)
    D.write_batch(batch(spark, range(40, 60), None, 3), new, SESSIONS, "q", 1, parts=3)
    got = {i: (t, s, w) for i, t, s, w in rows(db, "SELECT * FROM sessions")}
    assert len(got) == 60 and got[0] == ("a", 5, 1) and got[45] == (None, 5, 2) and got[55] == (None, 3, 1)
    D.write_batch(batch(spark, range(50), "z", 9), new, SESSIONS, "q", 0, parts=3)  # a batch that was there
    assert {i: (t, s, w) for i, t, s, w in rows(db, "SELECT * FROM sessions")} == got
    D.write_batch(batch(spark, [], "z", 9), new, SESSIONS, "q", 2, parts=3)
    D.write_batch(batch(spark, [0], "other", 1), new, SESSIONS, "another query", 0, parts=3)
    assert rows(db, "SELECT title, seen, writes FROM sessions WHERE session_id = 0") == [("other", 5, 2)]
    keep = D.Target("documents", ["doc_id", "name"], ["doc_id"])
    for n, name in enumerate("xy"):
        D.write_batch(spark.range(10 * (n + 1)).select(F.col("id").alias("doc_id"), F.lit(name).alias("name"), F.lit(1).alias("extra")), new, keep, "docs", n, parts=2)
    assert rows(db, "SELECT name, count(*) FROM documents GROUP BY 1 ORDER BY 1") == [("x", 10), ("y", 10)]


def test_a_failed_part_leaves_nothing(db):
    def broken():
        yield from [(i, "a", 1) for i in range(10)]
        raise OSError("lost")

    con = connect(db)
    with pytest.raises(OSError):
        D.apply_part(con, SESSIONS, broken(), "q", 0, 0, size=3)
    assert rows(db, "SELECT * FROM sessions") == rows(db, f"SELECT * FROM {D.APPLIED}") == []
    assert D.apply_part(con, SESSIONS, [(1, "a", 1)], "q", 0, 0)
    assert not D.apply_part(con, SESSIONS, [(2, "b", 1)], "q", 0, 0)
    con.close()
    assert rows(db, "SELECT session_id, writes FROM sessions") == [(1, 1)]


RETRY = """
    import os, sqlite3
    from marginalia.sources import databases as D
    from pyspark.sql import SparkSession
    from tests.test_databases import SESSIONS

    path = {path!r}

    class Failing(sqlite3.Connection):
        def cursor(self):
            return super().cursor(FailingCursor)

    class FailingCursor(sqlite3.Cursor):
        def executemany(self, statement, rows):
            super().executemany(statement, rows)
            if any(r[0] == 13 for r in rows) and not os.path.exists(path + ".failed"):
                open(path + ".failed", "w").close()
                raise OSError("lost halfway")

    def connect():
        return sqlite3.connect(path, timeout=30, factory=Failing)

    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
    rows = spark.createDataFrame([(i, "a", i) for i in range(40)], SESSIONS_DDL)
    D.write_batch(rows, connect, SESSIONS, "q", 0, parts=4, size=2)
"""


def test_a_task_that_is_tried_again(db):
    """A task fails after some of its calls, Spark runs it again, and each row is written once."""
    code = textwrap.dedent(RETRY.format(path=db)).replace("SESSIONS_DDL", "'session_id long, title string, seen long'")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT})
    assert done.returncode == 0, done.stderr[-2000:]
    assert rows(db, "SELECT count(*), max(writes), sum(seen) FROM sessions") == [(40, 1, 780)]
    assert rows(db, f"SELECT count(*) FROM {D.APPLIED}") == [(4,)]
    with open(db + ".failed"):
        pass


def test_stream_into_a_database(spark, db, tmp_path):
    folder, progress = str(tmp_path / "in"), f"file://{tmp_path}/progress"
    sink = D.database_sink(partial(connect, db), SESSIONS, "stream", parts=2)
    for n in range(2):
        batch(spark, range(5 * n, 10 + 5 * n), f"t{n}", n).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):
            S.run_all(spark.readStream.schema("session_id long, title string, seen long").parquet(folder), sink, progress=progress)
    assert rows(db, "SELECT title, writes, count(*) FROM sessions GROUP BY 1, 2 ORDER BY 1, 2") == [("t0", 1, 5), ("t1", 1, 5), ("t1", 2, 5)]

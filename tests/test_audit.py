"""The table rules, each by itself in plain Python, against the one pass."""

import random
from collections import Counter

from marginalia.operators.audit import RULES, constraint_audit
from pyspark.sql import Observation

SCHEMAS = {
    "users": "id long, email string", "sessions": "session_id long, user_id int",
    "documents": "doc_id string, session_id long, filename string", "messages": "id string, role string, content string",
}


def tables(seed=5, n=300):
    rng = random.Random(seed)

    def some(*values):
        return rng.choice([None, *values])

    return {
        "users": [(some(*range(200)), some(*(f"u{i}@x.org" for i in range(250)))) for _ in range(n)],
        "sessions": [(some(*range(250)), rng.choice([None, 7, *range(300)])) for _ in range(n)],
        "documents": [(some(*map(str, range(400))), rng.choice([None, -1, -1, -1, *range(300)]), some("a.pdf", "b.pdf")) for _ in range(n)],
        "messages": [(some(*map(str, range(400))), some("user", "assistant", "system"), some("x", "")) for _ in range(n)],
    }


def text(v):
    return None if v is None else str(v)


def plain(data):
    """(rule, key) -> rows, rule by rule."""
    def column(table, i):
        return [r[i] for r in data[table]]

    out = Counter()
    alone = (("users.email null", "users", lambda r: r[1] is None), ("documents.filename null", "documents", lambda r: r[2] is None),
             ("messages.role unknown", "messages", lambda r: r[1] not in (None, "user", "assistant")), ("messages.content null", "messages", lambda r: r[2] is None))
    for rule, table, bad in alone:
        out.update((rule, text(r[0])) for r in data[table] if bad(r))
    unique = (("users.id", "users", 0), ("users.email", "users", 1), ("sessions.session_id", "sessions", 0), ("documents.doc_id", "documents", 0), ("messages.id", "messages", 0))
    for name, table, i in unique:
        out.update({(f"{name} repeated", text(k)): c for k, c in Counter(column(table, i)).items() if c > 1})
    refers = (("sessions.user_id", column("sessions", 1), column("users", 0)), ("documents.session_id", column("documents", 1), column("sessions", 0)))
    for name, keys, owners in refers:
        out.update((f"{name} orphan", text(k)) for k in keys if k is None or k not in owners)
    return dict(out)


def frames(spark, data):
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}


def test_against_each_rule(spark):
    data = tables()
    got = constraint_audit(frames(spark, data)).collect()
    assert {(r.rule, r.key): r.n for r in got} == plain(data)
    assert len(got) == len(plain(data))


def test_empty_tables(spark):
    data = {k: [] for k in SCHEMAS}
    assert constraint_audit(frames(spark, data)).collect() == []
    data["sessions"] = [(1, 5), (2, 5)]
    assert [tuple(r) for r in constraint_audit(frames(spark, data)).collect()] == [("sessions.user_id orphan", "5", 2)]


def test_clashing_columns(spark):
    data = tables()
    own = {k: df.selectExpr("*", "1 as rule", "2 as key", "3 as owns", "4 as n") for k, df in frames(spark, data).items()}
    assert {(r.rule, r.key): r.n for r in constraint_audit(own).collect()} == plain(data)


def test_each_table_is_read_once_and_shuffled_once(spark, tmp_path):
    for name, df in frames(spark, tables()).items():
        df.write.parquet(str(tmp_path / name))
    plan = constraint_audit({k: spark.read.parquet(str(tmp_path / k)) for k in SCHEMAS})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Python" not in plan


def test_observed_in_the_same_pass(spark):
    data = tables()
    seen = {k: Observation(k) for k in SCHEMAS}
    want = plain(data)
    constraint_audit(frames(spark, data), observations=seen).collect()
    for name, observation in seen.items():
        got = observation.get
        assert got["rows"] == len(data[name])
        for rule in RULES:
            if rule.table == name and rule.broken:
                assert got[rule.name] == sum(n for (r, _), n in want.items() if r == rule.name)

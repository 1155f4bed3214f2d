"""Histories as shared blocks against lists made in plain Python."""

import random

import pytest
from marginalia.operators import histories as H
from marginalia.operators import prompts as P

SCHEMA = "id string, session_id string, msg_seq long, role string, content string, extra int"


def talk(seed=3):
    """Sessions of many lengths, with gaps, ties, nulls and a session without an id."""
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 200), ("b", 1), ("c", 33), (None, 70), ("d", 32), ("e", 65)):
        seq = 0
        for i in range(n):
            seq += rng.choice([0, 1, 1, 5, 40])
            content = rng.choice([f"text {i}", "", None, "same"])
            rows.append((f"{s}-{i:04d}", s, seq, rng.choice(["user", "user", "assistant", "system", None]), content, i))
    rng.shuffle(rows)
    return rows


def plain(rows, last):
    out = {}
    for session in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == session and r[3] in ("user", "assistant")), key=lambda r: (r[2], r[0]))
        lines = [None if r[4] is None else ("User: " if r[3] == "user" else "Assistant: ") + r[4] for r in own]
        for i, r in enumerate(own):
            if r[3] == "user":
                out[r[0]] = (r[1], r[2], r[4], [x for x in (lines[:i] if last is None else lines[max(0, i - last) : i]) if x is not None])
    return out


@pytest.mark.parametrize("last", [None, 1, 4, 40])
@pytest.mark.parametrize("size, span", [(32, 1024), (3, 7), (1, 1)])
def test_expansion_is_the_history(spark, last, size, span):
    rows = talk()
    questions, blocks = H.history_blocks(spark.createDataFrame(rows, SCHEMA), size, span)
    got = H.with_history(questions, blocks, last, size).collect()
    assert {r.id: (r.session_id, r.msg_seq, r.content, r.history) for r in got} == plain(rows, last)
    assert len(got) == len(plain(rows, last))


def test_rows_are_linear_in_messages(spark):
    rows = [(str(i), "s", i, "user", f"m{i}", 0) for i in range(1000)]
    questions, blocks = H.history_blocks(spark.createDataFrame(rows, SCHEMA), 32)
    held = blocks.collect()
    assert sorted(len(b.lines) for b in held) == [8] + [32] * 31
    assert sum(len(b.lines) for b in held) == questions.count() == 1000
    assert "lines" not in questions.columns


def test_the_last_lines_need_two_blocks_at_most(spark):
    rows = [(str(i), "s", i, "user", f"m{i}", 0) for i in range(100)]
    questions, blocks = H.history_blocks(spark.createDataFrame(rows, SCHEMA), 4)
    kept = blocks.where("block in (9, 10)")  # lines 36 to 43
    got = H.with_history(questions.where("n_lines = 42"), kept, 4, 4).collect()
    assert got[0].history == [f"User: m{i}" for i in (38, 39, 40, 41)]


def test_empty_and_strange_columns(spark):
    assert P.history_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame(talk(), SCHEMA).withColumnRenamed("extra", "_block").withColumn("lines", P.F.lit(1))
    assert P.history_lines(rows, 4).count() == len(plain(talk(), 4))


def test_extra_columns_of_questions_stay(spark):
    questions, blocks = H.history_blocks(spark.createDataFrame(talk(), SCHEMA))
    more = questions.withColumn("a.b", P.F.col("n_lines") * 2)
    assert all(r["a.b"] == 2 * r.n_lines for r in H.with_history(more, blocks).collect())

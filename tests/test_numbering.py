"""Numbers within groups against sorting in plain Python."""

import random

import pytest
from marginalia.functions.numbering import numbered


@pytest.mark.parametrize("span", [1, 10, 1024])
def test_against_sorting(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-50, 500)]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, o int, i int")
    got = {r.i: r.n for r in numbered(df, "g", "o", "i", span, "n").collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own)}
    assert got == want


def test_empty_and_a_single_group_over_many_tasks(spark):
    assert numbered(spark.createDataFrame([], "g string, o int"), "g", "o").collect() == []
    got = numbered(spark.range(20_000).selectExpr("'g' as g", "id as o"), "g", "o", span=100)
    assert got.where("pos <> o").count() == 0 and got.count() == 20_000

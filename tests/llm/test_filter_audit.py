import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from marginalia.llm import filter_audit as A

from tests.llm.conftest import SF

DOCS, LABELS = "doc_id long, text string, source string, cell int, n string", "doc_id long, quality int, toxic int"


def by_hand(docs, labels):
    """The definition, document by document."""
    good, toxic = defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = {}
    for part in {d[2] or "" for d in docs}:
        rows = []
        for i, text, source, *_ in docs:
            if (source or "") == part:
                t = text or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                fails = {
                    "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                    "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
                }
                rows.append((fails, i in good and good[i], i in toxic and toxic[i]))
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                total[f] += len(gone)
                failing = [r for r in rows if r[0][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[0].values()) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, o, k), row in out.items():
            if p == part:
                row.append(total[o[k - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in df.collect()}


def test_small_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, None, "a", 1, "x"), (2, "", "b", 1, None), (3, long, None, 1, "x"), (4, long, "", 1, "x"), (4, long, "a", 1, "x"), (None, long, "a", 1, "x"), (None, long, "a", 1, "x"),
        (5, "the " * 70, "a", 0, "x"), (6, "the " * 70 + "|", "a", 0, "x"), (7, long.upper(), "b", 0, "x"), (8, long + " #", "b", 0, "x"), (9, long + " é🙂", "b", 0, "x"),
        (10, "\x0b\x1c a", "b", 0, "x"), (5, "AB " * 20_000 + long, "c", 0, "x"), (-3, long, "c", 0, "x"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (4, 1, 1), (4, 0, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (-3, 1, 0)]
    df = A.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert df.columns == [c.split()[0] for c in A.RESULT.split(", ")]
    assert found(df) == by_hand(docs, labels)
    assert df.count() == 4 * 600


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "x", "a", 1, "")], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert A.audit(none, labels).count() == 0
    assert found(A.audit(some, labels)) == by_hand([(1, "x", "a")], [])


@pytest.mark.parametrize("seed", range(3))
def test_contraction_against_counting(seed):
    """Random tables of cells: each step by walking the cells."""
    counts = np.random.default_rng(seed).integers(0, 50, (3, 2, 2, 2, 2, 2))
    plan = A.steps()
    out = A.audit_part(counts, plan)
    for i, (order, step) in enumerate(zip(plan[0], plan[1])):
        own, earlier = "ABCDE".index(order[step - 1]), ["ABCDE".index(x) for x in order[: step - 1]]
        removed = [sum(counts[(m, *c)] for c in np.ndindex(2, 2, 2, 2, 2) if c[own] and not any(c[j] for j in earlier)) for m in range(3)]
        assert [out["removed"][i], out["good_lost"][i], out["toxic_lost"][i]] == removed
        assert out["kept"][i] == sum(counts[(0, *c)] for c in np.ndindex(2, 2, 2, 2, 2) if not c[own] and not any(c[j] for j in earlier))
    shares = dict(zip((o[k - 1] for o, k in zip(plan[0], plan[1])), out["shapley"]))
    assert sum(shares.values()) == 120 * (counts[0].sum() - counts[0, 0, 0, 0, 0, 0])  # every order removes all that fail anything


def test_whole_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert found(A.op11_filter_audit(spark, SF)) == by_hand(docs, labels)

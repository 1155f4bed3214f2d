import random
from collections import defaultdict

import pyarrow as pa
import pytest
from marginalia.llm import suffix_dedup as S

from tests.llm.conftest import SF


def split(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)})
    return [w for w in text.split(" ") if w]


def brute(rows, passage):
    """Words within windows that occur twice or more, and within those that have occurred before, by (doc, place)."""
    seen = defaultdict(list)
    words = {i: split(t) for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - passage + 1):
            seen[tuple(words[i][k : k + passage])].append((i, k))
    every, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for n, (i, k) in enumerate(sorted(places)):
                every[i].update(range(k, k + passage))
                if n:
                    later[i].update(range(k, k + passage))
    return {i: (len(w), every[i], later[i]) for i, w in words.items()}


def covered(spans):
    return {k for s, e in zip(spans[::2], spans[1::2]) for k in range(s, e)}


def got(df):
    return {r.doc_id: (r.n_words, covered(r.repeated), covered(r.removed)) for r in df.collect()}


def corpus(rng, passages, docs, size):
    kept = [[f"p{k}w{i}" for i in range(rng.randint(size - 6, 3 * size))] for k in range(passages)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [f"v{rng.randrange(50_000)}" for _ in range(rng.randint(0, 40))]
            own = rng.choice(kept)
            start = rng.randint(0, 6)
            words += own[start : len(own) - rng.randint(0, 6)]
        rows.append((i, " ".join(words)))
    return rows


def batches_of(rows, names, size):
    table = pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
    return iter(table.to_batches(max_chunksize=size))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_runs_across_batches(size):
    rng = random.Random(size)
    for case in range(60):
        # sorted rows of few keys, copies included
        rows = sorted((rng.randrange(rng.choice([1, 3, 9])), rng.randrange(3), rng.randrange(3), rng.randrange(4)) for _ in range(rng.randint(0, 25)))
        runs = defaultdict(list)
        for r in rows:
            if not runs[r[0]] or runs[r[0]][-1][1:3] != r[1:3]:  # of equal text and place only the first
                runs[r[0]].append(r)
        order = sorted(runs)
        want = sorted((r[3], r[2]) for k in order for r in runs[k] if len(runs[k]) > 1 or k in (order[0], order[-1]))
        found = [b for b in S._kept_suffixes(batches_of(rows, ("key", "t1", "place", "doc"), size))]
        assert sorted((d, p) for b in found for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) == want, rows

        rows = sorted((k, d, p) for k, d, p, _ in rows)
        runs = {k: sorted({r for r in rows if r[0] == k}) for k in {r[0] for r in rows}}
        order = sorted(runs)
        want = []
        for k in order:
            edge = k in (order[0], order[-1])
            if len(runs[k]) > 1 or edge:
                want.append((*runs[k][0][1:], False, k if edge else None, len(runs[k]) if edge else 0))
                want += [(*r[1:], True, None, 0) for r in runs[k][1:]]
        got_ = [tuple(x) for b in S._repeats(batches_of(rows, ("key", "doc", "place"), size)) for x in zip(*(c.to_pylist() for c in b.columns))]
        got_ = [(d, p, c, e, n if e is not None else 0) for d, p, c, e, n in got_]
        assert sorted(got_, key=str) == sorted(want, key=str), rows


def test_against_all_windows(spark):
    rng = random.Random(2)
    rows = corpus(rng, 8, 60, 50)
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:5])] + [(300, "same word " * 80), (301, "same word " * 20), (302, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(S.repeated_passages(df)) == brute(rows, 50)


def test_short_passages(spark):
    rng = random.Random(4)
    rows = corpus(rng, 6, 50, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.repeated_passages(df, passage=8, prefix=3)) == brute(rows, 8)


def test_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows, 50)
    for r in S.op8_suffix_dedup(spark, SF).collect():
        spans = [[int(x) for x in s.split(",") if x] for s in (r.repeated, r.removed)]
        assert (r.n_words, covered(spans[0]), covered(spans[1])) == want[r.doc_id]
        assert (r.n_repeated, r.n_removed) == (len(want[r.doc_id][1]), len(want[r.doc_id][2]))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.repeated_passages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    # the long text repeats itself from its second period on
    assert [(r.n_words, r.repeated, r.removed) for r in rows if r.doc_id == 4] == [(30000, [0, 30000], [10, 30000])]
    assert all(not r.repeated and not r.removed for r in rows if r.doc_id != 4)
    assert S.repeated_passages(no_docs).count() == 0


def test_one_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, one), (1, two), (2, two + " end"), (1, one)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_words, r.repeated, r.removed) for r in S.repeated_passages(df).collect())
    assert rows == [(1, 60, [0, 60], []), (1, 60, [0, 60], []), (1, 60, [0, 60], []), (2, 61, [0, 60], [0, 60])]

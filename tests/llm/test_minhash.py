import random

import numpy as np
import pytest
from marginalia.llm import components
from marginalia.llm import minhash as M
from marginalia.llm.common import without

from tests.llm.conftest import SF


def brute(rows, n):
    """rows: (doc_id, text). All pairs on sets of strings."""
    sets = {}
    for i, text in rows:
        w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus():
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.randint(3, 260))]
        chain = base
        for _ in range(rng.randint(1, 14)):
            rows.append(" ".join(chain))
            chain = edited(rng, chain if rng.random() < 0.7 else base, rng.randint(0, 5))
    rows += ["", " \n", "one", "one", "one two", "A b C", "a B c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (4, 5):
        assert got(M.near_duplicates(df, n)) == brute(rows, n)


def test_clusters_beyond_a_cell(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df, 4, block_docs=2)) == brute(rows, 4)


def chain(links=700):
    """Each text shares three quarters of its words with the next, and a few are near copies of another."""
    rng = random.Random(11)
    parts = [[f"c{i}x{k}" for k in range(9)] for i in range(links + 3)]
    rows = [" ".join(parts[i] + parts[i + 1] + parts[i + 2] + parts[i + 3]) for i in range(links)]
    rows += [" ".join(edited(rng, rows[i].split(), 0) + ["more"]) for i in range(0, links, 9)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_chains_are_verified_bucket_by_bucket(spark, monkeypatch):
    rows, seen = chain(), {}
    members = M.bucket_members

    def counted(dealt, settled):
        out = members(dealt, settled)
        seen["settled"], seen["sizes"] = settled.count(), [r["count"] for r in out.groupBy("cluster").count().collect()]
        return out

    monkeypatch.setattr(M, "bucket_members", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df, 2, cell_docs=20)) == brute(rows, 2)
    # one cluster of hundreds, yet what meets in a cell is what shares a bucket
    assert seen["settled"] > 300 and max(seen["sizes"]) < 30
    assert sum(x * x for x in seen["sizes"]) < seen["settled"] ** 2 / 8


@pytest.mark.parametrize("block", [2, 7])
def test_large_buckets_of_unlike_texts(spark, block):
    # many texts that share most of their words, of similarities to either side of the bound
    rng = random.Random(21)
    rows = []
    for _ in range(4):
        base = [f"v{rng.randrange(9000)}" for _ in range(60)]
        rows += [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.near_duplicates(df, 3, block_docs=block, cell_docs=6)) == brute(rows, 3)


def test_both_sides_shuffled(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert got(M.near_duplicates(df, 4, cell_docs=4)) == want
    lost = spark.createDataFrame([(i,) for i, x in want.items() if not x[2]] + [(10**6,)], "lost_id long")
    for most in (10**6, 0):
        assert {r.doc_id for r in without(df, lost, most=most).collect()} == {i for i, x in want.items() if x[2]}


@pytest.mark.parametrize("few", [10**6, 0])
def test_components_with_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(components, "HUB", 1 / 20)
    monkeypatch.setattr(components, "HUB_EDGES", few)
    rng = random.Random(13)
    edges = [(0, i) for i in range(1, 4000)] + [(9000 + i, 9001 + i) for i in range(60)] + [(rng.randrange(4000, 9000), 4000) for _ in range(3000)] + [(7, 4001), (5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {i: find(i) for i in root}


def test_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(M.op10_minhash(spark, SF)) == brute(rows, 4)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64))))
    s = M.signatures([a, b], 512)
    assert abs((s[0] == s[1]).mean() - 3000 / 5000) < 0.08


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(odd_docs, 4).collect())
    assert rows == [
        (0, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (4, 10, 4, True), (5, 0, 5, True),
        (6, 1, 6, True), (7, 2, 7, True),
    ]
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = "a b c d e f g h", "r s t u v w x y"
    df = spark.createDataFrame([(1, a), (9, a), (9, b), (4, b), (5, "else where")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df, 4).collect()} == {1: 1, 9: 1, 4: 1, 5: 5}


def test_wordless_rows_of_an_id_in_a_large_cluster(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(12)] + [(i, t) for i in (0, 3, 11) for t in ("", " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got_ = M.near_duplicates(df, 4, cell_docs=2).where("n_shingles > 0").collect()
    assert {(r.doc_id, r.component_id) for r in got_} == {(i, 0) for i in range(12)}

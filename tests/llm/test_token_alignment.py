import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from marginalia.llm import token_alignment as T

from tests.llm.conftest import SF

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, codes string, row int"


@pytest.fixture(scope="module")
def own():
    return T.load(*T.paths(None, None))


def tokens(own, text):
    """(ids of A, ids of B, their bytes) of a whole text by the libraries; nothing where bytes are lost."""
    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    spelled = [[own.sides[k][1][i] for i in ids] for k, ids in enumerate((a, b))]
    return (a, b, *spelled) if all(b"".join(x) == (" " + text).encode() for x in spelled) else None


def plainly(own, text):
    """(groups, linked id pairs) by comparing all byte ranges."""
    found = tokens(own, text)
    if found is None:
        return None
    a, b, a_bytes, b_bytes = found
    ranges = []
    for x in (a_bytes, b_bytes):
        at, out = 0, []
        for t in x:
            out.append((at, at + len(t)))
            at += len(t)
        ranges.append(out)
    shared = {e for _, e in ranges[0]} & {e for _, e in ranges[1]}
    groups, left = [], 0
    for end in sorted(shared):
        groups.append(tuple(tuple(i for i, (s, e) in zip(ids, r) if left <= s and e <= end) for ids, r in zip((a, b), ranges)))
        left = end
    links = [(x, y) for x, (s, e) in zip(a, ranges[0]) for y, (u, v) in zip(b, ranges[1]) if s < v and u < e]
    return groups, links


def spelled(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def by_hand(own, docs):
    found = [(i, plainly(own, t)) for i, t in docs]
    count = Counter(link for _, f in found if f for link in f[1])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, f in found:
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        na, nb = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((i, na, nb, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(map(count.__getitem__, links)), hashlib.sha256(spelled(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def random_texts(n, seed):
    rng = random.Random(seed)
    odd = "ab  \n\t\r\x00\x1c\x85\xa0　 'stréß12٣漢字🙂é.,!aaa▁﻿́"
    plain = "the of  \n and st ion über Straße 12 don't ﬁ 漢字 <s></s><|endoftext|><0x0A>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for letters in (odd, plain, odd.replace("▁", "")) for _ in range(n)]


def test_groups_by_divide_and_conquer():
    rng = random.Random(5)
    for _ in range(2000):
        n = rng.randint(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2))
        shared = sorted(set(a) & set(b))
        at, want = [0, 0], []
        for end in shared:
            to = [a.index(end) + 1, b.index(end) + 1]
            want.append([at[0], to[0], at[1], to[1]])
            at = to
        a, b = np.array(a), np.array(b)
        assert T.groups_of(a, b).tolist() == want
        assert len(T.links_of(a, b)[0]) == len(a) + len(b) - len(want)


@pytest.mark.parametrize("kind", ["dense", "none", "left", "right", "edges"])
def test_long_lists_take_no_square(kind):
    n = 200_000
    a = list(range(2, 2 * n + 1, 2))
    keep = {"dense": lambda i: True, "none": lambda i: False, "left": lambda i: i < n // 2, "right": lambda i: i > n // 2, "edges": lambda i: i < n // 4 or i > 3 * n // 4}[kind]
    b = [x if keep(i) or i == n - 1 else x - 1 for i, x in enumerate(a)]
    began = time.process_time()
    assert len(T.groups_of(np.array(a), np.array(b))) == len(set(a) & set(b))
    assert time.process_time() - began < 6


def test_parts_against_whole_texts(own):
    texts = random_texts(1500, 1)
    parts = T.Parts(own)
    for text, rows in zip(texts, parts.rows(texts)):
        want = plainly(own, text)
        if want is None:
            assert not len(rows) or parts.lossy[rows].any()
        else:
            assert not parts.lossy[rows].any()
            assert parts.text(rows).decode() == spelled(want[0]), text
            codes, n = parts.links(rows)
            assert dict(zip(codes.tolist(), n.tolist())) == Counter(x * own.size_b + y for x, y in want[1])


def test_cache_that_forgets(own, monkeypatch):
    texts = random_texts(60, 2)
    parts, fresh = T.Parts(own), []
    monkeypatch.setattr(T, "MOST_PARTS", 5)
    for t in texts:
        rows = parts.rows([t])[0]
        fresh.append((parts.counts[rows].sum(0).tolist(), parts.links(rows)[1].sum()))
    monkeypatch.setattr(T, "MOST_PARTS", 10**6)
    for t, got in zip(texts, fresh):
        parts = T.Parts(own)
        rows = parts.rows([t])[0]
        assert got == (parts.counts[rows].sum(0).tolist(), parts.links(rows)[1].sum())


@pytest.mark.parametrize("most", [T.BROADCAST_PAIRS, 25, 0])
def test_small_tables(spark, own, most):
    docs = [(i, t) for i, t in enumerate(random_texts(25, 3))] + [(3, "the the the"), (3, "the the the"), (None, "of the"), (None, None), (-1, ""), (-2, "word\n"), (-3, " lead"), (-4, "a\nb"), (-5, "a▁b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = T.align(df, most=most)
    assert got.columns == ["doc_id", *T.COUNTS, "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(own, docs)


def test_long_texts_and_empty_tables(spark, own, odd_docs, no_docs):
    assert T.align(no_docs).count() == 0
    assert T.align(odd_docs).count() == odd_docs.count()
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeé") for _ in range(200_000)), "a" * 200_000, " " * 100_000, "\n" * 50_000, "ab " * 100_000, "漢" * 100_000]
    rows = {r.doc_id: r for r in T.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        a, b, *_ = tokens(own, text)
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_links) == (len(a), len(b), len(a) + len(b) - rows[i].n_groups)


def test_whole_query(spark, own):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = {r.doc_id: tuple(r) for r in T.op13_token_alignment(spark, SF).collect()}
    short = [d for d in docs if len(d[1]) < 3000]
    assert len(rows) == len(docs)
    # ranges by brute force are square in a text: shorter ones are compared whole, all by their tokens
    for i, text in short:
        groups, links = plainly(own, text)
        assert rows[i][3:5] == (len(groups), len(links)) and rows[i][7] == hashlib.sha256(spelled(groups).encode()).hexdigest()
    for i, text in docs:
        a, b, *_ = tokens(own, text)
        assert rows[i][1:3] == (len(a), len(b))
    groups = {r.doc_id: r.groups for r in T.spelled_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    count, best = Counter(), Counter()
    links = {}
    for i, text in docs:
        sizes = own.sides
        links[i] = []
        for g in groups[i].split(";"):
            a, b = ([int(x) for x in side.split(",")] for side in g.split("|"))
            ends = []
            for k, ids in enumerate((a, b)):
                at, out = 0, []
                for x in ids:
                    at += int(sizes[k][0][x])
                    out.append(at)
                ends.append(out)
            links[i] += [(a[x], b[y]) for x, e in enumerate(ends[0]) for y, f in enumerate(ends[1]) if max(e - int(sizes[0][0][a[x]]), f - int(sizes[1][0][b[y]])) < min(e, f)]
        count.update(links[i])
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for i, own_links in links.items():
        assert rows[i][4:7] == (len(own_links), sum(count[x] == best[x[1]] for x in own_links), sum(map(count.__getitem__, own_links)))

import random
import re

import numpy as np
from marginalia.llm import quality_rules as Q

from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "\n", "é ", "#", "\x0b", "\x85", "🙂 ", "a b a b "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", " ", "x " * 20_000, "a b c d e f g h " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.counts(df).collect():
        assert tuple(r[n] for n in NAMES) == brute(texts[r.doc_id]), repr(texts[r.doc_id])


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Q.op3_quality_rules(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = n = 0
    for r in got:
        assert tuple(r[x] for x in NAMES) == brute(rows[r.doc_id])
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
        if r.doc_id in labels and not failed:
            n, right = n + 1, right + (r.kept == bool(labels[r.doc_id]))
    assert right / n > 0.95


def test_votes_are_weighed(spark):
    """Three rules that follow the hidden class (fewer would not tell it) and one that is noise."""
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        good = rng.random() < 0.8
        vote = lambda p: (1 if good else -1) if rng.random() < p else (-1 if good else 1)
        rows.append((vote(0.95), vote(0.9), vote(0.9), rng.choice([-1, 0, 1]), good))
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, good boolean")
    names = ["a", "b", "c", "d"]
    model = Q.fit(df.groupBy(*names).count().withColumnRenamed("count", "n"), names)
    seen = df.withColumn("p", Q.posterior(names, model)).collect()
    assert sum((r.p > 0.5) == r.good for r in seen) / len(seen) > 0.93
    assert abs(model["prior"] - 0.8) < 0.1


def test_posterior_against_numpy(spark):
    """Expectation-maximisation and verdicts of the query, made anew over its votes."""
    out = Q.judge(spark.read.parquet(f"{SF}/documents.parquet"))
    names = list(Q.rules())
    rows = out.select(*names, "quality", "base_failed", "kept").toPandas()
    votes = rows[names].to_numpy()
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # text, rule, vote
    prior, good, bad = 0.8, np.tile([0.02, 0.28, 0.7], (len(names), 1)), np.tile([0.3, 0.3, 0.4], (len(names), 1))

    def posterior():
        w = np.log(good / bad)
        w[:, 2], w[:, 0] = np.maximum(w[:, 2], 0), np.minimum(w[:, 0], 0)
        return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + (one * w).sum((1, 2)))))

    for _ in range(Q.ITERATIONS):
        p = posterior()
        prior = (p.sum() + 2) / (len(p) + 4)
        good = ((one * p[:, None, None]).sum(0) + 1) / (p.sum() + 3)
        bad = ((one * (1 - p)[:, None, None]).sum(0) + 1) / ((1 - p).sum() + 3)
    assert np.allclose(rows["quality"], posterior(), atol=1e-6)
    assert (rows["kept"] == ~rows["base_failed"] & (posterior() >= Q.KEEP)).all()


def test_odd_rows(spark, odd_docs, no_docs):
    out = Q.judge(odd_docs)
    assert out.count() == odd_docs.count() and Q.judge(no_docs).count() == 0
    assert {r.doc_id for r in out.where("not base_failed").collect()} == set()

import itertools
import pickle
import random

import numpy as np
import pytest
from marginalia.llm import quality_model as M
from marginalia.llm import toxicity as X

SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def kernel(a, b):
    """The kernel as it is defined: common triples in order, weighed by what they span."""

    def weights(s):
        out = {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if all("a" <= c <= "z" for c in (s[i], s[j], s[k])):
                out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + X.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
    return dot(x, y) / max(np.sqrt(dot(x, x) * dot(y, y)), 1e-9)


def test_kernel_by_table():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc.-") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["idiot", "i.d.i.o.t", "aaaaaa"]
    marks = [w for w in words if len(set(w) & set("abcdiot")) > 1 and sum(c.isalpha() for c in w) >= 3][:8]
    got = X.against(words, X.embed(marks).T)
    want = [[kernel(w, m) for m in marks] for w in words]
    assert np.allclose(got, want, atol=1e-4)


def test_gaps_and_disguises_score_higher():
    rng = random.Random(2)
    plain = ["".join(rng.choice(["the", "an", "er", "on", "ti", "re"]) for _ in range(3)) for _ in range(300)]
    rows = [(" ".join(rng.choices(plain, k=20) + ["moron"] * 2 + rng.choices(plain, k=9)), 1) for _ in range(40)]
    rows += [(" ".join(rng.choices(plain, k=30)), 0) for _ in range(160)]
    model = X.fit(rows)
    score = model.scores(["you moron", "you m.o.r.o.n!", "m o r o n", " ".join(plain[:30]), "", "x" * 5000])
    assert score[:3].min() > 0.7 and score[3:].max() < 0.3


def worded(rng, plain, n, also=()):
    words = rng.choices(plain, k=n)
    for w in also:
        words.insert(rng.randrange(1, len(words)), w)
    return " ".join(words)


def test_inserted_letters_split_words_and_two_words():
    rng = random.Random(4)
    parts = ["the", "an", "er", "on", "ti", "re", "se", "ha", "lo", "ing", "ed", "st"]
    plain = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(900)]
    insults = ["wretchup", "moronic", "gribble", "scumbag", "dumzog", "twitfop"]
    two = ["vile crumb", "foul zelk"]  # none of their words, rare in harmless texts, is one alone
    rows = [(worded(rng, plain, 60, rng.sample(insults, rng.randint(2, 4))), 1) for _ in range(120)]
    rows += [(worded(rng, plain, 60, [rng.choice(two)] * 2), 1) for _ in range(60)]
    alone = [[w] for t in two for w in t.split()] * 3
    rows += [(worded(rng, plain, 60, also), 0) for also in alone + [[]] * 700]
    model = X.fit(rows)
    fresh = [worded(rng, plain, 60, also) for also in alone + [[]] * 200]
    assert (model.scores(fresh) >= X.THRESHOLD).mean() <= 0.01
    put = lambda w, c, k: w[:k] + c + w[k:]
    forms = {
        "letter": lambda w: put(w, rng.choice("abcdefghijklmnopqrstuvwxyz"), rng.randrange(1, len(w))), "mark": lambda w: put(w, rng.choice("*.7-"), rng.randrange(1, len(w))),
        "blank": lambda w: put(w, " ", rng.randrange(2, len(w) - 1)), "dots": lambda w: ".".join(w), "apart": lambda w: " ".join(w), "plain": lambda w: w,
    }
    for name, form in forms.items():
        texts = [worded(rng, plain, 60, [form(w) for w in rng.sample(insults, 2)]) for _ in range(100)]
        assert (model.scores(texts) >= X.THRESHOLD).mean() >= 0.9, name
    texts = [worded(rng, plain, 60, [rng.choice(two)] * 2) for _ in range(100)]
    assert (model.scores(texts) >= X.THRESHOLD).mean() >= 0.9
    copied = pickle.loads(pickle.dumps(model))
    assert np.array_equal(copied.scores(fresh[:9]), model.scores(fresh[:9]))


def test_bounds_of_the_sample(spark):
    text = ". ".join(f"word{i} other{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text), (2, "short one"), (3, None)], "doc_id long, text string")
    found = {}
    for batch in X._strings(100, spark.sparkContext.broadcast(frozenset()))(iter(docs.toArrow().to_batches())):
        found |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    assert 90 <= sum(len(x["words"]) + len(x["windows"]) for x in found[1]) <= 100
    assert found[2] == [{"words": ["one", "short"], "windows": ["shortone"]}] and found[3] == []


def rank_share(scores, label):
    """The share of pairs of both labels in which the score of label 1 is the higher one."""
    order = np.argsort(np.argsort(scores))
    n = int(label.sum())
    return (order[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("query, label, recall, wrong, area", [(X.op2_toxicity, "toxic", 0.85, 0.01, 0.9), (M.op7_quality_classifier, "quality", 0.97, 0.12, 0.97)])
def test_held_out_recall_and_false_alarms(spark, query, label, recall, wrong, area):
    # of the toxic texts held out there, 10 of 144 hold none of the words that mark the others
    rows = query(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    y = rows[label].to_numpy()
    assert rows["predicted"][y == 1].mean() >= recall and rows["predicted"][y == 0].mean() <= wrong
    assert rank_share(rows["score"].to_numpy(), y) >= area


def test_without_labels_of_both_classes():
    assert X.fit([("some text", 0)]).scores(["any", ""]).max() < 1e-6
    assert (M.Network(4).probability(np.zeros((3, 4))) == 0.5).all()


@pytest.mark.parametrize("query, label, least", [(X.op2_toxicity, "toxic", 0.9), (M.op7_quality_classifier, "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    found = query(spark, SMALL)
    rows = found.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[label] for r in rows) / len(rows)
    assert right >= least, right
    assert found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_random_indexing_adds_neighbours():
    total = np.zeros(M.BUCKETS * M.DIMENSIONS)
    words, sizes = M.sequences(["a b", "c"])
    M.add_contexts(total, words, sizes)
    places, signs = M.index_vectors()
    want = np.zeros((M.BUCKETS, M.DIMENSIONS))
    for x, y in ((words[0], words[1]), (words[1], words[0])):
        for p, s in zip(places[y], signs[y]):
            want[x, p] += s
    assert np.array_equal(total.reshape(want.shape), want)


def test_tables_of_many_tasks_are_summed_by_a_tree(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(9))) for i in range(90)], "doc_id long, text string")
    one = M.word_vectors(docs.coalesce(1))
    for parts, fan in ((30, 2), (30, 5), (30, 64)):
        assert np.allclose(M.word_vectors(docs.repartition(parts), fan), one, atol=1e-6)


def test_odd_rows(spark, odd_docs, no_docs):
    vectors = M.word_vectors(odd_docs)
    assert M.score(odd_docs, vectors, M.Network(2 * M.DIMENSIONS + 2)).count() == odd_docs.count()
    assert M.word_vectors(no_docs).shape == (M.BUCKETS, M.DIMENSIONS)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = X.train(odd_docs, labels)
    assert X.score(odd_docs, model).count() == odd_docs.count() and X.score(no_docs, model).count() == 0
    assert X.drop_toxic(odd_docs, model).count() == odd_docs.count()
    assert not M.train(odd_docs, labels, vectors).trained

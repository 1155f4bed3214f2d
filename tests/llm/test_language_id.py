import random

import numpy as np
import pytest
from marginalia.llm import language_id as L

from tests.llm.conftest import SF


def by_hand(text: bytes, data: bytes) -> int:
    """Phrases by searching the text itself."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in data:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("letters", [b"ab", b"abc \xc3\xa9", b"abcdefghij"])
def test_phrases(letters):
    rng = random.Random(len(letters))
    data = bytes(rng.choices(letters, k=300))
    parser = L.Parser(*L.suffix_automaton(data))
    texts = sorted((bytes(rng.choices(letters + b"x", k=rng.randint(0, 30))) for _ in range(300)), key=len, reverse=True)
    lengths = np.array(list(map(len, texts)))
    counts = parser.phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert counts.tolist() == [by_hand(t, data) for t in texts]


def test_words_and_their_parts():
    model = L.Model(dict(lang=n, n=len(d), codes=c.tobytes(), targets=t.tobytes()) for n, d in (("b", b" der die das "), ("a", b" the of and ")) for c, t in [L.suffix_automaton(d)])
    assert model.languages == ["a", "b"]
    words = [b"the", b"die", b"thedie", b"x" * 70, b"q" * 32, "é漢".encode(), b"der" * 30]
    for lang, data in enumerate((b" the of and ", b" der die das ")):
        for word, n in zip(words, model.parse(words)[:, lang]):
            cut = [b" " + word + b" "] if len(word) <= L.PART else [word[i : i + L.PART] for i in range(0, len(word), L.PART)]
            if len(word) > L.PART:
                cut[0], cut[-1] = b" " + cut[0], cut[-1] + b" "
            assert n == sum(by_hand(c, data) for c in cut), word


def test_cache_that_forgets(monkeypatch):
    model = L.Model([dict(lang="a", n=9, codes=c.tobytes(), targets=t.tobytes()) for c, t in [L.suffix_automaton(b" abc cab ")]])
    texts = [[bytes(random.Random(i).choices(b"abc", k=4)) for i in range(j, j + 9)] for j in range(40)]
    want = [model.parse(t).sum(0).tolist() for t in texts]
    monkeypatch.setattr(L, "CACHE_CELLS", 10)
    words = L.Words(model)
    assert [words.phrases(words.rows([t])[0]).tolist() for t in texts] == want


def test_bounds_of_the_sample(spark):
    rows = [(i, "ab cd " * (i % 7 + 1), "x" if i % 3 else "y", "clash") for i in range(300)] + [(1000, "z" * 500, "x", ""), (7, "", "x", ""), (8, None, "x", ""), (9, "ab", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string")
    found = L.sample(df, L.Sample(rows=20, bytes=400, row_bytes=100)).collect()
    for lang in "xy":
        own = [r.text for r in found if r.lang == lang]
        assert 0 < len(own) <= 20 and sum(map(len, own)) <= 400 and max(map(len, own)) <= 100
    with pytest.raises(ValueError):
        L.sample(df, L.Sample(languages=1))


def test_odd_rows(spark, odd_docs, no_docs):
    labelled = spark.createDataFrame([(1, "the word and a text of the id", "en"), (2, "das wort und ein text", "de"), (2, "das wort und ein text", "de"), (3, " 12 ", "no"), (4, None, "fr")], "doc_id long, text string, lang string")
    model = L.train(labelled)
    assert model.languages == ["de", "en"]
    rows = L.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.lang_pred, r.score) == ("und", 0) if r.doc_id in (1, 2, 5) else r.lang_pred in ("de", "en") and 0 < r.score <= 1
    marks = spark.createDataFrame([(1, "123 →→ ٣"), (2, "漢"), (3, "word " * 200_000), (4, "漢" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.identify(marks, model).collect()}
    assert got[1] == "und" and got[2] in ("de", "en") and got[4] == got[2] and got[3] == "en"
    assert L.identify(no_docs, model).count() == 0
    nothing = L.train(labelled.where("doc_id > 2"))
    assert {r.lang_pred for r in L.identify(odd_docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = L.op12_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in held)
    assert len(held) > 150 and right / len(held) >= 0.98

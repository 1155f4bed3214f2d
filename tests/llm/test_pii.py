import hashlib
import math
import random
import re

import pytest
from marginalia.llm import pii

from tests.llm.conftest import SF


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """The patterns as they are written, leftmost and without overlap per kind."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_spans_of_random_strings():
    rng = random.Random(8)
    parts = ["a@b.c", "4539 1488-0343 6467", "+1 (386) 555-3733", "1.2.3.4", "256.1.1.1", "é", "@", ".", "-", " ", "0", "9", "+", "x_y", "%", "12", "\n", "000255.1.1.1", "b@c.d_e@f.g"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == base(text), text
    assert pii.base_spans("a" * 50_000 + " @ " + "1" * 50_000 + "." * 3 + "1 " * 20_000) == []


def test_query_keeps_every_base_span(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op1_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base(rows[r.doc_id])
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("term")) == named


@pytest.mark.parametrize("max_terms", [100, 0])
def test_terms_that_give_a_value_away(spark, monkeypatch, max_terms):
    # "zorblatt" stands by one address in four different texts and nowhere else; "hello" stands everywhere
    texts = [f"hello zorblatt wrote from jo@ex.org today number{i}" for i in range(4)]
    texts += [f"hello someone else wrote other{i}@ex.org" for i in range(12)] + [f"hello nothing here {i}" for i in range(20)]
    texts += [texts[0]] * 3 + ["hello copied gloop by cp@ex.org"] * 9
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marked = {}
    for r in pii.find_personal_data(df, max_terms).collect():
        marked[r.doc_id] = {texts[r.doc_id][m.start : m.end] for m in r.marks or ()}
    assert all("zorblatt" in marked[i] for i in (0, 1, 2, 3, 36))
    assert not any("hello" in m for m in marked.values())
    # copies alone make no term disclosing
    assert not any(marked[i] for i in range(4, 36)) and not marked[45]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblatt" not in clean[0] and "jo@ex.org" not in clean[0] and clean[0].startswith("hello")


@pytest.mark.parametrize("max_terms", [100, 0])
def test_terms_of_values_that_stand_once(spark, max_terms):
    # four addresses, each in one text, share a domain and "quibble"; four cards, each in one text, share their kind and "frobnitz"
    cards = ["4539148803436467", "5500005555555559", "340000000000009", "6011000000000004"]
    texts = [f"hello quibble sent from jo{i}@rare.org today" for i in range(4)] + [f"hello frobnitz paid by {c} now" for c in cards]
    texts += [f"hello other{i}@many{i}.org says plain" for i in range(3)] + [f"hello nothing here {i}" for i in range(70)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marked = {r.doc_id: {texts[r.doc_id][m.start : m.end] for m in r.marks or ()} for r in pii.find_personal_data(df, max_terms).collect()}
    assert all("quibble" in marked[i] for i in range(4)) and all("frobnitz" in marked[i] for i in range(4, 8))
    assert not any("hello" in m for m in marked.values()) and not any(marked[i] for i in range(11, 81))


def disclosing(texts):
    """term -> removed, by the definition, with every count made anew."""
    texts = sorted(set(texts))
    word = re.compile(r"[^\W\d_]{3,}")
    terms = [{w.lower() for w in word.findall(t)} for t in texts]
    owned, near = [], []
    for t in texts:
        spans = base(t)
        own = {(e, v) for s, k, x in spans for e, v in enumerate(pii.entities(k, t[s:x]))}
        owned.append(own)
        pairs = set()
        for m in word.finditer(t):
            if all(m.end() <= s or m.start() >= x for s, _, x in spans):
                for s, k, x in spans:
                    if s - pii.REACH <= m.start() and m.end() <= s or x <= m.start() and m.end() <= x + pii.REACH:
                        pairs |= {(m[0].lower(), e, v) for e, v in enumerate(pii.entities(k, t[s:x]))}
        near.append(pairs)
    out = {}
    for term, e, v in set().union(*near):
        n_pair = sum((term, e, v) in p for p in near)
        n_value, n_term = sum((e, v) in o for o in owned), sum(term in x for x in terms)
        know, tells = math.log2(len(texts) / n_value), math.log2(len(texts) * n_pair / (n_term * n_value))
        if n_pair >= pii.SUPPORT and (know >= pii.RARE or e == 0 and know > 0) and tells >= pii.GENERALISE * know:
            out[term] = out.get(term, False) or tells >= pii.REMOVE * know
    return out


@pytest.mark.parametrize("max_terms", [10_000, 0])
def test_against_the_definition(spark, max_terms):
    # odd letters: signs that count as letters, letters whose lower case is two, marks that join
    rng = random.Random(14)
    words = ["Ⅷabc", "x½yz", "ab½cd", "İstan", "straße", "ſoft", "漢字仮名", "éclair", "e\u0301clair", "KELVIN", "it's", "snake_case", "a1b2ccc", "ﬁne", "ǅungla"]
    values = ["jo@ex.org", "al@ex.org", "x@rare.net", "10.1.2.3", "10.1.2.9", "+44 20 7946 0958", "+44 20 7946 0111", "4539 1488 0343 6467"]
    texts = []
    for i in range(260):
        own = [rng.choice(words[8:] if rng.random() < 0.97 else words) for _ in range(rng.randint(1, 3))] + [f"pad{chr(97 + i % 26)}{chr(97 + i // 26)}q"]
        if rng.random() < 0.2:
            v = rng.randrange(len(values))
            own += [values[v], words[v]] if rng.random() < 0.8 else [values[v]]
        rng.shuffle(own)
        texts.append(" ".join(own))
    texts += texts[:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = pii.id_text(df).withColumn("text_id", pii.F.xxhash64("text"))
    found = docs.mapInArrow(pii._find, pii._FOUND)
    want = disclosing(texts)
    assert {r.term: r.removed for r in pii.disclosing_terms(docs, found, max_terms).collect()} == want and len(want) > 3
    for r in pii.find_personal_data(df, max_terms).collect():
        t = texts[r.doc_id]
        spans = base(t)
        marks = [(m.start(), m.end(), want[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{3,}", t) if m[0].lower() in want and all(m.end() <= s or m.start() >= x for s, _, x in spans)]
        assert [(m.start, m.end, m.removed) for m in r.marks or ()] == marks


@pytest.mark.parametrize("max_terms", [100, 0])
def test_every_occurrence_of_a_disclosing_term(spark, max_terms):
    # "zorblatt" stands by one address in four texts; once more far from it, once in a text without a value, once without an id
    texts = [f"hello zorblatt wrote from jo@ex.org today number{i}" for i in range(4)] + [f"hello nothing here {i}" for i in range(200)]
    texts[0] += " filler" * 40 + " Zorblatt."
    texts += ["hello zorblatt alone", "hello again zorblatt", "mail zorblatt@ex.org"]
    ids = [*range(205), None, 206]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    marked = {}
    for r in pii.find_personal_data(df, max_terms).collect():
        text = texts[205 if r.doc_id is None else r.doc_id]
        marked[r.doc_id] = [text[m.start : m.end] for m in r.marks or () if text[m.start : m.end].lower() == "zorblatt"]
    assert marked[0] == ["zorblatt", "Zorblatt"] and marked[204] == ["zorblatt"] and marked[None] == ["zorblatt"]
    assert marked[206] == [] and len(marked) == len(texts)
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(df).collect()}
    assert not any("zorblatt" in t for t in clean.values())


def test_odd_rows(spark, odd_docs, no_docs):
    assert pii.find_personal_data(odd_docs).count() == odd_docs.count()
    assert pii.find_personal_data(no_docs).count() == 0
    assert pii.sanitise(odd_docs).count() == odd_docs.count()

import json
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from marginalia.llm import token_file as T
from tokenizers import Tokenizer

from tests.llm.conftest import SF

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [T.END_ID]


def test_parts_spell_texts(lib):
    rng = random.Random(3)
    letters = "ab  \n\t\r\x1c\x85\xa0　'stréßÉ́12٣漢字🙂é.,!aaAB<|>ſK\""
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["<|endoftext|> it's a I'M", "Σας ΣΑΣ. İi"]
    own = T.PartEncoder(P.path("word_bpe_49k.json"), most=500)
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        for text, found in zip(some, own.encode(some)):
            assert np.frombuffer(found, own.dtype).tolist() == lib(text), repr(text)


def test_strings_of_special_tokens(lib):
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "word", "Word.", "é", "'s", "<", ">", "\u0338"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    own = T.PartEncoder(P.path("word_bpe_49k.json"), most=200)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, found in zip(some, own.encode(some)):
            assert np.frombuffer(found, own.dtype).tolist() == lib(text), repr(text)
    assert lib("<|endoftext|>") == [49407, T.END_ID]


def test_parts_are_cut_where_words_end(lib):
    rng = random.Random(5)
    letters = ["a", "B", "w", "W", "ß", "É", "é", "İ", "ı", "I", "ſ", "\u212a", "Σ", "ς", "ŉ", "ǰ", "ɏ", "ɐ", "×", "÷", "ª", "5", "٣", "漢", "ﬁ", "\U0001e030", "\u0378"]
    others = [*".,!?'\"<>=_^`|~#*&%$-()@", "'s", "'LL", "\u030a", "\u0307", "\u0338", "\xa0", "\u2028", "\x1c", "\t", "\r", "\x00", "🙂"]
    texts = ["".join(rng.choice(rng.choice((letters, letters, others, [" ", "\n"]))) for _ in range(rng.randint(0, 14))) for _ in range(30_000)]
    own = T.PartEncoder(P.path("word_bpe_49k.json"), most=3000)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        for text, found in zip(some, own.encode(some)):
            assert np.frombuffer(found, own.dtype).tolist() == lib(text), repr(text)
    assert own.encode([]) == [] and own.encode(["", ""]) == [own.end] * 2 and own.encode(["."])[0] != own.end


class Counted:
    """A tokenizer that keeps what it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_each_word_is_encoded_once_and_with_others(lib):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefg") for _ in range(9)) + rng.choice("hhhhhhhhhü") for _ in range(5000)]
    texts = [" ".join(f(w) + tail for w in words[at : at + 50]) for at in range(0, len(words), 50) for f in (str, str.capitalize) for tail in ("", "***", ".,", "$$$\n")]
    own = T.PartEncoder(P.path("word_bpe_49k.json"))
    own.tokenizer = counted = Counted(own.tokenizer)
    found = own.encode(texts)
    assert all(np.frombuffer(x, own.dtype).tolist() == lib(t) for x, t in zip(found, texts))
    # capitals in ASCII, words with marks and words in other lines are the same words
    assert sum(len(t.split()) for t in counted.given) < 1.3 * len(words) and len(counted.given) < 0.02 * len(words)


def test_vocabulary_of_other_rules(tmp_path):
    rules = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    rules["normalizer"]["normalizers"].pop()  # case is kept
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    texts = ["Some TEXT in capitals. And more", "", "lower"]
    cased, own = Tokenizer.from_file(path), T.PartEncoder(path)
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [[*cased.encode(t, add_special_tokens=False).ids, T.END_ID] for t in texts]


def test_many_rows_of_one_id(spark):
    docs = spark.range(3000).selectExpr("if(id % 2 = 0, null, 7) doc_id", "concat('text ', id) text")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        manifest = T.write_token_files(docs.repartition(8))
    finally:
        spark.conf.unset(name)
    assert manifest.count() > 2  # dealt over parts by the hash of the text
    rows = sorted(T.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 1500 + [7] * 1500
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_query(spark, lib):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.op6_token_files(spark, SF).collect()}
    start = 0
    for i, text in rows:
        ids = lib(text)
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_index_gives_records_in_any_order(spark, lib):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5)) for i in range(40)], "doc_id long, text string")
    for part in T.write_token_files(docs).collect():
        index = T.read_index(part.uri)
        store, path = pafs.FileSystem.from_uri(part.uri)
        with store.open_input_file(path + ".rec") as f:
            for entry in np.random.default_rng(1).permutation(index):
                doc_id, ids = T.read_record(f, entry, 2)
                assert doc_id == entry["doc_id"] and ids.tolist() == lib(f"text number {doc_id} " * (doc_id % 5))


def test_damage_is_found(spark, tmp_path):
    part = T.write_token_files(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), f"file://{tmp_path}").first()
    path = part.uri.removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(T.read_part(part.uri))


def test_odd_rows(spark, odd_docs, no_docs, lib):
    got = sorted(((r.start, r.doc_id, r["ids"]) for r in T.read_token_files(T.write_token_files(odd_docs)).collect()), key=lambda x: x[0])
    assert [i for _, i, _ in got] == [None, 1, 2, 3, 3, 4, 5, 6, 7]
    assert got[1][2] == [T.END_ID] and got[3][2] == lib("word")
    assert T.read_token_files(T.write_token_files(no_docs)).count() == 0

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from marginalia.llm import byte_bpe as Y

from tests.llm.conftest import SF

P = pytest.importorskip("public_tokenizers")
RANKS = Y.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def own():
    return Y.MergeReplay(RANKS, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_random_strings(own):
    replay, lib = own
    rng = random.Random(3)
    letters = "ab  \n\t\r\x1c\x85\xa0　'stréß12٣漢字🙂é.,!aaa"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ["", "a" * 5000, " " * 300, "I'll we've\n\n x"]
    ids, sizes = replay.encode_texts(texts)
    ends = np.cumsum(sizes)
    for text, e, n in zip(texts, ends, sizes):
        assert ids[e - n : e].tolist() == lib.encode_ordinary(text)
        assert replay.decode(ids[e - n : e]) == text.encode()


def test_ranks_that_no_merging_would_make():
    """A vocabulary in which a merge makes a pair of a lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abcd": 256, b"bc": 270, b"ab": 260, b"cd": 265, b"abab": 258}
    replay = Y.MergeReplay(ranks, r"\S+|\s+")
    for piece in (b"abcd", b"ababcd", b"abcdabcd", b"bcdab", b"abababab"):
        assert replay.encode([piece, b"xyz"])[0].tolist()[:-3] == replay.lowest_first(piece)


def test_query(spark, own):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Y.op9_byte_bpe(spark, SF).collect():
        ids = own[1].encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_round_trip_and_odd_rows(spark, odd_docs, no_docs):
    back = sorted((r.doc_id or 0, r.text) for r in Y.decode(Y.encode(odd_docs)).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    assert Y.encode(no_docs).count() == 0 and Y.encode_digests(no_docs).count() == 0

import hashlib

import corpus_pipeline
import pytest
import tiktoken
from marginalia.llm import byte_bpe, decontaminate, secrets, toxicity
from marginalia.llm.common import table

from tests.llm.conftest import SF
from tests.llm.test_minhash import brute as near


def test_run_against_plain_python(spark):
    """Each stage in plain Python on what the one before kept. The trained model is the same one."""
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if model.scores([t])[0] < 0.7}
    rows = {i: rows[i] for i, (_, _, kept) in near(list(rows.items()), 5).items() if kept}
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = decontaminate.words(r.text)
        windows.update(tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)))
    lengths = {len(w) for w in windows}

    def hit(text):
        w = decontaminate.words(text)
        return any(tuple(w[k : k + n]) in windows for n in lengths if n for k in range(len(w) - n + 1))

    rows = {i: t for i, t in rows.items() if not hit(t)}
    import public_tokenizers as P

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        spans = sorted([*secrets.base_spans(text), *secrets.confirmed_spans(text)], key=lambda x: (x[0], -x[2]))
        end, out = 0, []
        for s, _, e in spans:
            if s >= end:
                out += [text[end:s], "[SECRET]"]
            end = max(end, e)
        text = "".join([*out, text[end:]])
        assert got[i].ids == own.encode_ordinary(text)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "some text", "en", "s", 9), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 1)]
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    assert out.count() == len(rows)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0

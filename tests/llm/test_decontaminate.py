import hashlib
import random
import re
import tempfile

from marginalia.llm import decontaminate as D
from pyspark.sql import functions as F

from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = {}
    for i, text in docs:
        w, hit, own = split(text), set(), set()
        for item, it in items:
            b = split(it)
            size = min(n, len(b))
            windows = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if size else set()
            for k in range(len(w) - size + 1 if size else 0):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    own.add(str(item))
        out[i] = (len(w), len(hit), len(own), D.items_digest(list(own)), bool(hit))
    return out


def got(rows):
    return {r.doc_id: (r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"]), D.items_digest(r["items"]), bool(r.spans)) for r in rows}


def case():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(12)] + ["É", "é", "漢字", "Ab"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ".", "!", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 12, 14]))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (0, text(3))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, items[4][1])]
    return docs, items


def test_against_plain_python(spark):
    docs, items = case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 4)
    assert got(D.find_hits(d, b, 4).collect()) == want
    # a benchmark over the bound is a table of windows behind an array of bits
    assert got(D.find_hits(d, b, 4, max_index_bytes=4_000).collect()) == want
    clean = {i for i, x in want.items() if not x[4]}
    assert {r.doc_id for r in D.drop_contaminated(d, b, 4).collect()} == clean
    assert {r.doc_id for r in D.drop_contaminated(d, b, 4, max_index_bytes=4_000).collect()} == clean
    assert {r.doc_id for r in D.decontaminate(d, b, n=4).collect()} == clean


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "Keep this, ONE two three four! and this")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert D.decontaminate(d, b, "span").first().text == "Keep this, ! and this"


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.op5_benchmark_decontamination(spark, SF).collect()}
    assert found == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string, spans int")
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert D.find_hits(odd_docs, none).where("size(spans) > 0").count() == 0
    assert D.find_hits(odd_docs, some).where("size(spans) > 0").count() == 2
    assert D.find_hits(no_docs, some).count() == 0


def test_items_without_an_id(spark):
    d = spark.createDataFrame([(1, "one two three four five"), (2, "ten eleven"), (3, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "one two three"), (7, "one two three"), (None, "ten eleven"), (8, "four five")], "item_id long, text string")
    for bound in (D.MAX_INDEX_BYTES, 1_000):
        found = {r.doc_id: r for r in D.find_hits(d, b, 3, bound).collect()}
        assert {i: r["items"] for i, r in found.items()} == {1: ["7", "8", None], 2: [None], 3: []}
        assert {r.doc_id for r in D.drop_contaminated(d, b, 3, bound).collect()} == {3}
    d.withColumn("source", F.lit("x")).write.parquet(path := f"{tempfile.mkdtemp(prefix='spark-')}/documents.parquet")
    b.write.parquet(path.replace("documents", "benchmark"))
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in D.op5_benchmark_decontamination(spark, path.rsplit("/", 1)[0]).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (5, 3, digest(b"7,8")), 2: (2, 1, digest(b"")), 3: (0, 0, digest(b""))}


def _big(benchmark, bound):
    return D.small_index(benchmark, 10, bound) is None


def test_large_benchmarks_by_a_table_of_windows(spark):
    """One huge item, thousands without an id, a window that most documents hold, copies, rows without an id, texts of a word."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    huge = " ".join(f"h{i}" for i in range(30_000))
    items = [(1, huge), (2, "the very common passage of ten words that many hold"), (3, "single"), (4, None), (5, "...")]
    items += [(None, text(12)) for _ in range(2_000)] + [(6 + i, text(rng.choice([2, 3, 11]))) for i in range(200)]
    docs = [(i, f"{text(5)} the very Common passage of ten words, that many hold {text(3)}") for i in range(300)]
    docs += [(1000, " ".join(f"h{i}" for i in range(20_000, 20_500))), (1001, "Single"), (1001, "other"), (1002, None), (1003, ""), (None, "single"), (None, "clean"), (1004, items[7][1]), (1004, items[7][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _big(b, 2_000) and not _big(b, 1 << 30)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    small, large = (sorted(D.find_hits(d, b, 10, bound).collect(), key=key) for bound in (1 << 30, 2_000))
    assert [tuple(r) for r in small] == [tuple(r) for r in large] and len(large) == len(docs)
    kept = [sorted(map(str, D.drop_contaminated(d.withColumn("lost_key", F.lit(1)), b, 10, bound).collect())) for bound in (1 << 30, 2_000)]
    assert kept[0] == kept[1] and len(kept[0]) == sum(not r.spans for r in small)


def test_documents_are_read_as_often_for_any_benchmark(spark, tmp_path):
    spark.createDataFrame([(i, f"some words number {i}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    d = spark.read.parquet(str(tmp_path / "docs"))
    for n_items in (5, 500):
        b = spark.createDataFrame([(i, f"some words number {i}") for i in range(n_items)], "item_id long, text string")
        reads = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                reads.add(batch.num_rows)
                yield batch

        hits = D.find_hits(d.mapInArrow(counted, "doc_id long, text string"), b, 4, 100).collect()
        assert sum(bool(r.spans) for r in hits) == min(n_items, 50)
        assert reads.value == 100


def test_hashes_that_meet_are_told_apart_by_words(spark, monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda codes, size: __import__("numpy").full(max(len(codes) - size + 1, 0), 7, "int64"))
    docs, items = [(1, "a b c d"), (2, "a b"), (3, "e f g h")], [(1, "a b c"), (2, "e f x")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.find_hits(d, b, 3, 10).collect()) == brute(docs, items, 3)

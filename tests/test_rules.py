"""Text rules and operators on small inputs, against plain Python."""

import datetime
import random

import pytest
from marginalia.functions.shared import shared_path
from marginalia.functions.text import byte_prefix, cut, fields, trim_space
from marginalia.operators import answers as A
from marginalia.operators import chunking as K
from marginalia.operators import context as C
from marginalia.operators import metrics as M
from marginalia.operators import prompts as P
from marginalia.operators import retrieval as R
from marginalia.operators import tables as B
from marginalia.plans.queries import QUERIES
from pyspark.sql import functions as F

ODD = ["", " ", "a b　c\x85d", "a\x1cb c", "é" * 60, "漢" * 40 + "x", "🙂" * 30, "  padded\t\n", None]


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def go_fields(s):
    return None if s is None else [w for w in "".join(" " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else c for c in s).split(" ") if w]


def test_fields_and_trim(spark):
    assert values(spark, ODD, fields("s")) == [go_fields(t) for t in ODD]
    assert values(spark, [" 　x y\x85", "\x1cx"], trim_space("s")) == ["x y", "\x1cx"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100])
def test_byte_prefix(spark, n):
    want = [None if t is None else t.encode()[:n].decode(errors="ignore") for t in ODD]
    assert values(spark, ODD, byte_prefix("s", n)) == want
    assert values(spark, ["abcdef"], cut("s", 3, "...")) == ["abc..."]


def pack(text, limit):
    if len(text.encode()) <= limit:
        return [text]
    out, cur = [], ""
    for w in go_fields(text):
        if cur and len(cur.encode()) + len(w.encode()) + 1 > limit:
            out.append(cur)
            cur = ""
        cur = f"{cur} {w}" if cur else w
    return out + [cur] if cur else out


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["", "  ", "x" * 2000, "x" * 2001, "y " * 1000 + "z", "w" * 3000 + " a b", " " * 2500]
    texts += [" ".join(rng.choice(["é" * rng.randint(1, 900), "ab", "🙂" * 5, "c d", "e\x1cf"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    assert [K.pack(t, 2000) for t in texts] == [pack(t, 2000) for t in texts]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {}
    for r in K.chunk_rows(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(int(r.doc_id), []).append(r.text)
    assert got == {i: pack(t, 2000) for i, t in enumerate(texts) if pack(t, 2000)}


def test_ranking_with_ties_repeats_and_fallback(spark):
    chunks = [("s", f"c{i}", 0, i, t) for i, t in enumerate(["cat dog", "Cat", "bird", "dog dog cat", "the cat dog here"])]
    c = spark.createDataFrame(chunks, "session_id string, chunk_id string, doc_pos int, chunk_index int, text string")
    q = spark.createDataFrame([("a", "s", "cat cat dog"), ("b", "s", "zzz"), ("c", "s", "  "), ("d", "s", "cat dog")], "question_id string, session_id string, message string")
    got = {}
    for r in R.rank(R.score(q, c), 3).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    assert got == {
        "a": [("c0", 3), ("c3", 3), ("c4", 3)],
        "b": [("c0", 0), ("c1", 0), ("c2", 0)],
        "c": [("c0", 0), ("c1", 0), ("c2", 0)],
        "d": [("c0", 7), ("c4", 7), ("c3", 2)],
    }


def test_takeaways_and_topics(spark):
    texts = ["• one\n- two\n•- three\n-", "First sentence that is long enough. Short. Third one that is long enough as well. Fourth", "no", "Main Topics: A b : c\nTheme:", "Über Alles die Große 1234 Word, WORD!"]
    assert values(spark, texts, A.extract_takeaways(F.col("s"))) == [["one", "two", "three"], ["First sentence that is long enough.", "Third one that is long enough as well."], [], ["Main Topics: A b : c\nTheme:."], ["Über Alles die Große 1234 Word, WORD!."]]
    assert values(spark, texts, A.extract_topics(F.col("s")))[3:] == [["a b"], ["Alles", "Große", "1234"]]


def test_token_groups_join_to_the_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", " ", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {}
    for r in A.token_groups(df, "s").orderBy("i", "pos").collect():
        got[r.i] = got.get(r.i, "") + r.piece
    assert all(got.get(i, "") == t for i, t in enumerate(texts))


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([(1, 3600), (2, 3601)], "session_id long, age int").select("session_id", F.timestamp_seconds(F.lit(1_000_000) - F.col("age")).alias("last_activity"))
    kept, gone = B.expire_inactive(df, F.timestamp_seconds(F.lit(1_000_000)))
    assert [r.session_id for r in kept.collect()] == [1] and [r.session_id for r in gone.collect()] == [2]


def test_malformed_completions(spark):
    bodies = ['{"choices":[{"message":{"content":" x "}}]}', '{"choices":[]}', '{"error":{"message":"quota"}}', "{broken", None, '{"choices":[{}]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [(r.answer, r.error) for r in A.parse_completion(df).orderBy("i").collect()]
    assert got == [(" x ", None), (None, "no choices"), (None, "quota"), (None, "malformed"), (None, "malformed"), ("", None)]


def test_context_fulltext_holds_few_texts(spark):
    rng = random.Random(5)
    docs, links = [], []
    sizes = {"many": [rng.randint(0, 300) for _ in range(900)], "one": [40_000], "small": [10, 20], "none": [None], "mixed": [None, 9_000, None, 9_000, 50]}
    sizes["exact"] = [15_000 - 11 - len("exact0.pdf"), 5]  # the second part begins just at the cut
    for name, own in sizes.items():
        for i, n in enumerate(own):
            text = None if n is None else "x" * n if name == "exact" else "".join(rng.choice("aé漢🙂 ") for _ in range(n))
            docs.append((f"{name}{i}", f"{name}{i}.pdf", text))
            links.append((name, f"{name}{i}", i))
    want = {}
    for name, own in sizes.items():
        text = {d: t for d, _, t in docs}
        whole = "".join(f"--- {name}{i}.pdf ---\n{text[f'{name}{i}']}\n\n" for i, n in enumerate(own) if n is not None)
        if len(whole.encode()) > 15_000:
            whole = whole.encode()[:15_000].decode(errors="ignore") + "\n... [truncated]"
        want[name] = "Document Context:\n\n" + whole
    ld = spark.createDataFrame(rng.sample(links, len(links)), "session_id string, doc_id string, doc_pos int")
    dd = spark.createDataFrame(docs, "doc_id string, filename string, text string")
    sessions = spark.createDataFrame([(s, s + "0") for s in sizes] + [("bare", "one0")], "session_id string, primary_doc_id string")
    chunks = spark.createDataFrame([("small1",)], "doc_id string")
    got = {r.session_id: r.context for r in C.context_fulltext(ld, dd, sessions, chunks).collect()}
    one = next(t for d, _, t in docs if d == "one0")
    want["bare"] = "Document Context:\n\n" + one.encode()[:15_000].decode(errors="ignore") + "\n... [truncated]"
    del want["small"]
    assert got == want
    # what is brought together for a session is bounded, however many and long its texts are
    parts = C.fulltext_parts(ld, dd)[0].collect()
    for name in sizes:
        assert sum(len(r.part.encode()) for r in parts if r.session_id == name) <= 2 * 15_004


def test_phrase_bonus_of_whole_messages(spark, tmp_path):
    # the last document of 30, its second chunk, and a message beyond 60 characters that differs at its end only
    long = "the quick brown fox jumps over the lazy dog while seven wizards watch closely from the hill"
    docs = [(i, f"filler text {i}", "src1") for i in range(29)] + [(29, "pad " * 600 + long.title(), "src1"), (30, long, "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, 0, "user", long), (1, 2, "user", long + "s"), (1, 4, "user", "filler text 28"), (1, 6, "assistant", long)]
    spark.createDataFrame(asked, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.question_id, r.phrase_bonus) for r in QUERIES["phrase_bonus_all"](spark, str(tmp_path)).collect())
    assert got == [("1-0", 5), ("1-4", 5)]


def test_weekly_share_of_the_users_there_are(spark):
    seen = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-03"), (3, "2024-01-10"), (4, "2024-01-11")], "user_id long, ts string")
    activity = seen.withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.share for r in M.weekly_active_share(activity, activity).orderBy("week").collect()] == [0.5, 0.5]


@pytest.mark.parametrize("blocks", [(256, 1000, 200_000), (4, 2, 0), (1, 1, 10)])
def test_scores_in_cells(spark, blocks):
    rng = random.Random(17)
    letters = ["a", "b", "ab", "ba", "aab", "é", "漢字", "x\x1cy", "c", "A", "Ab", "İ"]
    space = [" ", "  ", "\n", "　", "\x85", " \t"]

    def text(n):
        return "".join(rng.choice(letters) + rng.choice(space) for _ in range(rng.randint(0, n)))

    chunks = [(f"s{s}", f"{s}-{d}-{i}", d, i, text(14)) for s in range(3) for d in range(4) for i in range(3)] + [("s0", "none", 9, 0, None)]
    asked = [(f"q{s}-{i}", f"s{s}", text(4)) for s in range(4) for i in range(7)] + [("null", "s1", None), ("empty", "s2", ""), ("own", "s0", chunks[3][4])]
    c = spark.createDataFrame(rng.sample(chunks, len(chunks)), "session_id string, chunk_id string, doc_pos int, chunk_index int, text string")
    q = spark.createDataFrame(asked, "question_id string, session_id string, message string")
    # Java and Python lower-case this letter to the same two
    want = {}
    for qid, session, message in asked:
        low = None if message is None else message.lower()
        for s, cid, d, i, t in chunks:
            if s == session:
                t = (t or "").lower()
                k = sum(w in t for w in go_fields(low) or ())
                want[qid, cid] = (k, 5 if low is not None and low in t else 0)
    how = dict(zip(("block_chunks", "block_questions", "broadcast_sessions"), blocks))
    got = {(r.question_id, r.chunk_id): (r.keyword_score, r.phrase_bonus) for r in R.score(q, c, **how).collect()}
    assert got == want
    assert {(r.question_id, r.chunk_id) for r in R.score(q, c, phrases=True, **how).collect()} == {p for p, x in want.items() if x[1]}
    best = {}
    order = {cid: (d, i, cid) for _, cid, d, i, _ in chunks}
    for qid, _, _ in asked:
        own = sorted((-sum(want[p]), order[p[1]]) for p in want if p[0] == qid)[:3]
        best[qid] = [(o[2], -x) for x, o in own if -x > 0 or own[0][0] == 0]
    found = {}
    for r in R.rank(R.score(q, c, 3, **how), 3).orderBy("question_id", "rank").collect():
        found.setdefault(r.question_id, []).append((r.chunk_id, r.score))
    assert found == {i: x for i, x in best.items() if x}


def test_a_session_is_many_cells(spark):
    c = spark.range(3000).selectExpr("'s' session_id", "cast(id as string) chunk_id", "cast(id as int) doc_pos", "0 chunk_index", "concat('word', id % 7, ' text') text")
    q = spark.range(50).selectExpr("'s' session_id", "cast(id as string) question_id", "concat('word', id % 9) message")
    scored = R.score(q, c, 20, block_chunks=100, block_questions=20)
    assert max(r["count"] for r in scored.groupBy("question_id").count().collect()) <= 30 * 20 + 20
    assert scored.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    ranked = R.rank(scored)
    assert ranked.where("score > 0").groupBy("question_id").count().where("count != 20").count() == 0
    assert ranked.where("question_id % 9 >= 7").agg(F.max("score")).first()[0] == 0


def test_long_texts_are_cut_in_chats(spark):
    text = "漢" * 40_000
    df = spark.createDataFrame([(text, ["User: a", "Assistant: b"], "and?")], "t string, h array<string>, q string")
    m = df.select(P.chat_messages_array(F.col("t"), F.col("h"), F.col("q")).alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant", "user"]
    assert m[0].content == P.SYSTEM_HEAD + "漢" * 33_333 + P.CHAT_SUFFIX + P.SYSTEM_TAIL_CHAT


def test_unset_shared_folder_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None), "set": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_path(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert shared_path(Session, "x").startswith("file:///")


def test_activity_of_clearing_and_attaching(spark):
    sessions = spark.createDataFrame([(1, 10), (2, 10), (3, 50)], "session_id int, last_activity int")
    messages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "session_id int, msg_seq int")
    clears = spark.createDataFrame([(1, 1, 20), (3, 0, 40)], "session_id int, clear_seq int, created_at int")
    touched, left = B.clear_sessions(sessions, messages, clears)
    assert sorted(map(tuple, touched.collect())) == [(1, 20), (2, 10), (3, 50)]
    assert sorted((r.session_id, r.msg_seq) for r in left.collect()) == [(1, 2), (2, 1)]
    current = spark.createDataFrame([(1, "a", 0)], "session_id int, doc_id string, doc_pos int")
    batch = spark.createDataFrame([(1, "a", 1, 99), (2, "a", 2, 30), (2, "a", 3, 98), (1, "b", 4, 25)], "session_id int, doc_id string, seq int, created_at int")
    touched, links, refused = B.attach_to_sessions(sessions, current, batch)
    # a refused request is no activity
    assert sorted(map(tuple, touched.collect())) == [(1, 25), (2, 30), (3, 50)]
    assert sorted(map(tuple, links.collect())) == [(1, "a", 0), (1, "b", 1), (2, "a", 0)]
    assert sorted(r.seq for r in refused.collect()) == [1, 3]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_documents_attached_at_once_go_by_id(spark, parts):
    current = spark.createDataFrame([(1, 5, 0)], "session_id int, doc_id int, doc_pos int")
    batch = [(1, d, 10) for d in (9, 3, 7, 1, 8, 2)] + [(1, 4, 9)]
    links, refused = B.attach_documents(current, spark.createDataFrame(batch, "session_id int, doc_id int, seq int").repartition(parts))
    assert [r.doc_id for r in links.orderBy("doc_pos").collect()] == [5, 4, 1, 2, 3, 7, 8, 9]
    assert refused.count() == 0


@pytest.mark.parametrize("most", [(500_000, 64 << 20), (0, 64 << 20), (500_000, 0)])
def test_texts_of_a_ranking(spark, most):
    ranked = spark.createDataFrame([("q1", 1, "c1"), ("q2", 1, "c1"), ("q1", 2, "c2")], "question_id string, rank int, chunk_id string").withColumn("path", F.lit(None).cast("string"))
    chunks = spark.createDataFrame([("c1", 1, "a"), ("c2", 2, None), ("c3", 3, "c")], "chunk_id string, page_number int, text string")
    rows = R.with_text(ranked, chunks, *most)
    assert sorted((r.question_id, r.rank, r.chunk_id, r.page_number, r.text) for r in rows.collect()) == [("q1", 1, "c1", 1, "a"), ("q1", 2, "c2", 2, None), ("q2", 1, "c1", 1, "a")]
    assert R.with_text(ranked.where("rank > 5"), chunks, *most).count() == 0

"""A query for each operator, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.shared import shared_path
from marginalia.functions.text import byte_prefix, fields, trim_space
from marginalia.operators import answers as A
from marginalia.operators import asking as N
from marginalia.operators import audit as D
from marginalia.operators import chunking as K
from marginalia.operators import context as C
from marginalia.operators import histories as H
from marginalia.operators import metrics as M
from marginalia.operators import prompts as P
from marginalia.operators import retrieval as R
from marginalia.operators import tables as B
from marginalia.plans.tables import Tables
from marginalia.sources import upload_source as V
from marginalia.sources import uploads as U
from marginalia.sources.stores import Store, create, read
from marginalia.streaming import sessions as Q
from marginalia.streaming import streams as S

QUERIES = {}


def now() -> F.Column:
    return F.lit("1998-12-01 00:00:00").cast("timestamp")


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def scored(t: Tables, questions: DataFrame | None = None, **how) -> DataFrame:
    chunks = R.session_chunks(t.session_documents, t.chunks)
    return R.score(t.questions if questions is None else questions, chunks, sizes=t.chunk_bounds, **how)


def ranked(t: Tables) -> DataFrame:
    return R.rank(scored(t, k=R.TOP_K))


def ranked_heads(t: Tables) -> DataFrame:
    return R.with_text(ranked(t), C.heads(t.chunks))


def history(t: Tables, last: int | None) -> DataFrame:
    return P.history_lines(t.messages, last)


def joined(c: str, to: str = "|") -> F.Column:
    return F.array_join(c, to)


# Sources and sinks


def stored(t: Tables) -> str:
    """A folder of files with the documents, some hundred a file, as JSON lines."""
    path = shared_path(t.spark, "uploads")
    t.documents.select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.option("maxRecordsPerFile", 500).text(path)
    return path


def unpacked(lines: F.Column) -> F.Column:
    return F.explode(F.filter(F.split(lines, "\n"), lambda x: x != ""))


def digests(rows: DataFrame) -> DataFrame:
    found = F.from_json("line", "doc_id string, text string")
    return rows.select(found.alias("d")).select("d.doc_id", F.octet_length("d.text").alias("bytes"), F.md5("d.text").alias("digest"))


@query
def src_upload_dir(t):
    files = U.upload_dir(t.spark, stored(t), "part-*")
    return digests(files.select(unpacked(F.decode("content", "UTF-8")).alias("line")))


@query
def src_text(t):
    return digests(U.text_documents(t.spark, stored(t)).select(unpacked(F.col("text")).alias("line")))


def upload_rows(files: DataFrame) -> DataFrame:
    return digests(files.where("reject_reason is null").select(unpacked(F.decode("content", "UTF-8")).alias("line")))


@query
def src_upload_source(t):
    """Stored files through the data source of uploads."""
    V.register(t.spark)
    return upload_rows(t.spark.read.format("uploads").options(path=stored(t), pattern="part-*", mime="*").load())


@query
def src_upload_stream(t):
    """The same files as a stream, in one batch or more."""
    V.register(t.spark)
    return S.drained(upload_rows(t.spark.readStream.format("uploads").options(path=stored(t), pattern="part-*", mime="*").load())).drop("batch")


@query
def snk_tables(t):
    path = shared_path(t.spark, "tables")
    U.write_tables({"sessions": t.sessions, "documents": t.files, "messages": t.messages, "users": t.users}, path)
    own = U.read_tables(t.spark, path, ("sessions", "documents", "messages", "users"))
    return named(
        sessions=own["sessions"].select(F.col("session_id").alias("key"), F.col("title").alias("value")), documents=own["documents"].select(F.col("doc_id").alias("key"), F.col("filename").alias("value")),
        messages=own["messages"].select(F.col("id").alias("key"), F.md5("content").alias("value")), users=own["users"].select(F.col("id").alias("key"), F.col("email").alias("value")),
    )


@query
def src_tables(t):
    """Sessions with the number of their documents and the name of their user, from stored tables."""
    path = shared_path(t.spark, "tables")
    U.write_tables({"sessions": t.sessions, "documents": t.files, "users": t.users}, path)
    own = U.read_tables(t.spark, path, ("sessions", "documents", "users"))
    n = own["documents"].groupBy("session_id").agg(F.count("*").alias("n"))
    users = own["users"].select(F.col("id").alias("user_id"), "name")
    return own["sessions"].join(n, "session_id", "left").join(users, "user_id", "left").select("session_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query
def src_upload_gate(t):
    files = t.files.select("doc_id", "filename", F.when(F.col("pages") % 7 == 0, "text/plain").otherwise("application/pdf").alias("mime"), (F.col("pages") * 1_200_000).alias("length"))
    return U.upload_gate(files).select("doc_id", "filename", "mime", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@query
def src_upload_batch(t):
    files = t.read("lineitem").select(F.col("l_orderkey").alias("batch_id"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("file_no"), F.format_string("part_%d.pdf", "l_partkey").alias("filename"), (F.col("l_quantity") > 5).alias("ok"))
    files = files.groupBy("batch_id", "file_no", "filename").agg(F.max("ok").alias("ok"))
    return U.upload_batch(files)


@query
def src_last_written(t):
    files = t.files.select("filename", F.concat_ws("/", F.lit("uploads"), F.col("doc_id").cast("string")).alias("path"), F.col("uploaded_at").alias("modificationTime"))
    return U.last_written(files)


@query
def snk_json(t):
    return U.as_json(t.questions.select("question_id", "session_id", "msg_seq", "message"), "question_id", "session_id", "msg_seq", "message")


# Extraction to chunks


@query
def assemble_pages(t):
    return K.assemble_pages(t.pages)


@query
def assemble_pages_marked(t):
    return K.assemble_pages(t.pages, marked=True)


@query
def reject_blank(t):
    pages = t.pages.select(F.concat_ws("-", "doc_id", F.col("page_no").cast("string")).alias("doc_id"), F.when(F.col("page_no") % 5 == 0, "\u00a0\t ").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return K.reject_blank(pages)[1]


@query
def chunk_documents(t):
    return t.chunks.select("doc_id", "chunk_index", F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"))


@query
def chunk_rows(t):
    return t.chunks.select("chunk_id", "doc_id", "chunk_index", "page_number")


@query
def document_status(t):
    requests = t.read("documents").select((F.col("doc_id") * 2).cast("string").alias("doc_id"))
    return K.document_status(requests, t.documents, t.chunks)


# Retrieval


@query
def session_chunks(t):
    return R.session_chunks(t.session_documents, t.chunks).select("session_id", "doc_id", "doc_pos", "chunk_index")


@query
def keyword_score(t):
    return scored(t).select("question_id", "chunk_id", "keyword_score")


@query
def phrase_bonus(t):
    """Whole chunks of every document whose id is divisible by 20 as questions about all chunks of their session: each finds
    itself and its copies."""
    own = t.documents.where("no % 20 = 0").select("session_id", "doc_id")
    asked = own.join(t.chunks, "doc_id").select(F.col("chunk_id").alias("question_id"), "session_id", F.col("text").alias("message"))
    return scored(t, asked, phrases=True).select("question_id", "chunk_id", "phrase_bonus")


@query
def phrase_bonus_all(t):
    """All questions, as whole messages, against all chunks of their sessions."""
    return scored(t, phrases=True).select("question_id", "chunk_id", "phrase_bonus")


@query
def top_k_chunks(t):
    return ranked(t).where("score > 0").select("question_id", "rank", "chunk_id", F.col("score").cast("long").alias("score"))


@query
def fallback_first_k(t):
    """Questions made of one word that no chunk holds."""
    q = t.questions.select("question_id", "session_id", F.concat(F.lit("zzqx"), F.md5("message")).alias("message"))
    return R.fallback_first_k(scored(t, q, k=5), 5).select("question_id", "rank", "chunk_id")


@query
def build_context(t):
    return C.build_context(ranked(t), t.chunks).select("question_id", F.octet_length("context").alias("bytes"), F.md5("context").alias("digest"))


@query
def context_fulltext(t):
    links = t.session_documents
    empty = t.chunks.where("chunk_index < 0")
    return C.context_fulltext(links, t.documents, t.text_sessions, empty)


@query
def citations(t):
    return C.citations(ranked_heads(t))


@query
def relevant_previews(t):
    return C.relevant_previews(ranked_heads(t))


@query
def answer_record(t):
    held = R.stored(ranked(t))
    found = C.build_context(held, t.chunks, t.questions, is_stored=True).withColumn("answer_found", A.mock_found(F.coalesce("context", F.lit("")), F.col("message")))
    replies = found.select("question_id", "answer_found", A.mock_answer(F.col("answer_found"), F.col("message")).alias("response"))
    sessions = t.text_sessions.where("session_id != 'src3'")
    out = C.answer_record(t.questions, sessions, replies, R.with_text(held, C.heads(t.chunks), is_stored=True))
    return out.select("question_id", "session_id", "response", "answer_found", joined("relevant_chunks", "\n").alias("relevant_chunks"), F.size("citations").alias("n_citations"), "error")


# History and prompts


@query
def history_lines(t):
    return history(t, None).select("id", F.size("history").alias("n"), F.md5(joined("history")).alias("digest"))


@query
def history_blocks(t):
    """The blocks that questions share."""
    blocks = H.history_blocks(t.messages)[1]
    return blocks.select("session_id", "block", F.size("lines").alias("n"), F.md5(joined("lines")).alias("digest"))


@query
def history_lengths(t):
    """What a question holds of its history."""
    return H.history_blocks(t.messages)[0].select("id", "session_id", "n_lines")


@query
def question_prompt(t):
    """Every question with the chunks found for it and the last lines before it."""
    h = C.build_context(ranked(t), t.chunks, history(t, P.LAST), "id")
    prompt = P.question_prompt(F.coalesce("context", F.lit(C.CONTEXT_HEAD)), F.col("history"), F.col("content"))
    return h.select("id", F.octet_length(prompt).alias("bytes"), F.md5(prompt).alias("digest"))


@query
def chat_messages_array(t):
    """Every question with the chunks found for it and the whole history; the context may be cut."""
    m = P.chat_messages_array(F.coalesce("context", F.lit(C.CONTEXT_HEAD)), F.col("history"), F.col("content"))
    h = C.build_context(ranked(t), t.chunks, history(t, None), "id")
    return h.select("id", F.posexplode(m).alias("n", "m")).select("id", "n", "m.role", F.md5("m.content").alias("digest"))


@query
def chat_single_turn(t):
    m = P.chat_single_turn(F.col("text"), F.lit("What is this about?"))
    return t.documents.select("doc_id", F.posexplode(m).alias("n", "m")).select("doc_id", "n", "m.role", F.md5("m.content").alias("digest"))


@query
def summary_prompt(t):
    return t.documents.select("doc_id", F.md5(P.summary_prompt(F.col("text"))).alias("digest"))


@query
def summary_messages(t):
    return t.documents.select("doc_id", F.posexplode(P.summary_messages(F.col("text"))).alias("n", "m")).select("doc_id", "n", "m.role", F.md5("m.content").alias("digest"))


@query
def explain_prompt(t):
    m = t.messages
    page = (F.col("msg_seq") % 4).cast("int")
    return m.select("id", P.explain_prompt(page, F.col("content")).alias("prompt"), P.explain_preview(F.col("content")).alias("preview"))


@query
def inference_requests(t):
    """For every document the body of a summary and of a question about it."""
    summary = P.inference_request(P.summary_messages(F.col("text")), P.SUMMARY_LIMITS)
    chat = P.inference_request(P.chat_single_turn(F.col("text"), F.concat(F.lit("What is in "), "filename", F.lit("?"))), P.CHAT_LIMITS)
    kinds = F.explode(F.array(F.struct(F.lit("summary").alias("kind"), summary.alias("body")), F.struct(F.lit("chat").alias("kind"), chat.alias("body"))))
    return t.documents.select("doc_id", kinds.alias("x")).select("doc_id", "x.kind", F.octet_length("x.body").alias("bytes"), F.md5("x.body").alias("digest"))


# Answers


def completions(t: Tables) -> DataFrame:
    """Bodies of three kinds: an answer, no choices, an error; and some that aren't JSON."""
    m = t.messages.where("role = 'assistant'")
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(" "), "content", F.lit(" ")).alias("content")).alias("message"))
    n = F.pmod(F.col("session_id") + F.col("msg_seq"), F.lit(4))
    full = F.to_json(F.struct(F.array(choice).alias("choices")))
    body = F.when(n == 0, '{"choices":[]}').when(n == 1, '{"error":{"message":"quota"}}').when(n == 2, "not json").otherwise(full)
    return m.select("id", "content", body.alias("body"))


@query
def parse_completion(t):
    return A.parse_completion(completions(t), trims=True).select("id", "answer", "error")


def verdicts(t: Tables) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, ("I Cannot Find it", "Not in the document", "it is NOT FOUND", "not available", "yes"))), (F.pmod("msg_seq", F.lit(5)) + 1).cast("int"))
    return t.messages.select("id", F.concat_ws(" ", "content", phrase).alias("answer"))


@query
def answer_found_a(t):
    return verdicts(t).select("id", A.answer_found_a(F.col("answer")).alias("found"))


@query
def answer_found_b(t):
    return verdicts(t).select("id", A.answer_found_b(F.col("answer")).alias("found"))


@query
def mock_answer(t):
    """Every question about the chunks found for it."""
    q = C.build_context(ranked(t), t.chunks, t.questions.select("question_id", "message"))
    q = q.withColumn("found", A.mock_found(F.coalesce("context", F.lit(C.CONTEXT_HEAD)), F.col("message")))
    return q.select("question_id", "found", A.mock_answer(F.col("found"), F.col("message")).alias("answer"))


def reply(request: dict) -> str:
    """The mock rules as an answer function."""
    head = request["context_head"]
    return f"Based on {head}: {request['message']}" if len(head) % 2 else "nothing found"


@query
def with_answers(t):
    """Every question answered through a store of answers; the second run finds all of them there."""
    head = t.documents.groupBy("session_id").agg(F.min("filename").alias("context_head"))
    path = shared_path(t.spark, "prompts")
    t.questions.join(head, "session_id").select("question_id", "message", "context_head").write.parquet(path)
    prompts, store = t.spark.read.parquet(path), N.answer_store(shared_path(t.spark, "answers"), buckets=16)
    create(store, t.spark.createDataFrame([], store.schema))
    _, version = N.with_stored_answers(prompts, ["message", "context_head"], reply, store, 0)
    answers, _ = N.with_stored_answers(prompts, ["message", "context_head"], reply, store, version)
    return answers.select("question_id", "response")


@query
def mock_summary(t):
    return t.documents.select("doc_id", A.mock_summary(F.col("text")).alias("s")).select("doc_id", "s.summary", joined("s.key_takeaways").alias("takeaways"), joined("s.main_topics").alias("topics"))


def summaries(t: Tables) -> DataFrame:
    """Mock summaries for even documents; else the text with a bullet before each second line and a topic line."""
    n = F.col("no") % 3
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(" • - "), x)).otherwise(x)), "\n")
    named = F.concat(F.lit("Main Topics: First, Second : rest\n"), "text")
    return t.documents.select("doc_id", F.when(n == 0, marked).when(n == 1, named).otherwise(F.col("text")).alias("summary"))


@query
def extract_takeaways(t):
    return summaries(t).select("doc_id", joined(A.extract_takeaways(F.col("summary"))).alias("takeaways"))


@query
def extract_topics(t):
    return summaries(t).select("doc_id", joined(A.extract_topics(F.col("summary"))).alias("topics"))


@query
def session_summaries(t):
    """Sessions of documents, of conversations, whose document is missing where their number is even, and unknown ones."""
    others = t.messages.select(F.col("session_id").alias("no")).distinct().select(F.col("no").cast("string").alias("session_id"), F.concat(F.lit("missing"), F.col("no").cast("string")).alias("primary_doc_id"), "no")
    requests = t.documents.select("session_id").distinct().unionByName(others.select("session_id"))
    sessions = t.text_sessions.unionByName(others.where("no % 2 = 0").drop("no"))
    return A.session_summaries(requests, sessions, t.documents).select("session_id", "summary", joined("key_takeaways").alias("takeaways"), "error")


@query
def token_groups(t):
    return A.token_groups(t.messages.select("id", "content"), "content")


def stream_log(t: Tables) -> DataFrame:
    """The event lines that answers are sent as, with lines that aren't events between them."""
    pieces = A.token_groups(t.messages.where("role = 'assistant'").select("id", "content"), "content")
    tokens = pieces.select(F.col("id").alias("stream_id"), (F.col("pos") * 2).alias("line_no"), F.concat(F.lit("data: "), F.to_json(F.struct(F.col("piece").alias("content")))).alias("line"))
    names = pieces.select(F.col("id").alias("stream_id"), (F.col("pos") * 2 + 1).alias("line_no"), F.when(F.col("pos") % 2 == 0, "event: token").otherwise("data: {broken").alias("line"))
    done = t.messages.where("role = 'assistant'").select(F.col("id").alias("stream_id"), F.lit(1_000_000).alias("line_no"), F.concat(F.lit("data: "), F.to_json(F.struct(F.col("content").alias("response")))).alias("line"))
    return tokens.unionByName(names).unionByName(done)


@query
def parse_stream_log(t):
    return A.parse_stream_log(stream_log(t)).groupBy("stream_id", "kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query
def reassemble_stream(t):
    return A.reassemble_stream(A.parse_stream_log(stream_log(t)))


# Tables


def stored_keys(t: Tables, rows: DataFrame, key: str) -> Store:
    """A store in buckets with these rows as its version 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    store = Store(shared_path(t.spark, "store"), schema, [key], buckets=16)
    create(store, rows)
    return store


@query
def upsert_sessions(t):
    s = t.sessions
    changed = s.where("session_id % 3 = 0").select("session_id", F.lit(-1).cast("long").alias("user_id"), F.lit("changed").alias("title"), "created_at", (F.col("last_activity") + F.expr("interval 1 day")).alias("last_activity"), F.lit(2).alias("seq"))
    older = changed.withColumns({"title": F.lit("older"), "seq": F.lit(1)})
    new = s.where("session_id % 5 = 0").select((-F.col("session_id") - 1).alias("session_id"), "user_id", "title", "created_at", "last_activity", F.lit(1).alias("seq"))
    store = stored_keys(t, s, "session_id")
    B.upsert_sessions(t.spark, store, 0, older.unionByName(changed).unionByName(new), "seq")
    return read(t.spark, store, 1)


@query
def insert_ignore(t):
    first = F.struct("uploaded_at", "filename", "pages")
    files = t.files.withColumn("at", first)
    target = files.where("session_id % 2 = 0").groupBy("doc_id").agg(F.max("at").alias("x")).select("doc_id", "x.filename")
    store = stored_keys(t, target, "doc_id")
    B.insert_ignore(t.spark, store, 0, files, "at")
    return read(t.spark, store, 1)


@query
def persist_turn(t):
    q = t.questions.select("question_id", "session_id", F.when(F.col("msg_seq") % 4 != 0, F.col("msg_seq")).alias("user_id"), "message", F.lit("ok").alias("response"), F.array(F.struct(F.lit(1).alias("page"), F.lit("t").alias("text"))).alias("citations"))
    return B.persist_turn(q)


@query
def persist_upload(t):
    up = t.documents.select("doc_id", "session_id", F.lit("u").alias("user_id"), "filename", "pages", F.lit(1).alias("chunks_count"), (F.col("no") < 20).alias("is_new"), now().alias("now"))
    sessions, documents = B.persist_upload(up)
    return documents.join(sessions.select("session_id", "title"), "session_id", "left").select("doc_id", "session_id", "filename", "file_path", "title")


@query
def user_sessions(t):
    return B.user_sessions(t.sessions, t.files).select("user_id", "session_id", "session_rank", "doc_id", "doc_rank")


@query
def session_documents(t):
    files = t.files.withColumn("file_path", F.when(F.col("pages") > 10, F.concat(F.lit("/up/"), "filename")))
    return B.session_documents(files, t.sessions).groupBy("session_id", "doc_id").agg(F.min("doc_rank").alias("doc_rank"), F.min("file_path").alias("file_path"))


@query
def session_messages(t):
    m = t.messages.withColumns({"created_at": F.timestamp_seconds(F.col("msg_seq") * 60), "citations": F.when(F.col("msg_seq") % 2 == 1, '[{"page":3,"text":"t"}]')})
    return B.session_messages(m, t.messages).select("id", "n", F.get("citations", F.lit(0))["page"].alias("page"))


def session_requests(t: Tables) -> DataFrame:
    """Requests of which each second one is by the owner."""
    return t.sessions.select("session_id", (F.col("user_id") + F.col("session_id") % 2).alias("user_id"))


@query
def owned_messages(t):
    return B.owned_messages(session_requests(t), t.sessions, t.files.select("session_id", "doc_id")).groupBy("session_id").agg(F.count("*").alias("n"))


@query
def refused_requests(t):
    return B.owned(session_requests(t), t.sessions)[1]


@query
def delete_cascade(t):
    gone = B.owned(session_requests(t).where("session_id % 3 = 0"), t.sessions)[0]
    s, d, m = B.delete_cascade(t.sessions, t.files, t.messages, gone)
    return named(sessions=s.select(F.col("session_id").alias("key")), documents=d.select(F.col("doc_id").alias("key")), messages=m.select(F.col("id").alias("key")))


@query
def delete_user_cascade(t):
    u, s, d, m = B.delete_user_cascade(t.users, t.sessions, t.files, t.messages, t.users.where("id % 4 = 1").select(F.col("id").alias("user_id")))
    return named(users=u.select(F.col("id").alias("key")), sessions=s.select(F.col("session_id").alias("key")), documents=d.select(F.col("doc_id").alias("key")), messages=m.select(F.col("id").alias("key")))


def named(**tables: DataFrame) -> DataFrame:
    """The rows of tables of the same columns under one another, with the name of their table; key as a string."""
    out = [rows.withColumn("key", F.col("key").cast("string")).withColumn("name", F.lit(name)) for name, rows in tables.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query
def delete_document_rows(t):
    return B.delete_document_rows(t.files, t.files.where("pages > 10")).select("doc_id", "filename")


@query
def touch_last_activity(t):
    return B.touch_last_activity(t.sessions, t.files.select("session_id", F.col("uploaded_at").alias("created_at"))).select("session_id", "last_activity")


@query
def expire_inactive(t):
    kept, gone = B.expire_inactive(t.sessions, F.lit("1997-06-01 01:00:00").cast("timestamp"))
    return named(kept=kept.select(F.col("session_id").alias("key")), gone=gone.select(F.col("session_id").alias("key")))


@query
def clear_messages(t):
    clears = t.messages.where("msg_seq in (1, 3) and session_id % 2 = 0").select("session_id", F.col("msg_seq").alias("clear_seq"))
    return B.clear_messages(t.messages, clears).select("id")


@query
def clear_sessions(t):
    """Sessions of which those of even ids are cleared a day or more after 1997 began."""
    clears = t.messages.where("msg_seq in (1, 3) and session_id % 2 = 0").select("session_id", F.col("msg_seq").alias("clear_seq"), F.timestamp_seconds(F.lit(852076800) + F.col("msg_seq") * 86400).cast("timestamp_ntz").alias("created_at"))
    return B.clear_sessions(t.sessions, t.messages, clears)[0].select("session_id", "last_activity")


def attach_case(t: Tables):
    w = Window.partitionBy("session_id").orderBy("doc_id")
    current = t.files.where("pages <= 25").select("session_id", "doc_id").distinct().withColumn("doc_pos", F.row_number().over(w) - 1)
    batch = t.files.where("pages > 20").select("session_id", "doc_id", (F.col("pages") * 1_000_000 + F.unix_date(F.to_date("uploaded_at"))).alias("seq")).distinct()
    return current, batch


@query
def attach_documents(t):
    return B.attach_documents(*attach_case(t))[0]


@query
def attach_to_sessions(t):
    current, batch = attach_case(t)
    at = t.files.where("pages > 20").groupBy("session_id", "doc_id").agg(F.max("uploaded_at").alias("created_at"))
    return B.attach_to_sessions(t.sessions, current, batch.join(at, ["session_id", "doc_id"]))[0].select("session_id", "last_activity")


@query
def attach_refused(t):
    return B.attach_documents(*attach_case(t))[1]


@query
def detach_documents(t):
    current, batch = attach_case(t)
    return B.detach_documents(current, batch)[0]


@query
def detach_refused(t):
    current, batch = attach_case(t)
    return B.detach_documents(current, batch)[1]


@query
def session_document_count(t):
    return B.session_document_count(t.session_documents)


@query
def session_history(t):
    m = t.messages.withColumn("session_id", F.concat(F.lit("src"), (F.col("session_id") % 20).cast("string")))
    return B.session_history(m, t.text_sessions, t.documents).select("id", "session_id", "role", "filename", "pages")


@query
def document_store(t):
    v = t.files.select("doc_id", F.col("filename").alias("text"), F.when(F.col("pages") > 10, F.col("uploaded_at")).alias("created_at"), F.struct("uploaded_at", "filename", "pages").alias("seq"))
    return B.document_store(v, now()).select("doc_id", "text", "created_at", "updated_at")


def registrations(t: Tables) -> DataFrame:
    c = t.read("customer")
    n = F.col("c_custkey") % 6
    email = F.when(n == 0, "").when(n == 1, "no-at-sign").when(n == 2, F.format_string("c%d@example.com", "c_custkey")).otherwise(F.format_string("new%d@example.com", F.floor(F.col("c_custkey") / 12)))
    return c.select(email.alias("email"), F.when(n == 3, "short").otherwise("long enough").alias("password"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))


@query
def register_users(t):
    return B.register_users(t.users, registrations(t))[0]


@query
def register_refused(t):
    return B.register_users(t.users, registrations(t))[1]


@query
def lookup_users(t):
    return B.lookup_users(t.users, registrations(t))


@query
def constraint_audit(t):
    users = t.users.withColumn("email", F.when(F.col("id") % 50 == 0, None).otherwise(F.format_string("c%d@example.com", F.floor(F.col("id") / 2))))
    broken = D.constraint_audit({"users": users, "sessions": t.sessions.where("session_id % 7 != 0"), "documents": t.files, "messages": t.messages})
    rows = F.when(F.col("rule").endswith("repeated"), 1).otherwise(F.col("n"))
    return broken.groupBy("rule").agg(F.sum(rows).alias("n"), F.min("key").alias("least"))


@query
def relative_date(t):
    noon = F.lit("1997-06-05 12:00:00").cast("timestamp")
    return t.sessions.select("session_id", B.relative_date(F.col("last_activity").cast("timestamp"), noon).alias("label"))


@query
def session_title(t):
    title = F.when(F.col("session_id") % 3 == 0, "").when(F.col("session_id") % 3 == 1, F.col("title"))
    return t.sessions.select("session_id", B.session_title(title).alias("title"))


# Text rules


@query
def text_fields(t):
    return t.documents.select("doc_id", F.size(fields("text")).alias("n"), F.octet_length("text").alias("bytes"))


@query
def text_cuts(t):
    return t.documents.select("doc_id", byte_prefix("text", 100).alias("head"), F.md5(trim_space(F.concat(F.lit("  \n"), "text", F.lit("\t ")))).alias("trimmed"))


# Streams: all that is there is read, and the result returned


@query
def stream_chunks(t):
    docs = S.read_stream(t.spark, t.sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return S.drained(S.stream_chunks(docs).select("doc_id", "chunk_id", "chunk_index")).drop("batch")


@query
def stream_dedup_messages(t):
    """Messages once by id, merged into a store batch by batch."""
    events = S.read_stream(t.spark, t.sf_dir, "events").select(F.floor(F.col("event_id") / 4).cast("string").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    store = Store(shared_path(t.spark, "store"), "id string, created_at timestamp", ["id"], buckets=16)
    create(store, t.spark.createDataFrame([], store.schema))
    batches = []
    sink = S.merge_messages(store)

    def counted(rows, batch):
        sink(rows, batch)
        batches.append(batch)

    S.run_all(S.stream_dedup_messages(events, delay="60 days"), counted)
    return read(t.spark, store, max(batches, default=-1) + 1).select("id")


@query
def stream_last_activity(t):
    events = S.read_stream(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return S.latest_versions(S.drained(S.stream_last_activity(events), "update"))


@query
def stream_sessions(t):
    """Spells over by the end of the stream."""
    events = S.read_stream(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drained(S.stream_sessions(events)).drop("batch")


STATE_IDLE = 2 * 86_400


def session_actions(events: DataFrame) -> DataFrame:
    """Kinds of events stand for actions on the session of their user."""
    kind, third = F.col("event_type"), F.col("event_id") % 3
    action = F.when(kind == "signup", "create").when(kind == "view", "message").when(kind == "error", "detach")
    action = action.when((kind == "purchase") & (third == 0), "clear").when((kind == "purchase") & (third == 1), "delete").otherwise("attach")
    doc = F.when(~action.isin("message", "clear", "delete"), F.concat(F.lit("d"), (F.col("event_id") % 5).cast("string")))
    return events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), action.alias("action"), doc.alias("doc_id"))


@query
def stream_session_state(t):
    """Sessions alive at the end of the log, with an idle limit of two days, and all actions that were refused."""
    with Q.rocksdb(t.spark):
        seen = S.drained(Q.stream_session_state(session_actions(S.read_stream(t.spark, t.sf_dir, "events")), "0 seconds", STATE_IDLE), "update")
    end = t.activity.agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    live = Q.live_sessions(seen, end, STATE_IDLE).select("session_id", "seq", F.lit("state").alias("outcome"), "n_messages", joined("documents").alias("documents"), F.unix_micros("last_activity").alias("last_us"))
    refused = seen.where("kind = 'refused'").select("session_id", "seq", F.col("reason").alias("outcome"), F.lit(None).cast("long").alias("n_messages"), F.lit(None).cast("string").alias("documents"), F.lit(None).cast("long").alias("last_us"))
    return live.unionByName(refused)


# Figures


@query
def docs_per_user(t):
    return M.docs_per_user(t.files, t.sessions)


@query
def weekly_active_share(t):
    activity = t.activity.select(F.col("session_id").alias("user_id"), "ts")
    return M.weekly_active_share(activity, activity)


@query
def upload_success_rate(t):
    return M.upload_success_rate(t.pages.select(F.when(F.col("text").isNull(), "PDF_PROCESSING_ERROR").alias("error")))


@query
def answer_found_rate(t):
    return M.answer_found_rate(verdicts(t).select(A.answer_found_b(F.col("answer")).alias("answer_found")))


@query
def monthly_quota(t):
    docs = t.files.join(t.sessions.select("session_id", "user_id"), "session_id").select("user_id", F.col("uploaded_at").alias("ts"))
    return M.monthly_quota(docs, t.sessions.select("user_id", F.col("created_at").alias("ts")))


#: Earlier names of queries that take whole tables.
for _name, _now in (("user_sessions_all", "user_sessions"), ("session_documents_all", "session_documents"), ("session_messages_all", "session_messages"), ("weekly_active_share_counted", "weekly_active_share")):
    QUERIES[_name] = QUERIES[_now]

"""The session, document, message and user tables: merges, reads with owner checks, cascades, expiry, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.sources.stores import Store, merge

IDLE_SECONDS = 3600


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an arrival column."""
    return _one(rows, keys, F.max_by, order)


def first_arrival(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _one(rows, keys, F.min_by, order)


def _one(rows: DataFrame, keys: list[str], pick, order: str) -> DataFrame:
    """An aggregate that map tasks begin, in place of a sort of all rows; an order that is null comes first."""
    one = rows.groupBy(*keys).agg(pick(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), F.struct(order)).alias("_row"))
    return one.select("_row.*")


def newer(old: Column, new: Column) -> Column:
    return new


def upsert_sessions(spark: SparkSession, store: Store, version: int, batch: DataFrame, order: str) -> set[int]:
    """Insert by id; an existing session takes title and last_activity of the batch only, of several rows the last.

    Writes version + 1 of the store, of the buckets that the batch touches, and returns those.
    """
    return merge(spark, store, version, latest(batch, store.keys, order), {"title": newer, "last_activity": newer})


def insert_ignore(spark: SparkSession, store: Store, version: int, batch: DataFrame, order: str) -> set[int]:
    """Rows of batch whose key isn't in the store yet; of several the first to arrive. Writes version + 1 of the buckets that get
    a row, and returns those."""
    return merge(spark, store, version, first_arrival(batch, store.keys, order))


def persist_turn(answers: DataFrame) -> DataFrame:
    """(question_id, session_id, user_id, message, response, citations) -> two message rows for signed-in users."""
    user = F.struct(F.concat("question_id", F.lit(":u")).alias("id"), F.lit("user").alias("role"), F.col("message").alias("content"), F.lit(None).cast("string").alias("citations"))
    reply = F.struct(F.concat("question_id", F.lit(":a")).alias("id"), F.lit("assistant").alias("role"), F.col("response").alias("content"), F.to_json("citations").alias("citations"))
    return answers.where("user_id is not null").select("session_id", F.explode(F.array(user, reply)).alias("x")).select("session_id", "x.*")


def persist_upload(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, session_id, user_id, filename, pages, chunks_count, is_new, now) -> session rows and document rows."""
    sessions = uploads.where("is_new").select("session_id", "user_id", F.col("filename").alias("title"), F.col("now").alias("created_at"), F.col("now").alias("last_activity"))
    documents = uploads.select("doc_id", "session_id", "filename", F.lit("").alias("file_path"), "pages", "chunks_count", F.col("now").alias("uploaded_at"))
    return sessions, documents


def user_sessions(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """Flat dashboard: sessions of each user, latest first, with their documents in order of upload; empty ones stay."""
    by_user = Window.partitionBy("user_id").orderBy(F.desc("last_activity"), "session_id")
    by_session = Window.partitionBy("session_id").orderBy("uploaded_at", "doc_id")
    own = sessions.withColumn("session_rank", F.row_number().over(by_user))
    docs = documents.withColumn("doc_rank", F.row_number().over(by_session)).select("session_id", "doc_id", "doc_rank")
    return own.join(docs, "session_id", "left")


def session_documents(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents of the requested sessions in order of upload; a missing path is empty."""
    w = Window.partitionBy("session_id").orderBy("uploaded_at", "doc_id")
    out = documents.join(requests.select("session_id").distinct(), "session_id", "left_semi")
    return out.withColumns({"file_path": F.coalesce("file_path", F.lit("")), "doc_rank": F.row_number().over(w)})


def session_messages(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of the requested sessions in order, citations parsed."""
    w = Window.partitionBy("session_id").orderBy("created_at", "msg_seq")
    out = messages.join(requests.select("session_id").distinct(), "session_id", "left_semi")
    return out.withColumns({"citations": F.from_json("citations", "array<struct<page:int,text:string>>"), "n": F.row_number().over(w)})


def owned(requests: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests of the owner of a session, requests refused)."""
    keys = ["session_id", "user_id"]
    return requests.join(sessions.select(*keys), keys, "left_semi"), requests.join(sessions.select(*keys), keys, "left_anti")


def owned_messages(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return messages.join(owned(requests, sessions)[0].select("session_id").distinct(), "session_id", "left_semi")


def delete_cascade(sessions: DataFrame, documents: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sessions of gone and what belongs to them."""
    ids = gone.select("session_id").distinct()
    return tuple(t.join(ids, "session_id", "left_anti") for t in (sessions, documents, messages))


def delete_user_cascade(users, sessions, documents, messages, gone: DataFrame):
    """The four tables without the users of gone (user_id) and all that is theirs."""
    ids = gone.select("user_id").distinct()
    rest = delete_cascade(sessions, documents, messages, sessions.join(ids, "user_id", "left_semi"))
    return users.join(ids, users["id"] == ids["user_id"], "left_anti"), *rest


def delete_document_rows(documents: DataFrame, gone: DataFrame) -> DataFrame:
    return documents.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def touch_last_activity(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    return sessions.join(last, "session_id", "left").withColumn("last_activity", F.greatest("last_activity", "_last")).drop("_last")


def expire_inactive(sessions: DataFrame, now: Column, idle: int = IDLE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(sessions that stay, sessions idle for longer); in whole seconds, strictly."""
    old = F.unix_timestamp("last_activity") < F.unix_timestamp(now) - idle
    return sessions.where(~old), sessions.where(old)


def clear_messages(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """Messages after the last clearing (session_id, clear_seq) of their session."""
    last = clears.groupBy("session_id").agg(F.max("clear_seq").alias("_clear"))
    return messages.join(last, "session_id", "left").where("_clear is null or msg_seq > _clear").drop("_clear")


def clear_sessions(sessions: DataFrame, messages: DataFrame, clears: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clears (session_id, clear_seq, created_at) -> (sessions with the clearing as activity, messages that stay)."""
    return touch_last_activity(sessions, clears), clear_messages(messages, clears)


def _attachable(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batch with _n, its number among requests of its link; those of _n = 1 whose link isn't there yet)."""
    keys = ["session_id", "doc_id"]
    ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    return ranked, ranked.where("_n = 1").join(current.select(*keys), keys, "left_anti")


def attach_documents(current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """current (session_id, doc_id, doc_pos) and batch (session_id, doc_id, seq) -> (links, duplicates refused).

    Requests of one seq enter their session by doc_id, so that positions are the same on every run.
    """
    keys = ["session_id", "doc_id"]
    ranked, new = _attachable(current, batch)
    refused = ranked.join(new.select(*keys, "seq"), [*keys, "seq"], "left_anti").drop("_n")
    size = current.groupBy("session_id").agg((F.max("doc_pos") + 1).alias("_size"))
    place = F.coalesce("_size", F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "doc_id")) - 1
    added = new.join(size, "session_id", "left").select(*keys, place.cast("int").alias("doc_pos"))
    return current.select(*keys, "doc_pos").unionByName(added), refused


def attach_to_sessions(sessions: DataFrame, current: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """batch (session_id, doc_id, seq, created_at) -> (sessions with what was attached as activity, links, duplicates refused).

    A refused request leaves its session as it was.
    """
    return touch_last_activity(sessions, _attachable(current, batch)[1]), *attach_documents(current, batch)


def detach_documents(current: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that stay, requests whose link isn't there)."""
    keys = ["session_id", "doc_id"]
    return current.join(gone.select(*keys).distinct(), keys, "left_anti"), gone.join(current.select(*keys), keys, "left_anti")


def session_document_count(documents: DataFrame) -> DataFrame:
    """session_id, n_documents, doc_id, filename, pages: a row a document, with the number of documents of its session.

    Numbers are broadcast or joined as Spark sees fit; no session is gathered.
    """
    n = documents.groupBy(F.col("session_id").alias("_session")).agg(F.count("*").alias("n_documents"))
    out = documents.join(n, F.col("session_id").eqNullSafe(F.col("_session")))
    return out.select("session_id", "n_documents", "doc_id", "filename", "pages")


def session_history(messages: DataFrame, sessions: DataFrame, docs: DataFrame) -> DataFrame:
    """Messages with the primary document of their session."""
    head = sessions.select("session_id", F.col("primary_doc_id").alias("doc_id")).join(docs.select("doc_id", "filename", "pages"), "doc_id", "left")
    return messages.join(head.select("session_id", "filename", "pages"), "session_id")


def document_store(versions: DataFrame, now: Column) -> DataFrame:
    """(doc_id, text, created_at, seq): the last version of each document; created_at as it came, else now."""
    return latest(versions, ["doc_id"], "seq").withColumns({"created_at": F.coalesce("created_at", now), "updated_at": now})


def register_users(users: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """batch (email, password, name, seq) -> (new users, refused with a reason)."""
    reason = F.when(F.coalesce(F.col("email"), F.lit("")) == "", "email required").when(~F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email malformed")
    reason = reason.when(F.coalesce(F.length("password"), F.lit(0)) < 6, "password too short")
    rated = batch.withColumn("reason", reason)
    good = rated.where("reason is null")
    ranked = good.withColumn("_n", F.row_number().over(Window.partitionBy("email").orderBy("seq")))
    taken = users.select("email", F.lit(True).alias("_taken")).distinct()
    ranked = ranked.join(taken, "email", "left")
    fresh = F.coalesce(F.col("_n") == 1, F.lit(False)) & F.col("_taken").isNull()
    new = ranked.where(fresh).select("email", "name", "seq")
    dup = ranked.where(~fresh).select("email", "seq", F.lit("email present").alias("reason"))
    return new, rated.where("reason is not null").select("email", "seq", "reason").unionByName(dup)


def lookup_users(users: DataFrame, requests: DataFrame, key: str = "email") -> DataFrame:
    """Users by exact email or id, without the password hash."""
    return users.join(requests.select(key).distinct(), key, "left_semi").drop("password_hash")


def relative_date(ts: Column, now: Column) -> Column:
    days = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(ts, "M/d/yyyy"))


def session_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Session"))

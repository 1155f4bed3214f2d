"""Answers and summaries: parsing, verdicts, mock rules, takeaways, topics, streamed pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import TOKEN_RE, fields, ordered_join, trim_space

# Fixed values.
NOT_FOUND_A = ("cannot find", "not in the document")
NOT_FOUND_B = ("not found", "not available", "cannot find")
MOCK_FOUND = (
    "Based on the document, ",
    ". The document mentions relevant information about this topic. [This is a mock response - connect to a real AI "
    "service for actual answers.]",
)
MOCK_NOT_FOUND = "I cannot find this information in the document. [Mock response - connect to a real AI service for actual answers.]"
MOCK_SUMMARY = """Summary:
This document contains approximately %d words covering various topics.

Key Takeaways:
• This is a mock summary generated for development/testing purposes
• Connect to a real AI service (Puter AI) for actual summaries
• The document appears to contain structured information

Main Topics:
• Document Analysis
• Information Extraction
• Mock Data Processing"""
MOCK_TAKEAWAYS = ("This is a mock summary - connect to real AI for actual content", "Document contains structured information", "Approximately %d words processed")
MOCK_TOPICS = ("Document Analysis", "Information Extraction", "Mock Processing")
COMPLETION = (
    "id string, object string, created long, model string, "
    "choices array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, error struct<message:string>"
)


def parse_completion(rows: DataFrame, body: str = "body", reads_errors: bool = True, trims: bool = False) -> DataFrame:
    """rows with answer and error. reads_errors: an error message in the body counts; trims: the answer is trimmed."""
    parsed = F.from_json(body, COMPLETION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    whole = F.from_json(body, COMPLETION + ", corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    out = rows.withColumns({"c": parsed, "bad": F.col(body).isNull() | whole["corrupt"].isNotNull()})
    message = F.when(F.lit(reads_errors), F.col("c.error.message"))
    error = F.when(F.col("bad"), "malformed").when(message.isNotNull(), message).when(F.coalesce(F.size("c.choices"), F.lit(0)) <= 0, "no choices")
    content = F.coalesce(F.get("c.choices", F.lit(0))["message"]["content"], F.lit(""))
    answer = trim_space(content) if trims else content
    return out.withColumns({"error": error, "answer": F.when(error.isNull(), answer)}).drop("c", "bad")


def answer_found_a(answer: Column) -> Column:
    low = F.lower(answer)
    return ~(F.contains(low, F.lit(NOT_FOUND_A[0])) | F.contains(low, F.lit(NOT_FOUND_A[1])))


def answer_found_b(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(True)
    for phrase in NOT_FOUND_B:
        out = out & ~F.contains(low, F.lit(phrase))
    return out


def mock_found(context: Column, question: Column) -> Column:
    """Whether a word of over three bytes of the question is in the context."""
    low = F.lower(context)
    return F.exists(fields(F.lower(question)), lambda w: (F.octet_length(w) > 3) & F.contains(low, w))


def mock_answer(found: Column, question: Column) -> Column:
    return F.when(found, F.concat(F.lit(MOCK_FOUND[0]), question, F.lit(MOCK_FOUND[1]))).otherwise(MOCK_NOT_FOUND)


def mock_summary(text: Column) -> Column:
    n = F.size(fields(text))
    takeaways = [F.format_string(t, n) if "%d" in t else F.lit(t) for t in MOCK_TAKEAWAYS]
    return F.struct(F.format_string(MOCK_SUMMARY, n).alias("summary"), F.array(*takeaways).alias("key_takeaways"), F.array(*map(F.lit, MOCK_TOPICS)).alias("main_topics"))


def extract_takeaways(summary: Column) -> Column:
    lines = F.filter(F.transform(F.split(summary, "\n"), trim_space), lambda x: x.startswith("•") | x.startswith("-"))
    marked = F.filter(F.transform(lines, lambda x: trim_space(F.regexp_replace(F.regexp_replace(x, "^•", ""), "^-", ""))), lambda x: x != "")
    pieces = F.transform(F.slice(F.split(summary, r"\."), 1, 3), trim_space)
    sentences = F.transform(F.filter(pieces, lambda x: F.octet_length(x) > 20), lambda x: F.concat(x, F.lit(".")))
    return F.when(F.size(marked) > 0, marked).otherwise(sentences)


def extract_topics(summary: Column) -> Column:
    lines = F.transform(F.split(summary, "\n"), lambda x: F.lower(trim_space(x)))
    named = F.filter(lines, lambda x: F.contains(x, F.lit("topic")) | F.contains(x, F.lit("theme")))
    parts = F.transform(named, lambda x: F.coalesce(trim_space(F.get(F.split(x, ":"), F.lit(1))), F.lit("")))
    topics = F.filter(parts, lambda x: x != "")
    bare = F.transform(fields(summary), lambda w: F.regexp_replace(w, "^[.,!?;:]+|[.,!?;:]+$", ""))
    capital = F.slice(F.filter(bare, lambda w: (F.octet_length(w) > 3) & w.rlike(r"^[\x00-\x60\x7B-\x7F]")), 1, 3)
    return F.when(F.size(topics) > 0, topics).otherwise(capital)


def session_summaries(requests: DataFrame, sessions: DataFrame, docs: DataFrame) -> DataFrame:
    """A summary of the primary document of each requested session, or an error code."""
    known = sessions.select("session_id", F.col("primary_doc_id").alias("doc_id"), F.lit(True).alias("known"))
    out = requests.select("session_id").join(known, "session_id", "left").join(docs.select("doc_id", "text"), "doc_id", "left")
    made = mock_summary(F.col("text"))
    error = F.when(F.col("known").isNull(), "SESSION_NOT_FOUND").when(F.col("text").isNull(), "DOCUMENT_NOT_FOUND")
    return out.withColumns({"made": made, "error": error}).select(
        "session_id", *(F.when(F.col("error").isNull(), F.col(f"made.{x}")).alias(x) for x in ("summary", "key_takeaways", "main_topics")), "error"
    )


def token_groups(rows: DataFrame, text: str) -> DataFrame:
    """rows with pos and piece: three words and the white space before and between them at a time; all join to the text."""
    rest = [c for c in rows.columns if c != text]
    return rows.select(*rest, F.posexplode(F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0))).alias("pos", "piece"))


def parse_stream_log(log: DataFrame) -> DataFrame:
    """stream_id, line_no, kind (token, done, error), value of the event lines that hold JSON with a known key."""
    data = F.from_json(F.substring("line", 7, 2**31 - 1), "content string, response string, message string")
    out = log.where(F.col("line").startswith("data: ")).withColumn("d", data)
    kind = F.when(F.col("d.content").isNotNull(), "token").when(F.col("d.response").isNotNull(), "done").when(F.col("d.message").isNotNull(), "error")
    return out.select("stream_id", "line_no", kind.alias("kind"), F.coalesce("d.content", "d.response", "d.message").alias("value")).where("kind is not null")


def reassemble_stream(events: DataFrame) -> DataFrame:
    """stream_id, text of its tokens in order, whether it equals the response at its end."""
    tokens = events.withColumn("token", F.when(F.col("kind") == "token", F.col("value")))
    out = tokens.groupBy("stream_id").agg(ordered_join("line_no", F.coalesce("token", F.lit(""))).alias("text"), F.max(F.when(F.col("kind") == "done", F.col("value"))).alias("response"))
    return out.select("stream_id", "text", F.coalesce(F.col("text") == F.col("response"), F.lit(False)).alias("complete"))

"""Histories, prompts and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import cut
from marginalia.operators.histories import history_blocks, with_history

# Fixed values.
INSTRUCTION = (
    "Answer the question based ONLY on the document context above. If the answer is not in the context, "
    "respond with: 'I cannot find this information in the document.'"
)
SUMMARY_TEMPLATE = """Please provide a comprehensive summary of the following document in bullet point format.

Include:
1. Main topics and themes
2. Key takeaways
3. Important details

Document:
%s

Format your response as:
- Summary: [brief overview]
- Key Takeaways:
  • [takeaway 1]
  • [takeaway 2]
- Main Topics:
  • [topic 1]
  • [topic 2]"""
SYSTEM_HEAD = "You are an AI assistant helping users understand and analyze PDF documents. \n\nHere is the content of the PDF document:\n\n"
SYSTEM_TAIL_SINGLE = (
    "\n\nPlease answer questions about this document accurately and helpfully. If the answer is not found in the "
    "document, clearly state that the information is not available in the provided PDF."
)
SYSTEM_TAIL_CHAT = (
    "\n\nPlease answer questions about this document accurately and helpfully. Maintain context from previous messages "
    "in this conversation. If the answer is not found in the document, clearly state that the information is not "
    "available in the provided PDF."
)
SUMMARY_SYSTEM = (
    "You are an AI assistant that creates concise, informative summaries of PDF documents. Focus on the main points, "
    "key findings, and important details."
)
SUMMARY_USER = "Please provide a comprehensive summary of the following PDF content:\n\n"
CHAT_BYTES, CHAT_SUFFIX = 100000, "\n... [content truncated due to length]"
PROMPT_BYTES, PROMPT_SUFFIX = 8000, "..."
SUMMARY_BYTES, SUMMARY_SUFFIX = 12000, "... [content truncated]"
MODEL = "llama-3.3-70b-versatile"
CHAT_LIMITS, SUMMARY_LIMITS = (1000, 0.7), (500, 0.5)
LAST = 4


def history_lines(messages: DataFrame, last: int | None = None) -> DataFrame:
    """For each user message its id, session_id, msg_seq, content and history: lines of earlier messages (the last few).

    Roles other than user and assistant are dropped before lines are counted. The full history grows with the session; where
    no text is written, `histories.history_blocks` keeps it in rows that grow with the messages.
    """
    return with_history(*history_blocks(messages), last).drop("n_lines")


def question_prompt(context: Column, history: Column, question: Column) -> Column:
    """history: at most the last four lines are used."""
    lines = F.array_join(F.transform(F.slice(history, F.greatest(F.size(history) - LAST + 1, F.lit(1)), LAST), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    before = F.when(F.size(history) > 0, F.concat(F.lit("Previous conversation:\n"), lines, F.lit("\n"))).otherwise("")
    return F.concat(context, F.lit("\n\n"), before, F.lit("Question: "), question, F.lit("\n\n" + INSTRUCTION))


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def chat_messages_array(text: Column, history: Column, question: Column) -> Column:
    """System prompt, full history with roles by position, and the question."""
    system = message("system", F.concat(F.lit(SYSTEM_HEAD), cut(text, CHAT_BYTES, CHAT_SUFFIX), F.lit(SYSTEM_TAIL_CHAT)))
    turns = F.transform(history, lambda x, i: message(F.when(i % 2 == 1, "assistant").otherwise("user"), x))
    return F.concat(F.array(system), turns, F.array(message("user", question)))


def chat_single_turn(text: Column, question: Column) -> Column:
    return F.array(message("system", F.concat(F.lit(SYSTEM_HEAD), text, F.lit(SYSTEM_TAIL_SINGLE))), message("user", question))


def summary_prompt(text: Column) -> Column:
    head, tail = SUMMARY_TEMPLATE.split("%s")
    return F.concat(F.lit(head), cut(text, PROMPT_BYTES, PROMPT_SUFFIX), F.lit(tail))


def summary_messages(text: Column) -> Column:
    return F.array(message("system", F.lit(SUMMARY_SYSTEM)), message("user", F.concat(F.lit(SUMMARY_USER), cut(text, SUMMARY_BYTES, SUMMARY_SUFFIX))))


def explain_prompt(page: Column, text: Column) -> Column:
    where = F.coalesce(F.nullif(page, F.lit(0)).cast("string"), F.lit("unknown"))
    return F.concat(F.lit("Please explain the following text from page "), where, F.lit(':\n\n"'), text, F.lit('"'))


def explain_preview(text: Column) -> Column:
    return F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)


def inference_request(messages: Column, limits: tuple[int, float] = CHAT_LIMITS, model: str = MODEL) -> Column:
    """A request body as JSON; a stream flag of false is left out."""
    return F.to_json(F.struct(messages.alias("messages"), F.lit(model).alias("model"), F.lit(limits[0]).alias("max_tokens"), F.lit(limits[1]).alias("temperature")))

"""Histories as shared blocks: each line is stored once, and a question holds a number in place of a copy of what was said.

The lines of a session are numbered, and every `size` of them in a row are a block. The history of a question is the lines of
numbers below its own: whole blocks and the head of one more, which `with_history` fetches by their numbers where a text is
written. So what is kept grows with the messages, not with their square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.numbering import numbered

#: Lines of a block.
BLOCK = 32
#: Values of msg_seq whose messages are numbered in one task.
RANGE = 1024


def numbered_lines(messages: DataFrame, span: int = RANGE) -> DataFrame:
    """id, session_id, msg_seq, role, content, pos of the messages of users and assistants, by msg_seq, then id."""
    own = messages.where(F.col("role").isin("user", "assistant")).select("id", "session_id", "msg_seq", "role", "content")
    return numbered(own, "session_id", "msg_seq", "id", span)


def history_blocks(messages: DataFrame, size: int = BLOCK, span: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(id, session_id, msg_seq, content, n_lines of each user message; session_id, block, lines).

    n_lines is the number of lines before the message. A message without content has a null line, which counts in n_lines.
    """
    lines = numbered_lines(messages, span)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "content")
    held = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    blocks = lines.groupBy("session_id", F.floor(F.col("pos") / size).alias("block")).agg(F.transform(held, lambda x: x["line"]).alias("lines"))
    return lines.where("role = 'user'").select("id", "session_id", "msg_seq", "content", F.col("pos").alias("n_lines")), blocks


def with_history(questions: DataFrame, blocks: DataFrame, last: int | None = None, size: int = BLOCK) -> DataFrame:
    """questions (session_id and n_lines together unique) with history: the n_lines lines before each, or the last few of them.

    Null lines are left out. Only the blocks that a question needs are fetched: one or two for the last few lines.
    """
    first = F.lit(0).cast("long") if last is None else F.greatest(F.col("n_lines") - last, F.lit(0))
    needed = F.when(F.col("n_lines") > 0, F.sequence(F.floor(first / size), F.floor((F.col("n_lines") - 1) / size)))
    wanted = questions.withColumn("_block", F.explode_outer(needed))
    held = blocks.select(F.col("session_id").alias("_session"), F.col("block").alias("_held"), "lines")
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_block") == F.col("_held"))
    rest = [c for c in questions.columns if c not in ("session_id", "n_lines")]
    found = wanted.join(held, same, "left").groupBy("session_id", "n_lines").agg(
        *(F.first(F.col(f"`{c}`")).alias(c) for c in rest), F.array_sort(F.collect_list(F.struct("_block", "lines"))).alias("_lines")
    )
    own = F.flatten(F.transform(F.filter("_lines", lambda x: x["lines"].isNotNull()), lambda x: x["lines"]))
    history = F.filter(F.slice(own, (first % size + 1).cast("int"), (F.col("n_lines") - first).cast("int")), lambda x: x.isNotNull())
    return found.select(*(F.col(f"`{c}`") for c in questions.columns), history.alias("history"))

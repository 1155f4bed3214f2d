"""The rules of the stored tables, checked together: each table is read once, and one shuffle carries the keys of all rules.

A row leaves marks (rule, key): as an owner of the key, where the key must be unique or where other tables refer to it; as one that
refers to it; or as a row that breaks a rule by itself. Marks are counted by rule and key, in the map tasks first, so that
a key that a third of all rows share is one number of each task. A rule's own counts can be had from the same pass as observations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """table.column and what it must be: by itself (broken: a condition of a row that breaks it, named by key), unique, or a
    value of owner (table, column)."""

    table: str
    column: str
    fault: str
    broken: str | None = None
    key: str | None = None
    owner: tuple[str, str] | None = None

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column} {self.fault}"


RULES = (
    Rule("users", "email", "null", broken="email is null", key="id"),
    Rule("users", "id", "repeated"),
    Rule("users", "email", "repeated"),
    Rule("sessions", "session_id", "repeated"),
    Rule("sessions", "user_id", "orphan", owner=("users", "id")),
    Rule("documents", "filename", "null", broken="filename is null", key="doc_id"),
    Rule("documents", "doc_id", "repeated"),
    Rule("documents", "session_id", "orphan", owner=("sessions", "session_id")),
    Rule("messages", "role", "unknown", broken="role not in ('user', 'assistant')", key="id"),
    Rule("messages", "content", "null", broken="content is null", key="id"),
    Rule("messages", "id", "repeated"),
)


def _mark(rule: Rule, key: str, owns: bool) -> Column:
    return F.struct(F.lit(rule.name).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(owns).alias("owns"))


def _marks(name: str, rows: DataFrame, rules: tuple[Rule, ...], observation: Observation | None) -> DataFrame:
    """rule, key, owns of the rows of a table."""
    alone = [r for r in rules if r.table == name and r.broken]
    marks = [F.when(F.expr(r.broken), _mark(r, r.key, False)) for r in alone]
    marks += [_mark(r, r.column, r.owner is None) for r in rules if r.table == name and not r.broken]
    marks += [_mark(r, r.owner[1], True) for r in rules if r.owner and r.owner[0] == name]
    if observation is not None:
        rows = rows.observe(observation, F.count("*").alias("rows"), *(F.count_if(F.expr(r.broken)).alias(r.name) for r in alone))
    return rows.select(F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull())))


def constraint_audit(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES, observations: dict[str, Observation] | None = None) -> DataFrame:
    """rule, key (a string), n: the keys that break a rule and how many rows do so with each.

    Row rules give the key of the row; a repeated key counts all rows that share it, a null key among them; an orphan is a
    reference without an owner, and a null reference has none. A condition that is null isn't broken. observations
    (by table) are given the rows of their table and of each of its row rules once the result has been computed. A table
    without a rule isn't read; of empty ones nothing is broken, but what refers to them is.
    """
    marks = None
    for name in sorted({r.table for r in rules} | {r.owner[0] for r in rules if r.owner}):
        own = _marks(name, tables[name], rules, (observations or {}).get(name))
        marks = own if marks is None else marks.unionByName(own)
    counted = marks.groupBy("rule", "key").agg(F.count_if("owns").alias("owners"), F.count_if(~F.col("owns")).alias("others"))
    unique = F.col("rule").isin(*(r.name for r in rules if not r.broken and not r.owner))
    refers = F.col("rule").isin(*(r.name for r in rules if r.owner))
    lone = F.col("key").isNull() | (F.col("owners") == 0)
    n = F.when(unique, F.when(F.col("owners") > 1, F.col("owners"))).when(refers, F.when(lone & (F.col("others") > 0), F.col("others"))).otherwise(F.col("others"))
    return counted.select("rule", "key", n.alias("n")).where("n is not null")

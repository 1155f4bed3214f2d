"""Rows into database tables by their conflict rules, each partition of a batch once.

A task writes its partition in one transaction, together with a row (query, batch, part) in a table of what was applied. A task
that fails leaves nothing behind; one that runs again, or twice at the same time, finds that row and writes nothing. Rows are dealt by a
hash of their keys over a fixed number of partitions, so a repeated batch has the same partitions; rows of one key are never in two
transactions of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPLIED = "applied_batches"


@dataclass(frozen=True)
class Target:
    """A table, the columns to write, and what happens to a row whose keys are there: `updates` (column -> SQL over the table's name for
    the row that is there and `excluded` for the new one); without any the row that is there stays. Names are put into SQL as they are: they must be the program's own."""

    table: str
    columns: list[str]
    keys: list[str]
    updates: dict[str, str] = field(default_factory=dict)

    def statement(self, mark: str) -> str:
        rule = f"UPDATE SET {', '.join(f'{c} = {to}' for c, to in self.updates.items())}" if self.updates else "NOTHING"
        return f"INSERT INTO {self.table} ({', '.join(self.columns)}) VALUES ({', '.join([mark] * len(self.columns))}) ON CONFLICT ({', '.join(self.keys)}) DO {rule}"


def create_applied(connection) -> None:
    """The table of applied partitions, where it isn't there."""
    connection.cursor().execute(f"CREATE TABLE IF NOT EXISTS {APPLIED} (query VARCHAR(200), batch BIGINT, part INTEGER, PRIMARY KEY (query, batch, part))")
    connection.commit()


def apply_part(connection, target: Target, rows: Iterable, query: str, batch: int, part: int, mark: str = "?", size: int = 1000) -> bool:
    """Writes rows in one transaction, `size` a call; False where this part was applied before."""
    cursor = connection.cursor()
    try:
        cursor.execute(f"INSERT INTO {APPLIED} (query, batch, part) VALUES ({mark}, {mark}, {mark}) ON CONFLICT (query, batch, part) DO NOTHING", (query, batch, part))
        fresh = cursor.rowcount == 1
        if fresh:
            found, statement = iter(rows), target.statement(mark)
            while some := [tuple(r) for r in islice(found, size)]:
                cursor.executemany(statement, some)
        connection.commit()
        return fresh
    except BaseException:
        connection.rollback()
        raise


def write_batch(rows: DataFrame, connect: Callable, target: Target, query: str, batch: int, parts: int = 16, mark: str = "?", size: int = 1000) -> None:
    """A batch into the table. `connect` gives a DB-API connection in a task, outside autocommit; `mark` is the driver's parameter mark; `parts` is
    the number of connections at most, and must stay the same for a query. The batch must give the same rows when it runs again.

    Keys are not compared within the batch: rows of one key are applied one after the other, in no stated order; use `latest` or
    `first_arrival` first. An empty batch is recorded and writes nothing.
    """
    dealt = rows.select(*target.columns).repartition(parts, F.xxhash64(*target.keys))

    def write(own: Iterator) -> None:
        connection = connect()
        try:
            apply_part(connection, target, own, query, batch, TaskContext.get().partitionId(), mark, size)
        finally:
            connection.close()

    dealt.foreachPartition(write)


def database_sink(connect: Callable, target: Target, query: str, **how) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch once, whatever is repeated after a restart."""
    return lambda rows, batch: write_batch(rows, connect, target, query, batch, **how)

"""The state of sessions as a stream of their actions folds it.

State lives in the state store, by session: a value with counts and times, and a map of attached documents, so that an attach
or a detach touches one entry, however many documents a session has. A timer in event time ends an idle session.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

IDLE_SECONDS = 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# What a refused action is told.
NO_SESSION = "session not found: %s"
REPEATED_DOCUMENT = "document already exists in session: %s"
NO_DOCUMENT = "document not found in session: %s"

OUTPUT = "session_id long, kind string, seq long, action string, reason string, last_us long, n_messages long, documents array<string>"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, which maps and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class SessionProcessor(StatefulProcessor):
    """Folds the actions of a session in the order of (ts, seq) within a batch.

    create begins anew, with its document if it names one; message, clear, attach, detach and delete need a session. What a session
    refuses changes nothing, its time neither. A session is over once it has been idle for longer than `idle_us`.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last_us long, n_messages long, next_pos long, timer_ms long")
        self.documents = handle.getMapState("documents", "doc_id string", "pos long")

    def close(self) -> None:
        pass

    def _forget(self, timer_ms: int) -> None:
        if timer_ms >= 0:
            self.handle.deleteTimer(timer_ms)
        self.head.clear()
        self.documents.clear()

    def _listed(self) -> list[str]:
        return [d for (d,), _ in sorted(((k, v[0]) for k, v in self.documents.iterator()), key=lambda x: x[1])]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, out = key[0], []
        head = self.head.get() if self.head.exists() else None
        last, messages, place, timer = head or (None, 0, 0, -1)
        changed = gone = None
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        for seq, us, action, doc in zip(batch["seq"].tolist(), batch["us"].tolist(), batch["action"], batch["doc_id"]):
            if last is not None and us - last > self.idle_us:
                self._forget(timer)
                last, timer, gone = None, -1, seq
            reason = None
            if action == "create":
                self.documents.clear()
                last, messages, place = us, 0, 0
            elif last is None:
                reason = NO_SESSION % session
            elif action == "attach" and self.documents.containsKey((doc,)):
                reason = REPEATED_DOCUMENT % doc
            elif action == "detach" and not self.documents.containsKey((doc,)):
                reason = NO_DOCUMENT % doc
            if reason:
                out.append((session, "refused", seq, action, reason, None, None, None))
                continue
            if action == "delete":
                self._forget(timer)
                last, timer, gone = None, -1, seq
                continue
            if action == "message":
                messages += 1
            elif action == "clear":
                messages = 0
            elif action == "detach":
                self.documents.removeKey((doc,))
            elif doc is not None and action in ("attach", "create"):
                self.documents.updateValue((doc,), (place,))
                place += 1
            last, changed = max(last, us), seq
        if last is None:
            if gone is not None:
                out.append((session, "gone", gone, None, None, None, None, None))
        elif changed is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = (last + self.idle_us) // 1000 + 1
            self.handle.registerTimer(timer)
            self.head.update((last, messages, place, timer))
            out.append((session, "state", changed, None, None, last, messages, self._listed()))
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        if head and head[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.head.clear()
            self.documents.clear()
            yield self._rows([(key[0], "expired", None, None, None, head[0], head[1], None)])

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "Int64" for c in ("session_id", "seq", "last_us", "n_messages")})


def stream_session_state(actions: DataFrame, delay: str = "0 seconds", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """actions (seq, ts, session_id, action, doc_id) -> after each batch, in update mode, by kind:

    state: a session that changed, its counts and its documents in the order of their attachment, with the last action that changed it;
    refused: an action that was refused, and why; gone: a session that was deleted, or found idle by an action;
    expired: a session that its timer ended. Start it within `rocksdb`.
    """
    rows = actions.withWatermark("ts", delay).select("session_id", "seq", "ts", F.unix_micros("ts").alias("us"), "action", "doc_id")
    folded = rows.groupBy("session_id").transformWithStateInPandas(SessionProcessor(idle_seconds * 1_000_000), OUTPUT, "Update", "EventTime")
    return folded.withColumn("last_activity", F.timestamp_micros("last_us")).drop("last_us")


def live_sessions(changes: DataFrame, end: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """The sessions that are alive at the end (a row with column `end`) of the actions, from the rows of all batches."""
    last = changes.where("kind in ('state', 'gone')").groupBy("session_id").agg(F.max_by(F.struct("kind", "seq", "last_activity", "n_messages", "documents"), "seq").alias("x"))
    alive = last.select("session_id", "x.*").where("kind = 'state'").join(F.broadcast(end))
    return alive.where(F.unix_micros("end") - F.unix_micros("last_activity") <= idle_seconds * 1_000_000).drop("end", "kind")

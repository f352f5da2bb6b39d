"""Conversations and login sessions as state: what a stream must remember of a key, and no more.

A conversation's state is its counts and its last few messages; every other message leaves as a piece of the dialogue once,
whichever batch it came in and however late. A login's state is its end, and a timer that ends it. Both need the RocksDB
state store (see `ready`): a state of many keys lies on the executors' disks and is copied to the checkpoint folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import SETTINGS, Settings

CHANGES = "conversation_id long, kind string, n long, chars long, created_at long, role string, content string"
ENDS = "token string, user_id long, what string, at timestamp"


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _place(row: tuple) -> tuple:
    """Messages by time, then by content and role; nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


class LastMessages(StatefulProcessor):
    """Rows of CHANGES: 'piece' for each message that is no longer among the last `keep`, and 'total' for each batch that
    brings a conversation messages."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, chars long")
        self.last = handle.getListState("last", "created_at long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, chars = self.total.get() or (0, 0)
        last = [(_place((at, content, role)), (at, role, content)) for at, role, content in (self.last.get() if n else ())]
        heapq.heapify(last)
        for part in rows:
            out = []
            for at, role, content in part[["created_at", "role", "content"]].astype(object).where(part[["created_at", "role", "content"]].notna(), None).itertuples(index=False, name=None):
                n, chars = n + 1, chars + len(content or "")
                at = None if at is None else int(at)
                item = (_place((at, content, role)), (at, role, content))
                if len(last) < self.keep:
                    heapq.heappush(last, item)
                else:
                    out.append((key[0], "piece", None, None, *heapq.heappushpop(last, item)[1]))
            if out:
                yield _frame(out)
        self.total.update((n, chars))
        self.last.put([x for _, x in last])
        yield _frame([(key[0], "total", n, chars, None, None, None)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])
    return out.astype({"conversation_id": "int64", "n": "Int64", "chars": "Int64", "created_at": "Int64"})


def context_changes(messages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """A stream of messages (conversation_id long, created_at long, role, content) as a stream of CHANGES."""
    rows = messages.select("conversation_id", "created_at", "role", "content").groupBy("conversation_id")
    return rows.transformWithStateInPandas(LastMessages(s.recent_messages), CHANGES, "Append", "None")


def context_pieces(changes: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """conversation_id, n, chars, created_at, content, role, piece of conversations that have grown too long, from the table that
    a stream of changes has written: the pieces of a dialogue stay rows, in order of (created_at, content, role)."""
    totals = changes.where("kind = 'total'").groupBy("conversation_id").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))
    long = totals.where((F.col("n") >= s.context_messages) & (F.col("chars") >= s.context_chars))
    piece = F.concat(F.upper("role"), F.lit(": "), F.col("content")).alias("piece")
    return changes.where("kind = 'piece'").select("conversation_id", "created_at", "content", "role", piece).join(long, "conversation_id")


class SessionEnds(StatefulProcessor):
    """Rows of ENDS for sessions of (token, user_id, action, at): 'closed' when one is closed, 'expired' when its time is up."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "user_id long, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for part in rows:
            for user, action, at in part.sort_values("at")[["user_id", "action", "at"]].itertuples(index=False, name=None):
                held = self.open.get() if self.open.exists() else None
                if held:
                    self.handle.deleteTimer(held[1])
                if action == "open":
                    expires = int((at + timedelta(days=self.days)).timestamp() * 1000)
                    self.open.update((int(user), expires))
                    self.handle.registerTimer(expires)
                elif held:
                    self.open.clear()
                    out.append((key[0], held[0], "closed", at))
        yield pd.DataFrame(out, columns=["token", "user_id", "what", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        user, expires = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], user, "expired", pd.Timestamp(expires, unit="ms"))], columns=["token", "user_id", "what", "at"])


def session_ends(actions: DataFrame, s: Settings = SETTINGS, late: str = "1 hour") -> DataFrame:
    """A stream of (token, user_id long, action: open or close, at timestamp) as a stream of ENDS. A session that is opened again
    lasts anew. Actions may come late by so much."""
    rows = actions.withWatermark("at", late).groupBy("token")
    return rows.transformWithStateInPandas(SessionEnds(s.session_days), ENDS, "Append", "EventTime")

"""Streams of frame messages: correlation as they arrive, and idempotent append.

The batch operators are the measure; a stream gives the same matches for logs that arrive in order.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.writers import append_once, committed

MATCH = "log string, key_dir string, id string, request_line long, response_line long, method string, latency_ms long"
STATE = "line long, method string, ts_ns long"
COLUMNS = ["log", "key_dir", "id", "request_line", "response_line", "method", "latency_ms"]


def correlate(messages: DataFrame, idle: int | None = None) -> DataFrame:
    """Matched pairs of a stream of messages, with one pending request as the state of each (log, direction, id).

    A later request takes the place of a pending one; a response takes it away. A log's messages must
    come in order from batch to batch; within one they are sorted. With ``idle``, in milliseconds, a
    request that waits so long without a message of its key is given out with null response_line and
    leaves the state, as at the end of a log; else it stays.
    """
    key = F.when(F.col("kind") == "request", F.when(F.col("dir") == "c2s", "s2c").otherwise("c2s")).otherwise(F.col("dir"))
    events = messages.where("id is not null and kind in ('request', 'response')").withColumn("key_dir", key)

    def step(group, batches, state):
        if state.hasTimedOut:
            line, method, _ = state.get
            state.remove()
            yield pd.DataFrame([(*group, line, None, method, None)], columns=COLUMNS).astype({"response_line": "Int64", "latency_ms": "Int64"})
            return
        rows = pd.concat(list(batches)).sort_values(["line", "item"])
        pending = state.get if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == "request":
                pending = (int(r.line), r.method, int(r.ts_ns))
            elif pending is not None:
                out.append((*group, pending[0], int(r.line), pending[1], int((r.ts_ns - pending[2]) / 1_000_000)))
                pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update(pending)
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=COLUMNS)

    slim = events.select(F.col("log").cast("string").alias("log"), "key_dir", "id", "line", "item", "kind", "method", "ts_ns")
    return slim.groupBy("log", "key_dir", "id").applyInPandasWithState(step, MATCH, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


#: What ``records`` needs of a stream, one row for each line of a log: seq counts a log's rows from 0 without gaps, ends is true on its last.
RECORD = "log string, seq long, ends boolean, line long, messages array<struct<item:int,dir:string,kind:string,id:string,method:string,ts_ns:bigint>>"
ANSWERED = "log string, key_dir string, id string, request_line long, request_item int, response_line long, method string, latency_ms long"


class _Log(StatefulProcessor):
    """A log's state: the number that comes next, rows that came before their turn, requests without an answer yet."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long, timer long")
        self.early = handle.getMapState("early", "seq long", "line long, ends boolean, messages string")
        self.open = handle.getMapState("open", "key_dir string, id string", "line long, item int, method string, ts_ns long")

    def _messages(self, log: str, line: int, messages: list[dict]) -> list[tuple]:
        out = []
        for m in sorted(messages, key=lambda m: m["item"]):
            if m["kind"] not in ("request", "response") or (m["kind"] == "request" and m["id"] is None):
                continue
            to = ("s2c" if m["dir"] == "c2s" else "c2s") if m["kind"] == "request" else m["dir"]
            key = (to, m["id"] or "")
            if m["kind"] == "request":
                self.open.updateValue(key, (line, m["item"], m["method"], m["ts_ns"]))
            elif self.open.containsKey(key):
                asked, item, method, since = self.open.getValue(key)
                self.open.removeKey(key)
                took = None if since is None or m["ts_ns"] is None else int((m["ts_ns"] - since) / 1_000_000)
                out.append((log, *key, asked, item, line, method, took))
        return out

    def _closed(self, log: str) -> list[tuple]:
        out = [(log, *key, line, item, None, method, None) for key, (line, item, method, _) in list(self.open.iterator())]
        for state in (self.open, self.early, self.next):
            if state.exists():
                state.clear()
        return sorted(out, key=lambda r: (r[3], r[4]))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        columns = [f.split()[0] for f in ANSWERED.split(", ")]
        return pd.DataFrame(rows, columns=columns).astype({"request_line": "Int64", "request_item": "Int32", "response_line": "Int64", "latency_ms": "Int64"})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        log, out = key[0], []
        due, timer = tuple(self.next.get()) if self.next.exists() else (0, None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        ended = False
        for batch in rows:
            for seq, line, ends, messages in zip(batch["seq"], batch["line"], batch["ends"], batch["messages"], strict=True):
                if seq >= due:  # a row that comes again is passed over
                    self.early.updateValue((int(seq),), (int(line), bool(ends), messages))
        while not ended and self.early.containsKey((due,)):
            line, ended, messages = self.early.getValue((due,))
            self.early.removeKey((due,))
            out += self._messages(log, line, json.loads(messages))
            due += 1
        if ended:
            out += self._closed(log)
        else:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle if self.idle else None
            if timer:
                self.handle.registerTimer(timer)
            self.next.update((due, timer))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._frame(self._closed(key[0]))

    def close(self) -> None:
        pass


def records(rows: DataFrame, idle: int | None = None) -> DataFrame:
    """Answered and unanswered requests of a stream of ``RECORD`` rows, whatever order they come in.

    A row waits in the state until those before it have come, so what is given out is what ``frames.correlated``
    finds in the whole log. Its last row (``ends``) closes a log: requests without an answer come out with a null
    response_line, and nothing of the log stays in the state. A request whose id is asked again before an answer
    gives no row. A row that comes again while its log is open is passed over. With ``idle`` a log of which nothing
    came for so many milliseconds is closed as it is, rows that still wait for others included. Needs the RocksDB
    state store; the state of a log is its open requests and the rows that came early.
    """
    slim = rows.select(F.col("log").cast("string").alias("log"), "seq", "line", F.coalesce("ends", F.lit(False)).alias("ends"), F.to_json("messages", {"ignoreNullFields": "false"}).alias("messages"))
    return slim.groupBy("log").transformWithStateInPandas(_Log(idle), ANSWERED, "append", "ProcessingTime" if idle else "None")


def counts_by_window(messages: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Messages and bytes by log, method and window of ``ts`` (timestamp); an extension for live logs."""
    timed = messages.withWatermark("ts", late)
    return timed.groupBy("log", "method", F.window("ts", width)).agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


def append_new(path: str, key: list[str]):
    """For foreachBatch: appends the rows whose key the table at ``path`` doesn't hold yet, each batch once.

    A batch is a folder of its own, and counts once its commit is written beside it (``writers.append_once``): a
    writer that dies between the two leaves nothing that readers see, and the batch replaces it when it runs again.
    Read the table with ``writers.committed``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(key)
        done = committed(spark, path, batch.schema, but=str(batch_id))
        if done is not None:
            fresh = fresh.join(done.select(*key).distinct(), key, "left_anti")
        append_once(fresh, path, str(batch_id), again=True)

    return write

"""The retryable queue as a running stream: one state machine a session, moved by processing-time timers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tapeloom.functions.text import trim
from tapeloom.operators.queue import ERROR_CHARACTERS, MAX_ATTEMPTS
from tapeloom.streaming.capture import ROCKS

POLL_MS = 1000
QUEUE_EVENT_SCHEMA = "session string, arrival long, kind string, id long, source string, language string"
TOLD_SCHEMA = "session string, number long, kind string, id long, status string, attempts long, text string, error string, pending long"
TOLD = Row(*[c.split()[0] for c in TOLD_SCHEMA.split(", ")])
DOCUMENT_COLUMNS = ("session", "id", "position", "status", "attempts", "source", "text", "error")


def _text(value: Any) -> str | None:
    return None if value is None or value != value else str(value)


def _retryable(status: str, attempts: int) -> bool:
    return status in ("pending", "processing") or (status == "failed" and attempts < MAX_ATTEMPTS)


class Each:
    """Work of one item: f takes a dict of session, id, source, text and language, and returns text and error, one of them None."""

    def __init__(self, f: Callable[[dict], tuple[str | None, str | None]]) -> None:
        self.f = f

    def __call__(self, item: dict) -> tuple[str | None, str | None]:
        return self.f(item)


def _framed(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[dict], tuple[Any, Any]]:
    def one(item: dict) -> tuple[Any, Any]:
        done = work(pd.DataFrame([item]))
        return done["text"].iloc[0], done["error"].iloc[0]

    return one


class QueueWorker(StatefulProcessor):
    """One session's segments: those that wait are worked on one at a time, the first in stored order, each time the session's timer fires.

    Events by arrival: enqueue (a new segment is pending; a known one starts again if its source text changed), language (of all that still waits), delete (the session goes,
    with what waits), wake (nothing but a look). Rows told are numbered for each session: kind segment (a snapshot: processing once claimed, then complete or failed) and
    kind status (the session's rollup and how many wait).

    A claim and its outcome are in one batch: if that is lost, the batch runs again from the state before it, so an item may be worked on twice but its attempt
    counts once, and what is told is told once where the sink writes batches once.
    work: as for queue.resolve, with one row (session, id, source, text, language) at a time; or Each(f), which takes no frame.
    attempts: how many follow each other when a timer fires, in the order and with the rows told that as many firings would have. A firing costs a batch of the whole stream, so a
    long session needs more than one where the work is short; all of them are done anew if the batch is lost.

    Rows come and go one by one and not as frames, of which there would be several a session and batch."""

    def __init__(self, work: Callable[[pd.DataFrame], pd.DataFrame], poll_ms: int = POLL_MS, attempts: int = 1) -> None:
        if attempts < 1:
            raise ValueError("a firing makes one attempt at least")
        self.work, self.poll_ms, self.attempts = work if isinstance(work, Each) else _framed(work), poll_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id long", "position long, status string, attempts long, source string, text string, error string")
        # Of the items only those that wait, by position: a pass looks at no others. timed: a timer is set.
        self.session = handle.getValueState("session", "told long, last long, failed long, language string, timed boolean, positions array<long>, ids array<long>")

    def _load(self) -> None:
        known = self.session.get()
        self.fresh = known is None
        self.told, self.last, self.failed, self.language, self.timed, positions, ids = known or (0, -1, 0, None, False, [], [])
        # What waits by position, and what changes, which is written once, when the call ends.
        self.open, self.changed, self.rows = dict(zip(positions, ids, strict=True)), {}, []

    def _set(self, item: int, row: tuple, before: tuple | None) -> None:
        """Puts an item in place of what it was, and whether it waits; keeps count of those that failed for good."""
        lost = lambda r: int(r is not None and r[1] == "failed" and not _retryable(r[1], r[2]))
        self.failed += lost(row) - lost(before)
        self.changed[item] = row
        if _retryable(row[1], row[2]):
            self.open[row[0]] = item
        else:
            self.open.pop(row[0], None)

    def _known(self, item: int) -> tuple | None:
        if item in self.changed:
            return self.changed[item]
        return None if self.fresh or not self.items.containsKey((item,)) else self.items.getValue((item,))

    def _tell(self, key: Any, item: int, row: tuple) -> None:
        self.rows.append(TOLD(key[0], self.told, "segment", item, row[1], row[2], row[4], row[5], None))
        self.told += 1

    def _tell_status(self, key: Any) -> None:
        pending = len(self.open)
        status = "pending" if pending else "partial" if self.failed else "complete"
        self.rows.append(TOLD(key[0], self.told, "status", None, status, None, None, None, pending))
        self.told += 1

    def _save(self, at: int) -> list[Row]:
        """Writes what changed, sets a timer if anything waits and none is set, and returns what is told."""
        for item, row in self.changed.items():
            self.items.updateValue((item,), row)
        if self.open and not self.timed:
            self.handle.registerTimer(at)
            self.timed = True
        self.session.update((self.told, self.last, self.failed, self.language, self.timed, list(self.open), list(self.open.values())))
        return self.rows

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """Stored documents: what was being processed waits again."""
        self._load()
        for r in initialState.segments:
            self.last = max(self.last, int(r["position"]))
            status = "pending" if r["status"] == "processing" else r["status"]
            self._set(int(r["id"]), (int(r["position"]), status, int(r["attempts"]), _text(r["source"]), _text(r["text"]), _text(r["error"])), None)
        self._tell_status(key)
        self._save(timerValues.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self._load()
        for event in sorted(rows, key=lambda r: r.arrival):
            if event.kind == "enqueue":
                item, source = int(event.id), _text(event.source)
                known = self._known(item)
                if known is None or known[3] != source:
                    self.last += known is None
                    row = (self.last if known is None else known[0], "pending", 0, source, "", None)
                    self._set(item, row, known)
                    self._tell(key, item, row)
            elif event.kind == "language":
                self.language = _text(event.language)
            elif event.kind == "delete":
                self.items.clear()
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.last, self.failed, self.timed, self.open, self.changed = -1, 0, False, {}, {}
        self._tell_status(key)
        yield from self._save(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """One pass: the first segment that waits is claimed and worked on, so many times; if more waits, the next pass follows after the poll time."""
        self._load()
        self.timed = False
        order = sorted(self.open, reverse=True)
        for _ in range(self.attempts if order else 0):
            self._attempt(key, order[-1])
            if order[-1] not in self.open:
                order.pop()
            if not order:
                break
        yield from self._save(timerValues.getCurrentProcessingTimeInMs() + max(1, self.poll_ms))

    def _attempt(self, key: Any, position: int) -> None:
        """An item is claimed and worked on, and all that is told."""
        item = self.open[position]
        before = self.changed[item] if item in self.changed else self.items.getValue((item,))
        _, _, attempts, source, text, error = before
        self._tell(key, item, (position, "processing", attempts + 1, source, text, error))
        try:
            text, error = map(_text, self.work({"session": key[0], "id": item, "source": source, "text": text, "language": self.language}))
        except Exception as fault:
            text, error = None, str(fault)[:ERROR_CHARACTERS]
        row = (position, "complete" if error is None else "failed", attempts + 1, source, text if error is None else "", error)
        self._set(item, row, before)
        self._tell(key, item, row)
        self._tell_status(key)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], stored: DataFrame | None = None, poll_ms: int = POLL_MS, attempts: int = 1) -> DataFrame:
    """What happens to the segments of a stream of events (QUEUE_EVENT_SCHEMA), as rows of TOLD_SCHEMA. See QueueWorker.

    stored: segments of documents to go on from (DOCUMENT_COLUMNS), read once, in the first batch of a new checkpoint. Sessions that wait need an event to begin: wake, as
    recovery sends it. Timers fire in batches of their own, so the query runs until it is stopped."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    first = None if stored is None else stored.groupBy("session").agg(F.collect_list(F.struct(*DOCUMENT_COLUMNS[1:])).alias("segments")).groupBy("session")
    return events.groupBy("session").transformWithState(QueueWorker(work, poll_ms, attempts), TOLD_SCHEMA, "Update", "ProcessingTime", initialState=first)


def told_to_files(told: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Writes the rows of a queue_stream as Parquet, a folder a batch, for other streams to read. A batch that runs again replaces its folder; a reader that has read it already may read its
    rows twice, which an enqueue of a known text doesn't mind."""
    return told.writeStream.outputMode("update").foreachBatch(_appended(path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _appended(path: str) -> Callable[[DataFrame, int], None]:
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def translation_events(told: DataFrame) -> DataFrame:
    """Enqueue events (QUEUE_EVENT_SCHEMA) for the translation queue of what a transcript queue's stream tells: a segment that completed with a text that isn't blank."""
    done = told.filter((F.col("kind") == "segment") & (F.col("status") == "complete") & (trim(F.col("text")) != ""))
    return done.select("session", F.col("number").alias("arrival"), F.lit("enqueue").alias("kind"), "id", F.col("text").alias("source"), F.lit(None).cast("string").alias("language"))


def until_idle(query: StreamingQuery, quiet_seconds: float = 2.0, at_most: float | None = None) -> None:
    """Waits until a query has had no input and no timer for some time, then stops it. quiet_seconds must be longer than its poll time.

    Only batches count that began after the call: one that began before may have looked for input before the last came. Attempts are counted, so a queue comes to an end however
    long it takes; at_most, in seconds, is for those who won't wait for it."""
    called, began, quiet, seen = time.time(), time.monotonic(), None, None
    while query.isActive and (at_most is None or time.monotonic() - began < at_most):
        progress = query.lastProgress
        if progress is not None and progress["batchId"] != seen:
            seen, started = progress["batchId"], datetime.fromisoformat(progress["timestamp"]).timestamp()
            busy = progress["numInputRows"] > 0 or any(int(op["customMetrics"].get(m, 0)) for op in progress["stateOperators"] for m in ("numExpiredTimers", "numDeletedTimers", "numRegisteredTimers"))
            quiet = None if busy or started < called else quiet or started
            if quiet and started - quiet >= quiet_seconds:
                break
        time.sleep(0.05)
    else:
        quiet = None
    fault = query.exception()
    query.stop()
    if fault:
        raise fault
    if quiet is None:
        raise TimeoutError("the query is still at work" if at_most is not None and time.monotonic() - began >= at_most else "the query was stopped")


def read_state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """A state variable of a stream's last batch, whether it runs or not: key, then value, or user_map_key and user_map_value."""
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(checkpoint)


def queue_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, status, pending, failed, language) of each session of a queue_stream, from its state: nothing is read but the small values and the numbers of what waits."""
    sessions = read_state(spark, checkpoint, "session").select(F.col("key.session").alias("session"), F.size("value.ids").cast("long").alias("pending"), "value.failed", "value.language")
    status = F.when(F.col("pending") > 0, "pending").when(F.col("failed") > 0, "partial").otherwise("complete").alias("status")
    return sessions.select("session", status, "pending", "failed", "language")


def queue_documents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All segments of a queue_stream's sessions (DOCUMENT_COLUMNS) from its state: what a document holds, and what a new stream can go on from."""
    items = read_state(spark, checkpoint, "items")
    return items.select(F.col("key.session").alias("session"), F.col("user_map_key.id").alias("id"), "user_map_value.*").select(*DOCUMENT_COLUMNS)


def recording_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, mode, source, position, elapsed_ms) of each session of a mixed_stream, from its state."""
    from tapeloom.functions.signal import samples_to_ms

    read = read_state(spark, checkpoint, "session")
    return read.select(F.col("key.session").alias("session"), "value.mode", "value.source", "value.position", samples_to_ms(F.col("value.position")).alias("elapsed_ms"))

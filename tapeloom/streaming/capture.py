"""The capture pipeline as a stateful stream: order and rate checks, levels, resampling, and positional mixing of two sources."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.signal import FLOOR_DB, TARGET_RATE
from tapeloom.operators.resample import Resampler

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "session string, arrival long, kind string, source string, sequence long, channels int, sample_rate int, samples array<float>, message string"
MIXED_SCHEMA = "session string, kind string, source string, position long, samples array<float>, level_db double, waveform array<float>, pending long"
MIXED_COLUMNS = [c.split()[0] for c in MIXED_SCHEMA.split(", ")]
LIMIT = 10 * TARGET_RATE
BINS = 48
CHECKPOINT_MS = 5000


def capture_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of JSON files as they come; a schema is never inferred. arrival numbers a session's events in the order in which they came."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def to_mono_block(samples: np.ndarray, channels: int) -> np.ndarray:
    if channels <= 0 or len(samples) % channels:
        raise ValueError("a block must hold whole frames")
    clean = np.where(np.isfinite(samples), np.minimum(np.maximum(samples, -1), 1), 0)
    return clean if channels == 1 else clean.reshape(-1, channels).mean(axis=1)


def level_db(samples: np.ndarray) -> float:
    level = math.sqrt(float(samples @ samples) / len(samples)) if len(samples) else 0.0
    return max(FLOOR_DB, 20 * math.log10(level)) if level > 0 else FLOOR_DB


def peaks(samples: np.ndarray, bins: int = BINS) -> np.ndarray:
    n = len(samples)
    if not n:
        return np.zeros(bins)
    # With at most as many samples as bins each bin is one sample; else bins follow each other without a gap.
    start, size = np.arange(bins) * n // bins, np.abs(samples)
    return size[start] if n <= bins else np.maximum.reduceat(size, start)


def arrived(rows: Iterator[pd.DataFrame], order: str = "arrival") -> Iterator[Any]:
    """The rows of one session and batch in order, those of one number as they come. Cheap for few rows, of which there are many sessions."""
    frames = list(rows)
    rows = [r for f in frames for r in zip(*(f[c].tolist() for c in f.columns), strict=True)]
    kind = namedtuple("Event", frames[0].columns)
    at = frames[0].columns.get_loc(order)
    return map(kind._make, sorted(rows, key=lambda r: r[at]))


class Source:
    """One source of a session: its next number, its rate, its resampler and the samples that wait."""

    def __init__(self, rate: int) -> None:
        self.next, self.rate, self.resampler, self.waiting = 0, rate, Resampler(rate), np.zeros(0)

    def push(self, event: Any) -> np.ndarray:
        """Takes a block and returns it as one channel."""
        if event.sample_rate != self.rate:
            raise RuntimeError(f"sample rate of {event.source} changed")
        if event.sequence != self.next:
            raise RuntimeError(f"sequence gap in {event.source}: {event.sequence} instead of {self.next}")
        self.next += 1
        mono = to_mono_block(np.asarray(event.samples, np.float64), int(event.channels))
        more = self.resampler.push(mono)
        self.waiting = np.concatenate((self.waiting, more)) if len(self.waiting) else more
        if len(self.waiting) > LIMIT:
            raise RuntimeError("too much audio is pending")
        return mono

    def take(self, n: int) -> np.ndarray:
        out, self.waiting = self.waiting[:n], self.waiting[n:]
        return out


class Mixer(StatefulProcessor):
    """One session: checks and mixes its sources; rows of kind level (of each block, at its source), mixed (the output), end (after the last) and checkpoint.

    Events count in order of arrival. A gap, a changed rate, an error event or more than LIMIT waiting samples ends the query. A control event
    (kind mode; message: microphone, system or mixed) that changes the mode drops what waits and makes the session's source mixed. A
    source that the mode leaves out is discarded; mixed mode gives what both sources have. Kind end flushes the resamplers and, in mixed mode, gives
    the longer source's rest, if both ever came. The rest of a block waits as one binary value in a list; the filter's state goes on.

    checkpoint_ms: a timer tells every so often how far a session's output is, until it ends: what a writer makes durable."""

    def __init__(self, mode: str = "mixed", gains: dict[str, float] | None = None, checkpoint_ms: int | None = None) -> None:
        gain = lambda g: min(4.0, max(0.0, g)) if np.isfinite(g) else 0.0
        self.mode, self.gains, self.checkpoint_ms = mode, {k: gain(v) for k, v in (gains or {}).items()}, checkpoint_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "mode string, position long, source string")
        self.known = handle.getMapState("sources", "name string", "next long, rate int, held binary, first long, read long, made long")
        self.waiting = handle.getListState("waiting", "name string, samples binary")

    def _load(self) -> tuple[str, int, str, dict[str, Source]]:
        known = self.session.get()
        if known is None:
            return self.mode, 0, self.mode, {}
        mode, position, label = known
        sources: dict[str, Source] = {}
        for (name,), (number, rate, *state) in self.known.iterator():
            sources[name] = Source(rate)
            sources[name].next, sources[name].resampler = number, Resampler.resume(rate, tuple(state))
        for name, samples in self.waiting.get():
            sources[name].waiting = np.concatenate((sources[name].waiting, np.frombuffer(samples, np.float64)))
        return mode, position, label, sources

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mode, position, label, sources = self._load()
        out: list[tuple] = []
        ended = False
        for event in arrived(rows):
            if event.kind == "error":
                raise RuntimeError(f"capture of {event.source} failed: {event.message}")
            if event.kind == "mode" and event.message != mode:
                mode, label = event.message, "mixed"
                for s in sources.values():
                    s.waiting = np.zeros(0)
            elif event.kind == "audio":
                if event.source not in sources:
                    sources[event.source] = Source(int(event.sample_rate))
                source = sources[event.source]
                mono = source.push(event)
                out.append((key[0], "level", event.source, event.sequence, None, level_db(mono), peaks(mono), len(source.waiting)))
            elif event.kind == "end":
                for s in sources.values():
                    s.waiting = np.concatenate((s.waiting, s.resampler.finish()))
            if event.kind in ("audio", "end"):
                mixed = self._drain(mode, sources, event.kind == "end")
                if len(mixed):
                    out.append((key[0], "mixed", label, position, mixed, level_db(mixed), None, max((len(s.waiting) for s in sources.values()), default=0)))
                    position += len(mixed)
            if event.kind == "end":
                ended = True
                out.append((key[0], "end", label, position, None, None, None, None))
        if self.checkpoint_ms:
            self._time(timerValues.getCurrentProcessingTimeInMs(), ended)
        self.session.update((mode, position, label))
        for name, s in sources.items():
            self.known.updateValue((name,), (s.next, s.rate, *s.resampler.state()))
        rest = [(name, s.waiting.tobytes()) for name, s in sources.items() if len(s.waiting)]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=MIXED_COLUMNS)

    def _time(self, now: int, ended: bool) -> None:
        """A timer for the next checkpoint where none is set; none after the end."""
        timers = list(self.handle.listTimers())
        if ended:
            for t in timers:
                self.handle.deleteTimer(t)
        elif not timers:
            self.handle.registerTimer(now + self.checkpoint_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, position, label = self.session.get()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.checkpoint_ms)
        yield pd.DataFrame([(key[0], "checkpoint", label, position, None, None, None, None)], columns=MIXED_COLUMNS)

    def _drain(self, mode: str, sources: dict[str, Source], ended: bool) -> np.ndarray:
        if mode != "mixed":
            for name, s in sources.items():
                if name != mode:
                    s.waiting = np.zeros(0)
            return (sources[mode].take(len(sources[mode].waiting)) * self.gains.get(mode, 1.0)).clip(-1, 1) if mode in sources else np.zeros(0)
        parts = [(n, sources[n]) for n in ("microphone", "system") if n in sources]
        if len(parts) < 2:
            return np.zeros(0)
        n = (max if ended else min)(len(s.waiting) for _, s in parts)
        total = np.zeros(n)
        for name, s in parts:
            piece = s.take(n)
            total[: len(piece)] += piece * self.gains.get(name, 1.0)
        return total.clip(-1, 1)

    def close(self) -> None:
        pass


def mixed_stream(events: DataFrame, mode: str = "mixed", gains: dict[str, float] | None = None, checkpoint_ms: int | None = None) -> DataFrame:
    """Levels and mixed audio of each session as they come (see Mixer). The events of one session and trigger are put in order in memory.

    With checkpoint_ms (the recorder's own is CHECKPOINT_MS) there are timers, so the query runs until it is stopped."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("session").transformWithStateInPandas(Mixer(mode, gains, checkpoint_ms), MIXED_SCHEMA, "Append", "ProcessingTime" if checkpoint_ms else "None")


class LatestSegment(StatefulProcessor):
    """The newest snapshot of one segment; a change that isn't older is emitted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "attempts long, rank int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ranks = {"pending": 0, "processing": 1, "complete": 2, "failed": 2}
        best = tuple(self.state.get()) if self.state.exists() else (-1, -1)
        chosen = None
        for row in pd.concat(list(rows)).sort_values("arrival", kind="stable").to_dict("records"):
            order = (int(row["attempts"]), ranks[row["status"]])
            if order >= best:
                best, chosen = order, row
        self.state.update(best)
        if chosen:
            yield pd.DataFrame([chosen])[["session", "id", "status", "attempts", "text", "arrival"]]

    def close(self) -> None:
        pass


def latest_stream(changes: DataFrame) -> DataFrame:
    """Accepted upserts (session, id, status, attempts, text, arrival) of a change stream, in update order."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return changes.groupBy("session", "id").transformWithStateInPandas(LatestSegment(), "session string, id long, status string, attempts long, text string, arrival long", "Update", "None")


CHANNELS = ("recording-status", "model-download-status", "transcription-status", "transcript-segment", "translation-segment")  # fixed values


def channel_events(rows: DataFrame, channel: str, key: str) -> DataFrame:
    """(channel, key, payload): rows as the JSON objects that listeners of a channel get."""
    if channel not in CHANNELS:
        raise ValueError(f"no channel {channel}")
    return rows.select(F.lit(channel).alias("channel"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("payload"))


def recording_status(mixed: DataFrame) -> DataFrame:
    """The last output row of each session in a batch of mixed_stream: how far it is, its level and what waits."""
    last = mixed.filter("kind = 'mixed'").groupBy("session").agg(F.max_by(F.struct("position", "level_db", "pending"), "position").alias("s"))
    return last.select("session", "s.*")


def publish_stream(rows: DataFrame, channel: str, key: str, path: str, checkpoint: str, shape=lambda batch: batch, every: str = "100 milliseconds", **trigger: bool):
    """Writes a stream's rows, shaped batch by batch, to a channel's folder.

    A batch has a folder of its own that a repeat overwrites, so a retry tells nothing twice."""

    def publish(batch: DataFrame, number: int) -> None:
        channel_events(shape(batch), channel, key).write.mode("overwrite").parquet(f"{path}/{channel}/batch={number}")

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()

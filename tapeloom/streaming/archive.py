"""Recording archives written as the audio comes: one writer a session, files split at exact lengths, headers completed at checkpoints."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.codecs import BLOCK, flac_frames, flac_header, wav_header
from tapeloom.functions.signal import TARGET_RATE
from tapeloom.streaming.capture import ROCKS, arrived

SAVED_SCHEMA = "session string, directory string, status string, samples long, manifest string"
STATE = "started long, completed long, source string, samples long, durable long, octets long, least int, shortest int, longest int"
EMPTY = (BLOCK, 1 << 24, 0)
ORDER = {"checkpoint": 0, "mixed": 1, "end": 2}


def quantise(samples: np.ndarray) -> np.ndarray:
    """16-bit samples: what isn't finite is 0, halves go away from zero."""
    x = np.asarray(samples, np.float64)
    x = np.where(np.isfinite(x), np.clip(x, -1, 1), 0) * 32767
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int16)


class Archiver(StatefulProcessor):
    """One session's archive from rows of mixed_stream: mixed audio is appended, a checkpoint row makes durable what is there, an end row completes the session.

    State: counts, and for FLAC the samples of a frame that isn't full. Each file's length follows from the state before a batch, so a batch that runs again writes the same bytes at the
    same places, and what a lost attempt left is cut off. A stop at any moment leaves files whose headers tell what was durable then, and a manifest that records, for recovery to
    mark as interrupted. The folder must be one that the executors share and can write at any place."""

    def __init__(self, root: str, kind: str, limit: int, zone: str, every_batch: bool) -> None:
        if limit <= 0 or kind not in ("wav", "flac"):
            raise ValueError("an archive needs a length for its segments, and a format")
        self.root, self.kind, self.limit, self.zone, self.every_batch = re.sub(r"^file:/+", "/", root).rstrip("/"), kind, limit, zone, every_batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("archive", STATE)
        self.tail = handle.getValueState("tail", "pcm binary")

    def _load(self, key: Any, source: str, now: int) -> None:
        self.session = key[0]
        if self.state.exists():
            self.started, self.completed, self.source, self.samples, self.durable, self.octets, *self.frames = self.state.get()
        else:
            self.started, self.completed, self.source, self.samples, self.durable, self.octets, self.frames = now, -1, source, 0, 0, 0, list(EMPTY)
        self.pcm = np.frombuffer(self.tail.get()[0], np.int16) if self.tail.exists() else np.zeros(0, np.int16)
        day = datetime.fromtimestamp(self.started / 1000, ZoneInfo(self.zone)).strftime("%Y/%m/%d")
        self.directory = f"{self.root}/{day}/{self.session}"

    @property
    def index(self) -> int:
        return self.samples // self.limit

    def _path(self) -> str:
        return f"{self.directory}/audio-{self.index:04}.{self.kind}"

    def _place(self) -> int:
        os.makedirs(self.directory, exist_ok=True)
        return os.open(self._path(), os.O_RDWR | os.O_CREAT)

    def _append(self, samples: np.ndarray) -> None:
        """Samples to the active file and, where it is full, to the next ones."""
        pcm = quantise(samples)
        while len(pcm):
            take = min(len(pcm), self.limit - self.samples % self.limit)
            held = np.concatenate((self.pcm, pcm[:take]))
            full = self.samples % self.limit + take == self.limit
            whole = len(held) if full or self.kind == "wav" else len(held) // BLOCK * BLOCK
            place = self._place()
            try:
                self._write(place, held[:whole], self.samples % self.limit - len(self.pcm))
                if full:
                    self._header(place, self.limit)
            finally:
                os.close(place)
            self.samples, self.pcm, pcm = self.samples + take, held[whole:], pcm[take:]
            if full:
                self.durable, self.octets, self.frames = self.samples, 0, list(EMPTY)

    def _write(self, place: int, pcm: np.ndarray, begin: int) -> None:
        """Samples of the active file from its sample `begin` on, behind what it has; for FLAC in frames, of which the last may be short."""
        if not len(pcm):
            return
        if self.kind == "wav":
            octets = [pcm.astype("<i2").tobytes()]
        else:
            cuts = range(0, len(pcm), BLOCK)
            octets = flac_frames([begin + c for c in cuts], [pcm[c : c + BLOCK] for c in cuts])
            sizes = list(map(len, octets))
            self.frames = [min(self.frames[0], len(pcm) - cuts[-1]), min(self.frames[1], *sizes, sizes[0]), max(self.frames[2], *sizes, sizes[0])]
        os.pwrite(place, b"".join(octets), (44 if self.kind == "wav" else 42) + self.octets)
        self.octets += sum(map(len, octets))

    def _header(self, place: int, samples: int) -> None:
        """The active file's header for its samples so far; whatever lies behind them goes."""
        head = wav_header(2 * samples, TARGET_RATE) if self.kind == "wav" else flac_header(samples, *self.frames, TARGET_RATE)
        os.pwrite(place, head, 0)
        os.ftruncate(place, len(head) + self.octets)
        os.fsync(place)

    def _checkpoint(self) -> None:
        """Makes all samples so far durable: a FLAC frame that isn't full is written as a short one."""
        inside = self.samples % self.limit
        if self.durable == self.samples or not inside:
            return
        place = self._place()
        try:
            self._write(place, self.pcm, inside - len(self.pcm))
            self.pcm = np.zeros(0, np.int16)
            self._header(place, inside)
        finally:
            os.close(place)
        self.durable = self.samples

    def _manifest(self) -> dict[str, Any]:
        """The document; the active segment counts what is durable of it."""
        segments, ended = [], self.completed >= 0
        for i in range(-(-self.samples // self.limit)):
            begin = i * self.limit
            count = max(0, min(self.limit, self.durable - begin))
            segments.append({"durationMs": count * 1000 // TARGET_RATE, "fileName": f"audio-{i:04}.{self.kind}", "finalized": count == self.limit or ended, "index": i, "sampleCount": count, "startedOffsetMs": begin * 1000 // TARGET_RATE})
        at = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return {"audioFormat": self.kind, "audioSource": self.source, "completedAt": at(self.completed) if ended else None, "lastError": None, "sampleRate": TARGET_RATE, "schemaVersion": 1, "segmentMinutes": max(1, self.limit // (60 * TARGET_RATE)), "segments": segments, "sessionId": self.session, "startedAt": at(self.started), "status": "completed" if ended else "recording"}

    def _save(self) -> tuple:
        """The manifest's file, all or nothing, and the row that tells it."""
        text = json.dumps(self._manifest(), indent=2)
        os.makedirs(self.directory, exist_ok=True)
        path = f"{self.directory}/session.json"
        with open(f"{path}.tmp", "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(f"{path}.tmp", path)
        return self.session, self.directory, "completed" if self.completed >= 0 else "recording", self.durable, text

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)  # a stream without timers has no processing time of its own
        batch = sorted((r for r in arrived(rows, "position") if r.kind in ORDER), key=lambda r: (r.position, ORDER[r.kind]))
        if not batch:
            return
        fresh = not self.state.exists()
        self._load(key, batch[0].source, now)
        files, save = self.index, fresh
        waiting: list[np.ndarray] = []  # of rows that follow each other: written in one go
        place = self.samples

        def write() -> None:
            if waiting:
                self._append(np.concatenate(waiting))
                waiting.clear()

        for row in batch:
            if row.kind == "mixed":
                if row.position != place:
                    raise RuntimeError(f"samples of {self.session} don't follow: {row.position} instead of {place}")
                if row.source != self.source:
                    self.source, save = "mixed", True
                waiting.append(np.asarray(row.samples, np.float64))
                place += len(row.samples)
                continue
            write()
            if row.kind == "checkpoint":
                self._checkpoint()
                save = True
            else:
                self._checkpoint()
                self.completed, save = now, True
        write()
        if self.every_batch and self.completed < 0:
            self._checkpoint()
            save = True
        if save or self.index != files:
            yield pd.DataFrame([self._save()], columns=[c.split()[0] for c in SAVED_SCHEMA.split(", ")])
        if self.completed >= 0:
            self.state.clear()
            self.tail.clear()
            return
        self.state.update((self.started, self.completed, self.source, self.samples, self.durable, self.octets, *self.frames))
        self.tail.update((self.pcm.tobytes(),)) if len(self.pcm) else self.tail.clear()

    def close(self) -> None:
        pass


def archive_stream(mixed: DataFrame, root: str, kind: str = "flac", segment_minutes: int = 60, segment_samples: int | None = None, every_batch: bool = False) -> DataFrame:
    """Writes the sessions of mixed_stream's rows as files of WAV or FLAC below root (year/month/day/session, by the session time zone), each of at most segment_minutes (or exactly
    segment_samples samples), with a manifest; gives a row (session, directory, status, samples that are durable, manifest) for each manifest saved. See Archiver.

    every_batch: each batch is a checkpoint, for streams triggered as often as checkpoints are wanted. A session that ends may begin anew under another name only."""
    spark = mixed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    limit = segment_samples or segment_minutes * 60 * TARGET_RATE
    archiver = Archiver(root, kind, limit, spark.conf.get("spark.sql.session.timeZone"), every_batch)
    return mixed.select("session", "kind", "source", "position", "samples").groupBy("session").transformWithStateInPandas(archiver, SAVED_SCHEMA, "Append", "None")

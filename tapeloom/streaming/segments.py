"""Speech segments of running audio: a partial frame and an open segment are carried from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.signal import TARGET_RATE
from tapeloom.operators.sequence import FRAME
from tapeloom.sources.settings import check_segmentation
from tapeloom.streaming.capture import ROCKS, arrived

SEGMENT_SCHEMA = "session string, start_sample long, end_sample long, duration_ms long, peak double, samples array<float>"


@dataclass(frozen=True)
class Rules:
    """When a segment opens and closes, in frames."""

    threshold: float
    frame: int
    gap: int
    least: int
    most: int

    @classmethod
    def of(cls, threshold: float = 0.5, frame: int = FRAME, min_speech_ms: int = 250, min_silence_ms: int = 500, max_segment_ms: int = 30_000) -> Rules:
        check_segmentation(threshold, min_speech_ms, min_silence_ms, max_segment_ms)
        # Samples are single floats: one that reads as the threshold reaches it.
        return cls(float(np.float32(threshold)), frame, *(max(1, ms * (TARGET_RATE // 1000) // frame) for ms in (min_silence_ms, min_speech_ms, max_segment_ms)))


@dataclass
class Open:
    """The segment that is open: the first loud frame, where its present piece begins, the last loud frame, and the piece's peak."""

    first: int
    begin: int
    last: int
    peak: float | None

    def loud(self, place: int, level: float, rules: Rules) -> Iterator[tuple[int, int, float | None]]:
        """Takes a loud frame; gives the pieces that are as long as a segment may be."""
        while place >= self.begin + rules.most:
            yield self.begin, self.begin + rules.most, self.peak
            self.begin, self.peak = self.begin + rules.most, None
        self.last, self.peak = place, level if self.peak is None else max(self.peak, level)

    def close(self, rules: Rules) -> Iterator[tuple[int, int, float | None]]:
        if self.last + 1 - self.first >= rules.least:
            yield self.begin, self.last + 1, self.peak


def follow(state: Open | None, levels: np.ndarray, at: int, rules: Rules, ended: bool) -> tuple[Open | None, list[tuple[int, int, float | None]]]:
    """The open segment and the pieces that closed, after frames of these levels, the first of which is frame `at`."""
    out = []
    for i in np.flatnonzero(levels >= rules.threshold).tolist():
        if state and at + i - state.last > rules.gap:
            out += state.close(rules)
            state = None
        state = state or Open(at + i, at + i, at + i, None)
        out += state.loud(at + i, float(levels[i]), rules)
    if state and (ended or at + len(levels) - state.last > rules.gap):
        out += state.close(rules)
        state = None
    return state, out


class Segmenter(StatefulProcessor):
    """One session's audio (rows of kind mixed: position, samples) as it comes, cut to segments; a row of kind end closes what is open.

    A segment closes once min_silence has passed since its last loud frame, or is cut as soon as a later loud frame shows that it is longer than the longest. So what is
    told doesn't depend on where batches cut. State: three small values, and the samples since the open piece's begin (at most the longest segment and the shortest
    silence) or of the partial frame. Samples that don't follow the last ones end the query."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "held_from long, frames long")
        self.open = handle.getValueState("open", "first long, begin long, last long, peak double")
        self.audio = handle.getListState("audio", "samples binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rules, size = self.rules, self.rules.frame
        start, frames = self.place.get() if self.place.exists() else (0, 0)
        state = Open(*self.open.get()) if self.open.exists() else None
        held = np.concatenate([np.frombuffer(b, np.float32) for (b,) in self.audio.get()]) if self.audio.exists() else np.zeros(0, np.float32)
        known, ended = len(held), False
        for row in arrived(rows, "position"):
            if row.kind == "end":
                ended = True
            elif row.kind == "mixed":
                if row.position != start + len(held) or ended:
                    raise RuntimeError(f"samples of {key[0]} don't follow: {row.position} instead of {start + len(held)}")
                new = np.asarray(row.samples, np.float32)
                held = np.concatenate((held, np.where(np.isfinite(new), np.clip(new, -1, 1), 0).astype(np.float32)))
        processed = start + len(held)
        until = -(-processed // size) if ended else processed // size
        whole = np.zeros(max(0, until - frames) * size, np.float32)
        fresh = held[frames * size - start :][: len(whole)]
        whole[: len(fresh)] = np.abs(fresh)
        state, pieces = follow(state, whole.reshape(-1, size).max(axis=1).astype(float), frames, rules, ended)
        out = []
        for begin, end, peak in pieces:
            first, last = begin * size, min(end * size, processed)
            if last > first:
                out.append((key[0], first, last, (last - first) * 1000 // TARGET_RATE, peak, held[first - start : last - start]))
        keep = (state.begin if state else until) * size
        rest = held[max(0, keep - start) :]
        if keep > start or ended:
            self.audio.clear() if ended or not len(rest) else self.audio.put([(rest.tobytes(),)])
        elif len(held) > known:
            self.audio.appendValue((held[known:].tobytes(),))
        # After its end a session may begin anew, as another recording of that name would.
        self.place.update((0, 0) if ended else (max(keep, start), until))
        if state and not ended:
            self.open.update((state.first, state.begin, state.last, state.peak))
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["session", "start_sample", "end_sample", "duration_ms", "peak", "samples"])

    def close(self) -> None:
        pass


def segment_stream(audio: DataFrame, **rules: float) -> DataFrame:
    """(session, start_sample, end_sample, duration_ms, peak, samples) of running audio (session, kind, position, samples) as mixed_stream gives it. See Segmenter; rules: those of Rules.of.

    The same segments as threshold_segments gives for the peaks of whole recordings' frames. The peak is that of the piece; a piece that holds none of its segment's
    loud frames has none."""
    audio.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return audio.select("session", "kind", "position", "samples").groupBy("session").transformWithStateInPandas(Segmenter(Rules.of(**rules)), SEGMENT_SCHEMA, "Append", "None")

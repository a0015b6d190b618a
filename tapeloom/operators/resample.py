"""Resampling of one recorded source at a time: windowed-sinc interpolation with carried state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.signal import TARGET_RATE
from tapeloom.operators.sequence import running_offsets

HALF = 32
#: Input samples of a block that is filtered on its own.
BLOCK_SAMPLES = 1 << 18


class Resampler:
    """push() samples as they come, finish() at the end: in all ceil(n * out / in) samples, the filter's delay taken out."""

    def __init__(self, rate_in: int, rate_out: int = TARGET_RATE) -> None:
        if rate_in <= 0:
            raise ValueError("the sample rate must be positive")
        self.rate_in, self.rate_out, self.scale = rate_in, rate_out, min(1.0, rate_out / rate_in)
        self.reach = math.ceil(HALF / self.scale)
        self.held, self.first, self.read, self.made = np.zeros(self.reach), -self.reach, 0, 0

    def state(self) -> tuple[bytes, int, int, int]:
        """What goes on to a later batch: the samples still needed, where they begin, how many were read and made."""
        return self.held.tobytes(), self.first, self.read, self.made

    @classmethod
    def resume(cls, rate_in: int, state: tuple[bytes, int, int, int], rate_out: int = TARGET_RATE) -> Resampler:
        out = cls(rate_in, rate_out)
        out.held, (out.first, out.read, out.made) = np.frombuffer(state[0], np.float64), state[1:]
        return out

    def _until(self, end: int) -> np.ndarray:
        """Output samples from made to end; all inputs that they need are held."""
        at = np.arange(self.made, end) * self.rate_in / self.rate_out
        base = np.floor(at).astype(np.int64)
        near = base[:, None] + np.arange(-self.reach + 1, self.reach + 1)
        far = (at[:, None] - near) * self.scale
        kernel = np.sinc(far) * np.where(np.abs(far) < HALF, np.cos(np.pi * far / (2 * HALF)) ** 2, 0) * self.scale
        out = (self.held[np.clip(near - self.first, 0, len(self.held) - 1)] * kernel).sum(axis=1)
        self.made = end
        keep = max(0, int(end * self.rate_in / self.rate_out) - self.reach - self.first)
        self.held, self.first = self.held[keep:], self.first + keep
        return out

    def push(self, samples: np.ndarray) -> np.ndarray:
        samples = np.asarray(samples, np.float64)
        if self.rate_in == self.rate_out:
            return samples
        self.held = np.concatenate((self.held, samples))
        self.read += len(samples)
        ready = self._ready(self.read)
        return np.concatenate([self._until(min(ready, at + 4096)) for at in range(self.made, ready, 4096)] or [np.zeros(0)])

    def _ready(self, read: int) -> int:
        """How many output samples there are after so many input samples."""
        return max(self.made, math.floor((read - self.reach - 1) * self.rate_out / self.rate_in))

    def push_all(self, blocks: list[np.ndarray]) -> list[np.ndarray]:
        """What push gives for each of the blocks in turn, filtered in one go."""
        if self.rate_in == self.rate_out or len(blocks) == 1:
            return [self.push(b) for b in blocks]
        made, read = self.made, self.read + np.cumsum([len(b) for b in blocks])
        cuts = [self._ready(int(r)) - made for r in read[:-1]]
        return np.split(self.push(np.concatenate([np.asarray(b, np.float64) for b in blocks])), cuts)

    def finish(self) -> np.ndarray:
        if self.rate_in == self.rate_out:
            return np.zeros(0)
        end = -(-self.read * self.rate_out // self.rate_in)
        self.held = np.concatenate((self.held, np.zeros(2 * self.reach + 2)))
        return np.concatenate([self._until(min(end, at + 4096)) for at in range(self.made, end, 4096)] or [np.zeros(0)])


def resample_sources(blocks: DataFrame, rate_out: int = TARGET_RATE) -> DataFrame:
    """(session, source, sequence, samples) at the target rate from blocks (session, source, sequence, sample_rate, samples).

    Each source of a session is one sorted stream, read a batch at a time with the state of the filter carried on, so
    memory doesn't grow with a recording; the last row of a stream holds its flush under the sequence after its last."""
    ordered = blocks.select("session", "source", "sequence", "sample_rate", "samples").repartition("session", "source").sortWithinPartitions("session", "source", "sequence")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stream, last = None, None, -1

        def row(session, source, sequence, samples):
            return {"session": session, "source": source, "sequence": sequence, "samples": samples.astype(np.float32)}

        for batch in batches:
            rows = []
            for (session, source), blocks in groupby(batch.itertuples(index=False), key=itemgetter(0, 1)):
                found = list(blocks)
                if key != (session, source):
                    rows += [row(*key, last + 1, stream.finish())] if stream else []
                    key, stream = (session, source), Resampler(int(found[0].sample_rate), rate_out)
                if any(b.sample_rate != stream.rate_in for b in found):
                    raise ValueError("sample rate changed")
                rows += [row(session, source, b.sequence, made) for b, made in zip(found, stream.push_all([b.samples for b in found]), strict=True)]
                last = found[-1].sequence
            yield pd.DataFrame(rows, columns=["session", "source", "sequence", "samples"])
        if stream:
            yield pd.DataFrame([row(*key, last + 1, stream.finish())])

    kinds = dict(blocks.dtypes)
    return ordered.mapInPandas(run, f"session {kinds['session']}, source {kinds['source']}, sequence long, samples array<float>")


def filter_block(samples: np.ndarray, first: int, begin: int, end: int, total: int, rate_in: int, rate_out: int = TARGET_RATE) -> np.ndarray:
    """The output samples that fall in input samples begin to end of a recording of total ones, from samples (those from first on that the filter reaches; what lies
    beyond either end of the recording is silence)."""
    if rate_in == rate_out:
        return samples[begin - first : end - first]
    filter_ = Resampler(rate_in, rate_out)
    made = lambda place: -(-place * rate_out // rate_in)  # noqa: E731 - output samples before an input sample
    lead, tail = max(0, first - (begin - filter_.reach)), end + filter_.reach + 2 - (first + len(samples))
    held = np.concatenate((np.zeros(lead), samples, np.zeros(max(0, tail))))
    filter_ = Resampler.resume(rate_in, (held.tobytes(), first - lead, total, made(begin)), rate_out)
    last = made(end)
    return np.concatenate([filter_._until(min(last, at + 4096)) for at in range(made(begin), last, 4096)] or [np.zeros(0)])


def resample_recordings(blocks: DataFrame, rate_out: int = TARGET_RATE, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """(session, source, part, first, samples) at the target rate from blocks (session, source, sequence, sample_rate, samples): what resample_sources gives, with a
    recording's parts on many tasks. first is the place of a part's first output sample.

    Inputs are cut at every block_samples; each part also gets what the filter reaches of its neighbours (overlap-save), so parts are filtered apart and their outputs follow
    each other without a seam. Only those edges are copied. A source's rate may not change."""
    names = ["session", "source"]
    told = blocks.select(*names, "sequence", F.col("sample_rate").cast("long").alias("rate"), F.col("samples").cast("array<double>").alias("samples"), F.size("samples").cast("long").alias("n"))
    totals = told.groupBy(*names).agg(F.sum("n").alias("total"), F.min("rate").alias("rate"), F.max("rate").alias("__most"))
    totals = totals.withColumn("rate", F.when(F.col("rate") == F.col("__most"), F.col("rate")).otherwise(F.raise_error("sample rate changed").cast("long"))).drop("__most")
    placed = running_offsets(told.drop("rate"), names, ["sequence"], "n").filter("n > 0").join(totals, names)
    reach = F.when(F.col("rate") == rate_out, 0).otherwise(F.ceil(HALF * F.greatest(F.lit(1.0), F.col("rate") / rate_out)) + 2).cast("long")
    size, begin = F.lit(block_samples).cast("long"), F.col("first_sample")
    end = begin + F.col("n")
    # Every part whose samples, or their surroundings, the block touches.
    near = F.sequence(F.greatest(F.lit(0), F.floor((begin - reach) / size)).cast("long"), F.least(F.floor((end - 1 + reach) / size), F.floor((F.col("total") - 1) / size)).cast("long"))
    parts = placed.withColumn("reach", reach).withColumn("part", F.explode(near))
    lo = F.greatest(begin, F.col("part") * size - F.col("reach"))
    hi = F.least(end, (F.col("part") + 1) * size + F.col("reach"))
    cut = parts.select(*names, "part", "rate", "total", lo.alias("at"), F.slice("samples", (lo - begin + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int")).alias("samples"))
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pieces, out = None, [], []

        def close() -> None:
            session, source, number, rate, total, first = part
            begin = number * block_samples
            out.append((session, source, number, -(-begin * rate_out // rate), filter_block(np.concatenate(pieces), first, begin, min(total, begin + block_samples), total, rate, rate_out)))

        def told(kinds: tuple) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["session", "source", "part", "first", "samples"])

        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = (batch.schema.field("session").type, batch.schema.field("source").type, pa.int64(), pa.int64(), pa.list_(pa.float64()))
            samples, keys = batch.column("samples"), list(zip(*(batch.column(c).to_pylist() for c in ("session", "source", "part")), strict=True))
            values, ends = samples.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(samples).to_numpy(zero_copy_only=False))
            cuts = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if part is None or part[:3] != keys[a]:
                    if part is not None:
                        close()
                    part, pieces = (*keys[a], *(batch.column(c)[a].as_py() for c in ("rate", "total", "at"))), []
                pieces.append(values[ends[a - 1] if a else 0 : ends[b - 1]])
            if out:
                yield told(kinds)
                out.clear()
        if part is not None:
            close()
            yield told(kinds)

    # Parts are many and may be small: a task takes them one after another from its sorted rows.
    dealt = cut.repartition(*names, "part").sortWithinPartitions(*names, "part", "at")
    return dealt.mapInArrow(run, f"session {kinds['session']}, source {kinds['source']}, part long, first long, samples array<double>")

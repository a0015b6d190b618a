"""Running captures as a streaming source: raw sample files that grow, read by offsets in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tapeloom.streaming.capture import EVENT_SCHEMA

#: Little-endian samples of these kinds; whole numbers become -1 to 1.
KINDS = {"i8": "<i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "f32": "<f4", "f64": "<f8"}
END = "end"
BLOCK_FRAMES = 1600
BLOCKS_A_TASK = 2000
FILES_A_TASK = 100
COLUMNS = ["session", "arrival", "kind", "source", "sequence", "channels", "sample_rate", "samples", "message"]


def to_floats(data: bytes, kind: str) -> np.ndarray:
    """Samples as floats; bytes after the last whole sample don't count."""
    if kind not in KINDS:
        raise ValueError(f"no sample format {kind}")
    size = np.dtype(KINDS[kind]).itemsize
    raw = np.frombuffer(data, KINDS[kind], len(data) // size)
    if kind[0] == "f":
        return raw.astype(np.float32)
    half = 2.0 ** (8 * size - 1)
    return ((raw.astype(np.float64) - (half if kind[0] == "u" else 0)) / half).astype(np.float32)


@dataclass(frozen=True)
class Capture:
    """A file's name, session/source.kind.rate.channels.pcm, taken apart."""

    session: str
    source: str
    kind: str
    rate: int
    channels: int

    @classmethod
    def of(cls, name: str) -> Capture:
        session, _, file = name.rpartition("/")
        source, kind, rate, channels, _ = file.rsplit(".", 4)
        out = cls(session, source, kind, int(rate), int(channels))
        if kind not in KINDS or out.rate <= 0 or out.channels <= 0:
            raise ValueError(f"{name} doesn't name a sample format, a rate and channels")
        return out

    @property
    def frame_bytes(self) -> int:
        return np.dtype(KINDS[self.kind]).itemsize * self.channels

    def arrival(self, block: int, frames: int) -> int:
        """Microseconds of sound before a block: what puts the blocks of a session's sources in order."""
        return block * frames * 1_000_000 // self.rate


@dataclass
class Blocks(InputPartition):
    """(file, first block, end) of what a task reads; or the ends of sessions (session, -1, arrival)."""

    pieces: list[tuple[str, int, int]]


class CaptureReader(DataSourceStreamReader):
    """Offsets are blocks by file, and the sessions that have ended. Only whole blocks are read while a session runs; its end gives the rest.

    A block's number is its place in its file, so numbers run from 0 without a gap and a batch that runs again gives the same ones. Listing the folder is the driver's work, as are
    the offsets: one number a capture; samples are read by tasks, at most BLOCKS_A_TASK blocks of FILES_A_TASK files each."""

    def __init__(self, path: str, frames: int) -> None:
        self.path, self.frames = path, frames

    def _system(self) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return system, root.rstrip("/")

    def initialOffset(self) -> dict:
        return {"blocks": {}, "ended": {}}

    def latestOffset(self) -> dict:
        system, root = self._system()
        found = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file]
        names = {f.path[len(root) + 1 :]: f.size for f in found}
        ended = {n.rpartition("/")[0]: True for n in sorted(names) if n.rpartition("/")[2] == END}
        blocks = {}
        for name, size in sorted(names.items()):
            if name.endswith(".pcm"):
                capture = Capture.of(name)
                n = size // capture.frame_bytes
                blocks[name] = -(-n // self.frames) if capture.session in ended else n // self.frames
        return {"blocks": blocks, "ended": ended}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        pieces, last = [], {}
        for name, until in end["blocks"].items():
            begin, capture = start["blocks"].get(name, 0), Capture.of(name)
            if until < begin:
                raise RuntimeError(f"{name} has become shorter")
            pieces += [(name, at, min(until, at + BLOCKS_A_TASK)) for at in range(begin, until, BLOCKS_A_TASK)]
            last[capture.session] = max(last.get(capture.session, 0), capture.arrival(until, self.frames))
        pieces += [(session, -1, last.get(session, 0)) for session in end["ended"] if session not in start["ended"]]
        # Short pieces share a task: as many as make up one's blocks, and not too many files.
        out, held = [], 0
        for name, begin, until in pieces:
            size = max(1, until - begin) if begin >= 0 else 1
            if not out or held + size > BLOCKS_A_TASK or len(out[-1].pieces) >= FILES_A_TASK:
                out.append(Blocks([]))
                held = 0
            out[-1].pieces.append((name, begin, until))
            held += size
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("session", pa.string()), ("arrival", pa.int64()), ("kind", pa.string()), ("source", pa.string()), ("sequence", pa.int64()), ("channels", pa.int32()), ("sample_rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("message", pa.string())])
        system, root = self._system()
        for name, begin, until in partition.pieces:
            if begin < 0:
                yield pa.RecordBatch.from_pylist([{"session": name, "arrival": until, "kind": "end"}], schema)
                continue
            capture = Capture.of(name)
            step = self.frames * capture.frame_bytes
            with system.open_input_file(f"{root}/{name}") as file:
                for first in range(begin, until, 100):
                    rows = []
                    for block in range(first, min(until, first + 100)):
                        file.seek(block * step)
                        data = file.read(step)
                        data = data[: len(data) // capture.frame_bytes * capture.frame_bytes]  # the last block may be short, and end in part of a frame
                        rows.append({"session": capture.session, "arrival": capture.arrival(block, self.frames), "kind": "audio", "source": capture.source, "sequence": block, "channels": capture.channels, "sample_rate": capture.rate, "samples": to_floats(data, capture.kind)})
                    yield pa.RecordBatch.from_pylist(rows, schema)


class CaptureSource(DataSource):
    """Events of running captures (EVENT_SCHEMA). Options: path, a folder of files session/source.kind.rate.channels.pcm that only ever grow, with a file session/end once a
    session is over; blockFrames, the frames of a block."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return EVENT_SCHEMA

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("blockFrames", BLOCK_FRAMES)))


def running_captures(spark: SparkSession, path: str, block_frames: int = BLOCK_FRAMES):
    """The stream of a folder of running captures; see CaptureSource. The folder must be reachable by that address from every executor."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").option("path", path).option("blockFrames", block_frames).load()

"""Audio files as a Spark source and sink: long WAV files read by ranges, WAV and FLAC files written block by block by many tasks."""

from __future__ import annotations

import contextlib
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tapeloom.functions.codecs import BLOCK, flac_frames, flac_header, wav_header

HEADER = {"wav": 44, "flac": 42, "raw": 0}
#: First sample numbers that take a byte more in a frame's header (fixed values).
LONGER = [1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31]
FRAME_BYTES = 4 + 1 + 1 + 1 + 2 * BLOCK + 2
RANGE_FRAMES = 1 << 22
ROWS_A_BATCH = 64
#: Files that wait for the disk at a time, and files renamed at a time (more of them wait for each other).
FINISHERS, RENAMERS = 16, 4
READ_SCHEMA = "name string, first long, rate int, samples array<float>"


def block_place(first: int, kind: str) -> int:
    """Where the block that begins at a sample lies in its file: all blocks before it are whole, so their sizes are known without looking at them."""
    if first % BLOCK:
        raise ValueError("a block begins at a multiple of its size")
    if kind != "flac":
        return HEADER[kind] + 2 * first
    longer = sum(max(0, first // BLOCK - -(-edge // BLOCK)) for edge in LONGER)
    return HEADER[kind] + first // BLOCK * FRAME_BYTES + longer


@dataclass
class Written:
    """What a task has written of one file: its ranges of samples, and of its blocks the least size and the ends of the frames' sizes."""

    ranges: list[tuple[int, int]] = field(default_factory=list)
    least: int = BLOCK
    shortest: int = 1 << 24
    longest: int = 0

    def add(self, first: int, n: int, size: int) -> None:
        if self.ranges and self.ranges[-1][1] == first:
            self.ranges[-1] = self.ranges[-1][0], first + n
        else:
            self.ranges.append((first, first + n))
        self.least, self.shortest, self.longest = min(self.least, n), min(self.shortest, size), max(self.longest, size)

    @property
    def gapless(self) -> bool:
        return len(self.ranges) == 1 and not self.ranges[0][0]


@dataclass
class TaskWrote(WriterCommitMessage):
    files: dict[str, Written]


def joined(parts: list[Written]) -> tuple[Written, list[tuple[int, int]]]:
    """All of a file's blocks as one, and the ranges that are there, joined where they meet; samples written twice are an error."""
    whole = Written([], min(p.least for p in parts), min(p.shortest for p in parts), max(p.longest for p in parts))
    for first, end in sorted(r for p in parts for r in p.ranges):
        if whole.ranges and first < whole.ranges[-1][1]:
            raise ValueError(f"sample {first} was written twice")
        if whole.ranges and first == whole.ranges[-1][1]:
            whole.ranges[-1] = whole.ranges[-1][0], end
        else:
            whole.ranges.append((first, end))
    return whole, whole.ranges


def many_at_once(f: Callable[[str], None], names: list[str], n: int) -> None:
    """Calls f for each name, n at a time; a thread has a share of the names, so what waits is small however many there are."""
    with ThreadPoolExecutor(n) as pool:
        list(pool.map(lambda k: [f(name) for name in names[k::n]], range(n)))


class AudioWriter(DataSourceArrowWriter):
    """Files from rows (name, first, pcm) in any order and on any task: blocks of BLOCK samples, the last of a file may be short.

    A task writes each block at its place in a file of this job, which the readers don't see; the same bytes go to the same place if a task runs again. Its message has, for each
    file, the ranges written. A file's header (lengths, and for FLAC the frames' ends) is written, and the file brought to the disk, by the task if its blocks are gapless from 0.
    Committing checks that all files are gapless, does the same for those of several tasks, and renames the files: a file of one task costs the driver its renaming only. When the
    job fails, what is there without a gap from the start gets its header and stays beside the file's name as .partial, to be played or repaired.
    The folder must be one that the driver and all executors share and can write at any place, as local and network file systems are."""

    def __init__(self, path: str, kind: str, rate: int) -> None:
        if kind not in HEADER:
            raise ValueError(f"no audio format {kind}")
        self.root, self.kind, self.rate, self.job = re.sub(r"^file:/+", "/", path).rstrip("/"), kind, rate, uuid.uuid4().hex

    def _own(self, name: str) -> str:
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name} is no file below the folder")
        return f"{self.root}/{name}.{self.job}.tmp"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskWrote:
        found: dict[str, Written] = {}
        made: set[str] = set()
        with contextlib.ExitStack() as stack:
            open_name, place = None, -1
            for batch in iterator:
                names, firsts = batch.column("name").to_pylist(), batch.column("first").to_pylist()
                blocks = [np.asarray(x.values) if x.is_valid else np.zeros(0) for x in batch.column("pcm")]
                if self.kind == "flac":
                    data = flac_frames(firsts, blocks)
                else:
                    data = [b.astype("<i2").tobytes() for b in blocks]
                for name, first, block, octets in zip(names, firsts, blocks, data, strict=True):
                    if not 0 < len(block) <= BLOCK:
                        raise ValueError(f"a block holds 1 to {BLOCK} samples")
                    if name != open_name:
                        stack.close()
                        path = self._own(name)
                        if (folder := os.path.dirname(path)) not in made:
                            os.makedirs(folder, exist_ok=True)
                            made.add(folder)
                        place = os.open(path, os.O_WRONLY | os.O_CREAT)
                        stack.callback(os.close, place)
                        open_name = name
                    os.pwrite(place, octets, block_place(first, self.kind))
                    found.setdefault(name, Written()).add(first, len(block), len(octets))
        # Nothing is cut off here: other tasks may have written what follows.
        many_at_once(lambda name: self._complete(name, found[name], found[name].ranges[0][1]), [name for name, part in found.items() if part.gapless], FINISHERS)
        return TaskWrote(found)

    def _end(self, whole: Written, samples: int) -> int:
        """The size of a file of so many samples."""
        full = samples // BLOCK * BLOCK
        return block_place(full, self.kind) + (0 if samples == full else whole.shortest if self.kind == "flac" else 2 * (samples - full))

    def _complete(self, name: str, whole: Written, samples: int, end: int | None = None) -> None:
        """The header for so many samples, and nothing after `end`, on the disk."""
        header = {"wav": lambda: wav_header(2 * samples, self.rate), "flac": lambda: flac_header(samples, whole.least, whole.shortest, whole.longest, self.rate), "raw": lambda: b""}[self.kind]()
        place = os.open(self._own(name), os.O_RDWR)
        try:
            os.pwrite(place, header, 0)
            if end is not None:
                os.ftruncate(place, end)
            os.fsync(place)
        finally:
            os.close(place)

    def _finish(self, name: str, whole: Written, samples: int, to: str, done: bool = False) -> None:
        """The file under its name, completed before if its task hasn't or a lost attempt left it longer."""
        own, end = self._own(name), self._end(whole, samples)
        if not done or os.stat(own).st_size != end:
            self._complete(name, whole, samples, end)
        os.replace(own, to)

    @staticmethod
    def _by_name(messages: list[WriterCommitMessage | None]) -> dict[str, list[Written]]:
        out: dict[str, list[Written]] = {}
        for message in messages:
            for name, part in message.files.items() if message else ():
                out.setdefault(name, []).append(part)
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        written = self._by_name(messages)
        done = {name for name, parts in written.items() if len(parts) == 1 and parts[0].gapless}
        files = {name: parts[0] if name in done else joined(parts)[0] for name, parts in written.items()}
        for name, whole in files.items():
            if not whole.gapless:
                raise ValueError(f"{name} has gaps: {whole.ranges[:3]}")
        finish = lambda name: self._finish(name, files[name], files[name].ranges[0][1], f"{self.root}/{name}", name in done)
        many_at_once(finish, [name for name in files if name not in done], FINISHERS)
        many_at_once(finish, list(done), RENAMERS)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for name, parts in self._by_name(messages).items():
            with contextlib.suppress(OSError, ValueError):
                whole, ranges = joined(parts)
                # A short block in the middle can't be: what is there ends at a whole block, or is all.
                self._finish(name, whole, ranges[0][1] if not ranges[0][0] else 0, f"{self.root}/{name}.partial")
        for folder, _, names in os.walk(self.root):
            for n in names:
                if n.endswith(f".{self.job}.tmp"):
                    with contextlib.suppress(OSError):
                        os.remove(f"{folder}/{n}")


@dataclass(frozen=True)
class Layout:
    """Where a WAV file's samples are."""

    begin: int
    octets: int
    rate: int
    channels: int

    @property
    def frames(self) -> int:
        return self.octets // (2 * self.channels)


def wav_layout(file, size: int, repair: bool) -> Layout:
    """Reads the chunks' heads only. repair: the samples go on to the file's end, whatever the header says."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels = 12, 0, 0
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if kind != 1 or bits != 16 or not channels:
                raise ValueError("only 16-bit PCM is read")
        elif name == b"data":
            if not channels:
                raise ValueError("samples come before their format")
            there = size - at - 8
            return Layout(at + 8, there if repair else min(length, there), rate, channels)
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


@dataclass
class Range(InputPartition):
    """Frames begin to end of one file whose layout is known, or whole short files."""

    names: list[tuple[str, int]]
    layout: Layout | None = None
    begin: int = 0
    end: int = 0


class WavReader(DataSourceReader):
    """Rows (name, first, rate, samples: channels averaged) of WAV files, BLOCK frames a row.

    A file of more than rangeFrames frames is cut to ranges, each a task's, and its header is read once, by the driver; shorter ones are packed together and tasks read their headers."""

    def __init__(self, path: str, range_frames: int, repair: bool) -> None:
        self.path, self.range_frames, self.repair = path, max(BLOCK, range_frames // BLOCK * BLOCK), repair

    def _system(self) -> tuple[pafs.FileSystem, str]:
        system, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + re.sub(r"^file:/+", "/", self.path))
        return system, root.rstrip("/")

    def partitions(self) -> Sequence[InputPartition]:
        system, root = self._system()
        info = system.get_file_info(root)
        files = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".wav")]
        out, packed, held = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f.size <= 2 * self.range_frames:
                packed.append((f.path, f.size))
                held += f.size
                if held > 2 * self.range_frames:
                    out.append(Range(packed))
                    packed, held = [], 0
                continue
            with system.open_input_file(f.path) as file:
                layout = wav_layout(file, f.size, self.repair)
            out += [Range([(f.path, f.size)], layout, at, min(layout.frames, at + self.range_frames)) for at in range(0, layout.frames, self.range_frames)]
        return [*out, *([Range(packed)] if packed else [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = self._system()
        for path, size in partition.names:
            with system.open_input_file(path) as file:
                layout = partition.layout or wav_layout(file, size, self.repair)
                until = partition.end if partition.layout else layout.frames
                name = path[len(root) + 1 :] or path.rpartition("/")[2]
                for at in range(partition.begin, until, ROWS_A_BATCH * BLOCK):
                    end = min(until, at + ROWS_A_BATCH * BLOCK)
                    file.seek(layout.begin + at * 2 * layout.channels)
                    data = file.read((end - at) * 2 * layout.channels)
                    mono = np.frombuffer(data, "<i2").reshape(-1, layout.channels).astype(np.float32).mean(axis=1) / np.float32(32768)
                    firsts = list(range(at, end, BLOCK))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(firsts)), pa.array(firsts, pa.int64()), pa.array([layout.rate] * len(firsts), pa.int32()), pa.ListArray.from_arrays(pa.array([*range(0, end - at, BLOCK), end - at], pa.int32()), pa.array(mono.astype(np.float32)))], ["name", "first", "rate", "samples"])


class AudioSource(DataSource):
    """Options: path; format (of what is written: wav, flac or raw); rate; rangeFrames; repair (true: read to the file's end, for files whose header was never completed)."""

    @classmethod
    def name(cls) -> str:
        return "audio"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("rangeFrames", RANGE_FRAMES)), self.options.get("repair", "false") == "true")

    def writer(self, schema, overwrite: bool) -> AudioWriter:
        return AudioWriter(self.options["path"], self.options.get("format", "wav"), int(self.options.get("rate", 16_000)))


def write_audio(blocks: DataFrame, path: str, kind: str = "wav", rate: int = 16_000, key: str = "name") -> None:
    """One file (named by key, with the format's ending) for each stream of blocks (key, first, pcm) as pcm_blocks gives them. See AudioWriter.

    No rows are moved: a long recording's blocks are written where they are. Sorting within a task only keeps its files few."""
    blocks.sparkSession.dataSource.register(AudioSource)
    ending = "pcm" if kind == "raw" else kind
    named = blocks.select(F.concat(F.col(key).cast("string"), F.lit(f".{ending}")).alias("name"), F.col("first").cast("long").alias("first"), F.col("pcm").cast("array<smallint>").alias("pcm"))
    named.sortWithinPartitions("name", "first").write.format("audio").mode("append").option("path", path).option("format", kind).option("rate", rate).save()


def read_wav_files(spark: SparkSession, path: str, range_frames: int = RANGE_FRAMES, repair: bool = False) -> DataFrame:
    """(name, first, rate, samples) of a WAV file or of all below a folder, at most range_frames frames of a file a task. See WavReader."""
    spark.dataSource.register(AudioSource)
    return spark.read.format("audio").option("path", path).option("rangeFrames", range_frames).option("repair", str(repair).lower()).load()


def repair_wav_file(path: str) -> int:
    """Puts the length that is there into a file's header, and returns the number of samples; nothing but the 44 bytes is read or written."""
    place = os.open(re.sub(r"^file:/+", "/", path), os.O_RDWR)
    try:
        head, octets = os.pread(place, 44, 0), os.fstat(place).st_size - 44
        if octets < 0 or head[:4] != b"RIFF":
            raise ValueError("too short for a WAV file")
        os.pwrite(place, wav_header(octets, int.from_bytes(head[24:28], "little")), 0)
        os.fsync(place)
    finally:
        os.close(place)
    return octets // 2

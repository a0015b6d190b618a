"""WAV and FLAC bytes: small Arrow helpers for what column expressions can't write."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.signal import quantise

BLOCK = 4096
WAV_LIMIT = 2**32 - 1 - 36


def wav_header(data_bytes: int, rate: int = 16_000) -> bytes:
    """44 bytes of a mono 16-bit RIFF file."""
    if data_bytes > WAV_LIMIT:
        raise ValueError("a WAV file can't pass 4 GiB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + data_bytes, b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", data_bytes)


def parse_wav_bytes(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in -1..1, channels averaged) of a 16-bit PCM file; other chunks are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, channels = 12, 0, 1
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind != 1 or bits != 16 or not channels:
                raise ValueError("only 16-bit PCM is read")
        elif name == b"data":
            pcm = np.frombuffer(body[: len(body) // (2 * channels) * 2 * channels], "<i2").astype(np.float32) / 32768
            return rate, pcm.reshape(-1, channels).mean(axis=1)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def repair_wav_bytes(data: bytes) -> bytes:
    """The file with the length in its header set to what is there."""
    rate = int.from_bytes(data[24:28], "little")
    return wav_header(max(0, len(data) - 44), rate) + data[44:]


def _crc_table(polynomial: int, bits: int) -> list[int]:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value & top else 0)) & mask
        table.append(value)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = CRC8[value ^ byte]
    return value


def crc16(data: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of a byte matrix, all rows a byte at a time."""
    table, value = np.array(CRC16, np.uint16), np.zeros(len(data), np.uint16)
    for column in np.ascontiguousarray(data.T):
        value = (value << np.uint16(8)) ^ table[(value >> np.uint16(8)) ^ column]
    return value


def utf8_uint(value: int) -> bytes:
    """UTF-8's scheme carried on to 36 bits."""
    if not 0 <= value < 1 << 36:
        raise ValueError("the stream is too long")
    if value < 0x80:
        return bytes([value])
    tail = []
    while value >= 1 << (6 - len(tail)) if len(tail) < 6 else value:
        tail.insert(0, 0x80 | value & 0x3F)
        value >>= 6
    lead = 0xFF << (7 - len(tail)) & 0xFF
    return bytes([lead | value, *tail])


def flac_frames(first: list[int], pcm: list[np.ndarray]) -> list[bytes]:
    """Verbatim mono frames that begin at the absolute samples `first`, of at most BLOCK samples each; frames of one size are checked together."""
    bodies = []
    for at, samples in zip(first, pcm, strict=True):
        short = b"" if len(samples) == BLOCK else struct.pack(">H", len(samples) - 1)
        head = b"\xff\xf9" + (b"\x70" if short else b"\xc0") + b"\x08" + utf8_uint(at) + short
        bodies.append(head + bytes([crc8(head), 0x02]) + np.asarray(samples).astype(">i2").tobytes())
    sums = [0] * len(bodies)
    for size in set(map(len, bodies)):
        own = [i for i, b in enumerate(bodies) if len(b) == size]
        for i, value in zip(own, crc16(np.frombuffer(b"".join(bodies[i] for i in own), np.uint8).reshape(len(own), size)), strict=True):
            sums[i] = int(value)
    return [b + struct.pack(">H", s) for b, s in zip(bodies, sums, strict=True)]


def flac_header(samples: int, least: int, shortest: int, longest: int, rate: int = 16_000) -> bytes:
    """The stream's marker and STREAMINFO. least: samples of the smallest frame; shortest, longest: frames' bytes."""
    if not samples:
        raise ValueError("a FLAC stream needs a sample")
    info = struct.pack(">HH", least, BLOCK) + shortest.to_bytes(3, "big") + longest.to_bytes(3, "big") + (rate << 44 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + info


def decode_flac_bytes(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a stream of verbatim mono frames, each checksum verified."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    rate, at, out = int.from_bytes(data[18:26], "big") >> 44, 42, []
    while at < len(data):
        lead = data[at + 4]
        extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        end = at + 5 + extra
        count = BLOCK
        if data[at + 2] >> 4 == 7:
            count, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
        if crc8(data[at:end]) != data[end]:
            raise ValueError("a frame's header is damaged")
        stop = end + 2 + 2 * count
        if int(crc16(np.frombuffer(data[at:stop], np.uint8)[None])[0]) != int.from_bytes(data[stop : stop + 2], "big"):
            raise ValueError("a frame is damaged")
        out.append(np.frombuffer(data[end + 2 : stop], ">i2"))
        at = stop + 2
    return rate, np.concatenate(out).astype(np.int16)


def _each(f, data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else f(b))


def decode_f32(data: Column) -> Column:
    """Little-endian 32-bit floats; trailing bytes are ignored; null stays null."""
    return F.pandas_udf(lambda x: _each(lambda b: np.frombuffer(b, "<f4", len(b) // 4), x), "array<float>", 200)(data)


def pcm_blocks(df: DataFrame, key: str, samples: str, order: str | None = None) -> DataFrame:
    """(key, first, pcm): the 16-bit samples of each stream in blocks of BLOCK, with the absolute place of the first.

    A stream is one row, or the rows of a key in order; a short last block stays."""
    from tapeloom.operators.sequence import sample_parts

    rows = df.withColumn("__order", F.lit(0) if order is None else F.col(order))
    cut = sample_parts(rows, key, ["__order"], samples, BLOCK)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "samples"))), lambda x: x["samples"]))
    return cut.groupBy(key, "part").agg(whole.alias("samples")).select(key, (F.col("part") * BLOCK).alias("first"), F.transform("samples", quantise).alias("pcm"))


def wav_rows(blocks: DataFrame, key: str, rate: int = 16_000) -> DataFrame:
    """(key, n, bytes): each stream's WAV file in rows, its header (n = -1) and blocks in order; written one after the other they are the file.

    The header is an aggregate of the blocks there, so a checkpoint is a rewrite of one row."""
    data = F.pandas_udf(lambda x: x.map(lambda a: np.asarray(a).astype("<i2").tobytes()), "binary", 200)(F.col("pcm"))
    head = F.pandas_udf(lambda x: x.map(lambda n: wav_header(2 * int(n), rate)), "binary", 200)
    sizes = blocks.groupBy(key).agg(F.sum(F.size("pcm")).alias("n"))
    return blocks.select(key, F.col("first").alias("n"), data.alias("bytes")).unionByName(sizes.select(key, F.lit(-1).cast("long").alias("n"), head("n").alias("bytes")))


def flac_rows(blocks: DataFrame, key: str, rate: int = 16_000) -> DataFrame:
    """(key, n, bytes): each stream's FLAC file in rows, a frame a block, as wav_rows."""
    frame = F.pandas_udf(lambda first, pcm: pd.Series(flac_frames(list(map(int, first)), list(pcm))), "binary", 200)
    head = F.pandas_udf(lambda n, least, shortest, longest: pd.Series([flac_header(*map(int, x), rate) for x in zip(n, least, shortest, longest, strict=True)]), "binary", 200)
    frames = blocks.select(key, F.col("first").alias("n"), F.size("pcm").alias("__size"), frame("first", "pcm").alias("bytes"))
    sizes = frames.groupBy(key).agg(F.sum("__size").alias("n"), F.min("__size").alias("least"), F.min(F.octet_length("bytes")).alias("shortest"), F.max(F.octet_length("bytes")).alias("longest"))
    return frames.drop("__size").unionByName(sizes.select(key, F.lit(-1).cast("long").alias("n"), head("n", "least", "shortest", "longest").alias("bytes")))


def whole_files(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): files short enough to be one value."""
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("n", "bytes"))), F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    return rows.groupBy(key).agg(joined.alias("content"))


def read_wav(content: Column) -> Column:
    """struct<rate, samples>; a file that isn't 16-bit PCM is an error."""

    def read(data: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if b is None else parse_wav_bytes(bytes(b)) for b in data]
        return pd.DataFrame({"rate": pd.array([r for r, _ in rows], "Int32"), "samples": [s for _, s in rows]})

    return F.pandas_udf(read, "rate int, samples array<float>", 200)(content)


def repair_wav(content: Column) -> Column:
    return F.pandas_udf(lambda x: _each(lambda b: repair_wav_bytes(bytes(b)), x), "binary", 200)(content)

"""Audio files written by many tasks and read by ranges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import codecs
from tapeloom.sources import audio


def blocks(spark, streams, parts=5):
    rows = [(k, first, pcm[first : first + codecs.BLOCK].tolist()) for k, pcm in streams.items() for first in range(0, len(pcm), codecs.BLOCK)]
    return spark.createDataFrame(rows, "name string, first long, pcm array<int>").repartition(parts)


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(-32767, 32768, n)


STREAMS = {"a": noise(9001), "deep/b": noise(4096, 2), "c": noise(1, 3), "d": noise(40_000, 4)}


@pytest.mark.parametrize("kind", ["wav", "flac", "raw"])
def test_files_hold_what_was_written(spark, tmp_path, kind):
    audio.write_audio(blocks(spark, STREAMS), f"file://{tmp_path}", kind)
    for name, pcm in STREAMS.items():
        data = (tmp_path / f"{name}.{'pcm' if kind == 'raw' else kind}").read_bytes()
        if kind == "wav":
            assert data == codecs.wav_header(2 * len(pcm)) + pcm.astype("<i2").tobytes()
        elif kind == "raw":
            assert data == pcm.astype("<i2").tobytes()
        else:
            frames = codecs.flac_frames(list(range(0, len(pcm), 4096)), [pcm[i : i + 4096] for i in range(0, len(pcm), 4096)])
            least = min(4096, len(pcm) % 4096 or 4096)
            assert data == codecs.flac_header(len(pcm), least, min(map(len, frames)), max(map(len, frames))) + b"".join(frames)
            assert (codecs.decode_flac_bytes(data)[1] == pcm).all()
    assert sum(len(f) for *_, f in os.walk(tmp_path)) == len(STREAMS)


def test_places_of_blocks_beyond_all_lengths_of_numbers():
    for edge in audio.LONGER:
        for first in {max(0, edge // 4096 * 4096 + d * 4096) for d in range(-2, 3)}:
            size = len(codecs.utf8_uint(first)) + 4 + 2 + 2 * 4096 + 2
            assert audio.block_place(first + 4096, "flac") - audio.block_place(first, "flac") == size
    assert audio.block_place(0, "flac") == 42 and audio.block_place(8192, "wav") == 44 + 16384
    with pytest.raises(ValueError):
        audio.block_place(5, "wav")


@pytest.mark.parametrize("kind", ["wav", "flac"])
def test_a_failed_job_leaves_a_prefix_that_plays(spark, tmp_path, kind):
    (tmp_path / f"s.{kind}").write_bytes(b"before")
    pcm = noise(12 * 4096)
    bad = blocks(spark, {"s": pcm}).withColumn("pcm", F.when(F.col("first") == 5 * 4096, F.raise_error("lost").cast("array<int>")).otherwise(F.col("pcm"))).repartitionByRange(12, "first")
    with pytest.raises(Exception, match="lost"):
        audio.write_audio(bad, str(tmp_path), kind)
    assert (tmp_path / f"s.{kind}").read_bytes() == b"before"
    left = [p.name for p in tmp_path.iterdir()]
    assert all(n.endswith((f".{kind}", ".partial")) for n in left)
    writer = audio.AudioWriter(str(tmp_path), kind, 16_000)
    import pyarrow as pa

    def batch(*places):
        return pa.RecordBatch.from_pylist([{"name": f"t.{kind}", "first": n * 4096, "pcm": pcm[n * 4096 : (n + 1) * 4096].tolist()} for n in places])

    told = [writer.write(iter([batch(0, 1)])), None, writer.write(iter([batch(2), batch(4)])), writer.write(iter([batch(7)]))]
    writer.abort(told)
    data = (tmp_path / f"t.{kind}.partial").read_bytes()
    got = codecs.decode_flac_bytes(data)[1] if kind == "flac" else np.round(codecs.parse_wav_bytes(data)[1] * 32768)
    assert (got == pcm[: 3 * 4096]).all() and not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError, match="gaps"):
        writer.commit([writer.write(iter([batch(0, 2)]))])
    with pytest.raises(ValueError, match="twice"):
        writer.commit([writer.write(iter([batch(0, 1)])), writer.write(iter([batch(1)]))])
    for name in ("../x", "/x", ""):
        with pytest.raises(ValueError):
            writer._own(name)


def test_ranges_of_a_long_file_are_the_whole_read(spark, tmp_path):
    pcm = noise(300_000, 9)
    audio.write_audio(blocks(spark, {"long": pcm, "short": pcm[:5000]}), str(tmp_path))
    read = audio.read_wav_files(spark, str(tmp_path), range_frames=20_000)
    assert read.rdd.getNumPartitions() == -(-300_000 // 16_384) + 1
    for name, n in (("long.wav", 300_000), ("short.wav", 5000)):
        rows = read.filter(F.col("name") == name).orderBy("first").collect()
        assert [r.first for r in rows] == list(range(0, n, 4096)) and {r.rate for r in rows} == {16_000}
        whole = codecs.parse_wav_bytes((tmp_path / name).read_bytes())[1]
        assert (np.concatenate([r.samples for r in rows]) == whole).all()
    stereo = tmp_path / "one" / "two.wav"
    stereo.parent.mkdir()
    body = noise(20_000, 5).astype("<i2").tobytes()
    import struct

    stereo.write_bytes(struct.pack("<4sI4s4sI3s1x4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"LIST", 3, b"abc", b"fmt ", 16, 1, 2, 8000, 32000, 4, 16, b"data", len(body)) + body)
    rows = audio.read_wav_files(spark, str(stereo), 4096).orderBy("first").collect()
    want = np.frombuffer(body, "<i2").reshape(-1, 2).mean(axis=1) / 32768
    assert np.allclose(np.concatenate([r.samples for r in rows]), want, atol=1e-7) and rows[0].rate == 8000 and rows[0].name == "two.wav"


def test_a_header_without_its_length_is_repaired(spark, tmp_path):
    pcm = noise(10_000, 6)
    path = tmp_path / "x.wav"
    path.write_bytes(codecs.wav_header(0) + pcm.astype("<i2").tobytes())
    count = lambda **o: sum(len(r.samples) for r in audio.read_wav_files(spark, str(tmp_path), **o).collect())
    assert count() == 0 and count(repair=True) == 10_000
    assert audio.repair_wav_file(f"file://{path}") == 10_000 and count() == 10_000
    path.write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        audio.repair_wav_file(str(path))
    with pytest.raises(Exception, match="WAV"):
        count()


@pytest.mark.parametrize("kind", ["wav", "flac", "raw"])
def test_a_task_completes_files_that_it_has_whole(tmp_path, kind, monkeypatch):
    """The driver only renames them; a file of two tasks, or one that a lost attempt left longer, is completed on commit."""
    import pyarrow as pa

    pcm, longer = noise(3 * 4096 + 7, 11), noise(8 * 4096, 12)
    writer = audio.AudioWriter(str(tmp_path), kind, 16_000)
    whole = {"short": 7, "even": 2 * 4096, "a/long": 3 * 4096 + 7}

    def batch(*places, of=pcm):
        return pa.RecordBatch.from_pylist([{"name": name, "first": first, "pcm": of[first : min(first + 4096, n)].tolist()} for name, first, n in places])

    def want(n):
        samples = pcm[:n]
        if kind != "flac":
            return (codecs.wav_header(2 * n) if kind == "wav" else b"") + samples.astype("<i2").tobytes()
        cuts = range(0, n, 4096)
        frames = codecs.flac_frames(list(cuts), [samples[i : i + 4096] for i in cuts])
        return codecs.flac_header(n, min(4096, n - cuts[-1]), min(map(len, frames)), max(map(len, frames))) + b"".join(frames)

    writer.write(iter([batch(*[("cut", k * 4096, 8 * 4096) for k in range(5)], of=longer)]))  # a lost attempt
    told = [writer.write(iter([batch(*[(name, first, n) for name, n in whole.items() for first in range(0, n, 4096)]), batch(("two", 0, 4096))]))]
    for name, n in whole.items():
        assert open(writer._own(name), "rb").read() == want(n)
    told += [None, writer.write(iter([batch(("two", 4096, 4096 + 5), ("cut", 0, 4096))]))]
    completed, complete = [], audio.AudioWriter._complete
    monkeypatch.setattr(audio.AudioWriter, "_complete", lambda self, name, *a: (completed.append(name), complete(self, name, *a)))
    writer.commit(told)
    assert sorted(completed) == ["cut", "two"]
    for name, n in (whole | {"two": 4096 + 5, "cut": 4096}).items():
        assert (tmp_path / name).read_bytes() == want(n)
    assert not list(tmp_path.rglob("*.tmp"))

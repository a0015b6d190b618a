"""Archives written by a stream: the same files however batches cut it, and readable after any stop."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sessions import write

from tapeloom.functions import codecs
from tapeloom.operators import history, queue
from tapeloom.sources import documents
from tapeloom.streaming import archive

LIMIT = 10_000
SCHEMA = "session string, kind string, source string, position long, samples array<float>"


def wave(n, seed):
    return np.random.default_rng(seed).uniform(-1.1, 1.1, n).astype(np.float32)


def pcm_of(path):
    data = path.read_bytes()
    if path.suffix == ".flac":
        return codecs.decode_flac_bytes(data)[1]
    assert len(data) == 44 + int.from_bytes(data[40:44], "little")
    return np.frombuffer(data[44:], "<i2")


def play(spark, folder, name, rows, kind, fail=False, **options):
    write(folder / "in", f"{name}.json", "\n".join(map(json.dumps, rows)))
    out = archive.archive_stream(spark.readStream.schema(SCHEMA).json(str(folder / "in")), f"file://{folder}/root", kind, segment_samples=LIMIT, **options)
    told = []

    def keep(batch, number):
        told.extend(batch.collect())
        if fail:
            raise RuntimeError("lost")

    q = out.writeStream.foreachBatch(keep).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return told


def mixed(session, x, a, b, source="mixed"):
    return {"session": session, "kind": "mixed", "source": source, "position": a, "samples": x[a:b].tolist()}


def mark(session, kind, position):
    return {"session": session, "kind": kind, "source": "mixed", "position": position}


@pytest.mark.parametrize("kind", ["wav", "flac"])
def test_files_are_the_same_however_batches_cut(spark, tmp_path, kind):
    rng = random.Random(2)
    audio = {"one": wave(25_001, 1), "exact": wave(20_000, 2), "short": wave(7, 3)}
    at = dict.fromkeys(audio, 0)
    for n in range(4):
        rows = []
        for s, x in audio.items():
            until = len(x) if n == 3 else rng.randint(at[s], len(x))
            cuts = sorted({at[s], until, *(rng.randint(at[s], until) for _ in range(2))})
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows += [mixed(s, x, a, b)] + ([mark(s, "checkpoint", b)] if rng.random() < 0.5 else [])
            rows += [mark(s, "end", until)] if n == 3 else [{"session": s, "kind": "level", "source": "system", "position": 3}]
            at[s] = until
        rng.shuffle(rows)
        told = play(spark, tmp_path, str(n), rows, kind)
    assert {r.session: (r.status, r.samples) for r in told} == {s: ("completed", len(x)) for s, x in audio.items()}
    for s, x in audio.items():
        (folder,) = (tmp_path / "root").glob(f"*/*/*/{s}")
        files = sorted(folder.glob("audio-*"))
        assert [len(pcm_of(f)) for f in files] == [min(LIMIT, len(x) - a) for a in range(0, len(x), LIMIT)]
        assert (np.concatenate([pcm_of(f) for f in files]) == archive.quantise(x)).all()
        assert sorted(p.name for p in folder.iterdir()) == [f.name for f in files] + ["session.json"]
    scan = lambda k: documents.scan_documents(spark, f"{tmp_path}/root", k)
    found = {r.sessionId: r for r in history.history_entries(scan("session"), scan("transcript"), scan("translation")).collect()}
    assert {s: (r.segmentCount, r.durationMs, r.status, r.completedAt is None) for s, r in found.items()} == {"one": (3, 625 + 625 + 312, "completed", False), "exact": (2, 1250, "completed", False), "short": (1, 0, "completed", False)}


@pytest.mark.parametrize("kind", ["wav", "flac"])
def test_a_stop_leaves_what_was_durable(spark, tmp_path, kind):
    x = wave(14_000, 5)
    play(spark, tmp_path, "0", [mixed("s", x, 0, 5000), mark("s", "checkpoint", 5000), mixed("s", x, 5000, 5100)], kind)
    (folder,) = (tmp_path / "root").glob("*/*/*/s")
    file = folder / f"audio-0000.{kind}"
    if kind == "flac":
        assert len(pcm_of(file)) == 5000
    else:
        data = file.read_bytes()
        assert int.from_bytes(data[40:44], "little") == 10_000 and len(data) == 44 + 10_200
    manifest = json.loads((folder / "session.json").read_text())
    assert manifest["status"] == "recording" and [(s["sampleCount"], s["finalized"]) for s in manifest["segments"]] == [(5000, False)]
    with pytest.raises(Exception, match="lost"):
        play(spark, tmp_path, "1", [mixed("s", x, 5100, 13_000, "system"), mark("s", "checkpoint", 13_000)], kind, fail=True)
    told = play(spark, tmp_path, "2", [mixed("s", x, 13_000, 14_000), mark("s", "end", 14_000)], kind)
    assert (np.concatenate([pcm_of(f) for f in sorted(folder.glob("audio-*"))]) == archive.quantise(x)).all()
    assert told[-1].status == "completed" and json.loads(told[-1].manifest)["audioSource"] == "mixed"
    with pytest.raises(Exception, match="follow"):
        play(spark, tmp_path, "3", [mixed("t", x, 5, 10)], kind)


def test_every_batch_can_be_a_checkpoint_and_recovery_takes_over(spark, tmp_path):
    x = wave(9000, 6)
    told = play(spark, tmp_path, "0", [mixed("s", x, 0, 9000)], "wav", every_batch=True)
    assert [(r.status, r.samples) for r in told] == [("recording", 9000)]
    manifests = documents.scan_documents(spark, f"{tmp_path}/root", "session").filter("NOT corrupt")
    lengths = spark.createDataFrame([("s", "audio-0000.wav", 44 + 18_000)], "sessionId string, fileName string, length long")
    r = queue.recover_manifests(manifests, lengths, F.current_timestamp()).first()
    assert (r.status, r.segments[0].sampleCount, r.segments[0].durationMs) == ("interrupted", 9000, 562) and r.completedAt is not None
    for bad in ({"kind": "mp3"}, {"limit": 0}):
        with pytest.raises(ValueError):
            archive.Archiver(str(tmp_path), bad.get("kind", "wav"), bad.get("limit", 5), "UTC", False)


def test_halves_go_away_from_zero():
    assert archive.quantise(np.array([0.5 / 32767, -0.5 / 32767, 2.0, -2.0, np.nan, np.inf])).tolist() == [1, -1, 32767, -32767, 0, 0]


def test_rows_that_follow_are_written_in_one_go(tmp_path):
    """Three rows of one file: one write of its samples."""
    import numpy as np
    import pandas as pd

    from tapeloom.streaming import archive

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, x: setattr(self, "value", x)
        clear = lambda self: setattr(self, "value", None)

    archiver, calls = archive.Archiver(str(tmp_path), "wav", 100, "UTC", False), []
    archiver.state, archiver.tail, append = Value(), Value(), archiver._append
    archiver._append = lambda samples: (calls.append(len(samples)), append(samples))
    rows = [("s", "mixed", "mixed", n * 4, np.full(4, n / 10)) for n in (2, 0, 1)] + [("s", "level", "system", 0, None), ("s", "end", "mixed", 12, None)]
    saved = list(archiver.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["session", "kind", "source", "position", "samples"])]), None))
    assert calls == [12] and saved[0]["status"].tolist() == ["completed"]
    (file,) = tmp_path.rglob("*.wav")
    assert np.frombuffer(file.read_bytes()[44:], "<i2").tolist() == [0] * 4 + [3277] * 4 + [6553] * 4

"""Live segmentation, the queue as a stream, checkpoints and status from state, and the capture source."""

import json
import random
import shutil

import numpy as np
import pandas as pd
import pytest
from test_sessions import event, write

from tapeloom.operators import sequence
from tapeloom.plans import streams as plans
from tapeloom.streaming import capture, segments, source, worker

RULES = {"threshold": 0.5, "frame": 16, "min_speech_ms": 3, "min_silence_ms": 4, "max_segment_ms": 12}


def recording(rng, n):
    """Loud and quiet stretches of random lengths."""
    out = []
    while len(out) < n:
        level = rng.choice([0.0, 0.0, 0.9, 0.7])
        out += [level * rng.choice([1, -1]) * rng.random() for _ in range(rng.randint(1, 130))]
    return [float(np.float32(x)) for x in out[:n]]


def batch_segments(spark, recordings):
    blocks = spark.createDataFrame([(k, n, x[n : n + 37]) for k, x in recordings.items() for n in range(0, len(x), 37)], "session string, block long, samples array<double>")
    levels = sequence.frame_levels(blocks, "session", ["block"], "samples", RULES["frame"])
    found = sequence.threshold_segments(levels, "session", "position", "level", RULES["threshold"], RULES["frame"], RULES["min_speech_ms"], RULES["min_silence_ms"], RULES["max_segment_ms"])
    sizes = {k: len(x) for k, x in recordings.items()}
    return sorted((r.session, r.start_sample, min(r.end_sample, sizes[r.session])) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_live_segments_are_those_of_the_whole_recording(spark, tmp_path, seed):
    """However batches cut the audio: inside frames, inside segments, at silences."""
    rng = random.Random(seed)
    recordings = {f"s{i}": recording(rng, rng.randint(1, 4000)) for i in range(12)} | {"quiet": [0.0] * 100, "loud": [0.75] * 1001}
    at = dict.fromkeys(recordings, 0)
    schema = "session string, kind string, position long, samples array<float>"
    for n in range(5):
        rows = []
        for k, x in recordings.items():
            until = len(x) if n == 4 else rng.randint(at[k], len(x))
            cuts = sorted({at[k], until, *(rng.randint(at[k], until) for _ in range(rng.randint(0, 3)))})
            rows += [{"session": k, "kind": "mixed", "position": a, "samples": x[a:b]} for a, b in zip(cuts, cuts[1:], strict=False)] + [{"session": k, "kind": "level", "position": 7}]
            rows += [{"session": k, "kind": "end", "position": len(x)}] if n == 4 else []
            at[k] = until
        rng.shuffle(rows)
        write(tmp_path / "in", f"{n}.json", "\n".join(map(json.dumps, rows)))
        audio = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        segments.segment_stream(audio, **RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.session, r.start_sample, r.end_sample) for r in found) == batch_segments(spark, recordings) and len(found) > 20
    for r in found:
        own = recordings[r.session][r.start_sample : r.end_sample]
        assert r.samples == own and r.duration_ms == len(own) // 16
        loud = [abs(x) for x in own if abs(x) >= 0.5]
        assert r.peak == max(loud) if loud else r.peak is None


def test_pieces_close_as_soon_as_they_can():
    rules = segments.Rules(0.5, 1, 2, 2, 4)
    state, out = segments.follow(None, np.array([0, 0.9, 0.9, 0.0]), 0, rules, False)
    assert out == [] and state.last == 2
    state, out = segments.follow(state, np.array([0.0]), 4, rules, False)
    assert out == [(1, 3, 0.9)] and state is None
    state, out = segments.follow(state, np.array([0.6] * 5), 5, rules, False)
    assert out == [(5, 9, 0.6)] and (state.begin, state.last) == (9, 9)
    assert segments.follow(state, np.zeros(0), 10, rules, True) == (None, [(9, 10, 0.6)])
    assert segments.follow(None, np.array([0.9, 0, 0, 0]), 0, rules, True) == (None, [])
    with pytest.raises(ValueError):
        segments.Rules.of(max_segment_ms=1)


def test_a_sample_that_reads_as_the_threshold_is_loud(spark):
    at = np.float32(0.08)
    rules = segments.Rules.of(0.08, 8, 1, 1, 2)
    _, pieces = segments.follow(None, np.array([0, at, at, 0, 0, 0], np.float32).astype(float), 0, rules, True)
    assert [p[:2] for p in pieces] == [(1, 3)]
    levels = sequence.frame_levels(spark.createDataFrame([("a", 0, [0.0] * 8 + [float(at)] * 16 + [0.0] * 24)], "session string, block long, samples array<float>"), "session", ["block"], "samples", 8)
    found = sequence.threshold_segments(levels, "session", "position", "level", 0.08, 8, 1, 1, 2).collect()
    assert [(r.start_sample, r.end_sample) for r in found] == [(8, 24)]


def test_events_of_a_switched_session_have_an_order(spark, tmp_path):
    """A switch at block 7 of session 4, with blocks of both sources on both sides."""
    rows = [(n, 4, kind, 10.0 * n) for n in range(97 * 4, 97 * 9, 11) for kind in [("click", "error")[n % 2]]]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    events = sorted((r.arrival, r.kind, r.source) for r in plans._switched_events(spark, str(tmp_path)).collect())
    assert len({a for a, _, _ in events}) == len(events) == 11
    switch = next(n for n, e in enumerate(events) if e[1] == "mode")
    assert [e[2] for e in events[switch - 2 : switch + 3]] == ["microphone", "system", None, "microphone", "system"] and switch == 6


def test_switched_samples_are_not_held_within_one(spark, tmp_path):
    """As in the SQL: loud samples of either source, a switch before all blocks, and one of an odd session at block 9999999."""
    far = 97 * 9999999
    rows = [(97, 4, "click", 1500.0), (97 * 7, 4, "click", 10.0), (97 * 8, 4, "error", 800.0), (97 * 9, 4, "error", 0.25), (97, 5, "view", 20.0), (97 * 2, 5, "error", 30.0), (far, 5, "view", 40.0), (far + 1, 5, "error", 50.0), (97, -38, "click", 60.0), (98, -38, "error", 70.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = {r.session: (r.samples, r.total) for r in plans.switched_mix(spark, str(tmp_path)).collect()}
    assert found == {"4": (3, 3.1005), "5": (2, 0.12), "-38": (1, 0.14)}


def test_audio_that_does_not_follow_ends_the_stream(spark, tmp_path):
    write(tmp_path / "in", "0.json", json.dumps({"session": "s", "kind": "mixed", "position": 5, "samples": [0.1]}))
    audio = spark.readStream.schema("session string, kind string, position long, samples array<float>").json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="follow"):
        segments.segment_stream(audio).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()


def stub():
    """Work as a closure, which travels to workers that don't have this module."""

    def work(batch):
        fails = batch["source"].str.startswith("bad")
        text = (batch["language"].fillna("auto") + ":" + batch["source"]).where(~fails, None)
        return pd.DataFrame({"text": text, "error": pd.Series("noise", batch.index).where(fails, None)})

    return work


def play(spark, folder, events, stored=None, name="a", wait=True):
    write(folder / "in", f"{name}.json", "\n".join(map(json.dumps, events)))
    read = spark.readStream.schema(worker.QUEUE_EVENT_SCHEMA).json(str(folder / "in"))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = worker.queue_stream(read, stub(), stored, poll_ms=1).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/c").trigger(processingTime="50 milliseconds").start()
    worker.until_idle(q, 1.5, 120)
    rows = spark.read.schema(worker.TOLD_SCHEMA).parquet(f"{folder}/out").collect()
    return sorted(rows, key=lambda r: (r.session, r.number))


def test_queue_goes_on_from_documents_and_works_each_item_once(spark, tmp_path):
    documents = [("s", 7, 0, "processing", 1, "one", "", None), ("s", 3, 1, "complete", 1, "done", "done", None), ("s", 9, 2, "failed", 2, "bad", "", "noise"), ("s", 4, 3, "failed", 3, "bad for good", "", "noise"), ("t", 1, 0, "pending", 9, "x", "", None), ("u", 1, 0, "complete", 1, "y", "y", None)]
    stored = spark.createDataFrame(documents, "session string, id long, position long, status string, attempts long, source string, text string, error string")
    events = [{"session": s, "arrival": 0, "kind": "wake"} for s in "stu"] + [{"session": "new", "arrival": n, "kind": "enqueue", "id": n, "source": f"n{n}"} for n in range(2)]
    events.append({"session": "new", "arrival": 9, "kind": "language", "language": "en"})
    rows = play(spark, tmp_path, events, stored)
    assert [r.number for r in rows if r.session == "s"] == list(range(1, 1 + sum(r.session == "s" for r in rows)))  # 0 was the recovery's own
    told = {(r.session, r.id): (r.status, r.attempts, r.text, r.error) for r in rows if r.kind == "segment"}
    assert told == {("s", 7): ("complete", 2, "auto:one", None), ("s", 9): ("failed", 3, "", "noise"), ("t", 1): ("complete", 10, "auto:x", None), ("new", 0): ("complete", 1, "en:n0", None), ("new", 1): ("complete", 1, "en:n1", None)}
    steps = [(r.id, r.status) for r in rows if r.session == "s" and r.kind == "segment"]
    assert steps == [(7, "processing"), (7, "complete"), (9, "processing"), (9, "failed")]
    state = {r.session: (r.status, r.pending) for r in worker.queue_status(spark, f"{tmp_path}/c").collect()}
    assert state == {"s": ("partial", 0), "t": ("complete", 0), "u": ("complete", 0), "new": ("complete", 0)}
    # The same stream goes on: known segments start again only if their source changed; a deleted session is forgotten.
    more = [{"session": "new", "arrival": 20, "kind": "enqueue", "id": 0, "source": "n0"}, {"session": "new", "arrival": 21, "kind": "enqueue", "id": 1, "source": "other"}, {"session": "t", "arrival": 22, "kind": "enqueue", "id": 5, "source": "z"}, {"session": "t", "arrival": 23, "kind": "delete"}]
    rows = [r for r in play(spark, tmp_path, more, stored, "b") if r.kind == "segment" and r.number > 8]
    assert [(r.id, r.status, r.text) for r in rows if r.session == "new"] == [(1, "pending", ""), (1, "processing", ""), (1, "complete", "en:other")]
    docs = worker.queue_documents(spark, f"{tmp_path}/c")
    assert sorted((r.session, r.id, r.status) for r in docs.collect() if r.session in ("new", "t")) == [("new", 0, "complete"), ("new", 1, "complete")]
    # A new stream from what the old one's state holds has nothing left to do.
    again = play(spark, tmp_path / "again", [{"session": s, "arrival": 0, "kind": "wake"} for s in ("s", "new")], docs)
    assert [r.kind for r in again] == ["status", "status"] and {r.status for r in again} == {"partial", "complete"}


def test_attempts_that_follow_in_one_firing_are_told_as_firings_of_one(spark, tmp_path):
    """And work may come as a function of one item. Texts whose length is a multiple of three fail."""
    items = [("s", 9 - n, n, "pending", 0, "x" * (n + 2), "", None) for n in range(5)] + [("t", 1, 0, "failed", 1, "xxx", "", "noise"), ("u", 1, 0, "complete", 1, "y", "y", None)]
    stored = spark.createDataFrame(items, "session string, id long, position long, status string, attempts long, source string, text string, error string")
    write(tmp_path / "in", "a.json", "\n".join(json.dumps({"session": s, "arrival": 0, "kind": "wake"}) for s in "stu"))
    told, batches = {}, {}
    for attempts, work in ((1, lambda b: pd.DataFrame({"text": b["source"] + "!", "error": ["noise" if len(x) % 3 == 0 else None for x in b["source"]]})), (4, worker.Each(lambda i: (None, "noise") if len(i["source"]) % 3 == 0 else (i["source"] + "!", None)))):
        rows = told.setdefault(attempts, {})
        events = spark.readStream.schema(worker.QUEUE_EVENT_SCHEMA).json(str(tmp_path / "in"))
        q = worker.queue_stream(events, work, stored, 1, attempts).writeStream.outputMode("update").foreachBatch(lambda b, n, rows=rows: rows.update({n: b.collect()})).option("checkpointLocation", f"{tmp_path}/c{attempts}").trigger(processingTime="50 milliseconds").start()
        worker.until_idle(q, 1.0, 120)
        batches[attempts] = sum(any(r.session == "s" for r in b) for b in rows.values())
        assert [(r.pending, r.status) for r in worker.queue_status(spark, f"{tmp_path}/c{attempts}").orderBy("session").collect()] == [(0, "partial"), (0, "partial"), (0, "complete")]
    one, more = (sorted((tuple(r) for b in told[n].values() for r in b), key=lambda r: r[:2]) for n in (1, 4))
    assert one == more and sum(r[0] == "s" and r[4] == "processing" for r in one) == 9 and batches[4] < batches[1]
    with pytest.raises(ValueError):
        worker.QueueWorker(stub(), attempts=0)


class Clock:
    """Stands for the module time and for a query of batches (begin, end, rows read)."""

    def __init__(self, *batches):
        self.now, self.batches, self.isActive = 1000.0, batches, True

    def monotonic(self):
        return self.now

    time = monotonic

    def sleep(self, seconds):
        self.now += 0.5

    @property
    def lastProgress(self):
        done = [(n, b) for n, b in enumerate(self.batches) if 1000 + b[1] <= self.now]
        if not done:
            return None
        n, (begin, _, rows) = done[-1]
        return {"batchId": n, "timestamp": pd.Timestamp(1000 + begin, unit="s", tz="UTC").isoformat(timespec="milliseconds").replace("+00:00", "Z"), "numInputRows": rows, "stateOperators": []}

    def exception(self):
        return None

    def stop(self):
        self.isActive = False


@pytest.mark.parametrize(("batches", "ends"), [
    ([(0, 900, 5), (900, 1900, 5), (1900, 1901, 0), (1902, 1903, 0)], 1903),  # at work for longer than ten minutes
    ([(-9, -8, 0), (-8, 5, 0), (5, 9, 7), (9, 10, 0), (11, 12, 0)], 12),  # batches that began before the call may not have seen the last input
])
def test_until_idle_waits_for_work_and_for_batches_of_its_own_time(monkeypatch, batches, ends):
    query = Clock(*batches)
    monkeypatch.setattr(worker, "time", query)
    worker.until_idle(query, 1.0)
    assert query.now - 1000 == ends
    with pytest.raises(TimeoutError):
        query.now, query.isActive = 1000.0, True
        worker.until_idle(query, 1.0, 3)


def test_a_failing_worker_fails_its_item(spark):
    state = worker.QueueWorker(stub())
    assert state.poll_ms == 1000 and worker._retryable("failed", 2) and not worker._retryable("failed", 3) and worker._text(float("nan")) is None


def test_checkpoints_are_told_by_timers_and_status_is_read_from_state(spark, tmp_path):
    """A running mix tells how far it is; after it was stopped its state answers."""
    folder = tmp_path / "in"
    write(folder, "0.json", "\n".join(map(json.dumps, [event(0, "audio", "microphone", 0, 0.25), event(1, "audio", "system", 0, 0.5), event(2, "audio", "microphone", 1, 0.5)])))
    rows = []
    stream = capture.mixed_stream(capture.capture_events(spark, str(folder)), checkpoint_ms=300).writeStream.foreachBatch(lambda b, n: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="50 milliseconds").start()
    import time

    until = time.monotonic() + 60
    while sum(r.kind == "checkpoint" for r in rows) < 2 and stream.isActive and time.monotonic() < until:
        time.sleep(0.1)
    stream.stop()
    assert [r.position for r in rows if r.kind == "checkpoint"][:2] == [1600, 1600] and {r.session for r in rows} == {"s"}
    status = worker.recording_state(spark, str(tmp_path / "c")).collect()
    assert [tuple(r) for r in status] == [("s", "mixed", "mixed", 1600, 100)]
    write(folder, "1.json", json.dumps(event(3, "end")))
    q = capture.mixed_stream(capture.capture_events(spark, str(folder)), checkpoint_ms=300).writeStream.foreachBatch(lambda b, n: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="50 milliseconds").start()
    worker.until_idle(q, 1.0, 60)
    assert [r.position for r in rows if r.kind == "end"] == [3200] and worker.recording_state(spark, str(tmp_path / "c")).first().position == 3200


def test_captures_are_numbered_without_gaps_also_after_a_failure(spark, tmp_path):
    raw = {"a/microphone.i16.16000.1": (np.arange(-50, 57) * 300).astype("<i2"), "a/system.f32.8000.2": np.linspace(-1, 1, 90).astype("<f4"), "b/microphone.u8.16000.1": np.arange(0, 255).astype("<u1")}
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/b").mkdir()
    seen, fail = {}, {"next": False}

    def grow(share):
        for name, data in raw.items():
            (tmp_path / f"in/{name}.pcm").write_bytes(data.tobytes()[: int(share * data.nbytes)])

    def keep(batch, number):
        rows = batch.collect()
        if fail["next"]:
            fail["next"] = False
            seen["lost", number] = rows
            raise RuntimeError("lost")
        seen[number] = rows

    def run():
        q = source.running_captures(spark, str(tmp_path / "in"), 10).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    grow(0.37)
    run()
    grow(0.81)
    fail["next"] = True
    with pytest.raises(Exception, match="lost"):
        run()
    grow(1.0)
    run()
    (tmp_path / "in/a/end").touch()
    run()
    lost = {k[1]: v for k, v in seen.items() if isinstance(k, tuple)}
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0], r[3] or "", r[4] or -1))
    assert len(lost) == 1 and all(order(seen[n]) == order(rows) for n, rows in lost.items())
    rows = [r for k, v in seen.items() if isinstance(k, int) for r in v]
    for name, data in raw.items():
        session, file = name.split("/")
        own = sorted((r for r in rows if r.session == session and r.source == file.split(".")[0]), key=lambda r: r.sequence)
        assert [r.sequence for r in own] == list(range(len(own)))
        want = source.to_floats(data.tobytes(), file.split(".")[1]).tolist()
        got = [x for r in own for x in r.samples]
        assert got == (want if session == "a" else want[:250])
    assert [(r.session, r.arrival) for r in rows if r.kind == "end"] == [("a", 6875)]
    with pytest.raises(ValueError):
        source.to_floats(b"", "i24")
    with pytest.raises(ValueError):
        source.Capture.of("a/x.i16.0.1.pcm")
    shutil.rmtree(tmp_path / "c")


def test_captures_are_mixed_as_they_grow(spark, tmp_path):
    (tmp_path / "in/s").mkdir(parents=True)
    for name, value, n in (("microphone", 8192, 5000), ("system", 16384, 4000)):
        (tmp_path / f"in/s/{name}.i16.16000.1.pcm").write_bytes(np.full(n, value, "<i2").tobytes())
    mixed = lambda: capture.mixed_stream(source.running_captures(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    mixed()
    assert sum(len(r.samples) for r in spark.read.parquet(str(tmp_path / "out")).filter("kind = 'mixed'").collect()) == 3200
    (tmp_path / "in/s/end").touch()
    mixed()
    rows = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'mixed'").orderBy("position").collect()
    assert [x for r in rows for x in r.samples] == [0.75] * 4000 + [0.25] * 1000


def test_events_of_a_batch_come_in_order_without_a_frame_each():
    frame = lambda *rows: pd.DataFrame(rows, columns=["arrival", "kind", "samples"])
    rows = capture.arrived(iter([frame((3, "audio", np.ones(2)), (1, "end", None)), frame((1, "mode", None))]))
    assert [(r.arrival, r.kind) for r in rows] == [(1, "end"), (1, "mode"), (3, "audio")]


def test_peaks_and_levels():
    x = np.random.default_rng(3).normal(size=200)
    assert capture.peaks(x[:5]).tolist() == [abs(x[n * 5 // 48]) for n in range(48)]
    assert capture.peaks(x).tolist() == [np.abs(x[n * 200 // 48 : (n + 1) * 200 // 48]).max() for n in range(48)]
    assert capture.level_db(np.full(7, 0.1)) == pytest.approx(-20) and capture.level_db(np.zeros(3)) == capture.FLOOR_DB

import json
import math

import pytest

from tapeloom.operators import history, merge, queue, sequence
from tapeloom.sources import documents
from tapeloom.streaming import capture


def write(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def manifest(name, at="2026-01-02T03:04:05Z", status="completed"):
    return {"sessionId": name, "startedAt": at, "status": status, "audioFormat": "wav", "audioSource": "mixed", "sampleRate": 16000, "segments": [{"index": 0, "fileName": "a.wav", "sampleCount": 16000, "durationMs": 1000, "startedOffsetMs": 0, "finalized": False}]}


def test_history(spark, tmp_path):
    day = tmp_path / "2026/01/02"
    write(day / "a", "session.json", manifest("a"))
    write(day / "a", "transcript.json", {"sessionId": "a", "status": "partial", "segments": [{"id": 2, "status": "complete", "text": " two "}, {"id": 1, "status": "complete", "text": "one"}]})
    write(day / "b", "session.json", "not json")
    write(day / "c", "session.json", manifest("c", "2026-01-03T00:00:00Z"))
    write(day / "d", "session.json", manifest("d"))
    write(day / "d", "transcript.json", "{broken")
    scan = lambda kind: documents.scan_documents(spark, str(tmp_path), kind)
    rows = history.newest(history.history_entries(scan("session"), scan("transcript"), scan("translation")), 0).collect()
    assert [r.sessionId for r in rows] == ["c"]
    rows = history.newest(history.history_entries(scan("session"), scan("transcript"), scan("translation")), 100).collect()
    assert [(r.sessionId, r.durationMs, r.segmentCount, r.transcriptPreview, r.transcriptSegmentCount) for r in rows] == [("c", 1000, 1, "", 0), ("a", 1000, 1, "two one", 2)]
    assert documents.load_document(spark, str(day / "c"), "transcript") is None
    with pytest.raises(Exception):
        documents.scan_documents(spark, str(tmp_path), "session", strict=True).collect()
    (tmp_path / "linked").symlink_to(day / "a")
    write(tmp_path / "1/2/3/4/5/6", "session.json", manifest("deep"))
    assert {r.sessionId for r in scan("session").filter("NOT corrupt").collect()} == {"a", "c", "d"}
    with pytest.raises(ValueError):
        documents.delete_session(scan("session").filter("sessionId = 'a'").selectExpr("* except (status)", "'recording' AS status"), "a", f"file://{tmp_path}")
    documents.delete_session(scan("session").filter("NOT corrupt"), "c", f"file://{tmp_path}")
    assert {r.sessionId for r in scan("session").filter("NOT corrupt").collect()} == {"a", "d"} and not (day / "c").exists()
    with pytest.raises(ValueError):
        documents.delete_session(scan("session"), "no such", f"file://{tmp_path}")


def segments(spark, rows):
    return spark.createDataFrame(rows, "session string, id long, position long, status string, attempts long, text string, error string")


def test_queue(spark):
    rows = [("s", 1, 1, "complete", 1, "x", None), ("s", 2, 2, "failed", 2, "", "e"), ("s", 3, 3, "pending", 9, "", None), ("t", 1, 1, "failed", 3, "", "e"), ("u", 1, 1, "processing", 1, "", None)]
    q = segments(spark, rows)
    assert {r.session: r.status for r in q.groupBy("session").agg(queue.rollup_status().alias("status")).collect()} == {"s": "pending", "t": "partial", "u": "pending"}
    assert sorted((r.session, r.id) for r in queue.next_items(q).collect()) == [("s", 2), ("u", 1)]
    after = {(r.session, r.id): r for r in queue.step(q, lambda b: b.assign(text="done", error=None)).collect()}
    assert after["s", 2].status == "complete" and after["s", 2].attempts == 3 and after["s", 3].status == "pending" and len(after) == 5
    assert [r.status for r in queue.recover_segments(q).orderBy("session", "id").collect()] == ["complete", "failed", "pending", "failed", "pending"]
    calls = spark.sparkContext.accumulator(0)

    def count(b):
        calls.add(len(b))
        return b.assign(text="done", error=None)

    assert queue.step(q, count).count() == 5 and calls.value == 2
    clips = spark.createDataFrame([("s", 1600, 3200)], "session string, start_sample long, end_sample long")
    r = queue.enqueue_clips(q, clips).first()
    assert (r.id, r.startMs, r.endMs, r.status) == (4, 100, 200, "pending")


def test_merge_is_the_fold(spark):
    rank = {"pending": 0, "processing": 1, "complete": 2, "failed": 2}
    rows = [("s", i % 3, ["pending", "processing", "complete", "failed"][i * 7 % 4], i * 5 % 3, f"t{i}", i) for i in range(60)]
    held = {}
    for session, id_, status, attempts, text, _ in rows:
        if id_ not in held or (attempts, rank[status]) >= (held[id_][1], rank[held[id_][0]]):
            held[id_] = (status, attempts, text)
    changes = spark.createDataFrame(rows, "session string, id long, status string, attempts long, text string, arrival long")
    found = merge.merge_segments(changes.limit(0).drop("arrival"), changes, ["session", "id"]).collect()
    assert {r.id: (r.status, r.attempts, r.text) for r in found} == held


def test_sequences(spark):
    blocks = spark.createDataFrame([("s", 0, 1000), ("s", 1, 1501)], "session string, block long, samples long")
    parts = sequence.split_fixed(blocks, "session", ["block"], "samples", 1000).orderBy("part").collect()
    assert [r.sample_count for r in parts] == [1000, 1000, 501]
    kind = "session string, source string, block long, samples array<double>"
    assert sequence.align_mix(spark.createDataFrame([("s", "microphone", 0, [0.25])], kind), {}).count() == 0
    both = spark.createDataFrame([("s", "microphone", 0, [0.25] * 5), ("s", "microphone", 1, [0.5] * 4), ("s", "system", 0, [0.5] * 3)], kind)
    for ended, want in ((True, [0.75] * 3 + [0.25] * 2 + [0.5] * 4), (False, [0.75] * 3)):
        rows = sequence.align_mix(both, {}, ended=ended, chunk=4).orderBy("pos").collect()
        assert [x for r in rows for x in r.samples] == want
    events = spark.createDataFrame([("a", "m", 0, 16000), ("a", "m", 1, 8000), ("b", "m", 2, 16000), ("c", "m", 0, 1), ("c", "m", 0, 1)], "session string, source string, sequence long, sample_rate int")
    assert sorted((r.session, r.sequence, r.fault) for r in sequence.check_sequence(events).collect() if r.fault) == [("a", 1, "sample rate changed"), ("b", 2, "sequence gap"), ("c", 0, "sequence gap")]
    with pytest.raises(Exception, match="fault"):
        sequence.require_sequence(events).collect()
    huge = spark.createDataFrame([("s", 0, 2**62), ("s", 1, 2**62), ("s", 2, 1)], "session string, block long, samples long")
    assert [r.first_sample for r in sequence.running_offsets(huge, "session", ["block"], "samples").orderBy("block").collect()] == [0, 2**62, 2**63 - 1]
    with pytest.raises(Exception, match="pending"):
        sequence.check_pending(both, 5).collect()


def event(arrival, kind, source=None, n=None, value=0.0, message=None, rate=16000, count=1600):
    return {"session": "s", "arrival": arrival, "kind": kind, "source": source, "sequence": n, "channels": 1, "sample_rate": rate, "samples": [value] * count, "message": message}


def play(spark, folder, batches, mode="mixed"):
    """The mixed samples and the rows of a stream that gets the events in these batches."""
    for n, events in enumerate(batches):
        write(folder / "in", f"{n}.json", "\n".join(map(json.dumps, events)))
        q = capture.mixed_stream(capture.capture_events(spark, str(folder / "in")), mode).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(str(folder / "out")).collect()
    mixed = sorted((r for r in rows if r.kind == "mixed"), key=lambda r: r.position)
    return [x for r in mixed for x in r.samples], rows


SWITCH = [event(0, "audio", "microphone", 0, 0.25), event(1, "mode", message="system"), event(2, "audio", "system", 0, 0.5), event(3, "mode", message="system"), event(4, "audio", "microphone", 1, 0.9)]


@pytest.mark.parametrize("bounds", [[0, 5], [0, 1, 2, 5]])
def test_stream_switches_its_source(spark, tmp_path, bounds):
    """The switch counts where it came, whatever the batches are; a switch to the same source changes nothing."""
    samples, rows = play(spark, tmp_path, [SWITCH[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], "microphone")
    assert samples == [0.25] * 1600 + [0.5] * 1600
    assert {r.source for r in rows if r.kind == "mixed" and r.position == 1600} == {"mixed"}
    level = next(r for r in rows if r.kind == "level" and r.source == "system")
    assert abs(level.level_db - 20 * math.log10(0.5)) < 1e-4 and level.waveform == [0.5] * 48


def test_stream_carries_the_filter_and_flushes(spark, tmp_path):
    events = [event(n, "audio", s, n // 2, 0.25, rate=48000, count=500) for n, s in enumerate(["microphone", "system"] * 6)]
    events[-1]["samples"] = [0.25] * 100
    samples, rows = play(spark, tmp_path, [events[:5], events[5:], [event(20, "end")]])
    assert len(samples) == 1000 and max(abs(x - 0.5) for x in samples[40:800]) < 2e-3


@pytest.mark.parametrize("events", [[event(0, "audio", "system", 2)], [event(0, "audio", "system", 1), event(1, "audio", "system", 0)], [event(0, "error", "system", message="gone")], [event(0, "audio", "system", 0), event(1, "audio", "system", 1, rate=8000)], [event(0, "audio", "system", 0, count=160_001)]])
def test_stream_ends_at_a_fault(spark, tmp_path, events):
    with pytest.raises(Exception, match="sequence gap|failed|changed|pending"):
        play(spark, tmp_path, [events])


def test_statuses_are_told_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    changes = spark.readStream.schema("session string, id long, status string, attempts long, text string, arrival long").json(str(tmp_path / "in"))
    write(tmp_path / "in", "a.json", "\n".join(json.dumps({"session": "s", "id": 1, "status": x, "attempts": n, "text": x, "arrival": n}) for n, x in enumerate(["pending", "processing", "complete"])))
    for _ in range(2):
        capture.publish_stream(capture.latest_stream(changes), "transcript-segment", "session", str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/transcript-segment")).collect()
    assert [json.loads(r.payload)["status"] for r in rows] == ["complete"]
    with pytest.raises(ValueError):
        capture.channel_events(changes, "other", "session")


def test_models_are_kept_and_dropped():
    now, loads = [0.0], []
    cache = queue.ModelCache(lambda *key: loads.append(key) or len(loads), 600, lambda: now[0])
    assert [cache.get("m", 2, None), cache.get("m", 2, None), cache.get("m", 4, None)] == [1, 1, 2]
    now[0] = 601
    assert cache.get("m", 4, None) == 3


def test_client_and_recogniser_outcomes():
    import pandas as pd

    answers = iter([(200, '{"choices":[{"message":{"content":" hi "}}]}'), (500, "x" * 900), (200, "{}"), (200, '{"choices":[{"message":{"content":" "}}]}')])
    asked = []
    work = queue.translator(lambda url, body: asked.append(json.loads(body)) or next(answers), "http://h/v1/chat/completions", "m", "Chinese")
    out = work(pd.DataFrame({"sourceText": ["a", "b", "c", "d"]}))
    assert out["text"].tolist()[0] == "hi" and out["text"].isna().tolist() == [False, True, True, True]
    assert out["error"][1] == "HTTP 500: " + "x" * 500 and asked[0]["messages"][1] == {"role": "user", "content": "a"} and asked[0]["temperature"] == 0
    loads = []
    recognise = queue.transcriber(lambda *key: loads.append(key) or (lambda clip: f"{key[0]}:{1 // clip}"))
    out = recognise(pd.DataFrame({"modelId": ["m", "m", "n"], "threads": [1, 1, 1], "language": ["en"] * 3, "clip": [1, 0, 1]}))
    assert out["text"].tolist()[::2] == ["m:1", "n:1"] and "division" in out["error"][1] and len(loads) == 2

"""Deletion, recovery, markers, settings and point reads of session documents."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import queue
from tapeloom.sources import documents, settings

from test_sessions import manifest, write


def scan(spark, root):
    return documents.scan_documents(spark, str(root), "session").filter("NOT corrupt")


def test_the_root_is_never_deleted(spark, tmp_path):
    write(tmp_path, "session.json", manifest("x"))
    write(tmp_path / "y", "session.json", manifest("y"))
    for root in (f"file://{tmp_path}", f"{tmp_path}/", str(tmp_path)):
        with pytest.raises(ValueError):
            documents.delete_session(scan(spark, tmp_path), "x", root)
    assert (tmp_path / "y/session.json").exists()
    documents.delete_session(scan(spark, tmp_path), "y", str(tmp_path))
    assert not (tmp_path / "y").exists() and (tmp_path / "session.json").exists()


def test_links_are_followed_before_a_deletion(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    write(root / "a", "session.json", manifest("a"))
    write(other / "b", "session.json", manifest("b"))
    (root / "b").symlink_to(other / "b")
    (tmp_path / "alias").symlink_to(root)
    told = scan(spark, root).limit(1).withColumn("sessionId", F.lit("b")).withColumn("directory", F.lit(f"file://{root}/b"))
    with pytest.raises(ValueError, match="outside"):
        documents.delete_session(told, "b", str(root))
    assert (other / "b/session.json").exists()
    documents.delete_session(scan(spark, tmp_path / "alias"), "a", f"{tmp_path}/alias")
    assert not (root / "a").exists()


def test_a_manifest_is_read_again_before_deletion(spark, tmp_path):
    write(tmp_path / "a", "session.json", manifest("a"))
    rows = [r.asDict(True) for r in scan(spark, tmp_path).collect()]
    stale = spark.createDataFrame(rows, scan(spark, tmp_path).schema)
    write(tmp_path / "a", "session.json", manifest("a", status="recording"))
    with pytest.raises(ValueError, match="active"):
        documents.delete_session(stale, "a", str(tmp_path))
    write(tmp_path / "a", "session.json", manifest("other"))
    with pytest.raises(ValueError):
        documents.delete_session(stale, "a", str(tmp_path))
    for bad in ("", "  ", "b"):
        with pytest.raises(ValueError):
            documents.delete_session(stale, bad, str(tmp_path))
    assert (tmp_path / "a/session.json").exists()


def test_point_reads_are_strict(spark, tmp_path):
    write(tmp_path / "a", "translation.json", {"sessionId": "a", "status": "complete", "segments": [{"segmentId": 1, "sourceText": " x ", "text": "y", "status": "complete", "attempts": 1}], "unknown": 1})
    write(tmp_path / "a/below", "transcript.json", {"sessionId": "below", "status": "complete", "segments": []})
    write(tmp_path / "b", "translation.json", {"sessionId": "b", "status": "complete"})
    assert documents.load_document(spark, f"file://{tmp_path}/a", "translation").first().segments[0].sourceText == " x "
    assert documents.load_document(spark, f"file://{tmp_path}/a", "transcript", depth=0) is None
    with pytest.raises(Exception, match="unreadable"):
        documents.load_document(spark, f"file://{tmp_path}/b", "translation").collect()
    found = documents.scan_documents(spark, str(tmp_path), "translation").collect()
    assert sorted((r.directory[-1], r.corrupt) for r in found) == [("a", False), ("b", True)]


def test_recovery_tells_when_and_leaves_short_files(spark):
    kinds = "sessionId string, status string, completedAt timestamp, audioFormat string, sampleRate long, segments array<struct<fileName: string, sampleCount: long, durationMs: long, finalized: boolean>>"
    one = lambda name, count=500, done=False: {"fileName": name, "sampleCount": count, "durationMs": 31, "finalized": done}
    rows = [("a", "recording", None, "wav", 16000, [one("0.wav", done=True), one("1.wav")]), ("short", "recording", None, "wav", 16000, [one("0.wav")]), ("gone", "recording", None, "wav", 16000, [one("0.wav")]), ("out", "recording", None, "wav", 16000, [one("../0.wav")]), ("flac", "recording", None, "flac", 16000, [one("0.wav")]), ("done", "completed", None, "wav", 16000, [one("0.wav")]), ("none", "recording", None, "wav", 16000, [])]
    lengths = spark.createDataFrame([("a", "1.wav", 44 + 2468), ("short", "0.wav", 43), ("out", "../0.wav", 999), ("flac", "0.wav", 999), ("done", "0.wav", 999), ("a", "0.wav", 999)], "sessionId string, fileName string, length long")
    at = F.timestamp_seconds(F.lit(1000))
    found = {r.sessionId: r for r in queue.recover_manifests(spark.createDataFrame(rows, kinds), lengths, at).collect()}
    assert [s.sampleCount for s in found["a"].segments] == [500, 1234] and found["a"].segments[1].durationMs == 77 and not found["a"].segments[1].finalized
    assert all(found[k].segments[0].sampleCount == 500 for k in ("short", "gone", "out", "flac", "done"))
    assert {k: r.status for k, r in found.items()} == {k: "completed" if k == "done" else "interrupted" for k in found}
    assert {k for k, r in found.items() if r.completedAt is None} == {"done"} and found["a"].completedAt is not None


def test_a_change_of_settings_holds_for_all_that_waits(spark):
    kinds = "sessionId string, forcedLanguage string, translation struct<enabled: boolean, targetLanguage: string>, updatedAt timestamp"
    docs = spark.createDataFrame([("s", "auto", (True, "Chinese"), None), ("t", "auto", (True, "Chinese"), None)], kinds)
    at = datetime.datetime(2026, 1, 1)
    controls = spark.createDataFrame([("s", at, "en", (True, "German")), ("s", at + datetime.timedelta(1), "ja", (False, "French")), ("u", at, "ko", (True, "x"))], "sessionId string, at timestamp, language string, translation struct<enabled: boolean, targetLanguage: string>")
    after = queue.update_languages(docs, controls)
    assert {r.sessionId: (r.forcedLanguage, r.translation.targetLanguage, r.translation.enabled, r.updatedAt is None) for r in after.collect()} == {"s": ("ja", "French", False, False), "t": ("auto", "Chinese", True, True)}
    segments = spark.createDataFrame([("s", 1, "complete", 1), ("s", 2, "pending", 0), ("s", 3, "failed", 2), ("t", 1, "pending", 0)], "session string, id long, status string, attempts long")
    assert sorted((r.session, r.id, r.language) for r in queue.with_document_settings(segments, after).collect()) == [("s", 2, "ja"), ("s", 3, "ja"), ("t", 1, "auto")]


def test_translations_keep_their_source_as_it_is(spark):
    none = spark.createDataFrame([], "session string, id long, sourceText string, text string, status string, attempts long, error string")
    done = lambda *texts: spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session string, id long, text string")
    first = queue.enqueue_translations(none, done(" a\n", "\u3000"))
    assert [(r.id, r.sourceText) for r in first.collect()] == [(0, " a\n")]
    worked = first.withColumns({"status": F.lit("complete"), "attempts": F.lit(1).cast("long")})
    assert [r.status for r in queue.enqueue_translations(worked, done(" a\n")).collect()] == ["complete"]
    assert [(r.status, r.attempts) for r in queue.enqueue_translations(worked, done("a")).collect()] == [("pending", 0)]


ARTIFACTS = [("m", "r", "archive", "a.tar", "1", 10), ("m", "r", "file", "b.onnx", "2", 20), ("m", "r", "voice_detector", "v.onnx", "3", 30)]


def test_markers_and_what_is_there(spark, tmp_path):
    spec = spark.createDataFrame(ARTIFACTS, "model_id string, revision string, kind string, name string, sha256 string, size long")
    listed = [{"name": n, "sha256": h, "size": z} for *_, n, h, z in ARTIFACTS]
    whole = [("m", "b.onnx", 20, "x"), ("m", "v.onnx", 30, "3")]

    def state(marker, files=whole, ready=True):
        f = spark.createDataFrame(files, "model_id string, name string, length long, sha256 string")
        r = documents.ready_models(spark.createDataFrame([("m", "model", int(ready))], "model_id string, name string, length long"), {"m": ["model"]})
        documents.save_marker(spark, marker, f"{tmp_path}/m/r")
        return documents.valid_markers(documents.load_markers(spark, str(tmp_path)), spec, f, r).first().valid, documents.download_progress(spec, f, r).first().done_bytes

    marker = {"model_id": "m", "revision": "r", "artifacts": listed}
    assert state(marker) == (True, 60)
    assert state(marker, ready=False) == (False, 50)
    assert state(marker | {"artifacts": [*listed, {"name": "more", "sha256": "", "size": 0}]}) == (False, 60)
    assert state(marker | {"artifacts": listed[:2]}) == (False, 60)
    assert state(marker | {"revision": "old"}) == (False, 60)
    assert state(marker, [("m", "b.onnx", 20, "x"), ("m", "v.onnx", 30, "other")]) == (False, 60)
    assert state(marker, [("m", "b.onnx", 19, "x"), ("m", "b.onnx.partial", 25, "x"), ("m", "v.onnx.partial", 7, "x")]) == (False, 37)
    with pytest.raises(Exception):
        documents.save_text(spark, "x", f"{tmp_path}/m/r")  # a folder that holds files


def test_models_without_files_are_not_ready(spark):
    files = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 1), ("b", "y", 2), ("other", "x", 1)], "model_id string, name string, length long")
    found = documents.ready_models(files, {"a": ["x", "y"], "b": ["x", "y"], "c": ["x"], "d": []})
    assert {r.model_id: r.ready for r in found.collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_settings_are_saved_whole_or_not_at_all(spark, tmp_path):
    path, models = f"{tmp_path}/settings.json", ("qwen3-asr-0.6b-int8",)
    settings.save_settings(spark, settings.load_settings(None), path, models)
    new = settings.load_settings((tmp_path / "settings.json").read_text())
    assert new == settings.load_settings(None)
    new["transcription"]["threads"] = 4
    settings.save_settings(spark, new, path, models)
    with pytest.raises(ValueError):
        settings.save_settings(spark, new | {"translation": new["translation"] | {"model": " "}}, path, models)
    assert json.loads((tmp_path / "settings.json").read_text())["transcription"]["threads"] == 4
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["settings.json"]

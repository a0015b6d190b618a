"""The bucketed store and the index of documents."""

import random

import pytest
from test_sessions import manifest, write

from tapeloom.operators import history, merge, queue
from tapeloom.sources import documents, index, store

SCHEMA = "session string, id long, status string, attempts long, text string"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, arrival long")


def test_changes_merge_as_all_at_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 9)}", rng.randint(0, 3), rng.choice(["pending", "processing", "complete", "failed"]), rng.randint(0, 2), f"t{n}", n) for n in range(120)]
    held = store.segment_store(spark, str(tmp_path), SCHEMA, 8)
    assert held.read().count() == 0
    for n in range(0, 120, 40):
        store.upsert_segments(held, changes(spark, rows[n : n + 40]), ["session", "id"])
    want = merge.merge_segments(changes(spark, []).drop("arrival"), changes(spark, rows), ["session", "id"])
    assert sorted(map(tuple, held.read().collect())) == sorted(map(tuple, want.collect()))
    assert held.update(changes(spark, []), lambda a, b: a) == 3


def test_a_change_of_one_session_rewrites_one_bucket(spark, tmp_path):
    held = store.segment_store(spark, str(tmp_path), SCHEMA, 8)
    store.upsert_segments(held, changes(spark, [(f"s{i}", 1, "pending", 0, "", 0) for i in range(40)]), ["session", "id"])
    _, before = held.manifest()
    store.upsert_segments(held, changes(spark, [("s7", 1, "complete", 1, "x", 0), ("s7", 2, "pending", 0, "", 1)]), ["session", "id"])
    version, after = held.manifest()
    assert version == 2 and sum(before[b] != after[b] for b in after) == 1 and sum(x["rows"] for x in after.values()) == 41
    store.delete_sessions(held, spark.createDataFrame([("s7",), ("unknown",)], "session string"))
    assert held.read().count() == 39 and held.read(version=1).count() == 40 and held.read(version=2).count() == 41
    held.vacuum(1)
    assert held.read().count() == 39 and held.versions() == [3]
    with pytest.raises(Exception):
        held.read(version=1).count()


def test_a_crash_between_write_and_swap_loses_nothing(spark, tmp_path, monkeypatch):
    held = store.segment_store(spark, str(tmp_path), SCHEMA, 4)
    store.upsert_segments(held, changes(spark, [("a", 1, "pending", 0, "", 0)]), ["session", "id"])

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(store.BucketStore, "_swap", crash)
        with pytest.raises(RuntimeError):
            store.upsert_segments(held, changes(spark, [("a", 1, "complete", 1, "x", 0)]), ["session", "id"])
    again = store.segment_store(spark, str(tmp_path), SCHEMA, 4)
    assert [r.status for r in again.read().collect()] == ["pending"]
    store.upsert_segments(again, changes(spark, [("a", 1, "complete", 1, "x", 0)]), ["session", "id"])
    assert [r.status for r in again.read().collect()] == ["complete"] and len(again._names("data")) == 3
    again.vacuum()
    assert len(again._names("data")) == 2 and [r.status for r in again.read(version=1).collect()] == ["pending"]


def test_of_two_updates_at_once_one_fails(spark, tmp_path):
    held = store.segment_store(spark, str(tmp_path), SCHEMA, 4)

    def slow(rows, new):
        store.upsert_segments(held, changes(spark, [("a", 1, "complete", 1, "other", 0)]), ["session", "id"])
        return new.drop("arrival")

    with pytest.raises(FileExistsError):
        held.update(changes(spark, [("a", 1, "pending", 0, "", 0)]), slow)
    assert [r.text for r in held.read().collect()] == ["other"]


def test_translations_are_queued_in_the_store(spark, tmp_path):
    schema = "session string, id long, sourceText string, text string, status string, attempts long, error string"
    held = store.segment_store(spark, str(tmp_path), schema, 4)
    done = lambda *rows: spark.createDataFrame(rows, "session string, id long, text string")
    held.update(done(("a", 1, "x"), ("b", 1, "y")), queue.enqueue_translations)
    held.update(done(("a", 1, "x"), ("a", 2, "z")), queue.enqueue_translations)
    held.update(done(("b", 1, "new")), queue.enqueue_translations)
    assert sorted((r.session, r.id, r.sourceText, r.status) for r in held.read().collect()) == [("a", 1, "x", "pending"), ("a", 2, "z", "pending"), ("b", 1, "new", "pending")]


def test_a_second_scan_parses_nothing(spark, tmp_path):
    root = tmp_path / "root"
    for day in range(1, 8):
        for n in range(3):
            write(root / f"2026/01/{day:02}/s{day}{n}", "session.json", manifest(f"s{day}{n}", f"2026-01-{day:02}T0{n}:00:00Z"))
    write(root / "loose", "session.json", manifest("loose", "2025-01-01T00:00:00Z"))
    write(root / "2026/01/03/bad", "session.json", "{")
    write(root / "1/2/3/4/5/6", "session.json", manifest("deep"))
    (root / "linked").symlink_to(root / "loose")
    held = index.DocumentIndex(spark, str(root), str(tmp_path / "index"))
    assert held.refresh() == (23, 0) and held.refresh() == (0, 0) and held.store.versions() == [1]
    scan = documents.scan_documents(spark, str(root), "session")
    told = lambda df: sorted((r.sessionId or "", r.corrupt, r.directory.removeprefix("file://").removeprefix("file:")) for r in df.collect())
    assert told(held.documents()) == told(scan) and held.documents().columns == scan.columns
    write(root / "2026/01/02/s20", "session.json", manifest("s20", "2026-01-02T09:00:00Z", status="failed"))
    write(root / "2026/01/09/new", "session.json", manifest("new", "2026-01-09T00:00:00Z"))
    import shutil

    shutil.rmtree(root / "2026/01/05/s51")
    before = held.store.manifest()[1]
    assert held.refresh() == (2, 1) and told(held.documents()) == told(documents.scan_documents(spark, str(root), "session"))
    after = held.store.manifest()[1]
    assert {d for d in after if before.get(d) != after[d]} == {"2026-01-02", "2026-01-05", "2026-01-09"}
    for limit in (1, 2, 5, 11, 500):
        want = [r.sessionId for r in history.newest(scan_again(spark, root), limit).collect()]
        assert [r.sessionId for r in held.newest_sessions(limit).collect()] == want
    assert "2026-01-01" not in held.newest_days(2) and len(held.newest_days(500)) == len(after)
    empty = index.DocumentIndex(spark, str(tmp_path / "none"), str(tmp_path / "empty"))
    (tmp_path / "none").mkdir()
    assert empty.refresh() == (0, 0) and empty.newest_sessions(10).count() == 0


def scan_again(spark, root):
    return documents.scan_documents(spark, str(root), "session").filter("NOT corrupt").drop("corrupt")

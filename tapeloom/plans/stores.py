"""Registered queries of the stored table and the document index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import queue
from tapeloom.plans.queries import TURNS, _turns
from tapeloom.plans.registry import query, table
from tapeloom.sources import index, store
from tapeloom.sources.shared import shared_path


@query("""
WITH c AS (SELECT user_id AS session, event_id % 5 AS id, event_id AS arrival, event_id % 3 AS attempts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'complete' END AS status, event_type AS text FROM events WHERE user_id % 11 <> 0)
SELECT session, id, attempts, status, text FROM c QUALIFY row_number() OVER (PARTITION BY session, id ORDER BY attempts DESC, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, arrival DESC) = 1
""")
def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes merged into a stored table in three updates, each over a snapshot that the last one left; then some sessions are deleted."""
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "failed", "complete"))), (F.col("event_id") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.expr("event_id % 5").alias("id"), F.expr("event_id % 3").alias("attempts"), status.alias("status"), F.col("event_type").alias("text"), F.col("event_id").alias("arrival"))
    held = store.segment_store(spark, shared_path(spark, "segments"), "session long, id long, attempts long, status string, text string", 16)
    last = c.agg(F.max("arrival")).first()[0] or 0
    for n in range(3):
        store.upsert_segments(held, c.filter(F.floor(F.col("arrival") * 3 / (last + 1)) == n), ["session", "id"])
    store.delete_sessions(held, c.filter("session % 11 = 0").select("session"))
    return held.read()


@query(f"""
WITH {TURNS}, n AS (SELECT session, id, CASE WHEN id % 2 = 0 THEN 'new ' ELSE '' END || text AS src, id % 2 = 0 OR session % 4 = 0 AS again FROM t WHERE trim(text) <> '')
SELECT session, id, src AS "sourceText", CASE WHEN again THEN 'pending' ELSE 'complete' END AS status, CASE WHEN again THEN 0 ELSE 1 END::BIGINT AS attempts FROM n
""")
def stored_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation queue as a stored table: all segments enter it, are translated in some sessions, and enter it again, some with another text."""
    turns = _turns(spark, sf_dir).select("session", "id", "text")
    held = store.segment_store(spark, shared_path(spark, "translations"), "session long, id long, sourceText string, text string, status string, attempts long, error string", 16)
    held.update(turns, queue.enqueue_translations)
    done = lambda rows, some: rows.join(some.select("session").distinct().withColumn("__done", F.lit(True)), "session", "left").withColumns({"status": F.when(F.col("__done"), "complete").otherwise(F.col("status")), "attempts": F.when(F.col("__done"), 1).otherwise(F.col("attempts")).cast("long")}).drop("__done")
    held.update(turns.filter("session % 4 <> 0"), done)
    held.update(turns.withColumn("text", F.when(F.expr("id % 2 = 0"), F.concat(F.lit("new "), "text")).otherwise(F.col("text"))), queue.enqueue_translations)
    return held.read().select("session", "id", "sourceText", "status", "attempts")


def _writes(root: str):
    """Writes each row's document in its folder, on the tasks."""
    import pyarrow.fs as pafs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for folder, content in zip(batch["folder"], batch["content"], strict=True):
                system.create_dir(f"{base}/{folder}", recursive=True)
                with system.open_output_stream(f"{base}/{folder}/session.json") as out:
                    out.write(content.encode())
            yield batch[["folder"]]

    return run


def _documents(turns: DataFrame, status: str) -> DataFrame:
    """A session document for each conversation, in the folder of its day; some unreadable."""
    day = F.date_add(F.to_date(F.lit("2026-01-01")), (F.col("session") % 40).cast("int"))
    segments = F.array_sort(F.collect_list(F.struct(F.col("id").alias("index"), F.lit(1000).cast("long").alias("durationMs"))))
    s = turns.groupBy("session").agg(segments.alias("segments")).withColumn("day", day)
    whole = F.to_json(F.struct(F.col("session").cast("string").alias("sessionId"), F.col("day").cast("timestamp").alias("startedAt"), F.lit(status).alias("status"), "segments"))
    return s.select("session", F.concat(F.date_format("day", "yyyy/MM/dd"), F.lit("/s"), F.col("session")).alias("folder"), F.when(F.col("session") % 9 == 4, F.substring(whole, 1, 30)).otherwise(whole).alias("content"))


@query("""
WITH t AS (SELECT conv_id AS session, count(*) AS n FROM conversations GROUP BY 1),
d AS (SELECT session, DATE '2026-01-01' + (session % 40)::INT AS day, CASE WHEN session % 6 = 0 THEN 'failed' ELSE 'completed' END AS status, n FROM t WHERE session % 9 <> 4 AND session % 10 <> 7)
SELECT session::VARCHAR AS "sessionId", day::TIMESTAMP::VARCHAR AS started, status, n::INT AS segments FROM d ORDER BY day DESC, session::VARCHAR LIMIT 50
""")
def indexed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 sessions from an index over document files: brought up to date after some documents had been rewritten and some deleted, it parses those alone."""
    root = shared_path(spark, "sessions")
    root = "file://" + re.sub(r"^file:/+", "/", root) if root.startswith(("file:", "/")) else root
    docs = _documents(_turns(spark, sf_dir), "completed")
    docs.select("folder", "content").repartition(4).mapInPandas(_writes(root), "folder string").count()
    held = index.DocumentIndex(spark, root, shared_path(spark, "session-index"))
    held.refresh()
    changed = _documents(_turns(spark, sf_dir), "failed").filter("session % 6 = 0").select("folder", "content")
    changed.repartition(4).mapInPandas(_writes(root), "folder string").count()
    gone = docs.filter("session % 10 = 7").select("folder")

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch["folder"]:
                system.delete_dir(f"{base}/{folder}")
            yield batch

    gone.mapInPandas(delete, "folder string").count()
    parsed, lost = held.refresh()
    want = docs.filter("session % 6 = 0 AND session % 10 <> 7").count(), gone.count()
    if (parsed, lost) != want:
        raise AssertionError(json.dumps({"parsed and gone": [parsed, lost], "changed": want}))
    found = held.newest_sessions(50)
    return found.select("sessionId", F.date_format("startedAt", "yyyy-MM-dd HH:mm:ss").alias("started"), "status", F.size("segments").alias("segments"))

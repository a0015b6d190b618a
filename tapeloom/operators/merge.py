"""Latest-wins merging of segment snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_rank(status: Column) -> Column:
    """A later stage ranks higher; done and failed rank the same."""
    return F.when(status == "pending", 0).when(status == "processing", 1).when(status.isin("complete", "failed"), 2)


def latest(changes: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row for each key: most attempts, then the highest stage, then the last to arrive.

    That is what replacing row by row gives, as each replacement needs at least as many attempts and as high a stage.
    A partial aggregate: one row for each key and task is exchanged, however many changes a key has."""
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct("attempts", status_rank(F.col("status")), arrival)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(*changes.columns)


def merge_segments(fetched: DataFrame, received: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """A stored snapshot and live changes as one: the snapshot counts as having arrived first. received has a column arrival (from 0)."""
    both = fetched.withColumn(arrival, F.lit(-1).cast("long")).unionByName(received.withColumn(arrival, F.col(arrival).cast("long")))
    return latest(both, keys, arrival).drop(arrival)


def with_translations(transcripts: DataFrame, translations: DataFrame) -> DataFrame:
    """Each transcript segment with its first translation (by position), if any. Keys: sessionId, id = segmentId."""
    first = translations.groupBy("sessionId", "segmentId").agg(F.min_by(F.struct("text", "status"), "position").alias("__t"))
    told = first.select("sessionId", F.col("segmentId").alias("id"), F.col("__t.text").alias("translation"), F.col("__t.status").alias("translationStatus"))
    return transcripts.join(told, ["sessionId", "id"], "left")


def without_ids(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def as_ordered_lists(segments: DataFrame, session: str = "session", id_col: str = "id") -> DataFrame:
    """(session, segments): each session's merged segments as one list by id, as a document stores them."""
    rest = [c for c in segments.columns if c not in (session, id_col)]
    return segments.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(id_col, *rest))).alias("segments"))

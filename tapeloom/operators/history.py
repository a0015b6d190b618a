"""Session history: manifests with what their transcripts and translations add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.text import preview

LIMIT = 500


def clamp_limit(limit: int) -> int:
    return max(1, min(limit, LIMIT))


def newest(entries: DataFrame, limit: int, time_col: str = "startedAt", id_col: str = "sessionId") -> DataFrame:
    """The newest rows, 1 to LIMIT of them; ties by id. One top-k step, no full sort."""
    return entries.orderBy(F.col(time_col).desc(), F.col(id_col)).limit(clamp_limit(limit))


def history_entries(sessions: DataFrame, transcripts: DataFrame, translations: DataFrame) -> DataFrame:
    """One row of 15 columns for each readable session. A session any of whose documents is corrupt is left out.

    Documents meet by directory, at most one of a kind in each; a missing one gives empty previews, 0 segments and null states."""
    t = transcripts.select("directory", F.col("corrupt").alias("t_bad"), F.col("status").alias("transcriptStatus"), F.col("segments").alias("t_segments"))
    x = translations.select("directory", F.col("corrupt").alias("x_bad"), F.col("status").alias("translationStatus"), F.col("segments").alias("x_segments"), F.col("targetLanguage").alias("translationTargetLanguage"))
    joined = sessions.join(t, "directory", "left").join(x, "directory", "left")
    good = joined.filter(~F.col("corrupt") & ~F.coalesce("t_bad", F.lit(False)) & ~F.coalesce("x_bad", F.lit(False)))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["durationMs"])
    return good.select(
        "audioFormat", "audioSource", "completedAt", "directory", total.alias("durationMs"), F.size("segments").alias("segmentCount"), "sessionId", "startedAt", "status",
        preview(F.col("t_segments")).alias("transcriptPreview"), F.when(F.col("t_segments").isNull(), 0).otherwise(F.size("t_segments")).alias("transcriptSegmentCount"), "transcriptStatus",
        preview(F.col("x_segments")).alias("translationPreview"), "translationStatus", "translationTargetLanguage",
    )


def find_session(entries: DataFrame, session_id: str) -> DataFrame:
    """A session among the newest LIMIT only: older ones aren't found."""
    return newest(entries, LIMIT).filter(F.col("sessionId") == session_id)


def source_rollup(source: str = "source") -> Column:
    """The only source of a group, or mixed."""
    return F.when(F.count_distinct(source) > 1, "mixed").otherwise(F.min(source))


def source_is_enabled(mode: Column, source: Column) -> Column:
    return (mode == "mixed") | (mode == source)

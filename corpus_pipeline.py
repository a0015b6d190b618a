"""A training corpus from the documents table: quality, near-duplicates, benchmark leaks, mixing and shards."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import broadcast_if_few, count_words, drop_tables, scratch, stored
from tapeloom.llm.decontaminate import drop_contaminated
from tapeloom.llm.minhash import drop_near_duplicates
from tapeloom.llm.mixing import mix_sources
from tapeloom.llm.quality import importance_resample
from tapeloom.llm.queries import quality_weights, table
from tapeloom.llm.sharding import OVERHEAD, shard_by_bytes

#: SQL has neither the resampling model nor the alignment of these stages; tests/llm/test_pipeline.py compares each with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards labelled good ones draws; toxic and bad ones go.

    Null and empty texts have equal odds under both models and stay. Repeated rows and ids, and null ids, are each judged by their text (a
    key's noise depends on the id). An empty table gives no rows. Added columns don't show; other columns stay as they are."""
    return importance_resample(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked at a similarity of 0.8 of five-word shingles.

    Null texts and texts without words are in no group and stay. Of repeated rows one stays; ids that repeat with other texts are
    judged apart; a null id comes after all others. An empty table gives no rows; other columns stay as they are."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts stay, repeated rows share their fate, ids don't matter."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each whole or part epoch, none where nothing is taken.

    Null and empty texts, which have no words to take, stay. A null source is a source of its own. Repeated rows each count; those that tie in
    id and size are interchangeable. An empty table gives no rows; other columns stay as they are.

    Documents are stored once with their sizes and weights; the mix reads only these columns but for the last pass, so no text is exchanged."""
    weights = broadcast_if_few(stored(quality_weights(table(spark, sf_dir, "labels")), "pipeline-weights"))
    sized = docs.withColumn("__words", count_words(F.col("text"))).join(weights.select(F.col("doc_id").alias("__doc"), F.col("weight").alias("__weight")), F.col("doc_id") == F.col("__doc"), "left")
    sized = stored(sized.withColumn("__weight", F.coalesce("__weight", F.lit(0.5))).drop("__doc"), "pipeline-sizes")
    mixed = mix_sources(sized, size_col="__words", weight_col="__weight")
    copies = F.when(F.col("__words") > 0, F.ceil(F.col("taken") / F.col("__words"))).otherwise(1).cast("long")
    told = mixed.withColumn("__copies", copies).filter("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return told.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard (of 40, contiguous and of near-equal bytes) and the slot that each goes to.

    A null text has no bytes but its overhead; a null id comes first; ties in id are in order of text hash and size, equal rows in any. An empty table gives no
    rows; columns named shard or slot are replaced."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"__bytes": (F.octet_length(text) + OVERHEAD).cast("long"), "__crc": F.crc32(text.cast("binary"))})
    return shard_by_bytes(sized, size_col="__bytes", tie_cols=("__crc", "__bytes")).drop("__bytes", "__crc")


#: For each Spark application the tables that its last stage stored for itself.
_LEFT: dict[str, list[str]] = {}


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame], first: bool) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; before it begins, what the stage before it had stored for itself is deleted, unless docs still reads it: that stage's rows have been written by then, so the
    disk holds one stage's tables. The first stage deletes nothing: what the last run returned may not have been read yet."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _LEFT.pop(app, [])
        kept = [] if first else drop_tables(spark, left, docs)
        with scratch() as found:
            out = stage(spark, docs, sf_dir)
        _LEFT[app] = kept + found
        return out

    return run


STAGES = [(name, _tidy(stage, stage is quality)) for name, stage in (("quality classifier", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("source mixing", mix), ("sharding", shard))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

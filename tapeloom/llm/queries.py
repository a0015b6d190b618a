"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, count_words, shared_dir, stored
from .decontaminate import benchmark_leaks
from .lines import drop_common_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .mixing_lm import score_texts
from .quality import drawn_keys
from .runs import periodic_runs
from .secrets import scan_secrets, secret_report
from .sharding import OVERHEAD, shard_by_bytes
from .substrings import remove_repeats
from .tokens import count_tokens
from .topk import exact_top_k
from .whitening import whiten_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and a sampling weight: 1 where a label calls the document good, 0.25 where it calls it bad."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(F.max("quality") == 1, 1.0).otherwise(0.25).alias("weight"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache outlives the session where spark.checkpoint.dir does: a later run encodes only texts that no run before it had."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/token-cache")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    weighted = docs.join(quality_weights(table(spark, sf_dir, "labels")), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    mixed = mix_sources(stored(weighted, "mix-sizes"), weight_col="weight")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "weight")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = drawn_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", F.lit(True).alias("kept"), "log_ratio", "sample_key")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(scan_secrets(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(slim, tie_cols=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs; where h = crc32(doc_id) is divisible by 10, words from the a-th on repeat the p words that begin there (a, p by h and the number of words)."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("__words")
    g = F.floor(h / 10).cast("long")
    some = docs.withColumn("__words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    a = (g % n).cast("int")
    some = some.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, 1 + F.floor((n - a) / (3 + g % 8)).cast("int"))})
    again = F.flatten(F.array_repeat(F.slice("__words", F.col("__a") + 1, F.col("__p")), F.ceil((n - F.col("__a")) / F.col("__p")).cast("int")))
    tail = F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), n - F.col("__a")))
    return some.withColumn("text", F.when(F.col("__a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text"))).drop("__words", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = periodic_runs(docs).withColumn("best", best)
    length, period = -F.col("best.shorter"), F.col("best.period")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("(-1000 * best.shorter) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten_vectors(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_mixing": op3_mixing,
        "op4_exact_topk": op4_exact_topk,
        "op5_decontamination": op5_decontamination,
        "op6_mixing_lm": op6_mixing_lm,
        "op7_quality": op7_quality,
        "op8_secrets": op8_secrets,
        "op9_sharding": op9_sharding,
        "op10_repeats": op10_repeats,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_whitening": op12_whitening,
        "op13_line_dedup": op13_line_dedup,
    }

"""Token counts by a digest cache: each distinct text is encoded once for each tokenizer version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, write_parquet

MEMO = 1_000_000
CACHE_SCHEMA = "tokenizer binary, content binary, n_tokens long"
# No token of a byte-level tokenizer spans a non-space character and a following space, so a text may be cut there.
CUT = re.compile(r"(?<=\S) ")


def tokenizer_digest(path: str) -> bytes:
    """What a stored count depends on besides the text: the vocabulary file and the library's version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(library.encode() + b"\0" + Path(path).read_bytes()).digest()


@lru_cache(maxsize=4)
def _counter(path: str):
    """(count of each of a list of texts, whether texts may be cut at CUT); loaded once for a Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    # An added token that holds a space or takes neighbouring ones in could lie across a cut.
    whole = any(" " in t.content or t.lstrip or t.rstrip for t in model.get_added_tokens_decoder().values())
    cut = not whole and isinstance(model.pre_tokenizer, tokenizers.pre_tokenizers.ByteLevel) and model.normalizer is None and "add_prefix_space=False" in repr(model.pre_tokenizer) and "use_regex=True" in repr(model.pre_tokenizer)
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)], cut


def count_texts(path: str, texts: list[str], memo: dict[str, int]) -> list[int]:
    """Tokens of each text. Texts that may be cut are counted piece by piece, a repeated piece only once."""
    count, cut = _counter(path)
    if not cut:
        return count(texts)
    pieces = [CUT.split(t) for t in texts]
    for p in pieces:
        p[1:] = [" " + x for x in p[1:]]
    if len(memo) > MEMO:
        memo.clear()
    new = list(set().union(*pieces).difference(memo))
    memo.update(zip(new, count(new), strict=True))
    return [sum(map(memo.__getitem__, p)) for p in pieces]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count_texts(path, part.column(1).to_pylist(), memo), pa.int64())], ["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache at the path, empty where nothing is stored yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for each row of df.

    Content is normalised as far as no tokenizer can tell the difference: null becomes the empty text (0 tokens). Its
    SHA-256 and the tokenizer's digest are joined to the cache (a Parquet table at cache_path, made if
    missing, which every executor must reach); only distinct texts that it lacks are encoded, whole, and appended. No
    special tokens are added, and their strings inside a text count as the library counts them. tokenizer_path
    must exist on every executor. Ids may be null or repeat; empty df: no rows, and no cache is written.

    Copies meet as digests only, pre-aggregated to one chosen document before the exchange; one text of each
    digest travels, dealt by digest and id, so a hot text is never in one task. Two runs that append the same text at
    once leave two equal rows, which the read drops.
    """
    spark = df.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    narrow = stored(docs.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    known = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version))
    chosen = narrow.groupBy("content").agg(F.min("doc_id").alias("chosen"))
    missing = chosen.join(known.select("content"), "content", "left_anti").withColumnRenamed("content", "wanted")
    texts = docs.join(missing, (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    counted = texts.select("content", "text").mapInArrow(_encode(tokenizer_path), "content binary, n_tokens long").dropDuplicates(["content"])
    write_parquet(counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens"), cache_path, "append")
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == F.lit(version)).dropDuplicates(["content"]).select("content", "n_tokens")
    return narrow.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

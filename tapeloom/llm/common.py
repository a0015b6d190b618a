"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources.shared import shared_dir, shared_path

WORD = r"[^\x20\x09-\x0D]+"
MOST_WORDS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


__all__ = ["shared_dir", "shared_path"]
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block; double underscores in a name stand for dots."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes df; the shuffle files of its plan go as soon as the job has ended, not when the driver next collects garbage."""
    with settings(df.sparkSession, **{CLEANUP.replace(".", "__"): "true"}):
        df.write.mode(mode).parquet(path)


SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """A list of the tables that are stored in the time of a block."""
    found: list[str] = []
    token = SCRATCH.set(found)
    try:
        yield found
    finally:
        SCRATCH.reset(token)


def drop_tables(spark: SparkSession, paths: list[str], but_of: DataFrame) -> list[str]:
    """Deletes stored tables, but not those that a DataFrame still reads; returns these."""
    read = [re.sub(r"^file:/+", "/", f) for f in but_of.inputFiles()] if paths else []
    kept = [p for p in paths if any(f.startswith(re.sub(r"^file:/+", "/", p) + "/") for f in read)]
    for path in set(paths) - set(kept):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return kept


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    if (held := SCRATCH.get()) is not None:
        held.append(path)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more; the session's end would do so too."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df (of narrow rows, stored), to be broadcast if it has at most so many rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) UTF-8 words; bytes.split cuts at the same six ASCII white-space bytes as WORD."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered: at most MOST_WORDS and those of one text (some 40 MB a Python worker)."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words; a shorter, non-empty sequence is one shingle."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _STEP + hashes[i : len(hashes) - n + 1 + i]
        return mix64(out ^ np.uint64(n))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {x.lower() for x in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])

"""Lines that many documents share: all but one document lose them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANK = " \t\n\x0b\x0c\r"
#: So many common lines (of 16 bytes and an id) at most are sent to every task; beyond that the lines travel to them.
SENT = 200_000
KEPT = "doc_id long, n_lines long, n_dropped long, kept string"


def line_key(line: str, least: int) -> bytes | None:
    """128 bits of the line, stripped and lower-cased (ASCII only); None if that is shorter than `least` code points."""
    line = line.strip(BLANK)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= least else None


def _pairs(keys: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's distinct keys with its id."""
        for batch in batches:
            keys, sizes = [], []
            for text in batch.column(1):
                own = {line_key(x, least) for x in (text.as_py() or "").split("\n")} - {None}
                keys += own
                sizes.append(len(own))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            yield pa.RecordBatch.from_arrays([ids, *_pairs(keys)], ["doc_id", "k1", "k2"])

    return run


def _drop(least: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without their common lines, which are few enough to be sent here: each with the id that keeps it."""
        last = common.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = (text.as_py() or "").split("\n")
                kept = [x for x in lines if last.get(line_key(x, least), doc) == doc]
                out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
            n, dropped, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All lines by position. Short ones get a key that nothing has (k2 null), which spreads them."""
        for batch in batches:
            for i in range(batch.num_rows):
                lines = (batch.column(1)[i].as_py() or "").split("\n")
                keys = [line_key(x, least) for x in lines]
                k1, k2 = _pairs([k or xxhash.xxh3_128_digest(b"%d %d" % (batch.column(2)[i].as_py(), at)) for at, k in enumerate(keys)])
                k2 = pa.array(k2.to_numpy(), mask=np.array([k is None for k in keys]))
                n = len(lines)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array([i] * n)), batch.column(0).take(pa.array([i] * n)), pa.array(np.arange(n)), pa.array(lines, pa.string()), k1, k2], ["row", "doc_id", "pos", "line", "k1", "k2"])

    return run


def common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """k1, k2 (a line's 128 bits), docs (documents that hold it) and last (the largest doc_id of them), for lines that at least least_docs documents hold.

    docs: doc_id and text. Keys go once for each row, and are counted before each of two exchanges: by key and id, then by key, so a line that a third of
    all documents holds reaches its task as one row from each."""
    found = docs.mapInArrow(_keys(least_chars), "doc_id long, k1 long, k2 long").groupBy("k1", "k2")
    # Rows without an id are one document, the least.
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return found.agg(n.alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= least_docs)


def drop_common_lines(df: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the lines that stay, in order, joined by newlines) for each row of df.

    A text is cut at newlines; null and empty texts are one empty line. A line's key is the line without ASCII white space at its ends, A to Z lower-cased. Keys of at
    least least_chars code points that at least least_docs documents hold lose all their lines except in the largest doc_id that holds them, where all
    stay. Equality of keys is that of 128 bits of hash. Rows of one id are one document, and rows without an id are one, the least. Empty df: no rows. Other columns
    are not read.

    At most `sent` common lines are sent to every task, and each text is cut where it is read. If there are more, the lines travel: each is joined to the common ones by
    key (Spark splits a hot key's side, the other has one row a key) and they are put together again by row and position."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = stored(common_lines(docs, least_chars, least_docs).filter("last IS NOT NULL"), "common-lines")
    few = common.limit(sent + 1).collect() if sent else []
    if sent and len(few) <= sent:
        last = {np.array([r.k1, r.k2], np.int64).tobytes(): r.last for r in few}
        return docs.mapInArrow(_drop(least_chars, df.sparkSession.sparkContext.broadcast(last)), KEPT)
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    lines = rows.mapInArrow(_explode(least_chars), "row long, doc_id long, pos long, line string, k1 long, k2 long").join(common, ["k1", "k2"], "left")
    gone: Column = F.coalesce(~F.col("last").eqNullSafe(F.col("doc_id")) & F.col("last").isNotNull(), F.lit(False))
    parts = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), F.count_if(gone).alias("n_dropped"), F.collect_list(F.when(~gone, F.struct("pos", "line"))).alias("kept"))
    return parts.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform(F.array_sort("kept"), lambda x: x["line"]), "\n").alias("kept"))

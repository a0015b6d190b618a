"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

QUERY_BLOCK = 8192
ROW_BLOCK = 4096
BLOCK_VALUES = 1 << 21  # a block of rows has at most so many components
QUERIES_AT_ONCE = 512
BIN_BITS = 8
FEW = 32
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
DOUBLE_MAX = 1.7976931348623157e308


def wrapped(v: np.ndarray) -> np.ndarray:
    """Whole doubles modulo 2**64 as signed longs."""
    small = np.abs(v) < 2.0**63
    out = np.where(small, v, 0).astype(np.int64)
    for i in np.argwhere(~small):
        out[tuple(i)] = np.array(int(v[tuple(i)]) & ((1 << 64) - 1), np.uint64).view(np.int64)
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b (whole numbers as doubles) as longs; what a long can't hold is its nearest end.

    Doubles are exact while the sum of magnitudes is below 2**53. Beyond, the double product says, within its error, whether the
    true value fits a long; if so, products that wrap at 2**64 give it exactly. What lies too near an end to tell is summed in Python."""
    with np.errstate(over="ignore", invalid="ignore"):
        about = a @ b.T
        bound = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :] * (1 + 1e-9)
        exact = bound < 2.0**52
        if exact.all():
            return np.rint(about).astype(np.int64)
        out = np.where(exact, np.rint(about), 0).astype(np.int64)
        rows, columns = np.flatnonzero(~exact.all(axis=1)), np.flatnonzero(~exact.all(axis=0))
        where = np.ix_(rows, columns)
        about, bound = about[where], bound[where]
        part = np.where(exact[where], out[where], wrapped(a[rows]) @ wrapped(b[columns]).T)
        error = bound * ((a.shape[1] + 4) * 2.0**-51)
        high, low = about - error >= 2.0**63, about + error < -(2.0**63)
        part[high], part[low] = LONG_MAX, LONG_MIN
        sure = high | low | (np.abs(about) + error < 2.0**63)
    for i, j in np.argwhere(~sure):
        true = sum(int(x) * int(y) for x, y in zip(a[rows[i]], b[columns[j]], strict=True))
        part[i, j] = min(max(true, LONG_MIN), LONG_MAX)
    out[where] = part
    return out


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ids, floors and the vectors as a matrix, in order of id."""
    column = table.column("v").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
    ids, floors = (table.column(n).to_numpy() for n in ("vec_id", "floor"))
    sizes = np.diff(at)
    out = {}
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        own = own[np.argsort(ids[own], kind="stable")]
        out[int(n)] = ids[own], floors[own], flat[at[own][:, None] + np.arange(n)]
    return out


def _scores(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each query of a pair of blocks: its id, its floor, the ids of the rows (rising) and their scores."""
    asked = np.asarray(table.column("asked").combine_chunks())
    queries, rows = (_vectors(table.filter(pa.array(asked == side))) for side in (True, False))
    for n in queries.keys() & rows.keys():
        (q_ids, floors, a), (r_ids, _, b) = queries[n], rows[n]
        for lo in range(0, len(q_ids), QUERIES_AT_ONCE):
            for q, floor, found in zip(q_ids[lo:], floors[lo:], exact_scores(a[lo : lo + QUERIES_AT_ONCE], b), strict=False):
                own = (r_ids != q) & (found >= floor)
                yield int(q), int(floor), r_ids[own], found[own]


def _histogram(shift: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts of score bins (score >> shift) for each query, from the best bin down until k scores are counted.

        The k-th score of all rows is at least the k-th of any block, so no bin below that is needed."""
        ids, bins, counts = [], [], []
        for q, _, _, own in _scores(table):
            if len(own) > k:
                own = own[own >= np.partition(own, len(own) - k)[len(own) - k] >> shift << shift]
            b, c = np.unique(own >> shift, return_counts=True)
            ids.append(np.full(len(b), q)), bins.append(b), counts.append(c)
        return pa.table({n: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for n, x in (("query_id", ids), ("bin", bins), ("n", counts))})

    return run


def _above(k: int):
    def run(table: pa.Table) -> pa.Table:
        """For each query the rows above its k-th score, and of those at it the k least ids: no more can be wanted of this block."""
        out = []
        for q, floor, ids, found in _scores(table):
            at = np.concatenate((np.flatnonzero(found > floor), np.flatnonzero(found == floor)[:k]))
            out.append((np.full(len(at), q), ids[at], found[at]))
        return pa.table({n: np.concatenate([*(x[i] for x in out), np.zeros(0, np.int64)]).astype(np.int64) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and the components as floor(scale * x), x as double, which stay whole doubles of any size; rows with a null id, a null vector or a null or non-finite component go."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def whole(x):
        y = F.greatest(F.lit(-DOUBLE_MAX), F.least(F.lit(DOUBLE_MAX), F.lit(float(scale)) * x.cast("double")))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return df.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best inner products of each query (rows whose id is divisible by every) over all rows but those with its own id.

    Returns query_id, rank (from 1), vec_id, score. Every block of queries meets every block of rows once a round and all
    pairs are scored. Round by round a global histogram of each query's scores is refined (bins of 2**s scores, s falling by
    BIN_BITS) until the k-th score is known exactly, or until the rows that reach the bins of the k-th scores are at most FEW * k a query
    over all; then only rows that reach it are kept, and ties are broken in order: the smaller vec_id first.

    Scores are exact whole numbers (see exact_scores). A score that a long can't hold counts as the nearest long, and ties
    with others there. Only vectors of equal length are compared; a query with fewer than k partners keeps them all. Repeated rows: each
    is a candidate; a query id that occurs more than once is asked with its smallest vector. Unusable vectors (usable_vectors) take
    no part; empty: no rows. Other columns of df are not read.

    A task holds one pair of blocks (at most ROW_BLOCK rows and QUERY_BLOCK queries) and QUERIES_AT_ONCE rows of scores. However
    many rows tie at a query's k-th score, a pair of blocks gives k of them at most. Thresholds stay in a table (a row for each
    query) and travel with the queries; nothing passes through the driver but counts and one bound of the scores.
    """
    spark = df.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = stored(usable_vectors(df, id_col, vector_col, scale), "topk-rows")
    n_rows, most, width = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = stored(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    fit = max(1, BLOCK_VALUES // max(1, width))
    row_blocks, query_blocks = (max(1, -(-n // min(size, fit))) for n, size in ((n_rows, ROW_BLOCK), (queries.count(), QUERY_BLOCK)))
    bits = min(63, int(min(most, 2.0**64)).bit_length() + 1)  # |score| <= the largest squared norm
    floors = queries.select("vec_id", F.lit(-(1 << bits)).cast("long").alias("floor"))

    def all_blocks(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # One id may hold many rows, so its rows are dealt by their number, which is stored with them.
    dealt = stored(rows.withColumn("r_block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks))), "topk-blocks")

    def scored(floors: DataFrame, work, schema: str) -> DataFrame:
        """work on each pair of blocks: rows and queries are copied once for each block of the other kind, and meet by both numbers."""
        asked = queries.join(floors.select("vec_id", "floor"), "vec_id").select(F.lit(True).alias("asked"), "vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("q_block"), all_blocks(row_blocks).alias("r_block"))
        told = dealt.select(F.lit(False).alias("asked"), "vec_id", "v", F.lit(0).cast("long").alias("floor"), all_blocks(query_blocks).alias("q_block"), "r_block")
        return asked.unionByName(told).groupBy("q_block", "r_block").applyInArrow(work, schema)

    shift, most_left = bits + 1, FEW * k * queries.count()
    while shift > 0:
        shift = max(0, shift - BIN_BITS)
        found = scored(floors, _histogram(shift, k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin"))
        counted = found.withColumn("above", F.sum("n").over(down.rowsBetween(W.unboundedPreceding, 0)))
        # The bin that holds the k-th score; with fewer than k scores the lowest bin, which keeps them all.
        enough = F.col("above") >= k
        reached = counted.groupBy("query_id").agg(F.coalesce(F.max(F.when(enough, F.col("bin"))), F.min("bin")).alias("bin"), F.coalesce(F.min(F.when(enough, F.col("above"))), F.max("above")).alias("left"))
        floors = stored(reached.select(F.col("query_id").alias("vec_id"), (F.col("bin") * (1 << shift)).alias("floor"), "left"), "topk-floors")
        if floors.agg(F.sum("left")).first()[0] <= most_left:
            break
    floors = floors.drop("left")
    kept = stored(scored(floors, _above(k), "query_id long, vec_id long, score long"), "topk-kept")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

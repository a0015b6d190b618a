"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, without

OVERHEAD = 16


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", size_col: str = "size", tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to every row of df.

    Rows are ordered by id_col (null first), then tie_cols; the global prefix sum of size_col is
    cut at equal targets, and a row goes to the shard in which its midpoint lies. So shards are contiguous
    and each is within one row of total / shards. A null size counts 0. Rows that agree in all ordering
    columns are interchangeable. An empty df gives no rows. Columns named shard or slot are replaced.

    One range exchange orders the rows and is stored with its partition number, so the per-partition totals
    and the rows always come from the same cut, also after an executor is lost. Only those totals (a row
    for each partition) meet in one task.
    """
    df = without(df, "shard", "slot")
    keys = [id_col, *tie_cols]
    dealt = df.repartitionByRange(*[F.col(f"`{k}`").asc_nulls_first() for k in keys], F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt.withColumn("__size", F.coalesce(F.col(size_col), F.lit(0)).cast("long")), "sharding")
    totals = dealt.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("__part")
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows0"),
        F.sum("__bytes").over(everything).alias("__total"),
    )
    own = W.partitionBy("__part").orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys])
    sums = dealt.withColumns({"__sum": F.sum("__size").over(own.rowsBetween(W.unboundedPreceding, 0)), "__nth": F.row_number().over(own)})
    middle = f"((2 * (__bytes0 + __sum) - __size) * {int(shards)}) div (2 * __total)"  # longs hold it up to 9e18 / (2 * shards) bytes
    place = sums.join(offsets, "__part").withColumns({
        "shard": F.when(F.col("__total") > 0, F.least(F.lit(shards - 1), F.expr(middle))).otherwise(0).cast("int"),
        "__row": F.col("__rows0") + F.col("__nth") - 1,
    })
    # The first row of each shard: rows are contiguous, so the smallest global number. One row a shard.
    first = place.groupBy("shard").agg(F.min("__row").alias("__first"))
    out = place.join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first"))
    return out.select(*df.columns, "shard", "slot")

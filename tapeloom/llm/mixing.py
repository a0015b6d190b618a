"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, without

FINER = 4096
MOST_SORTED = 10_000
BROADCAST_ROWS = 10_000


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by seed and id, from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(totals: DataFrame, source_col: str, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Adds target to totals(source, source_size): share of all sizes dealt by weight, none above max_epochs times its size.

    The excess of capped sources goes to the others by weight until none is above: the fixed point caps a
    prefix of the sources in order of cap / weight, so two running sums find it without a loop.
    Sources sort by code point, null last, and take the weights in turn. One row a source meets in one task.
    """
    order = F.row_number().over(W.orderBy(F.col(source_col).asc_nulls_last())) - 1
    picked = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int"))
    capped = totals.withColumn("__w", picked).withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size"))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("__cap") / F.col("__w"), F.col(source_col).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = capped.withColumns({
        "__left": F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(by_ratio), zero),
        "__weight_left": F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(by_ratio), zero),
    }).withColumn("__level", F.col("__left") / F.col("__weight_left"))
    open_ = F.col("__cap") > F.col("__level") * F.col("__w")
    water = F.min(F.when(open_, F.struct(F.col("__cap") / F.col("__w"), F.col(source_col).isNull(), F.col(source_col), F.col("__level").alias("level")))).over(whole)
    return level.withColumn("__water", water["level"]).withColumn(
        "target", F.when(F.col("__water").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__water") * F.col("__w")))
    ).select(source_col, "source_size", "target")


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11,
                id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str | None = None, most_sorted: int = MOST_SORTED) -> DataFrame:
    """Adds source_size, target and taken (long: size units of the row that the mix takes, repeats counted).

    A source's target is met by floor(target / source_size) complete epochs of all its rows; the rest comes
    from its rows in order of the exponential key -ln(u) / weight (Efraimidis-Spirakis: heavier rows tend to come
    first), by prefix sum; the row at which the budget ends is taken in part. So sum(taken) is the target, rounded
    half up, and no row exceeds ceil(max_epochs) times its size. u depends on seed and id only, so reruns agree.

    Null sizes count 0; rows of null or non-positive weight come last, in order of -ln(u); a null source is a source of its own.
    Rows that tie in key, id and size are interchangeable. Empty df: no rows. Columns named source_size,
    target or taken are replaced.

    A source is never sorted whole: a histogram of its keys (partial sums before the exchange) finds the bin in which the budget
    ends, and bins of that bin follow until it holds at most most_sorted rows or a single key; only those rows are sorted.
    """
    df = without(df, "source_size", "target", "taken")
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double")
    draw = -F.log(uniform(F.col(f"`{id_col}`"), seed))
    has = F.coalesce(weight > 0, F.lit(False))
    keyed = df.withColumns({"__size": F.coalesce(F.col(size_col), F.lit(0)).cast("long"), "__class": F.when(has, 0).otherwise(1), "__key": F.when(has, draw / weight).otherwise(draw)})
    slim = keyed.select(F.col(f"`{source_col}`").alias("__source"), "__size", "__class", "__key")
    # Bins of 1/64 of an octave: keys of any weight spread over hundreds of them.
    bins = slim.withColumn("__bin", F.floor(F.log2("__key") * 64).cast("long"))
    told = [F.sum("__size").alias("__in"), F.count(F.lit(1)).alias("__rows"), F.min("__key").alias("__lo"), F.max("__key").alias("__hi")]
    histogram = stored(bins.groupBy("__source", "__class", "__bin").agg(*told), "mix-histogram")
    totals = histogram.groupBy("__source").agg(F.sum("__in").alias("source_size"))
    targets = source_targets(totals, "__source", weights, share, max_epochs)
    targets = targets.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("__rest", F.greatest(F.lit(0), F.floor(F.col("target") + 0.5).cast("long") - F.col("__epochs") * F.col("source_size")))
    targets = stored(targets, "mix-targets")
    few = targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # a row for each source
    small = F.broadcast if few else lambda x: x
    same = lambda other: F.col("__source").eqNullSafe(F.col(other))

    def edges(counts: DataFrame, before: Column) -> DataFrame:
        """The bin of each source in which its budget ends, with what comes before it."""
        running = W.partitionBy("__source").orderBy("__class", "__bin").rowsBetween(W.unboundedPreceding, 0)
        ends = counts.withColumn("__before", before + F.sum("__in").over(running) - F.col("__in"))
        ends = ends.filter((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__in")))
        return ends.select(F.col("__source").alias("__of"), F.col("__class").alias("__edge"), "__lo", "__hi", "__rows", "__before", F.col("__rest").alias("__budget"))

    edge = stored(edges(histogram.join(targets.select(F.col("__source").alias("__s"), "__rest"), same("__s")), F.lit(0)), "mix-edge")
    while edge.filter((F.col("__rows") > most_sorted) & (F.col("__lo") < F.col("__hi"))).limit(1).count():
        inside = slim.join(small(edge.withColumnRenamed("__before", "__base").withColumnRenamed("__budget", "__rest").drop("__rows")), same("__of") & (F.col("__class") == F.col("__edge")) & F.col("__key").between(F.col("__lo"), F.col("__hi")))
        place = F.when(F.col("__lo") < F.col("__hi"), F.least(F.lit(FINER - 1), F.floor((F.col("__key") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * FINER))).otherwise(0).cast("long")
        finer = inside.withColumn("__bin", place).groupBy("__source", "__class", "__bin", "__rest", "__base").agg(*told)
        edge = stored(edges(finer, F.col("__base")), "mix-edge")
    plan = targets.join(edge.drop("__rows", "__budget"), same("__of"), "left").drop("__of")
    planned = keyed.join(small(plan), F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
    own = F.coalesce(F.col("__class") == F.col("__edge"), F.lit(False))
    inside = own & F.col("__key").between(F.col("__lo"), F.col("__hi"))
    first = F.col("__edge").isNull() & (F.col("__rest") > 0) | (F.col("__class") < F.col("__edge")) | own & (F.col("__key") < F.col("__lo"))
    rest = planned.filter(~F.coalesce(inside, F.lit(False))).withColumn("__extra", F.when(F.coalesce(first, F.lit(False)), F.col("__size")).otherwise(0))
    in_order = W.partitionBy("__source").orderBy("__key", F.col(f"`{id_col}`").asc_nulls_last(), "__size").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("__rest") - F.col("__before") - (F.sum("__size").over(in_order) - F.col("__size"))
    at_edge = planned.filter(F.coalesce(inside, F.lit(False))).withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), left)))
    both = rest.unionByName(at_edge).withColumn("taken", (F.col("__epochs") * F.col("__size") + F.col("__extra")).cast("long"))
    return both.select(*df.columns, F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken")

"""Ordered-sequence operators: gap checks, offsets, splitting, alignment and segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.signal import LONG_MAX, TARGET_RATE, apply_gain, mix_mono, sanitize_sample, samples_to_ms

CHUNK = 1600
FRAME = 512
#: Places of a session that one task holds at most.
STRIDE = 1 << 16


def check_sequence(events: DataFrame, key: tuple[str, ...] = ("session", "source"), sequence: str = "sequence", rate: str = "sample_rate", stride: int = STRIDE) -> DataFrame:
    """events with fault: null, or what is wrong. Each source's numbers run from 0 without a gap or a repeat, at its first rate.

    Rows are exchanged once, by key and stretch of `stride` numbers, and each looks at the one before it; a stretch's first row looks at the end of the stretch before, which
    comes from an aggregate with a row a stretch. So no source fills a task, however long."""
    names = [*key, "__stretch"]
    dealt = events.withColumn("__stretch", _stretch(events, sequence, stride))
    ends = dealt.groupBy(*names).agg(F.max(sequence).alias("__last"), F.min_by(rate, sequence).alias("__rate"))
    by = W.partitionBy(*key).orderBy("__stretch")
    edges = ends.select(*[F.col(c).alias(f"__of_{c}") for c in names], F.lag("__last").over(by).alias("__end"), F.first("__rate").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names])
    own = F.lag(sequence).over(W.partitionBy(*names).orderBy(sequence, rate))
    joined = dealt.withColumn("__own", own).join(edges, same)
    before = F.coalesce("__own", "__end")
    in_order = F.when(before.isNull(), F.col(sequence) == 0).otherwise((before == F.col(sequence) - 1) | ((F.col(sequence) == 0) & (before < 0)))
    fault = F.when(~in_order, "sequence gap").when(F.col(rate) != F.col("__first"), "sample rate changed")
    return joined.withColumn("fault", fault).select(*events.columns, "fault")


def require_sequence(events: DataFrame, **columns) -> DataFrame:
    """The events, or an error at the first fault."""
    found = check_sequence(events, **columns)
    return found.filter(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error("fault").cast("boolean"))).drop("fault")


def _stretch(df: DataFrame, column: str, stride: int) -> Column:
    """The number of the stretch of `stride` places that a row is in; all rows are in one where places aren't whole numbers."""
    whole = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.floor(F.col(f"`{column}`") / stride).cast("long") if whole else F.lit(0).cast("long")


def running_offsets(blocks: DataFrame, key: str | list[str], order: list[str], samples: str, stride: int = STRIDE) -> DataFrame:
    """blocks with first_sample (of all samples before, in order, at most the largest long) and offset_ms (its whole milliseconds, saturating).

    A scan in two levels, so that no task holds a long session: sums of stretches of `stride` values of the first ordering column (one row a stretch is left of a partial
    aggregate), running sums over a session's stretches, then running sums within each stretch. Where the first ordering column holds no whole numbers a session is one stretch."""
    names = _names(key)
    dealt = blocks.withColumn("__stretch", _stretch(blocks, order[0], stride))
    n = F.col(samples).cast("decimal(38,0)")
    sums = dealt.groupBy(*names, "__stretch").agg(F.sum(n).alias("__sum"))
    earlier = W.partitionBy(*names).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    own = [*names, "__stretch"]
    sums = sums.select(*[F.col(c).alias(f"__of_{c}") for c in own], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in own])
    before = W.partitionBy(*names, "__stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("__before", F.coalesce(F.sum(n).over(before), F.lit(0))).join(sums, same)
    first = F.least(F.col("__base") + F.col("__before"), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    out = placed.withColumn("first_sample", first).withColumn("offset_ms", samples_to_ms(F.col("first_sample")))
    return out.select(*blocks.columns, "first_sample", "offset_ms")


def _as_single(x: Column, kind: T.DataType) -> Column:
    return x.cast("float") if isinstance(kind, T.FloatType) else x


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_fixed(blocks: DataFrame, key: str, order: list[str], samples: str, limit: int) -> DataFrame:
    """(key, part, sample_count): samples in order cut exactly every `limit`; the last part may be short.

    A block that crosses a cut counts in each part it touches. Only counts move; slices are cut by sample_parts."""
    placed = running_offsets(blocks, key, order, samples).filter(F.col(samples) > 0).withColumn("__end", F.col("first_sample") + F.col(samples))
    parts = placed.withColumn("part", F.explode(F.sequence(F.expr(f"first_sample div {limit}"), F.expr(f"(__end - 1) div {limit}"))))
    inside = F.least(F.col("__end"), (F.col("part") + 1) * limit) - F.greatest(F.col("first_sample"), F.col("part") * limit)
    return parts.groupBy(key, "part").agg(F.sum(inside).cast("long").alias("sample_count"))


def sample_parts(blocks: DataFrame, key: str | list[str], order: list[str], samples: str, limit: int) -> DataFrame:
    """(key, part, at, samples): the slices of each block that fall in each part, at their place in the part."""
    placed = running_offsets(blocks.withColumn("__n", F.size(samples).cast("long")), key, order, "__n").filter("__n > 0")
    parts = placed.withColumn("part", F.explode(F.sequence(F.expr(f"first_sample div {limit}"), F.expr(f"(first_sample + __n - 1) div {limit}"))))
    begin = F.greatest(F.col("first_sample"), F.col("part") * limit)
    end = F.least(F.col("first_sample") + F.col("__n"), (F.col("part") + 1) * limit)
    cut = F.slice(samples, (begin - F.col("first_sample") + 1).cast("int"), (end - begin).cast("int"))
    return parts.select(*_names(key), "part", (begin - F.col("part") * limit).alias("at"), cut.alias("samples"))


def chunked(samples: Column, size: int = CHUNK) -> Column:
    """An array cut to arrays of at most so many samples."""
    n = F.size(samples)
    pieces = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((n - 1) / size).cast("int")), lambda i: F.slice(samples, i * size + 1, size))
    return F.when(n > 0, pieces).otherwise(F.slice(F.array(samples), 1, 0))


def framed(samples: Column, size: int = FRAME) -> Column:
    """array<struct<frame, valid>>: frames of a fixed size, the last one padded by zeros; valid: how many samples are real."""
    pad = lambda f: F.concat(f, F.array_repeat(F.lit(0.0), size - F.size(f)))
    return F.transform(chunked(F.transform(samples, sanitize_sample), size), lambda f: F.struct(pad(f).alias("frame"), F.size(f).alias("valid")))


def align_mix(blocks: DataFrame, gains: dict[str, float], mode: str = "mixed", ended: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(session, pos, samples) of two sources' blocks (session, source, block, samples; block gives their order), by position, chunk samples a row.

    mixed: while running, up to the shorter source; at the end, to the longer, what is missing being 0; a session of which
    one source never came gives nothing. One source alone: its own samples times its gain, of the other nothing. Blocks are cut at the same
    places in both sources and meet by session and chunk, so a row is a chunk, not a sample."""
    names = ("microphone", "system")
    gain = lambda n: F.lit(float(gains.get(n, 1.0)))
    cut = sample_parts(blocks.select("session", "source", "block", "samples").filter(F.col("source").isin(*names)), ["session", "source"], ["block"], "samples", chunk)
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "samples"))), lambda x: x["samples"]))
    chunks = cut.groupBy("session", "source", "part").agg(whole.alias("samples"))
    place = (F.col("part") * chunk).alias("pos")
    if mode != "mixed":
        return chunks.filter(F.col("source") == mode).select("session", place, apply_gain(F.col("samples"), gain(mode)).alias("samples"))
    there = blocks.groupBy("session").agg(*[F.count_if(F.col("source") == n).alias(n) for n in names]).filter(" AND ".join(f"{n} > 0" for n in names)).select("session")
    both = chunks.groupBy("session", "part").agg(*[F.first(F.when(F.col("source") == n, F.col("samples")), ignorenulls=True).alias(n) for n in names]).join(there, "session", "left_semi")
    empty = F.expr("CAST(array() AS array<double>)")
    sides = [F.coalesce(F.col(n).cast("array<double>"), empty) for n in names]
    mixed = mix_mono(*sides, *map(gain, names))
    if not ended:
        mixed = F.slice(mixed, 1, F.least(*map(F.size, sides)))
    return both.select("session", place, mixed.alias("samples")).filter(F.size("samples") > 0)


def check_pending(blocks: DataFrame, limit: int = 10 * TARGET_RATE) -> DataFrame:
    """(session, source, pending): the samples of each source's blocks that wait for the other source; more than the limit is an error."""
    n = blocks.groupBy("session", "source").agg(F.sum(F.size("samples")).alias("n"))
    pending = n.withColumn("pending", F.col("n") - F.min("n").over(W.partitionBy("session")))
    return pending.filter(F.when(F.col("pending") <= limit, True).otherwise(F.raise_error("too much audio is pending").cast("boolean"))).drop("n")


def _islands(rows: DataFrame, keys: list[str], first: Column, last: Column, level: Column, gap: int) -> DataFrame:
    """(keys, __lo, __hi, peak): rows (from first to last place) of a key, joined where at most `gap` places lie between one's last and the next's first."""
    by = W.partitionBy(*keys).orderBy("__first")
    placed = rows.select(*keys, first.alias("__first"), last.alias("__last"), level.alias("__level"))
    new = F.coalesce((F.col("__first") - F.lag("__last").over(by) > gap).cast("int"), F.lit(1))
    numbered = placed.withColumn("__new", new).withColumn("__island", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("__first").alias("__lo"), (F.max("__last") + 1).alias("__hi"), F.max("__level").alias("peak")).drop("__island")


def threshold_segments(frames: DataFrame, key: str, position: str, level: str, threshold: float = 0.5, frame: int = FRAME,
                       min_speech_ms: int = 250, min_silence_ms: int = 500, max_segment_ms: int = 30_000, stride: int = STRIDE) -> DataFrame:
    """(key, start_sample, end_sample, peak): runs of frames whose level reaches a threshold, as [start, end) samples.

    An amplitude-threshold segmenter, not a speech model. Runs closer than the shortest silence are one; a segment shorter than the
    shortest speech is dropped; one longer than the longest is cut at that length (a short last cut stays).

    Levels that are single floats are compared with the threshold as one.

    Runs are told within stretches of `stride` positions, and joined at the stretches' edges, so that no task holds a long session."""
    per_ms = TARGET_RATE // 1000
    gap, least, most = (max(1, ms * per_ms // frame) for ms in (min_silence_ms, min_speech_ms, max_segment_ms))
    loud = frames.filter(F.col(level) >= _as_single(F.lit(float(threshold)), frames.schema[level].dataType)).withColumn("__stretch", _stretch(frames, position, stride))
    runs = _islands(loud, [key, "__stretch"], F.col(position), F.col(position), F.col(level), gap)
    # Only a stretch's first and last runs can go on in another: at most two rows a stretch meet by key.
    ends = W.partitionBy(key, "__stretch").orderBy("__lo")
    edge = (F.row_number().over(ends) == 1) | (F.lead("__lo").over(ends).isNull())
    told = runs.withColumn("__edge", edge)
    joined = _islands(told.filter("__edge"), [key], F.col("__lo"), F.col("__hi") - 1, F.col("peak"), gap)
    runs = told.filter("NOT __edge").select(key, "__lo", "__hi", "peak").unionByName(joined.select(key, "__lo", "__hi", "peak"))
    kept = runs.filter(F.col("__hi") - F.col("__lo") >= least)
    cuts = kept.withColumn("__at", F.explode(F.sequence(F.col("__lo").cast("long"), (F.col("__hi") - 1).cast("long"), F.lit(most).cast("long"))))
    return cuts.select(key, (F.col("__at") * frame).alias("start_sample"), (F.least(F.col("__at") + most, F.col("__hi")) * frame).cast("long").alias("end_sample"), "peak")


def frame_levels(blocks: DataFrame, key: str | list[str], order: list[str], samples: str, frame: int = FRAME) -> DataFrame:
    """(key, position, level): the largest absolute sample of each frame of a recording's blocks in order; a short last frame counts as it is.

    Blocks are cut at frames, so a frame is a maximum over the slices that touch it."""
    cut = sample_parts(blocks, key, order, samples, frame)
    peak = F.array_max(F.transform("samples", lambda x: F.abs(sanitize_sample(x))))
    level = _as_single(F.max(peak), blocks.schema[samples].dataType.elementType)
    return cut.groupBy(*_names(key), F.col("part").alias("position")).agg(level.alias("level"))


def drain_segments(segments: DataFrame, processed: Column) -> DataFrame:
    """Segments cut to the samples processed so far; what is empty then goes. Adds duration_ms."""
    end = F.least(F.col("end_sample"), processed)
    cut = segments.withColumn("end_sample", end).filter(F.col("end_sample") > F.col("start_sample"))
    return cut.withColumn("duration_ms", F.expr(f"(end_sample - start_sample) * 1000 div {TARGET_RATE}"))

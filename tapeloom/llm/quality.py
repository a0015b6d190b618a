"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, broadcast_if_few, mix64, stored, without
from .mixing import uniform

BUCKETS = 1 << 16
MAX_LABELS = 20_000
MARGIN = 5.0
PRIOR = 64.0
FALSE_MARKS = 0.5  # features expected to pass as marks by chance
TOXIC_ODDS, BAD_ODDS = 5.0, 3.0
SPARED = 0.002  # the share of labelled clean rows that may be told toxic, or good ones bad
FILTER_BITS = 20
COPY_HASHES = 4
REJECTS = 500_000
MARK_ROWS = 1000
# A feature is a run of letters and digits or a run of other marks (other ASCII controls count as marks), A-Z lower-cased.
PART = re.compile(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\x09-\x0d]+")


def hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the text's unigrams and bigrams."""
    parts = hashes.of(PART.findall(text.encode("utf-8", "surrogatepass").lower())) if text else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        pairs = mix64(parts[:-1] * np.uint64(0x9E3779B97F4A7C15) + parts[1:])
    return np.concatenate((parts, pairs))


def bucketed(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Buckets of the text's unigrams and bigrams."""
    return bucketed(hashed(text, hashes))


def shaped(found: np.ndarray) -> np.ndarray:
    """The features with 1, 2 and 3 added where at least 1/8, 1/4 and 1/2 of the text's parts repeat the part before."""
    parts = found[: (len(found) + 1) // 2]
    again = 8 * np.count_nonzero(parts[1:] == parts[:-1])
    return np.concatenate((found, np.arange(1, 1 + sum(again >= k * len(parts) > 0 for k in (1, 2, 4)), dtype=np.uint64)))


@dataclass
class Marks:
    """Features that mark one kind of text (sorted hashes) with their log odds."""

    hashes: np.ndarray
    odds: np.ndarray

    def filter(self) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[self.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
        return table

    def of(self, found: np.ndarray, table: np.ndarray) -> float:
        """The summed log odds of the marks among a text's features, each once."""
        maybe = np.unique(found[table[found & np.uint64((1 << FILTER_BITS) - 1)]])
        if not len(maybe):
            return 0.0
        place = np.minimum(np.searchsorted(self.hashes, maybe), len(self.hashes) - 1)
        return float(self.odds[place[self.hashes[place] == maybe]].sum())


def _counts(told, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Feature counts of all rows and of the target's labelled rows, once for each task."""
        target, hashes = told.value, WordHashes()
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for doc, text in zip(batch.column(id_col).to_pylist(), batch.column(text_col), strict=True):
                found = features(text.as_py(), hashes)
                np.add.at(raw, found, 1)
                if doc in target:
                    np.add.at(good, found, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], good[at])], ["bucket", "raw", "good"])

    return run


def copies_key(found: np.ndarray) -> int:
    """A key of the least hashes of a text's bigrams (of its parts, if it has one) under COPY_HASHES permutations: near copies mostly share it, others seldom do."""
    parts = (len(found) + 1) // 2
    pairs = found[parts:] if len(found) > 1 else found
    if not len(pairs):
        return 0
    least = [int(mix64(pairs + np.uint64(n)).min()) for n in range(COPY_HASHES)]
    return int(mix64(np.array([sum(least) % 2**64], np.uint64))[0].astype(np.int64))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys = [copies_key(hashed(t.as_py(), hashes)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "copies"])


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of either kind have each feature; a null feature counts the rows themselves. MARK_ROWS rows at a time."""
    hashes = WordHashes()
    for batch in (b.slice(at, MARK_ROWS) for b in batches for at in range(0, b.num_rows, MARK_ROWS)):
        held, rows = ([], []), [0, 0]
        for text, side in zip(batch.column("text"), batch.column("other").to_pylist(), strict=True):
            held[side].append(np.unique(shaped(hashed(text.as_py(), hashes))))
            rows[side] += 1
        if not sum(rows):
            continue
        known, place = np.unique(np.concatenate([*held[0], *held[1]]), return_inverse=True)
        first = sum(map(len, held[0]))
        counts = [np.append(np.bincount(x, minlength=len(known)), n).astype(np.int64) for x, n in zip((place[:first], place[first:]), rows, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([*known.view(np.int64).tolist(), None], pa.int64()), *map(pa.array, counts)], ["feature", "one", "other"])


def _mark_scores(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, marks = WordHashes(), [(m, m.filter()) for m in told.value]
        for batch in batches:
            shapes = [shaped(hashed(t.as_py(), hashes)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("kinds"), *(pa.array([m.of(x, table) for x in shapes], pa.float64()) for m, table in marks)], ["kinds", "toxic", "bad"])

    return run


def _scores(told, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ratio, marks, least), hashes = told.value, WordHashes()
        marks = [(m, m.filter(), n) for m, n in zip(marks, least, strict=True)]
        for batch in batches:
            found = []
            for text in batch.column(text_col):
                of = hashed(text.as_py(), hashes)
                shape = shaped(of)
                found.append(-np.inf if any(m.of(shape, table) >= least for m, table, least in marks) else round(float(ratio[bucketed(of)].sum()), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "log_ratio"])

    return run


def target_ids(labels: DataFrame, most: int, id_col: str = "doc_id") -> list[int]:
    """Ids that a label calls good and none calls toxic, at most `most` of them (the smallest hashes, so any input gives an even sample)."""
    return _labelled(_by_id(labels, id_col).filter((F.col("good") == 1) & ~F.col("toxic")), most)


def _by_id(labels: DataFrame, id_col: str) -> DataFrame:
    """For each id: does a label call it good, does one call it bad, does one call it toxic, is either said of toxicity."""
    toxic = F.col("toxic") if "toxic" in (c.lower() for c in labels.columns) else F.lit(None).cast("int")
    told = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), "quality", toxic.alias("toxic"))
    good = F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")
    return told.groupBy("doc_id").agg(good, F.coalesce(F.max(F.col("quality") == 0), F.lit(False)).alias("bad"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"), (F.count("toxic") > 0).alias("said"))


def _labelled(ids: DataFrame, most: int) -> list[int]:
    return [r[0] for r in ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def labelled_rows(slim: DataFrame, told: DataFrame, most: int) -> DataFrame:
    """doc_id, text, kinds (of toxic, clean, bad and good) and copies of the labelled rows: those of at most `most` ids of each kind (the smallest hashes)."""
    kinds = {"toxic": "said AND toxic", "clean": "said AND NOT toxic", "bad": "bad AND good = 0", "good": "good = 1"}
    picked = None
    for name, rule in kinds.items():
        ids = told.filter(rule).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(name).alias("kind"))
        picked = ids if picked is None else picked.unionByName(ids)
    picked = stored(picked.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "quality-picked")
    rows = slim.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "kinds")  # at most 4 * most ids
    return stored(rows.mapInArrow(_copies, "doc_id long, text string, kinds array<string>, copies long"), "quality-labelled")


def marks_of(rows: DataFrame, one: str, other: str) -> Marks:
    """Features that labelled rows of kind `one` have more often than those of kind `other`, beyond chance.

    One row of each group of copies counts, as copies are no evidence of their own. Rows are counted, not uses, and hashes are whole, as a few rare words
    make a text toxic. A feature is a mark if the Chernoff bound of its count's chance, were both kinds alike, times the number of features
    in two rows of `one` or more is at most FALSE_MARKS: what marks must show is the same for any number of labels. Where a kind is empty there are no marks."""
    apart = lambda kind: rows.filter(F.array_contains("kinds", kind)).groupBy("copies").agg(F.min("text").alias("text"))
    both = apart(one).select("text", F.lit(False).alias("other")).unionByName(apart(other).select("text", F.lit(True).alias("other")))
    none = Marks(np.zeros(0, np.uint64), np.zeros(0))
    counts = both.mapInArrow(_mark_counts, "feature long, one long, other long")
    counts = stored(counts.groupBy("feature").agg(F.sum("one").alias("one"), F.sum("other").alias("other")).filter("one > 1 OR feature IS NULL"), "quality-marks")
    total = counts.filter("feature IS NULL").first()
    tested = counts.filter("feature IS NOT NULL")
    if total is None or not total["one"] or not total["other"]:
        return none
    alike = total["one"] / (total["one"] + total["other"])
    n, share = F.col("one") + F.col("other"), F.col("one") / (F.col("one") + F.col("other"))
    rest = F.when(F.col("other") > 0, (1 - share) * F.log((1 - share) / (1 - alike))).otherwise(0.0)
    sure = (share > alike) & (n * (share * F.log(share / alike) + rest) >= float(np.log(max(tested.count(), 1) / FALSE_MARKS)))
    found = tested.filter(sure).collect()  # from at most MAX_LABELS ids of each kind
    hashes = np.array([r["feature"] for r in found], np.int64).view(np.uint64)
    has, lacks = (np.array([r[c] for r in found], np.float64) for c in ("one", "other"))
    odds = np.log((has + 0.5) / (total["one"] + 1)) - np.log((lacks + 0.5) / (total["other"] + 1))
    order = np.argsort(hashes)
    return Marks(hashes[order], odds[order])


def least_odds(rows: DataFrame, marks: tuple[Marks, Marks]) -> tuple[float, float]:
    """What the marks' odds must reach: TOXIC_ODDS and BAD_ODDS, or more where over SPARED of the labelled clean (or good) rows would reach that."""
    scores = rows.mapInArrow(_mark_scores(rows.sparkSession.sparkContext.broadcast(marks)), "kinds array<string>, toxic double, bad double")
    high = lambda c, kind: F.percentile(F.when(F.array_contains("kinds", kind), F.col(c)), F.lit(1 - SPARED))
    toxic, bad = scores.agg(high("toxic", "clean"), high("bad", "good")).first()
    return tuple(max(least, (most or 0.0) + 1e-6) for least, most in ((TOXIC_ODDS, toxic), (BAD_ODDS, bad)))


def bucket_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket. The target's prior is PRIOR times BUCKETS features spread as raw's are, so
    where few labels are known the models agree; half the relative variance of the target's count makes up for the bias of its log."""
    if not good.sum():
        return np.zeros(BUCKETS)
    share = (raw + 1) / (raw.sum() + BUCKETS)
    told = good + PRIOR * BUCKETS * share
    return np.log(told / told.sum()) - np.log(share) + good / (2 * told**2)


def log_ratios(df: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with log_ratio: log of the target model's over the raw model's probability of the row's features.

    Both are bags of unigrams and bigrams in BUCKETS buckets (see bucket_ratios): raw over all rows of df, target over
    those of at most max_labels ids that labels call good and not toxic. Texts without features: 0. Without any good label the models
    are equal: all 0. Texts that the labels' own models call toxic or bad (the odds of
    marks_of toxic against clean, or of bad against good, reach least_odds) have a probability of 0: -infinity. So have rows whose own label calls
    them toxic, or bad and never good: all labels are asked for that, however many; up to REJECTS of them are sent to every task, more are joined by id."""
    spark = df.sparkSession
    df = without(df, "log_ratio")
    ids = frozenset(target_ids(labels, max_labels))
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = slim.mapInArrow(_counts(spark.sparkContext.broadcast(ids), "doc_id", "text"), "bucket long, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    ratio = bucket_ratios(raw, good)
    rows = labelled_rows(slim, _by_id(labels, "doc_id"), max_labels)
    marks = marks_of(rows, "toxic", "clean"), marks_of(rows, "bad", "good")
    told = (ratio, marks, least_odds(rows, marks))
    scored = df.mapInArrow(_scores(spark.sparkContext.broadcast(told), text_col), T.StructType([*df.schema.fields, T.StructField("log_ratio", T.DoubleType())]))
    rejected = _by_id(labels, "doc_id").filter("toxic OR bad AND good = 0").select(F.col("doc_id").alias("__rejected"))
    own = F.col(f"`{id_col}`").cast("long") == F.col("__rejected")
    judged = scored.join(broadcast_if_few(stored(rejected, "quality-rejected"), REJECTS), own, "left")
    return judged.withColumn("log_ratio", F.when(F.col("__rejected").isNotNull(), float("-inf")).otherwise(F.col("log_ratio"))).drop("__rejected")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest non-null value of a double column, by histograms of ever narrower ranges; None if there are fewer."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        inside = df.filter(F.col(column).between(lo, hi))
        step = (hi - lo) / bins
        if step == 0 or lo + step == lo:  # neighbouring numbers
            found = sorted(inside.groupBy(column).count().collect(), reverse=True)
        else:
            place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(step)).cast("long"))
            found = sorted(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for row in found:
            if row["n" if "n" in row.asDict() else "count"] >= k:
                break
            k -= row["n" if "n" in row.asDict() else "count"]
        lo, hi = (row["lo"], row["hi"]) if "lo" in row.asDict() else (row[0], row[0])
    return lo


def gumbel_key(log_ratio, id_col, seed: int):
    return log_ratio - F.log(-F.log(uniform(id_col, seed)))


def _drawn(scored: DataFrame, size: int | None, margin: float, seed: int, id_col: str, name: str) -> DataFrame:
    """The rows of scored whose key is among the `size` largest. Scores are stored once; the threshold and the rows both come from there."""
    keyed = stored(scored.withColumn("sample_key", gumbel_key(F.col("log_ratio"), F.col(f"`{id_col}`"), seed)), name)
    possible = F.col("log_ratio") > float("-inf")
    keys = keyed.select("log_ratio", "sample_key").filter(possible)
    if size is None:
        size = keys.filter(F.col("log_ratio") >= -margin).count()
    last = kth_largest(keys, "sample_key", size)
    if last is None:
        return keyed.filter(possible if size > 0 else F.lit(False))
    return keyed.filter(possible & (F.col("sample_key") >= F.lit(last)))


def drawn_keys(df: DataFrame, labels: DataFrame, size: int | None = None, margin: float = MARGIN, seed: int = 7, max_labels: int = MAX_LABELS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_ratio and sample_key of the rows that importance_resample draws, without their texts."""
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _drawn(log_ratios(slim, labels, max_labels).drop("text"), size, margin, seed, "doc_id", "quality-keys")


def importance_resample(df: DataFrame, labels: DataFrame, size: int | None = None, margin: float = MARGIN, seed: int = 7, max_labels: int = MAX_LABELS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that importance resampling draws, with log_ratio and sample_key added.

    Each row's key is its log importance weight (see log_ratios) plus Gumbel noise that depends on seed and id only; the rows
    with the `size` largest keys are drawn, which is sampling without replacement by weight. size None: as many as there are rows
    whose log_ratio is at least -margin, so that what the target could well have written stays and the rest is
    rejected. Texts that log_ratios calls toxic or bad are never drawn. Rows that tie at the last key are all drawn, and so are repeated rows; a null id
    has noise of its own, which all null ids share; null and empty texts have log_ratio 0, very long ones are read whole; size above the
    number of rows draws all others; empty df: no rows. Columns named log_ratio or sample_key are replaced.

    Rows are stored with their scores, so no text is scored twice; the threshold comes from histograms over the keys there, without a shuffle.
    """
    return _drawn(log_ratios(without(df, "sample_key"), labels, max_labels, id_col, text_col), size, margin, seed, id_col, "quality-scored")

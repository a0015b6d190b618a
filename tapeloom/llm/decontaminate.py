"""Benchmark decontamination: n-gram seeds of test items find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, shingle_hashes, stored

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6
#: Items of fewer words are found in texts that have nothing to do with them; they are told, but drop nothing.
LEAST_WORDS = 4
BLOCK_BYTES = 4_000_000
MEMO = 5_000


def seed_words(m: int) -> int:
    """How many words a seed of an item of m words has.

    Each word replaced costs 3 of an item's 2m points, so at MIN_SCORE at most 0.267 m are; of the others at least so many stand in a row."""
    return 3 if m > 10 else min(2, m)


# A-Z become a-z; other ASCII but letters and digits separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def passage_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of two word sequences and the end of the best one in b (linear gaps).

    A row's gaps from the left are a running maximum, so each row is a few vector operations."""
    steps = -GAP * np.arange(1, len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        t = np.maximum(np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.concatenate(([0], np.maximum.accumulate(t + steps) - steps))
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


@dataclass
class Items:
    """A block of test items ready for search; seeds: for each seed length, hash -> (item's place, offset)."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: dict[int, dict[int, list[tuple[int, int]]]]

    @classmethod
    def of(cls, rows: list[tuple[int, str]], least: int = 1) -> Items:
        """least: items of fewer words are left out."""
        hashes = WordHashes()
        out = cls([], [], {})
        for item, text in rows:
            words = hashes.of(passage_words(text))
            if len(words) >= least:
                n = seed_words(len(words))
                seeds = out.seeds.setdefault(n, defaultdict(list))
                for offset, seed in enumerate(shingle_hashes(words, n).tolist()):
                    seeds[seed].append((len(out.ids), offset))
                out.ids.append(item)
                out.words.append(words)
        return out

    def filters(self) -> dict[int, np.ndarray]:
        """For each seed length a table of hash ends, 16 to 32 places a seed; few words of a text pass it by chance."""
        out = {}
        for n, seeds in self.seeds.items():
            out[n] = np.zeros(1 << (16 * len(seeds)).bit_length(), bool)
            out[n][np.fromiter(seeds, np.uint64, len(seeds)) & np.uint64(len(out[n]) - 1)] = True
        return out


def find_regions(items: Items, filters: dict[int, np.ndarray], words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each item with a seed in the text, where its passages may lie: around each seed as much as gaps may add; overlapping ones are one."""
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n, table in filters.items():
        if len(words) < n:
            continue
        grams = shingle_hashes(words, n)
        for at in np.flatnonzero(table[grams & np.uint64(len(table) - 1)]).tolist():
            for item, offset in items.seeds[n].get(int(grams[at]), ()):
                m = len(items.words[item])
                more = int((1 - MIN_SCORE) * MATCH * m) + 1
                found[item].append((max(0, at - offset - more), min(len(words), at - offset + m + more)))
    out = {}
    for item, spans in found.items():
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(hi, merged[-1][1])
            else:
                merged.append((lo, hi))
        out[item] = merged
    return out


def find_leaks(items: Items, filters: dict[int, np.ndarray], words: np.ndarray, min_score: float, memo: dict) -> list[tuple[int, float, int, int, bool]]:
    """(item id, score, first word, end, whether the item is short) of the best passage of each item whose alignment reaches min_score of the item's own; of equal ones the first.

    A region with fewer of the item's words than the score needs matches isn't aligned."""
    out = []
    for item, spans in find_regions(items, filters, words).items():
        own, best = items.words[item], (0.0, 0, 0)
        known = np.unique(own)
        for lo, hi in spans:
            region = words[lo:hi]
            place = np.minimum(np.searchsorted(known, region), len(known) - 1)
            if np.count_nonzero(known[place] == region) < min_score * len(own):
                continue
            key = (item, region.tobytes())
            if key not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                score, end = smith_waterman(own, region)
                # The same alignment read backwards ends where this one begins.
                back = smith_waterman(own[::-1], region[:end][::-1])[1] if score >= min_score * MATCH * len(own) else 0
                memo[key] = score, end - back, end
            score, first, end = memo[key]
            best = max(best, (score / (MATCH * len(own)), -(lo + first), lo + end))
        if best[0] >= min_score:
            out.append((items.ids[item], best[0], -best[1], best[2], len(own) < LEAST_WORDS))
    return out


def _leaks(told, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes, memo = told.value, WordHashes(), {}
        filters = items.filters()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = hashes.of(passage_words(text.as_py()))
                rows += [(doc.as_py(), *x) for x in find_leaks(items, filters, words, min_score, memo)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word", "short"])

    return run


def _clean(told, min_score: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes, memo = told.value, WordHashes(), {}
        filters = items.filters()
        for batch in batches:
            keep = [not find_leaks(items, filters, hashes.of(passage_words(text.as_py())), min_score, memo) for text in batch.column(text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, least: int = 1) -> tuple[int, Iterator[Items]]:
    """How many blocks of about block_bytes of text the items make, and the blocks, each read when it is asked for.

    Items with equal text are one (the least id). A block's size is bounded, so one at a time may visit the driver and be broadcast;
    all seeds of an item are looked up, however many items share one."""
    items = benchmark.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(F.col(item_col).cast("long")).alias("item_id"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    dealt = stored(items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, n)))), "benchmark-items")
    return n, (Items.of([(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == b).sort("item_id", "text").collect()], least) for b in range(n))


LEAK_SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long, short boolean"


def benchmark_leaks(df: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word and short for each document and test item that it holds, whole, edited or paraphrased.

    The items' seeds (seed_words in a row) are looked up in every document; around the hits the item is aligned with the
    document's words by Smith-Waterman, and the score is a share of the item's score against itself. With words only replaced, none that
    reaches MIN_SCORE is missed; with words added between others, one is if no seed stays in a row. Words are
    split at everything but letters and digits, A-Z lower-cased. Null and empty texts give no rows, nor do items without words;
    repeated rows of df each give their rows, and a null id is told as null; of items with equal text the least id is named; of equally good
    passages of an item the first. An empty benchmark gives no rows. short: the item has fewer than LEAST_WORDS words, so that finding it says little; drop_contaminated leaves such
    items aside (short_items counts them).

    One pass over df for each block of items (see item_blocks), without a shuffle of documents; with several blocks each pass's
    rows are stored before the next block is read.
    """
    spark, docs = df.sparkSession, df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n, blocks = item_blocks(benchmark, block_bytes=block_bytes)
    out = spark.createDataFrame([], LEAK_SCHEMA)
    for block in blocks:
        told = spark.sparkContext.broadcast(block)
        found = docs.mapInArrow(_leaks(told, min_score), LEAK_SCHEMA)
        if n == 1:
            return found
        out = out.unionByName(stored(found, "leaks"))
        told.unpersist()
    return out


def short_items(benchmark: DataFrame, text_col: str = "text") -> int:
    """How many items of the benchmark have a word, but fewer than LEAST_WORDS."""
    n = F.size(F.filter(F.split(F.regexp_replace(text_col, r"[\x00-\x7F&&[^0-9A-Za-z]]", " "), " "), lambda w: w != ""))
    return benchmark.filter(n.between(1, LEAST_WORDS - 1)).count()


def drop_contaminated(df: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df without the rows that hold a test item of LEAST_WORDS words or more (see benchmark_leaks); the rest, null texts included, stays as it is."""
    n, blocks = item_blocks(benchmark, block_bytes=block_bytes, least=LEAST_WORDS)
    if n == 1:
        return df.mapInArrow(_clean(df.sparkSession.sparkContext.broadcast(next(blocks)), min_score, text_col), df.schema)
    if not n:
        return df
    numbered = stored(df.withColumn("__row", F.monotonically_increasing_id()), "clean-rows")
    found = benchmark_leaks(numbered, benchmark, min_score, "__row", text_col, block_bytes).filter("NOT short").select(F.col("doc_id").alias("__row")).distinct()
    return numbered.join(found, "__row", "left_anti").select(*df.columns)

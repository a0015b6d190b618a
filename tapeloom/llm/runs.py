"""Periodic stretches of words: all runs of each text by the runs theorem."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are worked on together (a longer text is worked on alone). A word takes some 60 bytes, 400 where its text may hold a run.
BLOCK_WORDS = 200_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Numbers(dict):
    """A number from 1 for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) + 1
        return found


def suffix_ranks(symbols: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """The inverse suffix array by prefix doubling: only suffixes that still tie are sorted again.

    Each text must end in a symbol that occurs nowhere else, so no two suffixes tie for good and no tied prefix leaves its text. levels
    receives the ranks by 1, 2, 4, ... symbols; two are equal exactly where so many symbols are."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    keys = symbols[order]
    rank, base, step = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    while len(order):
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(new, len(keys)))
        # A group's rank: where its old group begins, and how many of the old group come before it.
        rank[order] = np.repeat(base[new] + new, sizes)
        if levels is not None:
            levels.append(rank.astype(np.int32))
        order = order[np.repeat(sizes, sizes) > 1]
        step = step * 2 or 1
        keys = rank[order] << 32 | rank[order + step]
        at = np.argsort(keys, kind="stable")
        order, keys = order[at], keys[at]
        old = keys >> 32
        first = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1]))) if len(old) else old
        base = old - np.repeat(first, np.diff(np.append(first, len(old)))) if len(old) else old
    return rank


def window_minima(values: np.ndarray, most: int) -> list[np.ndarray]:
    """A sparse table: the minima of all windows of 1, 2, 4, ... up to most values."""
    table = [values]
    while 2 << len(table) - 1 <= min(most, len(values)):
        half = len(table[-1]) - (1 << len(table) - 1)
        table.append(np.minimum(table[-1][:half], table[-1][-half:]))
    return table


def next_smaller(values: np.ndarray, most: int) -> np.ndarray:
    """For each place the next one, at most `most` further on, of a smaller value; len(values) or a farther place where there is none.

    Most are found at once among the next few; the rest leap over windows whose minima are no smaller."""
    n = len(values)
    found, left = np.full(n, n, np.int64), np.arange(n)
    for step in range(1, 9):
        left = left[left + step < n]
        hit = values[left + step] < values[left]
        found[left[hit]] = left[hit] + step
        left = left[~hit]
    at, mine = left + 9, values[left]
    for k, minima in reversed(list(enumerate(window_minima(values, most)))):
        fits = at < len(minima)
        fits[fits] = minima[at[fits]] >= mine[fits]
        at = at + (fits.astype(np.int64) << k)
    found[left] = np.minimum(at, n)
    return found


class CommonPrefixes:
    """Lengths of common prefixes of any two suffixes: the least of the LCP array between their ranks, by a sparse table."""

    def __init__(self, symbols: np.ndarray):
        levels: list[np.ndarray] = []
        self.rank = suffix_ranks(symbols, levels)
        order = np.empty(len(symbols), np.int64)
        order[self.rank] = np.arange(len(symbols))
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(len(a), np.int32)
        for k in reversed(range(len(levels))):
            same = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a, b, lcp = a + same, b + same, lcp + same.astype(np.int32)
            levels.pop()
        self.table = window_minima(lcp, len(lcp))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a and b: places that differ."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        level = np.log2(hi - lo).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << k)])
        return out


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the texts in a row, each with an end symbol that sorts before its words; where each begins; its words)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << 32, sizes + 1)
    keep = np.ones(len(row), bool)
    keep[begins + sizes] = False
    row[keep] += np.concatenate([*texts, np.zeros(0, np.int64)])
    return row, begins, sizes


def _roots(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, place after) of the longest Lyndon words, in either order of words, that may be the first root of a run.

    The longest Lyndon word at a place ends before the next suffix that is smaller: before the next smaller value of the inverse suffix
    array, and in the reverse order before the next larger. A run of `times` periods goes on for at least times - 2 periods after its first root, so
    roots that fewer words follow, or whose first words differ from the next, are left out here."""
    rank, most = suffix_ranks(symbols).astype(np.int32), int(sizes.max(initial=0)) + 1
    text, ends = np.repeat(np.arange(len(sizes)), sizes + 1), begins + sizes
    out = []
    for values in (rank, -rank):
        place = np.arange(len(rank))
        after = next_smaller(values, most)
        goes_on = (times - 2) * (after - place) + 1
        fit = after + goes_on <= ends[text]
        place, after, goes_on = place[fit], after[fit], goes_on[fit]
        for step in range(4):
            same = step >= goes_on
            same[~same] = symbols[place[~same] + step] == symbols[after[~same] + step]
            place, after, goes_on = place[same], after[same], goes_on[same]
        out.append((text[place], place - begins[text[place]], after - begins[text[place]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def find_runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """For each text of word numbers (from 1) its runs: rows of start, length, smallest period, ordered by start and period.

    Runs have at least `least` words and `times` (2 or more) periods. By the runs theorem each run has a root that is the longest Lyndon word at its
    place in one of two orders; common prefixes (to the right, and to the left in the reversed texts) extend the roots to runs."""
    found = [np.zeros((0, 3), np.int64)] * len(texts)
    text, place, after = _roots(*_laid_out(texts), times)
    if not len(text):
        return found
    some, text = np.unique(text, return_inverse=True)
    symbols, begins, sizes = _laid_out([texts[i] for i in some])
    right = CommonPrefixes(symbols).of(begins[text] + place, begins[text] + after)
    symbols = _laid_out([texts[i][::-1] for i in some])[0]
    end = begins[text] + sizes[text]
    left = CommonPrefixes(symbols).of(end - place, end - after)
    period = after - place
    runs = np.column_stack((text, place - left, period, left + period + right))
    runs = np.unique(runs[runs[:, 3] >= np.maximum(least, times * period)], axis=0)
    for i, cut in zip(some, np.split(runs, np.searchsorted(runs[:, 0], np.arange(1, len(some)))), strict=True):
        found[i] = cut[:, [1, 3, 2]]
    return found


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0)]
    return b" ".join(words).decode()


def _find(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                begin, words, held = at, [], 0
                while at < batch.num_rows and (not words or held < BLOCK_WORDS):
                    words.append((texts[at].as_py() or "").encode().split())
                    held += len(words[-1])
                    at += 1
                numbers = Numbers()
                runs = find_runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words], least, times)
                told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in runs]
                columns = [ids.slice(begin, at - begin), pa.array([len(w) for w in words], pa.int64()), pa.array(told, RUN), pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(df: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array<struct<start, length, period>> in words, by start and period) and collapsed (the text without repetition) for each row of df.

    Words are what lies between ASCII white space. A run is a stretch of words with smallest period q, of at least `least` words and
    `times` * q, that no neighbouring word extends keeping that period. Collapsing drops each word that any run contains after its first q; the rest are
    joined by single spaces. Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or repeat: each row is judged
    alone. Empty df: no rows. Other columns are not read.

    Nothing is exchanged: texts are worked on where they are read, some hundred thousand words together and a longer text alone and whole. The work is
    n log n in a text's words, however periodic it is, and so is the memory."""
    if times < 2:
        raise ValueError("a run has at least two periods")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find(least, times), SCHEMA)

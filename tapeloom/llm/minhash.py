"""Near-duplicate groups by min-max hashing, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, mix64, shingle_hashes, stored, word_hashes, words_of
from .components import components

PERMUTATIONS = 64
MISS = 1e-6
SMALL = 32
BLOCK_SHINGLES = 100_000
COLUMNS = 4096


def bands_for(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands of a signature that still miss a pair at the threshold with at most this probability."""
    rows = max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (values // r) <= miss)
    return rows, values // rows


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PERMUTATIONS, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text)), words))


def set_key(found: np.ndarray) -> bytes:
    """128 bits that stand for the whole set: documents with equal sets are one node."""
    return xxhash.xxh3_128_digest(found.tobytes())


def band_hashes(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """A row of band hashes for each non-empty set. Both the least and the largest value under each permutation
    go in the signature, so 2 * PERMUTATIONS values cost PERMUTATIONS hash evaluations a shingle."""
    a, b = _constants()
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    signature = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(PERMUTATIONS):
            value = flat * a[j] + b[j]
            signature[:, 2 * j] = np.minimum.reduceat(value, starts)
            signature[:, 2 * j + 1] = np.maximum.reduceat(value, starts)
        out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
        for r in range(rows):
            out = mix64(out + signature[:, : rows * bands].reshape(len(sets), bands, rows)[:, :, r])
    return out.view(np.int64)


def _sign(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                sets, held, end = [], 0, at
                while end < batch.num_rows and held < 60_000:  # what fits a core's cache
                    sets.append(shingle_set(texts[end].as_py(), words))
                    held += len(sets[-1])
                    end += 1
                full = [s for s in sets if len(s)]
                hashed = iter(band_hashes(full, rows, bands)) if full else iter(())
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, end - at),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(hashed) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "node", "n_shingles", "bands"])
                at = end

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of two blocks: only shingles of both sides count, in slices of COLUMNS."""
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    if len(both):
        at = [np.minimum(np.searchsorted(both, f), len(both) - 1) for f in flat]
        hit = [both[a] == f for a, f in zip(at, flat, strict=True)]
        at, rows = [a[h] for a, h in zip(at, hit, strict=True)], [r[h] for r, h in zip(rows, hit, strict=True)]
        for lo in range(0, len(both), COLUMNS):
            dense = []
            for side, a, r in zip((left, right), at, rows, strict=True):
                own = (a >= lo) & (a < lo + COLUMNS)
                m = np.zeros((len(side), min(COLUMNS, len(both) - lo)), np.float32)
                m[r[own], a[own] - lo] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
    return out


def _block_links(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links between the two blocks of a pair (a block with itself too)."""
        keys, roots = list(pdf["node"]), list(pdf["root"])
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        sides = [np.flatnonzero(pdf["block"].to_numpy() == b) for b in (pdf["one"].iat[0], pdf["two"].iat[0])]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"u": [], "v": []})
        common = common_counts([sets[i] for i in sides[0]], [sets[i] for i in sides[1]])
        size = np.array([len(s) for s in sets], np.float32)
        linked = den * common >= num * (size[sides[0]][:, None] + size[sides[1]][None, :] - common)
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            i, j = sides[0][i], sides[1][j]
            p, q = top(roots[i]), top(roots[j])
            if p != q:
                parent[p] = q
                out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def near_duplicates(df: DataFrame, num: int = 85, den: int = 100, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df: documents are linked where den * intersection >= num * union of their shingle sets.

    Words are split at ASCII white space with A-Z lower-cased; a text of fewer words is one shingle; a text without words
    (or null) has none and links with nothing. component_id is the least id reached; kept: it is the row's own. Rows with equal
    ids and equal sets are copies of each other (each is returned); a null id is never linked: component_id null, kept true.
    Only id_col and text_col of df are read; empty df: no rows.

    1. One pass signs each text by min-max hashing; equal sets become one node (copies are never paired).
    2. Nodes that share a band hash are candidates. In buckets of at most SMALL nodes all pairs of fitting sizes are; in larger ones each
       node and the bucket's least node are. Pairs are confirmed on whole sets.
    3. Large buckets whose nodes are not yet one component are dealt into blocks of about BLOCK_SHINGLES; pairs of blocks are compared
       whole, and each gives a spanning forest of its links only. So no link between nodes sharing a bucket is lost, none is
       expanded into pairs of copies, and no bucket meets in one task. A pair at the threshold shares no band with probability MISS.
    """
    rows, bands = bands_for(num / den)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(_sign(words, rows, bands), "doc_id long, node binary, n_shingles long, bands array<long>"), "minhash-signed")
    named = signed.filter("doc_id IS NOT NULL AND node IS NOT NULL")
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("least"))
    member = named.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), F.min("node").alias("centre"), F.min("n").alias("least_n"), F.max("n").alias("most_n")).filter("size > 1")
    shared = stored(member.join(buckets, "bucket").filter((F.col("size") > 2) | (F.col("least_n") * den >= F.col("most_n") * num)), "minhash-shared")
    small = shared.filter(F.col("size") <= SMALL).select("bucket", "node", "n")
    fits = F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    large = shared.filter(F.col("size") > SMALL)
    spokes = large.filter("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    pairs = stored(pairs.unionByName(spokes).distinct(), "minhash-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(large.select("node")).distinct()
    # The whole text of one document of each node wanted; a repeated id may bring other texts, which the node's key sorts out.
    chosen = wanted.join(nodes, "node").select("node", F.col("least").alias("doc_id"))
    chosen = stored(chosen.select("doc_id").distinct(), "minhash-chosen")
    texts = docs.join(broadcast_if_few(chosen, 500_000), "doc_id", "left_semi").select("text")
    sets = stored(texts.mapInArrow(_sets(words), "node binary, shingles binary").dropDuplicates(["node"]), "minhash-sets")
    x, y = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    links = stored(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_confirm(num, den), "u binary, v binary"), "minhash-links")
    roots = components(links)
    if not large.isEmpty():
        placed = large.select("bucket", "node", "held").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
        blocks = F.ceil(F.col("held") / BLOCK_SHINGLES).cast("long")
        dealt = placed.join(open_, "bucket").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks)})
        # A block meets each block once: as the first of the pair with those from its own number on, as the second with those before.
        partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
        met = dealt.select("bucket", "block", "node", "root", partner).select("bucket", "block", "node", "root", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))
        more = met.join(sets, "node").groupBy("bucket", "one", "two").applyInPandas(_block_links(num, den), "u binary, v binary")
        again = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(again.unionByName(more))
    group = named.select("doc_id", "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    least = group.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = group.select("node", "root").distinct().join(least, "root").select("node", "component_id")
    out = signed.join(label, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, num: int = 80, den: int = 100, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without all but one row, that of the least id, of each near-duplicate group.

    Rows are told apart by a number of their own, so of rows that repeat an id each is judged by its own text; a null id comes
    after all others, and may be linked and dropped. Of equal rows one stays. Texts without words are in no group: all stay."""
    numbered = stored(df.withColumn("__row", F.monotonically_increasing_id()), "minhash-rows")
    groups = near_duplicates(numbered, num, den, words, "__row", text_col)
    by_id = groups.withColumnRenamed("doc_id", "__row").join(numbered.select("__row", F.col(f"`{id_col}`").alias("__id")), "__row")
    first = by_id.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), F.col("__id"), F.col("__row").alias("row"))).alias("first"))
    gone = by_id.filter("n_shingles > 0").join(first.select("component_id", F.col("first.row").alias("stays")), "component_id").filter("__row != stays").select("__row")
    return numbered.join(broadcast_if_few(stored(gone, "minhash-gone"), 500_000), "__row", "left_anti").select(*df.columns)

"""Repeated-substring removal: suffixes at content-defined anchors are sorted with their common prefixes, and induced leftwards.

This isn't a suffix array of the corpus: that would move some 13 bytes for each text byte. In any `length` bytes the least K-byte hash is at the
same offset wherever these bytes occur; its place, the anchor, stands for all strings of `length` bytes that hold it. Anchors that occur once are
done with. Of the others, those whose whole surroundings are copies are settled by 128 bits of two hashes. The suffixes at
what is left are sorted by Spark's disk-backed sorter; their common prefixes are carried as the suffixes that begin a byte earlier are
induced from them, byte by byte, up to `length` bytes, so bytes are compared there, not hashes, and no recursion is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, without
from .sharding import shard_by_bytes

K = 32
PIECE = 1 << 18
CROWD = 1000
POS_BITS = np.uint64(24)
_rng = np.random.default_rng(77)
TABLES = _rng.integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """64-bit hashes of any run of bytes of a buffer: differences of prefix sums, brought to the same power."""

    scale: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int) -> None:
        if which not in self.scale or len(self.scale[which][0]) < len(data) + 1:
            n = 1 << (len(data) + 1).bit_length()
            self.scale[which] = _powers(BASES[which], n), _powers(pow(BASES[which], -1, 1 << 64), n)
        up, self.down = self.scale[which]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLES[which][data] * up[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


class Piece:
    """A buffer of whole documents, or a part of a long one with its surroundings.

    docs: rows of the batch; base: where in its document the buffer's part begins; edges: the documents' bounds in the buffer."""

    def __init__(self, data: bytes, docs: list[int], sizes: list[int], base: int, window: tuple[int, int] | None, length: int) -> None:
        self.data, self.docs, self.base, self.length = np.frombuffer(data, np.uint8), docs, base, length
        self.bounds = np.cumsum([0, *sizes])
        n = len(data) - length + 1
        self.starts = self.anchor = np.zeros(0, np.int64)
        self.roll: Rolling | None = None
        if n <= 0:
            return
        self.roll = Rolling(self.data, 0)
        keys = self.roll.every(K)
        self.gram = keys
        keys = (keys >> POS_BITS << POS_BITS) | np.arange(len(keys), dtype=np.uint64)
        least = sliding_min(keys, length - K + 1)[:n]
        begin = np.arange(n)
        owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
        good = begin + length <= self.bounds[1:][owner]
        if window:
            good &= (begin >= window[0]) & (begin < window[1])
        self.starts = begin[good]  # where a whole string of `length` bytes begins
        self.anchor = (least[good] & np.uint64((1 << int(POS_BITS)) - 1)).astype(np.int64)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the batch, place in the document) of places in the buffer."""
        owner = np.searchsorted(self.bounds, at, "right") - 1
        return np.asarray(self.docs)[owner], at - self.bounds[owner] + self.base

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Hashes of all bytes that a string with its anchor there can hold, cut at the document's edges."""
        owner = np.searchsorted(self.bounds, at, "right") - 1
        a, b = np.maximum(self.bounds[owner], at - (self.length - K)), np.minimum(self.bounds[owner + 1], at + self.length)
        with np.errstate(over="ignore"):
            return mix64(Rolling(self.data, 1).of(a, b) + (at - a).astype(np.uint64) * np.uint64(1000003) + (b - at).astype(np.uint64))


def pieces(texts: list[bytes], length: int) -> Iterator[Piece]:
    held, docs, sizes = [], [], []
    for row, text in enumerate(texts):
        if len(text) > PIECE:
            for lo in range(0, len(text) - length + 1, PIECE):
                a, b = max(0, lo - 2 * length), min(len(text), lo + PIECE + 3 * length)
                yield Piece(text[a:b], [row], [b - a], a, (lo - a, lo - a + PIECE), length)
        elif len(text) >= length:
            if sum(sizes) + len(text) > PIECE:
                yield Piece(b"".join(held), docs, sizes, 0, None, length)
                held, docs, sizes = [], [], []
            held.append(text), docs.append(row), sizes.append(len(text))
    if docs:
        yield Piece(b"".join(held), docs, sizes, 0, None, length)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _grams(length: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each anchor; full: also its context, document and place."""
        for batch in _batches(batches):
            ids = batch.column("rid").to_numpy()
            for piece in pieces(_bytes(batch.column("text")), length):
                at = np.unique(piece.anchor)
                columns = [piece.gram[at].view(np.int64)] if len(at) else [np.zeros(0, np.int64)]
                if not len(at):
                    continue
                if full:
                    row, pos = piece.place(at)
                    columns += [piece.contexts(at).view(np.int64), ids[row], pos]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "context", "rid", "pos"][: len(columns)])

    return run


OPEN_SCHEMA = "gram long, rid long, pos long, string long, suffix binary, before binary, run int"


def _open(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each of the row's places the suffix tuple there: `length` bytes from the anchor on, and those before it, backwards; for each string
        anchored at one of its crowded places the string's hash.

        Of equal crowded strings in a batch only the earliest is told; the rest are repeats for certain, and leave as runs (no gram; from pos, run long)."""
        for batch in _batches(batches):
            strings: list[list[np.ndarray]] = []
            ids, texts = batch.column("rid").to_numpy(), _bytes(batch.column("text"))
            places, crowded = ([np.asarray(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("places", "crowded"))
            for piece in pieces(texts, length):
                at = np.unique(piece.anchor)
                if not len(at):
                    continue
                row, pos = piece.place(at)
                mine = _marked(row, pos, places, texts)
                if mine.any():
                    at, row, pos = at[mine], row[mine], pos[mine]
                    side = length - K
                    suffix, before = zip(*((texts[r][p : p + length], texts[r][max(0, p - side) : p][::-1]) for r, p in zip(row.tolist(), pos.tolist(), strict=True)), strict=True)
                    values = [piece.gram[at].view(np.int64), ids[row], pos, pa.nulls(len(at), pa.int64()), list(suffix), list(before), pa.nulls(len(at), pa.int32())]
                    yield _open_batch(values)
                row, pos = piece.place(piece.anchor)
                mine = _marked(row, pos, crowded, texts)
                if mine.any():
                    start = piece.starts[mine]
                    string = Rolling(piece.data, 1).of(start, start + length)
                    strings.append([piece.gram[piece.anchor[mine]].view(np.int64), ids[row[mine]], piece.place(start)[1], string.view(np.int64)])
            if strings:
                gram, rid, pos, string = (np.concatenate(c) for c in zip(*strings, strict=True))
                order = np.lexsort((pos, rid, string, gram))
                gram, rid, pos, string = gram[order], rid[order], pos[order], string[order]
                first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (string[1:] != string[:-1])))
                none = pa.nulls(int(first.sum()), pa.binary())
                yield _open_batch([gram[first], rid[first], pos[first], string[first], none, none, pa.nulls(len(none), pa.int32())])
                rid, pos = rid[~first], pos[~first]
                if len(rid):
                    order = np.lexsort((pos, rid))
                    rid, pos = rid[order], pos[order]
                    begin = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (pos[1:] > pos[:-1] + 1))))
                    last = np.concatenate((begin[1:], [len(rid)])) - 1
                    empty = pa.nulls(len(begin), pa.int64())
                    nothing = pa.nulls(len(begin), pa.binary())
                    yield _open_batch([empty, rid[begin], pos[begin], empty, nothing, nothing, (pos[last] + 1 - pos[begin]).astype(np.int32)])

    return run


def _open_batch(values: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["gram", "rid", "pos", "string", "suffix", "before", "run"])


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    texts = column.to_pylist()
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width), np.fromiter(map(len, texts), np.int64, len(texts))


def common_prefixes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the row before it; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate(([0], np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))))


def induced(order: np.ndarray, common: np.ndarray, letter: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of the suffixes that begin a byte (letter) earlier, from those of the suffixes after it.

    Equal letters keep the order of what follows them, so sorting by the letter alone, stably, sorts the longer suffixes; two of the same letter
    share one byte more than the least that the suffixes from one to the other share. Suffixes without a byte before them end here."""
    left = np.flatnonzero(has[order])
    place = left[np.argsort(letter[order[left]], kind="stable")]
    moved = order[place]
    out = np.zeros(len(place), np.int64)
    same = np.flatnonzero(letter[moved[1:]] == letter[moved[:-1]]) + 1
    if len(same):
        spans = np.stack((place[same - 1] + 1, place[same] + 1), axis=1).ravel()
        out[same] = 1 + np.minimum.reduceat(np.append(common, 0), spans)[::2]
    return moved, out


def _repeated(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end): runs of string beginnings in rows, sorted by suffix, that an earlier row has as well.

    For each offset of the anchor in a string the suffixes that begin there stand in order; those that share `length` bytes are neighbours, and
    the one of the least document and place is the original."""
    side, n = length - K, batch.num_rows
    (suffix, size), (before, held) = _padded(batch.column("suffix"), length), _padded(batch.column("before"), side)
    pos = batch.column("pos").to_numpy()
    rank = np.empty(n, np.int64)
    rank[np.lexsort((pos, batch.column("rid").to_numpy()))] = np.arange(n)
    again = np.zeros((n, side + 3), bool)
    order, common = np.arange(n), common_prefixes(suffix, size)
    for offset in range(side + 1):
        new = common < length
        if len(order):
            first = np.minimum.reduceat(rank[order], np.flatnonzero(new))
            again[order, side - offset + 1] = rank[order] != first[np.cumsum(new) - 1]
        if offset < side:
            order, common = induced(order, common, before[:, offset], held > offset)
    row, edge = np.nonzero(np.diff(again.view(np.int8), axis=1))
    place = pos[row[::2]] - side
    return row[::2], place + edge[::2], place + edge[1::2]


def _resolve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; the last gram of a batch, which may go on in the next, waits for it."""
        held: list[pa.RecordBatch] = []

        def out(part: pa.RecordBatch) -> pa.RecordBatch:
            row, lo, hi = _repeated(part, length)
            return pa.RecordBatch.from_arrays([pa.array(part.column("rid").to_numpy()[row]), pa.array(lo), pa.array(hi)], ["rid", "lo", "hi"])

        for whole in batches:
            for batch in _batches([whole], 4096):
                grams = batch.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1], "left"))
                if cut or (held and held[-1].column("gram")[-1].as_py() != grams[0]):
                    yield out(pa.concat_batches([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield out(pa.concat_batches(held))

    return run


def _marked(row: np.ndarray, pos: np.ndarray, marks: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Which (row, place) pairs are among the rows' marks."""
    offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
    table = np.zeros(offset[-1] + 1, bool)
    for r, m in enumerate(marks):
        table[m + offset[r]] = True
    return table[pos + offset[row]]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            texts = _bytes(batch.column("text"))
            anchors = [np.asarray(x if x is not None else [], np.int64) for x in batch.column("anchors").to_pylist()]
            hit = [np.zeros(len(t) + 1, np.int32) for t in texts]
            for h, runs in zip(hit, batch.column("runs").to_pylist(), strict=True):
                for run_ in runs or []:
                    h[run_["lo"] : run_["hi"]] = 1
            if any(map(len, anchors)):
                busy = [t if len(a) else b"" for t, a in zip(texts, anchors, strict=True)]
                for piece in pieces(busy, length):
                    row, pos = piece.place(piece.anchor)
                    mine = _marked(row, pos, anchors, texts)
                    row, begin = piece.place(piece.starts[mine])
                    for r in np.unique(row):
                        hit[r][begin[row == r]] = 1
            spans, kept = [], []
            for t, h in zip(texts, hit, strict=True):
                if not h.any():
                    spans.append([]), kept.append(t)
                    continue
                n = np.cumsum(h[: len(t)])
                covered = n.copy()
                covered[length:] -= n[:-length]
                covered = covered > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(np.frombuffer(t, np.uint8)[~covered].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return run


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array<struct<start, end>> of byte spans) and kept (the remaining bytes) for each row of df; strings with copied surroundings, and those of crowded
    anchors, are equal if 128 bits of hash are, all others if their bytes are.

    A byte goes if a string of `length` bytes that covers it also begins earlier: in a row of smaller id (null first), or in the same row at
    an earlier byte. Overlaps count; strings are judged on the input, never across rows. Rows of equal id are in order of
    their texts' hashes; equal rows are in any one order. Null texts count as empty; texts shorter than `length` stay whole; empty df: no rows.

    1. Anchor hashes are counted; those that occur once (most) are done with. 2. The others' tuples are joined to them. The earliest
       tuple of equal hash and equal context is the original: all strings anchored in its copies are repeats. 3. Originals
       whose hash also has other contexts are sorted by hash and suffix, and common prefixes tell which of the strings around each an
       earlier one has too (_repeated). Where a hash has more than CROWD contexts, the strings' own hashes are grouped instead (64 bits beside
       the anchor's 64), so that no hash fills a task. 4. Each document gets its anchors and strings, and its bytes are cut.
    Every grouping is summed before its exchange, and joins back are ones whose large side Spark may split, so no text, however
    often it occurs, meets in one task. Each step is stored and its shuffle files go before the next.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, distinct = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count("id")).first()
    if n == distinct:
        docs = docs.withColumn("rid", F.col("id"))
    else:
        docs = stored(shard_by_bytes(without(docs, "slot").withColumns({"__one": F.lit(1), "__tie": F.xxhash64("text")}), 1, "id", "__one", ("__tie",)).select("id", "text", F.col("slot").cast("long").alias("rid")), "repeats-docs")
    slim = docs.select("rid", "text")
    grams = slim.mapInArrow(_grams(length, False), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    grams = stored(grams.select("gram"), "repeats-grams")
    tuples = slim.mapInArrow(_grams(length, True), "gram long, context long, rid long, pos long").join(grams, "gram", "left_semi")
    tuples = stored(tuples, "repeats-tuples")
    originals = stored(tuples.groupBy("gram", "context").agg(F.min(F.struct("rid", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "repeats-originals")
    copies = tuples.join(originals.filter("n > 1").select("gram", "context", "first"), ["gram", "context"]).filter(F.struct("rid", "pos") != F.col("first")).select("rid", "pos")
    copies = stored(copies.groupBy("rid").agg(F.collect_set("pos").alias("anchors")), "repeats-copies")
    several = originals.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    crowd = F.col("contexts") > CROWD
    open_ = originals.join(several, "gram").groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(F.when(~crowd, F.col("first.pos"))).alias("places"), F.collect_list(F.when(crowd, F.col("first.pos"))).alias("crowded"))
    open_ = stored(slim.join(open_, "rid").mapInArrow(_open(length), OPEN_SCHEMA), "repeats-open")
    near = open_.filter("suffix IS NOT NULL").repartition("gram").sortWithinPartitions("gram", "suffix", "rid", "pos").mapInArrow(_resolve(length), "rid long, lo long, hi long")
    strings = open_.filter("string IS NOT NULL").select("gram", "string", "rid", "pos")
    firsts = strings.groupBy("gram", "string").agg(F.min(F.struct("rid", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    far = strings.join(firsts, ["gram", "string"]).filter(F.struct("rid", "pos") != F.col("first")).select("rid", F.col("pos").alias("lo"), (F.col("pos") + 1).alias("hi"))
    known = open_.filter("gram IS NULL").select("rid", F.col("pos").alias("lo"), (F.col("pos") + F.col("run")).alias("hi"))
    again = stored(near.unionByName(far).unionByName(known).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "repeats-runs")
    told = docs.join(copies.join(again, "rid", "full"), "rid", "left").select("id", "text", "anchors", "runs")
    return told.mapInArrow(_cut(length), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")

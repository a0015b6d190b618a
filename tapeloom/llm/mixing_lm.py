"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its tokens: words between ASCII white space, A-Z lower-cased, then one end. A token is told by up to LEVELS bits: was it
seen in training after the last two words; after the last word; earlier in this text; in training at all. Each bit is
predicted by several hashed contexts, whose log odds are combined by weights that a gate picks. The first bit that is 1
names the distribution the word comes from: its count there over all counts there. A word that no level has is spelt, bit by bit.

Over a whole text the model is mixed, half and half, with the base: the add-0.1 counts of single words, whose unknown words are spelt too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, stored, words_of

LEVELS = 4
INPUTS = 5  # log odds by counts, by the last word, by the last three levels, by this text so far; a constant
SPARE_BITS = 5  # keys are as many bits longer than log2 of the corpus' bytes, so few unseen pairs look seen
RANGE_BYTES = 1 << 24  # of text, for one range of keys
BUCKETS = 16
GATES = 8  # for each level, and as many bits of a spelt byte
HISTORY = (LEVELS + 1) ** 3
SPELL_ORDERS = (2, 3, 4, 6)
MOST_SLOT_BITS, MOST_SPELL_BITS = 18, 19
CHUNK = 1 << 14
BLOCK_BYTES = 2_000_000
ROUND = 16
RATE = 0.02
DOCS_AT_ONCE = 512
SPELT_AT_ONCE = 20_000
TASKS_AT_ONCE = 512  # tables of so many tasks are added up in one group
PRIOR = 0.4  # of each outcome, in every table
RIDGE = 1.0
FIRST_WEIGHTS = np.array([0.3, 0.5, 0.3, 0.3, 0.0])  # where the fit sets out, and what a gate without decisions keeps
SPELL_FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)]
END = b" "  # no word holds a space
START = np.uint64(0x9E3779B97F4A7C15)
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

# Sizes, tokens, words (one a line: none holds a line feed) and counts are packed.
BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, sizes binary, nbytes binary, tokens binary, words binary"
ASK_SCHEMA = "range long, block long, word_keys binary, word_counts binary, pair_keys binary, pair_counts binary"
ANSWER_SCHEMA = "block long, range long, word_counts binary, pair_counts binary, trained long, distinct long"
READY_SCHEMA = BLOCK_SCHEMA + ", known binary, after binary, earlier binary"
TABLE_SCHEMA = "kind long, chunk long, part long, counts binary"


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, zstd-packed: high planes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class Vocabulary(dict):
    """Words' places, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_BYTES of text: the documents' tokens as places in the block's own vocabulary."""
    part, number = TaskContext.get().partitionId(), 0
    ids, held, sizes, nbytes, tokens, vocabulary = [], [], [], [], [], Vocabulary()

    def flush() -> pa.RecordBatch:
        packed = [pack(np.array(x, np.int32)) for x in (sizes, nbytes, tokens)] + [zstandard.ZstdCompressor(level=1).compress(b"\n".join(vocabulary))]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([(part << 32) + number, ids, held, *packed], kinds, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    for batch in batches:
        for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            words = words_of(text)
            words.append(END)
            tokens += map(vocabulary.__getitem__, words)
            ids.append(doc), held.append(out), sizes.append(len(words)), nbytes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
            if sum(nbytes[-1:]) and (len(tokens) * 6 >= BLOCK_BYTES or sum(nbytes) >= BLOCK_BYTES) or len(ids) >= 50_000:
                yield flush()
                ids, held, sizes, nbytes, tokens, vocabulary, number = [], [], [], [], [], Vocabulary(), number + 1
    if ids:
        yield flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


class Texts:
    """A block of texts: tokens as places in its words, with each token's document and place."""

    def __init__(self, row: dict) -> None:
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.sizes, self.nbytes, self.tokens = (unpack(row[n], np.int32).astype(np.int64) for n in ("sizes", "nbytes", "tokens"))
        self.words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.tokens)) - self.begin[self.owner]
        self.first = self.place == 0
        self.learns = ~self.held[self.owner]

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """x of the token before, or start at a text's begin."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def earlier(self) -> np.ndarray:
        """How often a token's word came before in its text."""
        group = self.owner * max(1, len(self.words)) + self.tokens
        order = np.argsort(group, kind="stable")
        new = np.concatenate(([True], group[order][1:] != group[order][:-1]))[: len(order)]
        out = np.empty(len(order), np.int32)
        out[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        return out

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, each in `bits` high bits, and the places of each token's two among them: the word after the last two words, and after
        the last word. Nothing reaches beyond its text."""
        word = self.hashes[self.tokens]
        last = self.before(word, START)
        with np.errstate(over="ignore"):
            two = mix64(self.before(last, START) * FACTORS[0] + last)
            flat = np.concatenate([mix64(c * FACTORS[1] + word * FACTORS[2] + np.uint64(n)) for n, c in enumerate((two, last))])
        return np.unique(flat >> np.uint64(64 - bits) << np.uint64(64 - bits), return_inverse=True)


def _ask(bits: int, range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range of keys the block's distinct keys, with how often its training texts have each."""
        for row in _rows(batches):
            texts = Texts(row)
            columns = []
            used, order = np.bincount(texts.tokens[texts.learns], minlength=len(texts.words)), np.argsort(texts.hashes)
            columns.append((texts.hashes[order], used[order]))
            known, place = texts.keys(bits)
            columns.append((known, np.bincount(place[np.tile(texts.learns, 2)], minlength=len(known))))
            edges = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits)
            cuts = [np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])) for keys, _ in columns]
            for r in range(1 << range_bits):
                (wk, wn), (pk, pn) = ((k[c[r] : c[r + 1]], n[c[r] : c[r + 1]]) for (k, n), c in zip(columns, cuts, strict=True))
                if len(wk) or len(pk):
                    values = [pack_sorted(wk), pack(wn), pack_sorted(pk), pack(pn)]
                    yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([row["block"]]), *(pa.array([v], pa.binary()) for v in values)], [c.split()[0] for c in ASK_SCHEMA.split(", ")])

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each list's counts replaced by their keys' sums over all lists; the sums of the distinct keys."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")  # merges the sorted lists
    ranked = flat[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(flat) else np.zeros(0, bool)
    sums = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new)) if len(flat) else np.zeros(0, np.int64)
    out = np.empty(len(flat), np.int64)
    out[order] = sums[np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1]), sums


def _answer(table: pa.Table) -> pa.Table:
    """All blocks' counts of one range of keys, summed and sent back to each; and how many training tokens and distinct words there are."""
    blocks, ranges = table.column("block").to_pylist(), table.column("range").to_pylist()
    get = lambda name, f: [f(x.as_py()) for x in table.column(name)]
    words, sums = _totals(get("word_keys", unpack_sorted), get("word_counts", unpack))
    pairs, _ = _totals(get("pair_keys", unpack_sorted), get("pair_counts", unpack))
    n = len(blocks)
    columns = [pa.array([*blocks, -1]), pa.array([*ranges, ranges[0]]), *(pa.array([*map(pack, x), None], pa.binary()) for x in (words, pairs)), pa.array([0] * n + [int(sums.sum())]), pa.array([0] * n + [int((sums > 0).sum())])]
    return pa.table(columns, names=[c.split()[0] for c in ANSWER_SCHEMA.split(", ")])


def _ready(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with what training knows of their words, and of each token after its contexts."""
        for row in _rows(batches):
            texts = Texts(row)
            words, pairs = (np.concatenate([unpack(a[n]) for a in row["answers"]]) for n in ("word_counts", "pair_counts"))
            _, place = texts.keys(bits)
            known = np.empty(len(words), np.int64)
            known[np.argsort(texts.hashes)] = words
            values = [row[c.split()[0]] for c in BLOCK_SCHEMA.split(", ")] + [pack(known), pack(pairs[place]), pack(texts.earlier())]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in READY_SCHEMA.split(", ")])

    return run


class Decisions:
    """A block's tokens as bits. Of each level and token: the count there (n), all counts there (total), whether the bit is told, its value, and its contexts.

    own: each training token's own count is taken out of all that training knows, so that a text is seen as if it were new."""

    def __init__(self, row: dict, trained: int, slot_bits: int, own: bool) -> None:
        self.texts = texts = Texts(row)
        self.known = unpack(row["known"])
        two, one = unpack(row["after"]).reshape(2, -1)
        less = texts.learns.astype(np.int64) if own else 0
        begun = self.known[texts.words.index(END)]  # each training text has one end
        word = self.known[texts.tokens]
        self.n = np.stack((two - less, one - less, unpack(row["earlier"], np.int32), word - less))
        self.total = np.stack((texts.before(one, begun) - less, texts.before(word, begun) - less, texts.place, np.full(len(word), trained) - less))
        np.maximum(self.n, 0, out=self.n)
        self.open = self.total > 0
        seen = (self.n > 0) & self.open
        self.bit, self.told = np.empty_like(seen), np.empty_like(seen)
        level, left = np.full(len(word), LEVELS, np.int8), np.ones(len(word), bool)
        for j in range(LEVELS):
            self.told[j], self.bit[j] = left & self.open[j], left & seen[j]
            level[self.bit[j]] = j
            left &= ~seen[j]
        # log2 of total + 1, rounded down: a float's exponent
        size = np.clip(((self.total + 1).astype(np.float32).view(np.int32) >> 23) - 127, 0, BUCKETS - 1)
        past = np.zeros(len(word), np.int32)
        for _ in range(3):
            level = texts.before(level, LEVELS)
            past = past * (LEVELS + 1) + level
        shift = np.uint64(64 - slot_bits)
        slot = texts.before((mix64(texts.hashes) >> shift).astype(np.int32).take(texts.tokens), int(mix64(np.array([START]))[0] >> shift))
        levels = np.arange(LEVELS, dtype=np.int32)[:, None]
        self.slots = [(levels * BUCKETS + size) * BUCKETS + np.concatenate((size[1:], np.zeros_like(size[:1]))), (levels << slot_bits) + slot, levels * HISTORY + past]
        self.gate = (levels * GATES + np.minimum(size // 2, GATES - 1)).astype(np.int8)

    def so_far(self) -> np.ndarray:
        """Log odds of each level's bits in the text before a token."""
        out = []
        for value in (self.bit & self.told, ~self.bit & self.told):
            before = np.cumsum(value, axis=1, dtype=np.int32) - value
            out.append(log_counts(before - np.repeat(before[:, self.texts.begin], self.texts.sizes, axis=1)))
        return out[0] - out[1]

    def inputs(self, tables: list[Odds]) -> np.ndarray:
        """Log odds (input, level, token)."""
        out = np.empty((INPUTS, *self.bit.shape), np.float32)
        for k, (table, slot) in enumerate(zip(tables, self.slots, strict=True)):
            out[k] = table.of(slot, self.bit)
        out[3], out[4] = self.so_far(), 1
        return np.clip(out, -9, 9, out=out)


LOGS = np.log(np.arange(1 << 14) + PRIOR).astype(np.float32)


def log_counts(n: np.ndarray) -> np.ndarray:
    """log(n + PRIOR); most counts are small, and looked up."""
    out = LOGS.take(n, mode="clip")
    big = n >= len(LOGS)
    if big.any():
        out[big] = np.log(n[big] + PRIOR)
    return out


class Odds:
    """A table's log odds of 1 by slot. own: by slot and bit, without that bit's own count."""

    def __init__(self, counts: np.ndarray, own: bool = False) -> None:
        zero, one = counts
        zeros, ones = log_counts(zero), log_counts(one)
        self.own = own
        self.odds = np.stack((ones - log_counts(np.maximum(zero - 1, 0)), log_counts(np.maximum(one - 1, 0)) - zeros), axis=1).reshape(-1) if own else ones - zeros

    def of(self, slot: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return self.odds.take(2 * slot + bit if self.own else slot)


def spelling(words: list[bytes], spell_bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slots for each order, bits, word of each byte) of the words' bytes and a closing space, 8 decisions a byte, whose numbers lie together by bit."""
    pad = max(SPELL_ORDERS)
    data = np.frombuffer(b"".join(b" " * pad + w + b" " for w in words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + (pad + 1)
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) >= pad
    at = np.flatnonzero(inside)
    depth = np.arange(8, dtype=np.uint8)[:, None]
    nodes = (1 << depth).astype(np.uint32) | (data[at] >> (8 - depth)).astype(np.uint32)
    bits = (data[at] >> (7 - depth)) & 1
    out = []
    context = np.zeros(len(at), np.uint64)
    for order in range(1, pad + 1):
        context |= data[at - order].astype(np.uint64) << np.uint64(8 * order - 8)
        if order in SPELL_ORDERS:
            with np.errstate(over="ignore"):
                mixed = (mix64(context + np.uint64(order << 56)) >> np.uint64(32)).astype(np.uint32)
                out.append(((mixed ^ nodes * SPELL_FACTORS[0]) * SPELL_FACTORS[1] >> np.uint32(32 - spell_bits)).astype(np.int32))
    return [slot.T for slot in out], bits.T, owner[at]


def spelling_inputs(slots: list[np.ndarray], bits: np.ndarray, tables: list[Odds]) -> np.ndarray:
    """Log odds (input, bit, byte) and a constant."""
    out = np.zeros((INPUTS, *bits.T.shape), np.float32)
    for k, (table, slot) in enumerate(zip(tables, slots, strict=True)):
        out[k] = table.of(slot.T, bits.T)
    out[INPUTS - 1] = 1
    return out


def _in_parts(words: list[bytes]) -> Iterator[list[bytes]]:
    """Lists of words that aren't long in all."""
    held, size = [], 0
    for word in words:
        held.append(word)
        size += len(word) + 8
        if size >= 10 * SPELT_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def table_bits(distinct: int) -> tuple[int, int]:
    """Of the slots of last words and of spellings: with the distinct words, as far as every task can hold."""
    return min(MOST_SLOT_BITS, max(8, distinct.bit_length())), min(MOST_SPELL_BITS, max(14, distinct.bit_length() + 3))


def table_sizes(slot_bits: int, spell_bits: int) -> list[int]:
    return [LEVELS * BUCKETS * BUCKETS, LEVELS << slot_bits, LEVELS * HISTORY, *[1 << spell_bits] * len(SPELL_ORDERS)]


def once_words(d: Decisions) -> list[bytes]:
    """Words that training has only once, here: they stand for those it lacks."""
    used = np.zeros(len(d.known), bool)
    used[d.texts.tokens[d.texts.learns]] = True
    return [d.texts.words[w] for w in np.flatnonzero(used & (d.known == 1))]


def _train(trained: int, slot_bits: int, spell_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the training texts' bits in each table's slots, in chunks, once for each task."""
        tables = [np.zeros(2 * n, np.int64) for n in table_sizes(slot_bits, spell_bits)]
        for row in _rows(batches):
            d = Decisions(row, trained, slot_bits, True)
            use = d.told & d.texts.learns
            for table, slot in zip(tables, d.slots, strict=False):
                table += np.bincount(slot[use] * 2 + d.bit[use], minlength=len(table))
            for words in _in_parts(once_words(d)):
                slots, bits, _ = spelling(words, spell_bits)
                for table, slot in zip(tables[3:], slots, strict=True):
                    table += np.bincount((slot * 2 + bits).ravel("K"), minlength=len(table))
        part = TaskContext.get().partitionId()
        for k, table in enumerate(tables):
            for chunk, lo in enumerate(range(0, len(table), 2 * CHUNK)):
                piece = table[lo : lo + 2 * CHUNK]
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([chunk]), pa.array([part // TASKS_AT_ONCE]), pa.array([pack(piece)], pa.binary())], ["kind", "chunk", "part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(unpack(x.as_py()) for x in table.column("counts"))
    return pa.table({"kind": table.column("kind")[:1], "chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": pa.array([pack(total)], pa.binary())})


def slopes(x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The curvature and slope, at FIRST_WEIGHTS, of the logistic regression of bit on x; those of parts add up to those of the whole."""
    p = 1 / (1 + np.exp(-(FIRST_WEIGHTS.astype(np.float32) @ x)))
    return np.concatenate((((x * (p * (1 - p))) @ x.T).astype(np.float64).ravel(), (x @ (bit - p)).astype(np.float64)))


def _learn(told, trained: int, slot_bits: int, spell_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The training texts' curvature and slope for each gate, added up for each task."""
        tables = [Odds(t, own=True) for t in told.value]
        sums = np.zeros((LEVELS * GATES + GATES, INPUTS * INPUTS + INPUTS))
        for row in _rows(batches):
            d = Decisions(row, trained, slot_bits, True)
            x = d.inputs(tables[:3])
            for j in range(LEVELS):
                use = np.flatnonzero(d.told[j] & d.texts.learns)
                use = use[np.argsort(d.gate[j, use], kind="stable")]
                gates, own, bit = d.gate[j, use], x[:, j, use], d.bit[j, use].astype(np.float32)
                cuts = np.searchsorted(gates, np.arange(j * GATES, (j + 1) * GATES + 1))
                for gate, lo, hi in zip(range(j * GATES, (j + 1) * GATES), cuts, cuts[1:], strict=False):
                    if hi > lo:
                        sums[gate] += slopes(own[:, lo:hi], bit[lo:hi])
            for words in _in_parts(once_words(d)):
                slots, bits, _ = spelling(words, spell_bits)
                x = spelling_inputs(slots, bits, tables[3:])
                for depth in range(8):
                    sums[LEVELS * GATES + depth] += slopes(x[:, depth], bits[:, depth].astype(np.float32))
        at = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["gate", "sums"])

    return run


class Model:
    """The tables of counts (outcomes 0 and 1 apart) and the weights of each gate."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray, spell_bits: int) -> None:
        self.spell_bits = spell_bits
        self.tables, self.weights = list(map(Odds, tables)), weights.astype(np.float32)

    def spelt(self, words: list[bytes]) -> np.ndarray:
        """ln of the probability of each spelling."""
        out = [np.zeros(0)]
        for part in _in_parts(words):
            slots, bits, owner = spelling(part, self.spell_bits)
            x = np.einsum("kdb,dk->db", spelling_inputs(slots, bits, self.tables[3:]), self.weights[LEVELS * GATES :])
            out.append(np.bincount(owner, -np.logaddexp(0, np.where(bits.T == 1, -x, x)).sum(axis=0), len(part)))
        return np.concatenate(out)

    def bits(self, d: Decisions) -> np.ndarray:
        """The probability that each bit is 1 (0 where it isn't told). Texts are read side by side, ROUND tokens at a time; after each
        round a text's own weights, which are added to the learnt ones, move down its gradient."""
        x = d.inputs(self.tables[:3])
        base = sum(v * w.take(d.gate) for v, w in zip(x, np.ascontiguousarray(self.weights.T), strict=True))
        flat = x[:-1].reshape((INPUTS - 1) * LEVELS, -1)  # the constant is known
        value = np.where(d.told, d.bit, np.int8(-1))
        out = np.empty(base.shape, np.float32)
        sizes, order = d.texts.sizes, np.argsort(-d.texts.sizes, kind="stable")
        for lo in range(0, len(order), DOCS_AT_ONCE):
            docs = order[lo : lo + DOCS_AT_ONCE]
            size, begin = sizes[docs], d.texts.begin[docs]
            more = np.zeros((INPUTS, LEVELS, len(docs), 1), np.float32)
            for at in range(0, int(size[0]), ROUND):
                n = int(np.searchsorted(-size, -at, "left"))  # texts longer than at
                place = begin[:n, None] + np.arange(at, min(at + ROUND, int(size[0])))
                inside = place < (begin + size)[:n, None]
                np.minimum(place, (begin + size)[:n, None] - 1, out=place)
                own = flat.take(place, axis=1).reshape(INPUTS - 1, LEVELS, *place.shape)
                p = base.take(place, axis=1)
                p += more[-1, :, :n]
                for x, w in zip(own, more[:-1], strict=True):
                    p += x * w[:, :n]
                p = 1 / (1 + np.exp(-np.clip(p, -12, 12, out=p)))
                bit = value.take(place, axis=1)
                error = (bit - p) * ((bit >= 0) & inside)
                error *= RATE
                more[-1, :, :n] += error.sum(axis=2, keepdims=True)
                for x, w in zip(own, more[:-1], strict=True):
                    w[:, :n] += (x * error).sum(axis=2, keepdims=True)
                out[:, place[inside]] = p[:, inside]
        out[~d.open] = 0
        return out

    def tokens(self, d: Decisions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ln of each token's probability; the same, but an unknown word not spelt; and ln of the unknown words' spellings, else 0.
        A word may be told at any level that has it, so all of them add up."""
        reach, ways = np.ones(d.n.shape[1]), np.zeros(d.n.shape[1])
        for p, n, total in zip(self.bits(d).astype(np.float64), d.n, d.total, strict=True):
            ways += reach * p * (n / np.maximum(total, 1))
            reach *= 1 - p
        with np.errstate(divide="ignore"):
            out = np.log(ways)
        unknown = np.flatnonzero(d.known == 0)
        spelt = np.zeros(len(d.known))
        spelt[unknown] = self.spelt([d.texts.words[w] for w in unknown])
        spelt, lacks = spelt[d.texts.tokens], d.known[d.texts.tokens] == 0
        unspelt = out.copy()
        unspelt[lacks] = np.log(ways[lacks] + reach[lacks])
        out[lacks] = np.logaddexp(out[lacks], np.log(reach[lacks]) + spelt[lacks])
        return out, unspelt, spelt


def _score(told, trained: int, distinct: int, slot_bits: int, spell_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*told.value, spell_bits)
        for row in _rows(batches):
            d = Decisions(row, trained, slot_bits, False)
            texts = d.texts
            base = np.add.reduceat(np.log10((d.known + 0.1) / (trained + 0.1 * (distinct + 1)))[texts.tokens], texts.begin)
            own, unspelt, spelt = (np.add.reduceat(x, texts.begin) for x in model.tokens(d))
            score, class_score = ((np.logaddexp(a, b) - np.log(2)) / np.log(10) for a, b in ((own, base * np.log(10) + spelt), (unspelt, base * np.log(10))))
            with np.errstate(divide="ignore"):
                bits = np.where(texts.nbytes > 0, -score / np.log10(2) / np.maximum(texts.nbytes, 1), np.nan)
            values = [
                pa.array(texts.ids, pa.int64()),
                pa.array(texts.held),
                pa.array(texts.sizes),
                pa.array(np.add.reduceat((d.known > 0).astype(np.int64)[texts.tokens], texts.begin)),
                pa.array(np.full(len(texts.ids), trained, np.int64)),
                pa.array(base),
                pa.array(score),
                pa.array(class_score),
                pa.array(bits, from_pandas=True),
            ]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "class_score", "bits_per_byte"])

    return run


def learnt_weights(rows: list) -> np.ndarray:
    """The gates' weights: from FIRST_WEIGHTS one Newton step, of at most 1, down the slope of all training texts."""
    weights = np.tile(FIRST_WEIGHTS, (LEVELS * GATES + GATES, 1))
    for row in rows:
        sums = np.array(row["sums"])
        step = np.linalg.solve(sums[: INPUTS * INPUTS].reshape(INPUTS, INPUTS) + RIDGE * np.eye(INPUTS), sums[INPUTS * INPUTS :])
        weights[row["gate"]] += step / max(1.0, float(np.abs(step).max()))
    return weights


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), class_score and bits_per_byte for each row of df.

    The model learns from the rows whose crc32(id as text) mod 10 isn't 0 (a null id counts as training) and scores all.
    base_score is the add-0.1 unigram score of the same tokens; it has one probability for all unknown words together, while score spells each
    of them. class_score doesn't spell them, so it compares with base_score: it is at most log10(2) below it. A null or empty text is its end alone (bits_per_byte null). Repeated rows each count.
    Empty df: no rows. Other columns of df are not read.

    1. Texts become blocks of tokens, once. 2. Each block asks, for its distinct words, and pairs of context and word, how often training has
       them, and says how often its own training texts do: sorted keys, packed, a row for each block and range of keys. Each range is
       summed and answered in one group. Keys of words are 64-bit hashes; those of pairs grow with the corpus (SPARE_BITS), as do the ranges, so
       what is known of contexts has no fixed size, and a frequent word is one key a block. 3. The bits of the training texts
       are counted in small tables of contexts. 4. Each gate's weights are fitted to all training texts at once (logistic regression,
       slopes and curvatures added up over all blocks); in 3. and 4. a token's own counts are left out. 5. All texts are scored;
       adaptive counts and weights go on from the learnt ones within each text.

    Another layout of the same rows gives the same model but for the rounding of sums: scores differ by less than 1e-5 of themselves.
    """
    spark = df.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    nbytes = int(docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)
    bits = min(60, max(24, nbytes.bit_length() + SPARE_BITS))
    range_bits = max(1, (nbytes // RANGE_BYTES).bit_length())
    blocks = stored(docs.mapInArrow(_blocks, BLOCK_SCHEMA), "lm-blocks")
    answers = stored(blocks.mapInArrow(_ask(bits, range_bits), ASK_SCHEMA).groupBy("range").applyInArrow(_answer, ANSWER_SCHEMA), "lm-answers")
    trained, distinct = (int(x) for x in answers.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first())
    by_block = answers.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "word_counts", "pair_counts"))).alias("answers"))
    ready = stored(blocks.join(by_block, "block").mapInArrow(_ready(bits), READY_SCHEMA), "lm-ready")
    discard(blocks)
    discard(answers)
    table = table_bits(distinct)
    chunks = ready.mapInArrow(_train(trained, *table), TABLE_SCHEMA)
    chunks = chunks.groupBy("kind", "chunk", "part").applyInArrow(_add, TABLE_SCHEMA).groupBy("kind", "chunk").applyInArrow(_add, TABLE_SCHEMA)
    tables = [np.zeros(2 * n, np.int64) for n in table_sizes(*table)]
    for row in stored(chunks, "lm-tables").select("kind", "chunk", "counts").toLocalIterator():  # at most 2**20 slots of words and 2**21 of spellings
        piece = unpack(row["counts"])
        tables[row["kind"]][row["chunk"] * 2 * CHUNK :][: len(piece)] = piece
    tables = [np.minimum(t.reshape(-1, 2).T, np.iinfo(np.int32).max).astype(np.int32) for t in tables]
    sums = ready.mapInArrow(_learn(spark.sparkContext.broadcast(tables), trained, *table), "gate long, sums array<double>")
    added = sums.select("gate", F.posexplode("sums").alias("at", "value")).groupBy("gate", "at").agg(F.sum("value").alias("value"))
    gates = added.groupBy("gate").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all")).select("gate", F.col("all.value").alias("sums")).collect()  # a row a gate
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, class_score double, bits_per_byte double"
    return ready.mapInArrow(_score(spark.sparkContext.broadcast((tables, learnt_weights(gates))), trained, distinct, *table), schema)

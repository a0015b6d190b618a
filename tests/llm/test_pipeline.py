"""The quality model and the pipeline's stages against plain versions, on hand-made documents."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm.common import WordHashes, mix64
from tapeloom.llm.quality import BAD_ODDS, BUCKETS, COPY_HASHES, FALSE_MARKS, MARGIN, PART, PRIOR, SPARED, TOXIC_ODDS, drawn_keys, importance_resample, kth_largest

rng = random.Random(12)
GOOD = [f"good{i}" for i in range(60)]
JUNK = [f"cell{i}" for i in range(60)]
ITEM = [f"item{i}" for i in range(30)]


def prose(n, words=GOOD):
    return " ".join(rng.choice(words) for _ in range(n))


LONG = prose(4000)
BASE = prose(80)
ROWS = [(i, prose(rng.randrange(10, 60)), f"src{i % 3}") for i in range(80)]
ROWS += [(100 + i, " | ".join(rng.choice(JUNK) for _ in range(20)), "src0") for i in range(40)]
ROWS += [(150 + i, prose(30) + " scum idiot", "src1") for i in range(40)]
ROWS += [(200, BASE, "src2"), (201, BASE + " tail", "src2"), (202, BASE, None), (203, prose(20) + " " + " ".join(ITEM) + " " + prose(9), "src1"), (204, " ".join(["changed", *ITEM[1:12], "x", *ITEM[13:]]), "src2")]
ROWS += [(300, None, "src0"), (301, "", "src1"), (None, prose(25), "src1"), (302, LONG, "src2"), (303, prose(33), None), (304, prose(33), None), (304, ROWS[5][1] + " more words here", None)]
LABELS = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(25)] + [(150 + i, 1, 1) for i in range(25)] + [(5, 1, None), (None, 0, 1), (9999, 1, 0)]


def frames(spark, rows=ROWS):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def uniform(i, seed):
    return (int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


class Plain:
    """The quality model a text at a time."""

    def __init__(self, rows, labels):
        self.hashes = WordHashes()
        said = {}
        for i, q, t in labels:
            if i is not None:
                s = said.setdefault(i, {"good": False, "bad": False, "toxic": False, "said": False})
                s["good"] |= q == 1
                s["bad"] |= q == 0
                s["toxic"] |= t == 1
                s["said"] |= t is not None
        target = {i for i, s in said.items() if s["good"] and not s["toxic"]}
        raw, good = Counter(), Counter()
        for i, t, _ in rows:
            for f in self.features(t):
                raw[f & (BUCKETS - 1)] += 1
                good[f & (BUCKETS - 1)] += i in target
        self.raw, self.good, self.n, self.g = raw, good, sum(raw.values()), sum(good.values())
        self.marks = [
            self.mark(rows, {i for i, s in said.items() if s["said"] and s["toxic"]}, {i for i, s in said.items() if s["said"] and not s["toxic"]}, TOXIC_ODDS),
            self.mark(rows, {i for i, s in said.items() if s["bad"] and not s["good"]}, {i for i, s in said.items() if s["good"]}, BAD_ODDS),
        ]

    def features(self, text):
        parts = [self.hashes[p] for p in PART.findall((text or "").encode().lower())]
        pairs = [int(mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(parts, parts[1:], strict=False)]
        return parts + pairs

    def shaped(self, text):
        parts = [self.hashes[p] for p in PART.findall((text or "").encode().lower())]
        again = sum(a == b for a, b in zip(parts, parts[1:], strict=False))
        return set(self.features(text)) | {n for n, k in ((1, 1), (2, 2), (3, 4)) if parts and 8 * again >= k * len(parts)}

    def mark(self, rows, one, other, least):
        odds = self.odds(rows, one, other)
        scores = [sum(odds.get(f, 0) for f in self.shaped(t)) for i, t, _ in rows if i in other]
        return odds, max(least, float(np.percentile(scores, 100 * (1 - SPARED))) + 1e-6)

    def apart(self, rows, kind):
        """One text of each group of copies."""
        best = {}
        for i, t, _ in rows:
            if i in kind:
                f = self.features(t)
                pairs = f[(len(f) + 1) // 2 :] or f
                key = tuple(min((int(mix64(np.array([(x + n) % 2**64], np.uint64))[0]) for x in pairs), default=0) for n in range(COPY_HASHES))
                best[key] = min(best.get(key, t or ""), t or "")
        return list(best.values())

    def odds(self, rows, one, other):
        a, b, n, m = Counter(), Counter(), 0, 0
        for t in self.apart(rows, one):
            a.update(self.shaped(t))
            n += 1
        for t in self.apart(rows, other):
            b.update(self.shaped(t))
            m += 1
        tested = [f for f in a if a[f] > 1]
        out, alike = {}, n / (n + m)
        for f in tested:
            x, y = a[f], b[f]
            s = x / (x + y)
            bound = (x + y) * (s * math.log(s / alike) + ((1 - s) * math.log((1 - s) / (1 - alike)) if y else 0))
            if s > alike and bound >= math.log(len(tested) / FALSE_MARKS):
                out[f] = math.log((x + 0.5) / (n + 1)) - math.log((y + 0.5) / (m + 1))
        return out

    def log_ratio(self, text):
        shape = self.shaped(text)
        if any(sum(odds.get(f, 0) for f in shape) >= least for odds, least in self.marks):
            return -math.inf
        whole, out = self.g + PRIOR * BUCKETS, 0.0
        for f in self.features(text):
            share = (self.raw[f & (BUCKETS - 1)] + 1) / (self.n + BUCKETS)
            told = self.good[f & (BUCKETS - 1)] + PRIOR * BUCKETS * share
            out += math.log(told / whole) - math.log(share) + self.good[f & (BUCKETS - 1)] / (2 * told**2)
        return out


def drawn(plain, rows):
    keys = [(plain.log_ratio(t) - math.log(-math.log(uniform(i, 7))), n) for n, (i, t, _) in enumerate(rows)]
    ratios = [plain.log_ratio(t) for _, t, _ in rows]
    size = sum(r >= -MARGIN for r in ratios)
    last = sorted((k for k, n in keys if ratios[n] > -math.inf), reverse=True)[size - 1]
    return [n for k, n in keys if ratios[n] > -math.inf and k >= last]


def test_quality_against_a_plain_model(spark):
    docs, labels = frames(spark)
    plain = Plain(ROWS, LABELS)
    found = importance_resample(docs.repartition(3), labels).collect()
    want = drawn(plain, ROWS)
    assert Counter((r.doc_id, r.text) for r in found) == Counter(ROWS[n][:2] for n in want)
    for r in found:
        assert r.log_ratio == pytest.approx(plain.log_ratio(r.text), abs=1e-5)
    assert Counter(r.doc_id for r in drawn_keys(docs, labels).collect()) == Counter(ROWS[n][0] for n in want)
    kept = {ROWS[n][0] for n in want}
    assert not kept & set(range(100, 190)) and {0, 1, 2, 300, 301, 302, None} <= kept


def test_ties_at_the_last_key(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 3, 3, 1, 1, 5, 2.5, 2.5 + 1e-15]] + [(None,)], "x double")
    assert [kth_largest(df, "x", k) for k in (1, 2, 4, 5, 6, 8, 9, 0)] == [5, 3, 3, 2.5 + 1e-15, 2.5, 1, None, None]
    rows = [(1, "a b", "s")] * 5 + [(2, "c d", "s")] * 5
    docs, labels = frames(spark, rows)
    assert importance_resample(docs, labels, size=3).count() == 5  # all that tie with the third
    assert importance_resample(docs, labels, size=0).count() == 0


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def apart(rows):
    """One row of each group of near-duplicates."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    top = lambda x: x if root[x] == x else top(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    best = {}
    for n, (i, _, _) in enumerate(rows):
        best[top(n)] = min(best.get(top(n), (True, math.inf, math.inf)), (i is None, i or 0, n))
    return [rows[n] for n in range(len(rows)) if not sets[n] or best[top(n)][2] == n]


def aligned(item, text):
    words = (text or "").split()
    row, best = [0] * (len(words) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(words):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item))


def write(spark, folder, rows):
    docs, labels = frames(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_plain_stages(spark, tmp_path):
    folder = write(spark, tmp_path / "in", ROWS)
    found = corpus_pipeline.run(spark, folder).collect()
    rows = [ROWS[n] for n in drawn(Plain(ROWS, LABELS), ROWS)]
    rows = [r for r in apart(rows) if aligned(ITEM, r[1]) < 0.6]
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    taken = Counter()
    for r in found:
        taken[r.source] += 1
    by_row = Counter((r.doc_id, r.text, r.source) for r in found)
    assert set(by_row) <= set(rows)
    from test_tables import reshared

    targets = reshared(dict(sizes))
    weight = {i: 1.0 if max(q for j, q, _ in LABELS if j == i) == 1 else 0.25 for i, _, _ in LABELS if i is not None}
    want = Counter()
    for s in sizes:
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        left = math.floor(targets[s] + 0.5) - epochs * sizes[s]
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (-math.log(uniform(r[0], 11)) / weight.get(r[0], 0.5), r[0] is None, r[0] or 0, size(r[1]))):
            part = min(size(r[1]), left)
            left -= part
            want[r] = math.ceil((epochs * size(r[1]) + part) / size(r[1])) if size(r[1]) else 1
    assert by_row == Counter({r: n for r, n in want.items() if n})
    ordered = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode()), len((r.text or "").encode())))
    total, at, slots = sum(len((r.text or "").encode()) + 16 for r in found), 0, Counter()
    shards = {}
    for r in ordered:
        n = len((r.text or "").encode()) + 16
        shard = min(39, (2 * at + n) * 40 // (2 * total))
        shards.setdefault((r.doc_id, r.text), []).append((shard, slots[shard]))
        slots[shard], at = slots[shard] + 1, at + n
    got = {}
    for r in found:
        got.setdefault((r.doc_id, r.text), []).append((r.shard, r.slot))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in shards.items()}


def test_empty_corpus_and_columns(spark, tmp_path):
    folder = write(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs, _ = frames(spark)
    folder = write(spark, tmp_path / "some", ROWS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.withColumnRenamed("lang", "log_ratio").withColumnRenamed("n_chars", "weight"), folder).columns == ["doc_id", "text", "log_ratio", "source", "weight"], name

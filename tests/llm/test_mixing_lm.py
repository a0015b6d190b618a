import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tapeloom.llm.common import mix64
from tapeloom.llm.mixing_lm import END, FIRST_WEIGHTS, PRIOR, RATE, RIDGE, ROUND, SPELL_ORDERS, START, score_texts, spelling


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


HELD = [i for i in range(4000) if held(i)]
LEARN = [i for i in range(4000) if not held(i)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, Block string, score long")


def log_odds(pair, less=None):
    zero, one = pair
    if less is not None:
        zero, one = zero - (less == 0), one - (less == 1)
    return math.log(one + PRIOR) - math.log(zero + PRIOR)


class Plain:
    """The model once more, a token at a time, with whole contexts for keys."""

    def __init__(self, rows):
        self.rows = [(i, [w.encode() for w in (t or "").lower().split()] + [END]) for i, t in rows]
        self.c0, self.c1, self.c2 = Counter(), Counter(), Counter()
        for i, words in self.rows:
            if not held(i):
                for c, w in zip(self.contexts(words), words, strict=True):
                    self.c0[w] += 1
                    self.c1[c[1], w] += 1
                    self.c2[c, w] += 1
        self.trained = sum(self.c0.values())
        self.t1, self.t2 = Counter(), Counter()
        for (a, _), n in self.c1.items():
            self.t1[a] += n
        for (c, _), n in self.c2.items():
            self.t2[c] += n
        self.slot_bits = min(18, max(8, len(self.c0).bit_length()))
        self.tables = [defaultdict(lambda: [0, 0]) for _ in range(3)]
        self.spell_bits = min(19, max(14, len(self.c0).bit_length() + 3))
        self.spell = [defaultdict(lambda: [0, 0]) for _ in SPELL_ORDERS]
        learn = [self.decisions(words, 1) for i, words in self.rows if not held(i)]
        once = [w for w, n in self.c0.items() if n == 1]
        for tokens in learn:
            for t in tokens:
                for told in t["told"]:
                    for table, key in zip(self.tables, told["keys"], strict=True):
                        table[key][told["bit"]] += 1
        for w in once:
            slots, bits, _ = spelling([w], self.spell_bits)
            for table, s in zip(self.spell, slots, strict=True):
                for key, bit in zip(s.ravel(), bits.ravel(), strict=True):
                    table[key][bit] += 1
        gates = defaultdict(list)
        for tokens in learn:
            for t in tokens:
                for told in t["told"]:
                    gates[told["gate"]].append((self.inputs(told, True), told["bit"]))
        for w in once:
            slots, bits, _ = spelling([w], self.spell_bits)
            for b, d in itertools.product(range(bits.shape[0]), range(8)):
                gates["spell", d].append(([log_odds(t[s[b, d]], bits[b, d]) for t, s in zip(self.spell, slots, strict=True)] + [1], bits[b, d]))
        self.weights = defaultdict(lambda: FIRST_WEIGHTS, {g: self.fit(rows) for g, rows in gates.items()})

    @staticmethod
    def contexts(words):
        return [((b"<", b"<") + tuple(words))[k : k + 2] if k else (b"<", b"<") for k in range(len(words))]

    def decisions(self, words, own):
        out, levels, cache = [], [4, 4, 4], Counter()
        ones, zeros = [0] * 4, [0] * 4
        for k, (c, w) in enumerate(zip(self.contexts(words), words, strict=True)):
            n = [self.c2[c, w] - own, self.c1[c[1], w] - own, cache[w], self.c0[w] - own]
            total = [self.t2[c] - own, self.t1[c[1]] - own, k, self.trained - own]
            n = [max(x, 0) for x in n]
            size = [min(15, int(math.log2(max(x, 0) + 1))) for x in total] + [0]
            hashed = START if c[1] == b"<" else np.uint64(xxhash.xxh3_64_intdigest(c[1]))
            slot = int(mix64(np.array([hashed]))[0] >> np.uint64(64 - self.slot_bits))
            level = next((j for j in range(4) if total[j] > 0 and n[j] > 0), 4)
            told, every = [], []
            for j in range(4):
                keys = [(j, size[j], size[j + 1]), (j, slot), (j, *levels)]
                d = {"j": j, "keys": keys, "bit": int(j == level), "gate": (j, min(size[j] // 2, 7)), "ones": ones[j], "zeros": zeros[j]}
                every.append(d)
                if total[j] > 0 and j <= level:
                    told.append(d)
            for d in told:
                ones[d["j"]] += d["bit"]
                zeros[d["j"]] += 1 - d["bit"]
            levels = [level, *levels[:2]]
            cache[w] += 1
            out.append({"word": w, "n": n, "total": total, "told": told, "every": every})
        return out

    def inputs(self, d, own=False):
        x = [log_odds(t.get(k, (0, 0)), d["bit"] if own else None) for t, k in zip(self.tables, d["keys"], strict=True)]
        x += [math.log(d["ones"] + PRIOR) - math.log(d["zeros"] + PRIOR), 1]
        return [min(9, max(-9, v)) for v in x]

    @staticmethod
    def fit(rows):
        x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
        p = 1 / (1 + np.exp(-x @ FIRST_WEIGHTS))
        step = np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + RIDGE * np.eye(5), x.T @ (y - p))
        return FIRST_WEIGHTS + step * min(1, 1 / max(1e-12, abs(step).max()))

    def spelt(self, w):
        slots, bits, _ = spelling([w], self.spell_bits)
        out = 0
        for b, d in itertools.product(range(bits.shape[0]), range(8)):
            x = [log_odds(t.get(s[b, d], (0, 0))) for t, s in zip(self.spell, slots, strict=True)] + [1]
            z = float(np.dot(self.weights["spell", d], x))
            out -= math.log1p(math.exp(-z if bits[b, d] else z))
        return out

    def score(self, words):
        """With the unknown words spelt, and without."""
        total, unspelt, more, tokens = 0, 0, np.zeros((4, 5)), self.decisions(words, 0)
        base = sum(math.log10((self.c0[w] + 0.1) / (self.trained + 0.1 * (len(self.c0) + 1))) for w in words)
        spelt = sum(self.spelt(w) for w in words if not self.c0[w]) / math.log(10)
        for at in range(0, len(tokens), ROUND):
            step = np.zeros((4, 5))
            for t in tokens[at : at + ROUND]:
                reach, ways, told = 1.0, 0.0, {d["j"] for d in t["told"]}
                for d in t["every"]:
                    j, x = d["j"], np.array(self.inputs(d))
                    p = 1 / (1 + math.exp(-min(12, max(-12, float((self.weights[d["gate"]] + more[j]) @ x)))))
                    if j in told:
                        step[j] += RATE * (d["bit"] - p) * x
                    if t["total"][j] > 0:
                        ways += reach * p * t["n"][j] / t["total"][j]
                        reach *= 1 - p
                new = not self.c0[t["word"]]
                unspelt += math.log10(ways + reach * new)
                total += math.log10(ways + reach * math.exp(self.spelt(t["word"])) if new else ways)
            more += step
        return [float(np.logaddexp(a * math.log(10), b * math.log(10)) / math.log(10)) - math.log10(2) for a, b in ((total, base + spelt), (unspelt, base))]


def some_rows():
    rng = np.random.default_rng(3)
    words = ["the", "cat", "sat", "on", "a", "mat", "Dog", "ran", "é", "longer", "words", "here"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(40)] + [None, "", "the cat sat on the mat " * 12, "unseen zebra zebra", "once only", "x" * 300]
    return [(i, t) for i, t in enumerate(texts)] + [(HELD[3 + k], t) for k, t in enumerate(texts[-6:])] + [(HELD[12], "zebras zebras once zebras"), (None, "null id"), (5, texts[5])]


@pytest.mark.parametrize("blocks", [1, 5])
def test_scores_against_a_plain_model(spark, blocks):
    rows = some_rows()
    plain = Plain(rows)
    found = score_texts(docs(spark, rows).repartition(blocks)).collect()
    scores = {(r.doc_id, r.n_tokens): (r.score, r.class_score) for r in found}
    assert len(found) == len(rows)
    for i, w in plain.rows:
        if i != 5:
            assert scores[i, len(w)] == pytest.approx(plain.score(w), rel=1e-4, abs=1e-4), (i, w)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        assert r.class_score >= r.base_score - math.log10(2) - 1e-9 and r.score <= r.class_score + 1e-9
        assert (r.bits_per_byte is None) == (text == "")
        if text:
            assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(text.encode()))


def test_scores_do_not_depend_on_blocks_or_ranges(spark, monkeypatch):
    """Many blocks and ranges of keys give the scores of one."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 5000)) for i in range(120)]
    whole = {r.doc_id: r.score for r in score_texts(docs(spark, rows).coalesce(1)).collect()}
    monkeypatch.setattr("tapeloom.llm.mixing_lm.RANGE_BYTES", 1 << 14)
    parts = {r.doc_id: r.score for r in score_texts(docs(spark, rows).repartition(7)).collect()}
    assert len(whole) == 120 and parts == pytest.approx(whole, rel=1e-5)


def test_probabilities_sum_to_at_most_one(spark):
    train = [(LEARN[k], t) for k, t in enumerate(["a b", "a b c", "b b a", "c", "", "a c b a"] * 3)]
    asked = [" ".join(w) for n in range(4) for w in itertools.product("abc", repeat=n)]
    found = {r.doc_id: r.score for r in score_texts(docs(spark, train + list(zip(HELD, asked, strict=False)))).collect()}
    total = sum(10 ** found[i] for i, _ in zip(HELD, asked, strict=False))
    assert 0.2 < total <= 1


def test_contexts_beat_single_words_on_held_out_texts(spark):
    rng = np.random.default_rng(1)
    follow = {w: rng.choice(30, 3) for w in range(30)}

    def text():
        w, out = 0, []
        for _ in range(80):
            w = int(rng.choice(follow[w]))
            out.append(f"w{w}")
        return " ".join(out)

    found = [r for r in score_texts(docs(spark, [(i, text()) for i in range(300)])).collect() if r.held_out]
    assert len(found) > 20 and all(r.score > r.base_score + 0.5 * r.n_tokens for r in found)


def test_long_and_repeated_texts(spark):
    rows = [(LEARN[0], "a b " * 40_000), (LEARN[1], "a b"), (LEARN[1], "a b"), (HELD[0], "a b"), (HELD[1], "é" * 100_000)]
    found = [(r.doc_id, r.n_tokens, r.score) for r in score_texts(docs(spark, rows)).collect()]
    assert len(found) == 5 and all(math.isfinite(s) and s < 0 for _, _, s in found)
    assert len({round(s, 6) for _, n, s in found if n == 3}) == 1

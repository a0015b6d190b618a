"""Runs of words against all periods tried at all places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tapeloom.llm.queries import with_periodic_tails
from tapeloom.llm.runs import BLOCK_WORDS, CommonPrefixes, find_runs, next_smaller, periodic_runs


def brute(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and all(any(words[x] != words[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (1, 3)])
def test_runs_of_random_texts(least, times):
    rnd = random.Random(times)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(0, 6)):
            n, kinds = rnd.randint(0, 60), rnd.randint(1, 4)
            words = [rnd.randint(1, kinds) for _ in range(n)]
            if n > 8 and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(2, 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            texts.append(words)
        found = find_runs([np.array(t, np.int64) for t in texts], least, times)
        assert [[tuple(r) for r in x.tolist()] for x in found] == [brute(t, least, times) for t in texts]


def test_parts_against_plain_ones():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 300)
    found = next_smaller(values, 300)
    for i, v in enumerate(values):
        later = [j for j in range(i + 1, 300) if values[j] < v]
        assert found[i] == (later[0] if later else 300)
    word = np.append(rng.integers(1, 3, 200), 0)
    a, b = rng.integers(0, 200, (2, 500))
    a, b = a[a != b], b[a != b]
    for x, y, size in zip(a, b, CommonPrefixes(word).of(a, b), strict=True):
        top = max(x, y)
        assert size == next(k for k in range(202) if top + k >= 200 or word[x + k] != word[y + k])


def test_rows_of_any_kind(spark):
    long = ["x", "y"] * (BLOCK_WORDS // 2 + 5)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "b  a\na a\x0ba a a b", "é é é é é é é é", "A a A a A a A a A", " ".join(long), "a b a b a b a b c c c c c c c"]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[5], "x", 0), (5, texts[5], "x", 0), (5, "other", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start long")
    found = periodic_runs(df.coalesce(1)).collect()
    assert len(found) == len(rows)
    for r, (doc, text, *_) in zip(found, rows, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        want = [(0, len(long), 2)] if words == long else brute(words)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (doc, len(words), want)
        assert r.collapsed == ("x y" if words == long else collapsed(words, want))
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, times=1)


def test_query_against_brute_force(spark, tmp_path):
    from tapeloom.llm.queries import op11_periodic_runs

    rnd = random.Random(11)
    rows = [(i, rnd.choice([" ", "\n", "  "]).join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90)))) for i in range(400)] + [(None, "a a a a a a a"), (401, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = {r.doc_id: r.text for r in with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) == len(rows)
    n = 0
    for r in op11_periodic_runs(spark, str(tmp_path)).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        words = tail(r.doc_id, (text or "").split()) if r.doc_id is not None else text.split()
        assert (planted[r.doc_id] or "").split() == words
        runs = brute(words)
        best = min(((-size, start, q) for start, size, q in runs), default=None)
        n += len(runs)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{z},{q}\n" for s, z, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert n > 10

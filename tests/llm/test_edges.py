"""Nulls, ties, repeated rows, empty tables and clashing column names, against brute force where there is a plain one."""

import math
import re
import zlib
from collections import Counter

import pytest

from tapeloom.llm.decontaminate import benchmark_leaks, drop_contaminated
from tapeloom.llm.minhash import drop_near_duplicates, near_duplicates
from tapeloom.llm.mixing import mix_sources
from tapeloom.llm.mixing_lm import score_texts
from tapeloom.llm.quality import importance_resample
from tapeloom.llm.secrets import BASE_RULES, scan_secrets, secret_report
from tapeloom.llm.sharding import shard_by_bytes
from tapeloom.llm.substrings import remove_repeats
from tapeloom.llm.topk import exact_top_k

WORDS = [f"w{i * 7919 % 997}" for i in range(80)]
BASE = " ".join(WORDS)
NEAR = " ".join(["other", *WORDS[1:]])
ROWS = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, BASE), (7, NEAR), (8, BASE), (8, BASE), (9, " ".join(f"z{i}" for i in range(90))), (10, BASE + " 　 é"), (11, "x" * 300_000)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "kept", i) for i, t in rows], "doc_id long, text string, Node string, score long")


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark):
    sets = [(i, shingles(t)) for i, t in ROWS]
    root = {i: i for i, _ in sets if i is not None}
    for _ in ROWS:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = Counter((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets)
    assert Counter(map(tuple, near_duplicates(docs(spark)).collect())) == want
    left = drop_near_duplicates(docs(spark))
    assert left.columns == ["doc_id", "text", "Node", "score"]
    assert {r.doc_id for r in left.collect()} == {None, *(i for i, r in root.items() if i == r)}


def test_top_k_against_all_scores(spark):
    rows = [(i, [((i * 37 + j * 11) % 23 - 11) / 17 for j in range(6)]) for i in range(120)] + [(150, [0.1] * 6), (151, [0.1] * 6), (152, None), (153, [0.1, None] * 3), (154, [float("nan")] * 6), (155, [float("-inf")] * 6), (None, [0.5] * 6)]
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and i < 152}
    want = []
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, floor int")
    assert sorted(map(tuple, exact_top_k(df).collect())) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_mix_meets_its_targets(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else None, i % 7, 1.0) for i in range(300)] + [(3, "a", None, None), (None, "z", 0, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    for weight in (None, "weight"):
        found = mix_sources(df, weight_col=weight).collect()
        again = mix_sources(df.repartition(3), weight_col=weight).collect()
        assert Counter(map(tuple, found)) == Counter(map(tuple, again)) and len(found) == len(rows)
        taken, target = Counter(), {}
        for r in found:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * (r.size or 0)
        assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())


def test_shards_are_contiguous_and_balanced(spark):
    rows = [(i // 2, (i * 13) % 50) for i in range(400)] + [(None, 5), (7, None)]
    found = sorted(shard_by_bytes(spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, size long, shard string"), 8, tie_cols=("size",)).collect(), key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted(ids) and len(found) == len(rows)
    held, counts = Counter(), Counter()
    for r in found:
        assert r.slot == counts[r.shard]
        counts[r.shard] += 1
        held[r.shard] += r.size or 0
    share = sum(held.values()) / 8
    assert all(abs(x - share) <= 50 for x in held.values())


def test_secrets_against_python(spark):
    texts = [None, "", 'é PassWord = "abcdefghijkl" x', "token:short secret:abcdef012345-long", "AKIAAKIA" + "B" * 12, "0123456789abcdef" * 3, "Api_key='A1b2C3d4E5f6G7' api-key=zzzzzzzzzzzzzz", "secret: token: abcdefghijklmn"]
    flags = {"assign": re.ASCII | re.IGNORECASE, "access": re.ASCII, "hex": re.ASCII}
    want = []
    for i, t in enumerate(texts):
        spans = {r.kind: [m.span() for m in re.finditer(r.pattern, t or "", flags[r.kind]) if len(m[r.group]) >= r.least] for r in BASE_RULES}
        want.append((i, *(len(spans[r.kind]) for r in BASE_RULES)))
    found = secret_report(scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in found) == want


def test_language_model_base_and_counts(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The  cat ran", None, "", "a dog sat on the cat", "dog dog dog"] * 8)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*(t or "").lower().split(), " "] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    found = score_texts(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert math.isfinite(r.score) and r.score < 0


def test_resampling_keeps_or_rejects_by_weight(spark):
    rows = [(i, f"good text number {i} of the set") for i in range(40)] + [(None, None), (90, ""), (91, "junk !! " * 500)]
    labels = spark.createDataFrame([*((i, 1) for i in range(20)), (91, 0), (None, 1)], "doc_id long, quality int")
    drawn = importance_resample(docs(spark, rows), labels, size=10)
    assert drawn.count() == 10 and drawn.columns == ["doc_id", "text", "Node", "score", "log_ratio", "sample_key"]
    ids = {r.doc_id for r in drawn.collect()}
    assert ids == {r.doc_id for r in importance_resample(docs(spark, rows).repartition(3), labels, size=10).collect()}
    none = labels.filter("false")
    assert importance_resample(docs(spark, rows), none).count() == len(rows)


def test_clean_rows_stay(spark):
    items = spark.createDataFrame([(1, BASE), (2, BASE), (3, None), (4, "")], "item_id long, text string")
    left = drop_contaminated(docs(spark), items)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left.collect()) == sorted((i is not None, i or 0) for i, t in ROWS if i not in (6, 7, 8, 10))
    assert {r.item_id for r in benchmark_leaks(docs(spark), items).collect()} == {1}
    assert drop_contaminated(docs(spark), items.limit(0)).count() == len(ROWS)


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    sized = spark.createDataFrame([], "doc_id long, source string, size long")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for found in (near_duplicates(none), exact_top_k(vectors), mix_sources(sized), shard_by_bytes(sized), scan_secrets(none), score_texts(none), remove_repeats(none), importance_resample(none, labels), benchmark_leaks(none, items)):
        assert found.count() == 0


def test_repeats_of_a_long_text_and_equal_ids(spark):
    found = remove_repeats(docs(spark, [(1, "ab" * 150_000), (2, BASE), (2, BASE), (None, BASE), (3, None)])).collect()
    kept = {(r.doc_id, r.n_bytes): [] for r in found}
    for r in found:
        kept[r.doc_id, r.n_bytes].append(len(bytes(r.kept)))
    # "abab...": the strings that begin at bytes 0 and 1 are new, the rest repeat them and cover all but the first two bytes.
    assert kept[1, 300_000] == [2] and kept[None, len(BASE)] == [len(BASE)] and kept[2, len(BASE)] == [0, 0] and kept[3, 0] == [0]

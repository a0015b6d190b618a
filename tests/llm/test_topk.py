import math

import numpy as np
import pyarrow as pa

from tapeloom.llm.topk import LONG_MAX, LONG_MIN, _above, exact_scores, exact_top_k


def held(n):
    return min(max(n, LONG_MIN), LONG_MAX)


def brute(rows, k=5, every=50):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    asked = {}
    for i, v in vectors:
        if i % every == 0:
            asked[i] = min(v, asked.get(i, v))
    want = []
    for q, a in asked.items():
        best = sorted((-held(sum(x * y for x, y in zip(a, v, strict=True))), i) for i, v in vectors if i != q and len(v) == len(a))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def found(spark, rows):
    return sorted(map(tuple, exact_top_k(spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, score long")).collect()))


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    big = [2.0**20, 2.0**20 + 2.0**-8, -(2.0**20)]
    rows = [(i, [float(rng.choice(big)), *map(float, rng.integers(-300, 300, 3) / 256), 1 / 256]) for i in range(0, 120)]
    assert found(spark, rows) == brute(rows)
    rows = [(0, [2.0**20, 1 / 256]), (1, [2.0**20, 1 / 256]), (2, [2.0**20, 0.0]), (3, [2.0**20, 2 / 256])]
    assert found(spark, rows) == brute(rows) and found(spark, rows)[1][3] == 72057594037927937


def test_scores_beyond_longs_are_its_ends(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 2.0]), (2, [-1e12, 2.0]), (3, [1e300, -1e300]), (4, [0.5, 1e300]), (50, [1e-3, 1e12]), (7, [1e8, 1.0]), (8, [2.0**46, 5.0]), (9, [1.7e308, 1.7e308])]
    assert found(spark, rows) == brute([(i, [max(min(x, 7e305), -7e305) for x in v]) for i, v in rows])


def test_limbs_against_python():
    rng = np.random.default_rng(9)
    for scale in (30, 33, 40, 70, 200, 900):
        a, b = (np.floor(rng.uniform(-1, 1, (6, 5)) * 2.0 ** rng.integers(1, scale, (6, 5)).astype(float)) for _ in range(2))
        want = [[held(sum(int(x) * int(y) for x, y in zip(p, q, strict=True))) for q in b] for p in a]
        assert exact_scores(a, b).tolist() == want


def test_equal_vectors_and_repeated_ids(spark):
    rows = [(i % 350, [0.5, 0.25]) for i in range(400)]
    assert found(spark, rows) == brute(rows)
    table = pa.table({"asked": [True] * 8 + [False] * 400, "vec_id": [*range(0, 400, 50), *range(400)], "v": pa.array([[128.0, 64.0]] * 408), "floor": pa.array([128 * 128 + 64 * 64] * 408)})
    kept = _above(5)(table)
    assert kept.num_rows == 8 * 5 and max(kept.column("vec_id").to_pylist()) <= 5

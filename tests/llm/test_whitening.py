"""Whitening against exact sums and a library's eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tapeloom.llm.whitening import LIMIT, fit_whitening, jacobi, products, whiten_vectors, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, i, "x") for i, v in vectors], SCHEMA)


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 40):
        a = rng.normal(size=(d, d))
        a = a @ a.T
        values, vectors = jacobi(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1]) and np.allclose(vectors @ np.diag(values) @ vectors.T, a) and np.allclose(vectors.T @ vectors, np.eye(d))
    # D * H * D with a well-conditioned H: eigenvalues are determined to full relative precision; 2 by 2 as a closed form.
    values, _ = jacobi(np.array([[1.0, 0.5e-10], [0.5e-10, 1e-20]]))
    assert values[1] == pytest.approx(0.75e-20, rel=1e-12)
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitened_rows_against_exact_sums(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(400, 6)) @ np.diag([9, 4, 2, 1, 0.5, 0.2]) @ rng.normal(size=(6, 6)) + 3
    vectors = [(i // 2, v.tolist()) for i, v in enumerate(mixed)] + [(None, mixed[0].tolist()), (7, None), (8, [1.0, None] * 3), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (11, []), (12, [1.0, 2.0])]
    x = [whole(v) for _, v in vectors[:401]]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    found = whiten_vectors(frame(spark, vectors), components=4).collect()
    again = whiten_vectors(frame(spark, vectors).repartition(7), components=4).collect()
    assert len(found) == n and {r.n for r in found} == {n}
    want = sorted((-1 if i is None else i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for (i, _), v in zip(vectors, x, strict=False))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in found) == want
    def told(rows):
        return sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened, r.explained) for r in rows)

    for a, b in zip(told(found), told(again), strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and np.allclose(a[2], b[2], rtol=0, atol=1e-12)
    v = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(6)] for i in range(6)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert np.allclose(found[0].explained, values / np.trace(v), rtol=1e-10) and found[0].identity_error < 1e-9
    by = {(r.vec_id, r.deviation): np.array(r.whitened) for r in found}
    signs = None
    for (i, _), own in zip(mixed_ids(x), x, strict=True):
        w = np.array([float(Fraction(n * c - s, n)) for c, s in zip(own, sums, strict=True)]) @ vectors / np.sqrt(values)
        got = by[i, sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))]
        signs = np.sign(w * got) if signs is None else signs
        assert np.allclose(w * signs, got, atol=1e-8)


def mixed_ids(x):
    return [(None if k == 400 else k // 2, None) for k in range(len(x))]


def test_sums_of_any_size_are_exact(spark):
    rng = np.random.default_rng(4)
    for scale in (10, 19, 25, 39):
        y = rng.integers(-(2**scale), 2**scale, (50, 3))
        assert [[int(c) for c in r] for r in products(y)] == [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    vectors = [(i, [float(c) for c in rng.integers(-(2**33), 2**33, 3)]) for i in range(40)] + [(41, [1e300, -1e300, 0.5])]
    rows = whole_vectors(frame(spark, vectors), "vec_id", "embedding", 64, 1_000_000)
    x = [[min(max(64 * int(c), -LIMIT), LIMIT) + 1_000_000 if abs(c) > 1 else 1_000_032 for c in v] for _, v in vectors]
    assert sorted(r.x for r in rows.collect()) == sorted(x)
    fit, error = fit_whitening(rows, 3)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    trace = sum(Fraction(sum((n * r[i] - sums[i]) ** 2 for r in x), n**3) for i in range(3))
    assert fit.trace == pytest.approx(float(trace), rel=1e-15) and error < 1e-9
    assert {r.deviation for r in whiten_vectors(frame(spark, vectors)).collect()} == {None}


def test_too_little_to_whiten(spark):
    one = whiten_vectors(frame(spark, [(3, [0.5, 0.25])])).collect()
    assert [tuple(r) for r in one] == [(3, 1, 0, [None, None], [0.0, 0.0], 0.0)]
    flat = whiten_vectors(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)])).collect()
    assert all(r.whitened[1:] == [None, None] and r.explained == pytest.approx([1.0, 0.0, 0.0]) for r in flat) and flat[0].identity_error < 1e-9
    assert sum(r.whitened[0] ** 2 for r in flat) == pytest.approx(10)
    for none in ([], [(1, None)], [(1, []), (2, [float("nan")])]):
        assert whiten_vectors(frame(spark, none)).count() == 0


def test_query_has_a_row_a_component(spark, tmp_path):
    from tapeloom.llm.queries import op12_whitening

    rng = np.random.default_rng(5)
    frame(spark, [(i, rng.normal(size=40).tolist()) for i in range(60)]).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = op12_whitening(spark, str(tmp_path))
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = found.collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in range(60) for c in range(1, 33)]
    assert all(np.var([r.whitened for r in rows if r.component == c]) == pytest.approx(1) for c in range(1, 33))

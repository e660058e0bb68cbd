"""Clusters and whitening against plain Python and numpy."""

import hashlib
import math
import random

import numpy as np
import pytest

from larkspur.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int, q int, n int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "own", 1, 2, 3) for i, v in zip(ids, vectors)], SCHEMA)


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min(range(len(cs)), key=lambda c: (far(v, cs[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        cs = [[sum(d) // len(groups[c]) for d in zip(*groups[c])] if c in groups else cs[c] for c in range(len(cs))]
    placed = [(i, near(v), v) for i, v in kept]
    inertia = {c: sum(far(v, cs[c]) for _, k2, v in placed if k2 == c) for c in range(len(cs))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted((repr(i), c, far(v, cs[c]), inertia[c], sum(inertia.values()), names[c]) for i, c, v in placed)


def as_float(values):
    return [None if v is None else float(np.float32(v)) for v in values]


def odd_rows(size):
    rng = random.Random(5)
    rows = [as_float([rng.gauss(0, 0.3) for _ in range(size)]) for _ in range(160)]
    hot = rows[0]
    rows += [hot] * 90 + [rows[1]] * 3
    rows += [None, [], rows[2][:-1], [None, *rows[2][1:]], [float("nan"), *rows[2][1:]], [float("-inf"), *rows[2][1:]]]
    ids = [*range(len(rows) - 3), None, 4, 4]
    return rows, ids


def test_clusters_equal_brute_force(spark):
    rows, ids = odd_rows(6)
    ids[150], ids[151] = None, 7  # a null and a repeated id among the kept ones
    for k in (12, 1000):
        got = centroids.cluster(table(spark, rows, ids), k, 4, 6)
        assert sorted((repr(r.vec_id), *r[1:]) for r in got.collect()) == brute_clusters(list(zip(ids, rows)), k, 4, 6)


def test_clusters_of_nothing_and_of_equal_vectors(spark):
    assert centroids.cluster(table(spark, []), 40, 5, 6).collect() == []
    got = centroids.cluster(table(spark, [[0.5] * 6] * 50), 40, 5, 6).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50


def test_large_entries(spark):
    rows = [[float(2**17 + i), -float(2**17), 0.0] for i in range(5)]
    assert sorted((repr(r.vec_id), *r[1:]) for r in centroids.cluster(table(spark, rows), 2, 2, 3).collect()) == brute_clusters(list(enumerate(rows)), 2, 2, 3)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [[1e30, 0.0, 0.0]]), 2, 2, 3).collect()


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 64):
        m = rng.normal(size=(size, 3 * size))
        values, vectors = whitening.jacobi(m @ m.T)
        assert np.allclose(values, np.linalg.eigvalsh(m @ m.T)[::-1]) and np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-13)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, m @ m.T)
    # graded by 1e-8 a step: a solver with absolute errors loses the small ones
    scale = np.diag(10.0 ** -np.arange(0, 32, 8))
    core = np.array([[1, 0.3, 0.2, 0.1], [0.3, 1, 0.3, 0.2], [0.2, 0.3, 1, 0.3], [0.1, 0.2, 0.3, 1]])
    values, _ = whitening.jacobi(scale @ core @ scale)
    schur = [1.0] + [1 / np.linalg.inv(core[: k + 1, : k + 1])[k, k] for k in range(1, 4)]
    assert np.allclose(values / np.diag(scale) ** 2, schur, rtol=1e-6)


def test_whitening_equals_numpy(spark):
    rows, ids = odd_rows(6)
    ids[150], ids[151] = None, 7
    got = whitening.whiten(table(spark, rows, ids), components=4).collect()
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in zip(ids, rows) if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x, n = np.array([v for _, v in kept]), len(kept)
    assert len(got) == 4 * n
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = x.sum(0)
    expected = ((x - sums / n) @ vectors / np.sqrt(values))[:, :4]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, rs in by.items():
        assert all(r.n == n and r.identity_error < 1e-9 for r in rs)
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-9 for r in rs)
        want = sorted((repr(i), int(((n * v - sums) ** 2).sum()), float(e)) for (i, _), v, e in zip(kept, x, expected[:, c - 1]))
        ours = sorted((repr(r.vec_id), r.deviation, r.whitened) for r in rs)
        assert [w[:2] for w in want] == [o[:2] for o in ours]
        far = lambda sign: max(abs(w - o) for w, o in zip(sorted(x[2] for x in want), sorted(sign * x[2] for x in ours)))
        assert min(far(1), far(-1)) < 1e-8


def test_whitening_of_few_rows_and_none(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [None, [], [float("nan")]])).collect() == []
    one = whitening.whiten(table(spark, [[0.5, 1.5]])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    line = whitening.whiten(table(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and max(r.identity_error for r in line) < 1e-12
    wide = whitening.whiten(table(spark, [[float(2**23), 0.0], [-float(2**23), 1.0]])).collect()
    assert {r.deviation for r in wide} == {(2**30) ** 2 + 64**2}
    mixed = whitening.whiten(table(spark, [[1.0], [2.0], [1.0, 2.0], [3.0, 5.0], [2.0, 2.5]])).collect()
    assert {r.vec_id for r in mixed} == {2, 3, 4}

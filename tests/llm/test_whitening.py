"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest

from artifactgate.llm import whitening


def spectrum(kind, d, rng):
    return {"any": rng.random(d) * 500, "flat": 400 + rng.random(d), "steep": 10.0 ** rng.uniform(-8, 3, d), "equal": np.full(d, 3.0), "pairs": np.repeat(np.arange(1, d // 2 + 2), 2)[:d].astype(float), "poor": np.where(np.arange(d) < 3, np.arange(d) + 1.0, 0)}[kind]


@pytest.mark.parametrize("kind", ["any", "flat", "steep", "equal", "pairs", "poor"])
@pytest.mark.parametrize("d", [1, 2, 5, 64, 150])
def test_components_of_a_matrix(kind, d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = (q * spectrum(kind, d, rng)) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * want[0]


def test_polar_factor_of_an_ill_conditioned_matrix():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    e = np.r_[10.0 ** -np.arange(1.0, 13.0), -(10.0 ** -np.linspace(0, 10, 28))]
    u = whitening.polar((q * e) @ q.T)
    assert np.abs(u.T @ u - np.eye(40)).max() < 1e-12
    assert np.abs((u + u.T) / 2 - (q * np.sign(e)) @ q.T).max() < 1e-2  # eigenvalues of 1e-12 keep few digits


def brute(rows, most=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in good}:
        x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == d]
        fit = sorted({v for _, v in x})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
        values, vectors = np.linalg.eigh(z.T @ z / n)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        for i, v in x:
            centred = np.array([(n * a - s) / n for a, s in zip(v, sums)])
            for k in range(len(values)):
                if values[k] > 1e-9 * values[0] and values[0] > 0:
                    out[i, k + 1] = n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), abs(centred @ vectors[:, k] / math.sqrt(values[k])), values[k] / (z**2).sum() * n
    return out


def test_operator(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(20) * np.linspace(1, 3, 20)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(200)]
    rows += [(600, None), (601, []), (602, [1.0] * 19 + [None]), (603, [float("nan")] * 20), (604, [math.inf] * 20), (605, [1e300] * 20)]
    rows += [(700 + i, (rng.standard_normal(3) * 2.0**30).tolist()) for i in range(50)] + [(800, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, i % 3, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int, n int").repartition(4)
    got = whitening.whitened(frame).collect()
    want = brute([r for r in rows if r[0] != 605])
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
        assert abs(abs(r.whitened) - white) < 1e-7 and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9


def test_signs_are_the_same_for_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)) * np.arange(1, 9)
    got = whitening.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<float>")).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], "vec_id int, embedding array<float>")
    assert whitening.whitened(empty).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<float>")).collect() == []

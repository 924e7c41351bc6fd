"""Whitening against numpy's symmetric eigenvalues and exact integers."""

import numpy as np
import pytest

from accordis.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string"


def made(vectors, first=0):
    return [(first + i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "n", "c") for i, v in enumerate(vectors)]


def whole(vectors):
    return [np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for v in vectors]


def held(spark, vectors, **more):
    return whitening.whiten(spark.createDataFrame(made(vectors, **more), SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(700, 12)) @ np.diag([3, 2, 1.5, 1.2, *[0.4] * 7, 1e-3]) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 5
    return [*spread.tolist(), *[spread[0].tolist()] * 300]  # copies count once in the fit


def test_against_eigenvalues(spark, vectors):
    odd = [None, [], [1.0] * 11, [None, *[1.0] * 11], [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11]]
    got = held(spark, vectors + odd).collect()
    x = np.array(whole(vectors))
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fitted.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(4):
        want = (x - s / n) @ axes[:, k] / np.sqrt(values[k])
        have = np.array([by[i, k + 1].whitened for i in range(len(x))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert by[0, k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        cov = np.cov(np.array([by[int(np.flatnonzero((x == f).all(axis=1))[0]), k + 1].whitened for f in fitted]), bias=True)
        assert cov == pytest.approx(1, abs=1e-9)
    assert [by[i, 1].deviation for i in range(len(x))] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_blocks_and_factors_of_any_number(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    monkeypatch.setattr(whitening, "FAN", 2)
    one, other = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(spark.createDataFrame(made(vectors), SCHEMA).repartition(p)).collect()} for p in (1, 9))
    assert one.keys() == other.keys() and max(abs(one[k] - other[k]) for k in one) < 1e-9


@pytest.mark.parametrize("shape", [(40, 1), (40, 2), (40, 5), (5, 40), (300, 33)])
def test_jacobi(shape):
    r = np.random.default_rng(1).normal(size=shape) @ np.diag(np.logspace(0, -12, shape[1]))
    lengths, v = whitening.jacobi(np.linalg.qr(r, mode="r"))
    assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-13
    want = np.linalg.svd(r, compute_uv=False)
    assert np.abs(lengths[: len(want)] / want - 1)[want > 1e-9 * want[0]].max() < 1e-6 and np.abs(lengths[0] / want[0] - 1) < 1e-13


def test_small_deviations_are_not_lost():
    """A variance 16 digits below the largest: a covariance in doubles couldn't tell it from zero."""
    lengths, _ = whitening.jacobi(np.array([[1.0, 1.0], [0.0, 1e-10], [0.0, 0.0]]))
    assert lengths[1] == pytest.approx(1e-10 / np.sqrt(2), rel=1e-6)


def test_flat_data(spark):
    assert held(spark, []).collect() == [] and held(spark, [None, []]).collect() == []
    assert held(spark, [[1.0, 2.0]] * 9).collect() == []
    line = held(spark, [[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0]]).collect()  # one component only
    assert {r.component for r in line} == {1} and {r.n for r in line} == {3} and {r.explained for r in line} == {1.0}
    assert sorted(abs(r.whitened) for r in line) == pytest.approx([0, 0, 1.5**0.5, 1.5**0.5])


def test_large_components(spark):
    got = held(spark, [[3e6, 0.0], [-3e6, 1.0], [0.0, 2.0], [1.0, 1.0]]).collect()
    x = [[768000000, 0], [-768000000, 256], [0, 512], [256, 256]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(row, s, strict=True)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 2**63 else None for i, v in want.items()}

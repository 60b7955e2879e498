import math
import os

import numpy as np
import pytest

from rookery.llm import whitening

DATA = "/root/testdata/sf0.01"


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 64, 64), np.r_[1e6, 1e3, 990, 5, 4.999, 4.99, np.linspace(4, 1, 40)], np.r_[np.full(12, 7.0), np.ones(20)], np.r_[3, 2, np.zeros(20)], np.full(64, 3.0), np.r_[np.full(40, 3.0), np.full(24, 2.999)], [5.0], [2.0, 1.0], np.linspace(1, 2, 300), 1 + np.random.default_rng(1).random(64) * 0.05],
)
def test_components_against_a_dense_solver(values):
    v = spectrum(np.array(values, float))
    got, axes = whitening.components(v)
    want = np.linalg.eigvalsh(v)[::-1][: len(got)]
    assert len(got) == min(8, int((np.array(values) > 1e-9).sum()))
    assert got == pytest.approx(want, rel=1e-12, abs=1e-14 * len(v) * want[0])
    assert np.abs(v @ axes - axes * got).max() < 1e-12 * want[0] and np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-10


def test_inertia_counts():
    v = spectrum(np.array([5.0, 4, 4, 1, -2]))
    sides = whitening.tridiagonal(v)
    assert [whitening.count_above(*sides, s) for s in (6, 4.5, 3, 0, -3)] == [0, 1, 3, 4, 5]


def plain(rows):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), by integers and a dense solver."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    z = np.array(y, float).reshape(n, width) / max(n, 1)
    v = z.T @ z / max(n, 1)
    e, u = np.linalg.eigh(v)
    out = []
    for k in range(min(8, width)):
        if e[-1 - k] > 1e-9:
            w = z @ u[:, -1 - k] / np.sqrt(e[-1 - k])
            out += [(i, k + 1, n, min(sum(a * a for a in r), (1 << 63) - 1), abs(c), e[-1 - k] / np.trace(v)) for (i, _), r, c in zip(kept, y, w)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def found(df):
    rows = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.array([r[4:] for r in got]).ravel() == pytest.approx(np.array([r[4:] for r in want]).ravel(), abs=1e-8)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n string, component string, v string"
    make = lambda rows: spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)
    rows = [(1, [0.1, 0.2, -0.3]), (1, [0.1, 0.2, -0.3]), (None, [0.5, -0.2, 0.1]), (3, None), (4, [0.1, None, 0.2]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [0.9]), (8, []), (9, [-0.4, 0.8, 0.31])]
    same(found(whitening.whitened(make(rows))), plain(rows))
    assert whitening.whitened(make([])).collect() == [] and whitening.whitened(make([(1, [0.5, 0.5])])).collect() == [] and whitening.whitened(make([(1, []), (2, None)])).collect() == []
    assert whitening.whitened(make([(i, [0.5, 0.25]) for i in range(9)])).collect() == []
    far = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e300, 0.5])]
    assert len(whitening.whitened(make(far)).collect()) >= 3  # past long's limits: defined, if not exact


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=2) * 1e4]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(found(whitening.whitened(df)), plain(rows))


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_query_against_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    df = whitening.op11_embedding_whitening(spark, DATA)
    same(found(df), plain(rows))
    errors = {r.identity_error for r in df.collect()}
    assert len(errors) == 1 and errors.pop() < 1e-10

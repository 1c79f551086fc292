from __future__ import annotations

import math
import random

import numpy as np
import pytest

from nightspark.llm import whitening


def brute(rows, components=4):
    """The contract row by row with whole numbers and a dense eigen-decomposition."""
    valid = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(256 * c) for c in v]) for i, v in valid]
    fit = sorted({tuple(x) for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, x in xs:
        c = np.array([(n * x[j] - s[j]) / n for j in range(d)])
        for k in range(components):
            if e[k] > 1e-12 * e[0]:
                deviation = sum((n * x[j] - s[j]) ** 2 for j in range(d))
                out.setdefault((i, k + 1), []).append((n, deviation if deviation < 2**63 else None, abs(c @ v[:, k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def check(spark, rows, **kw):
    schema = "vec_id long, embedding array<double>, label int, component string, n string, _x string, i string"
    df = spark.createDataFrame([(i, v, 1, "c", "n", "x", "i") for i, v in rows], schema)
    got = whitening.whiten(df.repartition(5), **kw).collect()
    want = brute(rows)
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.component) for r in got) == sorted((i is not None, i or 0, k) for (i, k), x in want.items() for _ in x)
    for r in got:
        assert r.identity_error < 1e-9
        n, deviation, whitened, explained = next(x for x in want[(r.vec_id, r.component)] if x[1] == r.deviation)
        assert r.n == n and abs(r.explained - explained) < 1e-9 * explained
        assert any(abs(abs(r.whitened) - x[2]) < 1e-6 * max(1, x[2]) for x in want[(r.vec_id, r.component)])
    return got


def test_whitening_against_dense_eigenvectors(spark):
    rng = random.Random(3)
    mix = np.random.default_rng(0).normal(size=(7, 7)) * np.array([5, 3, 2, 1.5, 1, 0.5, 0.1])[:, None]
    rows = [(i, [float(c) for c in np.array([rng.gauss(0, 1) for _ in range(7)]) @ mix]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[9][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 7), (2004, [0.0, float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (2005, [-0.0] * 7)]
    got = check(spark, rows)
    # one sign for all rows of a component
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    first = {k: {r.vec_id: r.whitened for r in x} for k, x in by.items()}
    for k, x in first.items():
        assert {x[1000 + i] for i in range(200)} == {x[0]}
    fit = {}
    for r in got:
        fit.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    distinct = np.array(sorted({tuple(x[k] for k in range(1, 5)) for x in fit.values()}))
    assert np.abs(np.cov(distinct.T, bias=True) - np.eye(4)).max() < 1e-9


def test_ill_conditioned_and_flat_directions(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 3)) * [1e4, 10.0, 1.0]
    flat = np.column_stack([base, base[:, 0], np.full(400, 7.0)])
    got = check(spark, [(i, [float(c) for c in v]) for i, v in enumerate(np.round(flat))])
    assert {r.component for r in got} == {1, 2, 3}


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.collect() == [] and [f.name for f in empty.schema][:2] == ["vec_id", "component"]
    for rows in ([(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [1.0, 2.0])], schema)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.n, r.deviation, abs(round(r.whitened, 12)), r.explained) for r in got] == [(1, 2, 256**2, 1.0, 1.0), (2, 2, 256**2, 1.0, 1.0)]


@pytest.mark.parametrize("size", [1e3, 1e12, 1e300])
def test_deviation_is_exact_or_null(spark, size):
    rows = [(i, [size * i, 1.0]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    hold = lambda c: min(max(math.floor(256 * c), -(2**63)), 2**63 - 1) if math.isfinite(256 * c) else 2**63 - 1
    x = [[hold(c) for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    s = [sum(v[j] for v in fit) for j in range(2)]
    want = [sum((len(fit) * v[j] - s[j]) ** 2 for j in range(2)) for v in x]
    assert got == {i: w if w < 2**63 else None for i, w in enumerate(want)}

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from nightspark.operators import folds

FEATURES = ["a", "b", "c"]


def table(spark, owners, per, seed=0, missing=0.1):
    rng = random.Random(seed)
    rows = []
    for o in range(owners):
        shift = rng.gauss(0, 1)
        # one owner holds a third of all rows
        for _ in range(per * owners // 2 if o == 0 else per):
            x = [rng.gauss(shift, 1), round(rng.gauss(5, 3)), rng.random() * 1000 + 1e4]
            y = int(rng.random() < 1 / (1 + np.exp(-(x[0] - 0.3 * x[1] + 0.001 * (x[2] - 1e4) - 0.2))))
            rows.append((o, *[None if rng.random() < missing else float(v) for v in x], y, len(rows)))
    rows += [(1, 0.5, 1.0, None, None, -1), (None, 0.5, 1.0, 3.0, 1, -2)]
    return rows, spark.createDataFrame(rows, "owner long, a double, b double, c double, y int, id long").repartition(6)


def brute_inputs(rows, out):
    """Filled and scaled training rows and the scaled held-out rows."""
    train = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows if r[0] not in (out, None) and r[4] is not None], float)
    y = np.array([r[4] for r in rows if r[0] not in (out, None) and r[4] is not None])
    median = np.nanmedian(train, axis=0)
    train = np.where(np.isnan(train), median, train)
    mean, std = train.mean(0), train.std(0)
    return (train - mean) / std, y, median, mean, std


def test_coefficients_equal_the_library_fit(spark):
    rows, df = table(spark, 6, 40)
    scored, models = folds.out_of_fold(df, FEATURES, "y", "owner", ["id"])
    got = {r.id: r for r in scored.collect()}
    assert set(got) == {r[5] for r in rows if r[0] is not None}
    for out in (0, 1, 5):
        x, y, median, mean, std = brute_inputs(rows, out)
        k = models.names.index(out)
        assert np.allclose(models.median[k], median) and np.allclose(models.mean[k], mean) and np.allclose(models.std[k], std)
        n = len(y)
        weight = {c: n / (2 * (y == c).sum()) for c in (0, 1)}
        train = spark.createDataFrame([(float(c), float(weight[int(c)]), Vectors.dense(v)) for c, v in zip(y, x, strict=True)], ["y", "w", "v"])
        fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1 / n, standardization=False, maxIter=500, tol=1e-13).fit(train)
        want = np.concatenate([[fit.intercept], fit.coefficients.toArray()])
        assert np.abs(models.coef[k] - want).max() < 1e-6
        for r in rows:
            if r[0] == out:
                v = np.array([m if z is None else z for z, m in zip(r[1:4], median, strict=True)])
                p = 1 / (1 + np.exp(-(models.coef[k][0] + ((v - mean) / std) @ models.coef[k][1:])))
                assert abs(got[r[5]].probability[1] - p) < 1e-9 and got[r[5]].fold_status == "fitted"
    assert folds.coefficients(spark, models).filter("fold is null").count() == 4


def test_a_thousand_owners_take_no_more_scans(spark, monkeypatch):
    rng = np.random.default_rng(1)
    scans = []
    real = folds.summed
    monkeypatch.setattr(folds, "summed", lambda *a: scans.append(1) or real(*a))
    for owners in (10, 1000):
        n = 3000
        o, x = rng.integers(0, owners, n), rng.normal(size=(n, 3))
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        df = spark.createDataFrame([(int(a), *map(float, v), int(c), i) for i, (a, v, c) in enumerate(zip(o, x, y, strict=True))],
                                   "owner long, a double, b double, c double, y int, id long")
        scans.clear()
        scored, models = folds.out_of_fold(df, FEATURES, "y", "owner", ["id"])
        assert scored.count() == n and len(models.names) == len(set(o.tolist())) and len(scans) <= 10
        k = 7
        keep = o != models.names[k]
        z = (x[keep] - x[keep].mean(0)) / x[keep].std(0)
        p = 1 / (1 + np.exp(-(models.coef[k][0] + z @ models.coef[k][1:])))
        w = np.where(y[keep] == 1, keep.sum() / (2 * y[keep].sum()), keep.sum() / (2 * (1 - y[keep]).sum()))
        grad = np.concatenate([[(w * (p - y[keep])).sum()], (w * (p - y[keep])) @ z + models.coef[k][1:]])
        assert np.abs(grad).max() < 1e-5


def test_medians_without_an_owner(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.choice([None, float(rng.randrange(6)), rng.random()]), None if rng.random() < 0.9 else 1.0) for _ in range(400)]
    rows += [(5, 2.0, 3.0)] * 300
    got = folds.leave_out_medians(spark.createDataFrame(rows, "_f int, a double, b double"), ["a", "b"], 6)
    for f in range(7):
        for j in (0, 1):
            values = [r[1 + j] for r in rows if r[0] != f and r[1 + j] is not None]
            assert got[f, j] == pytest.approx(np.median(values))


def test_one_class_and_small_tables(spark):
    schema = "owner string, a double, y int"
    rows = [("p", 1.0, 1), ("p", 2.0, 1), ("q", None, 0), ("q", 3.0, 0), ("q", 4.0, None)]
    scored, _ = folds.out_of_fold(spark.createDataFrame(rows, schema), ["a"], "y", "owner", [])
    assert {(r.owner, r.fold_status, tuple(r.probability)) for r in scored.collect()} == {("p", "one_class", (1.0, 0.0)), ("q", "one_class", (0.0, 1.0))}
    scored, _ = folds.out_of_fold(spark.createDataFrame(rows[:2], schema), ["a"], "y", "owner", [])
    assert [(r.prediction, r.probability) for r in scored.collect()] == [(None, None)] * 2
    scored, models = folds.out_of_fold(spark.createDataFrame([], schema), ["a"], "y", "owner", [])
    assert scored.collect() == [] and models.names == []

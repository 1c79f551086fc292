from __future__ import annotations

import threading

import numpy as np

from nightspark.operators import lloyd
from nightspark.plans.model_queries import together


def test_a_scan_has_no_more_tasks_than_cores_and_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double").repartition(40)
    rows = lloyd.prepared(df, ["a", "b", "c"], ["id"])
    table = lloyd.packed(rows)
    assert table.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
    got = np.concatenate([np.frombuffer(r.x).reshape(-1, 3) for r in table.collect()])
    assert np.allclose(got[np.lexsort(got.T)], x[np.lexsort(x.T)])
    # fits of several K, whole and on samples, are fixed points of the plain step on their rows
    for f in lloyd.lloyd(rows, [lloyd.Start(4, 1), lloyd.Start(2, 1), lloyd.Start(4, 7, 0.5, 3)]):
        hashed = np.array([r["_row"] for r in rows.orderBy("id").collect()])
        mine = x[lloyd.in_sample(hashed, f.start)]
        label = ((mine[:, None] - f.centres) ** 2).sum(2).argmin(1)
        assert np.allclose(f.centres, [mine[label == j].mean(0) for j in range(f.start.k)], atol=1e-6)
        assert f.counts.tolist() == np.bincount(label, minlength=f.start.k).tolist()
        assert np.isclose(f.inertia, ((mine - f.centres[label]) ** 2).sum())


def test_fits_run_beside_each_other(spark):
    all_here = threading.Barrier(3, timeout=20)

    def work(n):
        all_here.wait()
        return spark.range(n).count()

    assert together(spark, work, [1, 2, 3]) == [1, 2, 3] and together(spark, work, []) == []

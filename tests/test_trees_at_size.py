from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightspark.operators import trees
from nightspark.operators.trees import Growth


def test_bagged_trees_stay_in_tasks(spark):
    """The driver gets sums of held-out rows and shares of features; trees are grown again when asked for, and give the same scores."""
    df = spark.range(400).select(
        "id", (F.col("id") % 4).alias("owner"), (F.col("id") * 37 % 101 / 10).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") * 11 % 13).cast("double").alias("b"),
        F.when(F.col("id") % 50 > 0, (F.col("id") * 37 % 101 > 40).cast("int") + (F.col("id") % 3 == 0).cast("int")).alias("k"))
    growth = Growth(boosted=False, classes=3, trees=45, depth=6, leaf_rows=2, share=0.6)
    out, forest = trees.out_of_fold(df, ["a", "b"], ["k"], "owner", ["id"], growth)
    assert isinstance(forest, trees.Bagged) and len(forest) == 4
    rows = out.collect()
    assert {r.id for r in rows} == set(range(400)) and len(rows) == 400
    edges = trees.edges_of(df.select(F.col("a"), F.col("b")), ["a", "b"], 64)
    held = {o: forest["k", o] for o in range(4)}
    x = {r.id: (r.a, r.b, r.owner) for r in df.collect()}
    for r in rows[:60]:
        a, b, o = x[r.id]
        codes = np.array([[0 if v is None else 1 + np.searchsorted(e, v, "left") for v, e in zip((a, b), edges, strict=True)]], np.uint8)
        want = np.mean([t[4][trees.walk(t, codes)[0]] for t in held[o]], axis=0)
        assert r.probability == pytest.approx(list(want))
    for by_gain in (True, False):
        one, two = ({r.feature: (r["mean"], r.sd) for r in trees.importances(spark, f, ["a", "b"], by_gain=by_gain).collect()} for f in (forest, dict(forest)))
        assert {f: pytest.approx(v) for f, v in two.items()} == one


def test_many_boosted_rows_grow_in_tasks(spark, monkeypatch):
    """Over 200,000 different rows are no job a level; in a model rows of equal bins of all folds and classes are one row."""
    monkeypatch.setattr(trees, "grown", lambda *a: pytest.fail("a job a level"))
    df = spark.range(240_000).select(
        "id", (F.col("id") % 3).alias("owner"), *[(F.xxhash64("id", F.lit(i)) % 1000).cast("double").alias(c) for i, c in enumerate("abcd")], (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
    assert len(trees.out_of_fold(df, list("abcd"), ["y"], "owner", ["id"], Growth(trees=2, depth=2))[1]) == 3
    seen, real = [], trees.boosted_tree
    monkeypatch.setattr(trees, "boosted_tree", lambda tree, codes, *a: seen.append(len(codes)) or real(tree, codes, *a))
    codes = np.repeat(np.arange(10, dtype=np.uint8), 40)[:, None]
    y, fold = np.tile([0, 1, 1, 0], 100).astype(np.int8)[:, None], np.tile(np.arange(8), 50)
    assert len(list(trees.trained(trees.Model(0, 7, (1.0, 1.0), 7), codes, fold, y, np.ones(400, np.int64), Growth(trees=2, depth=2)))) == 2
    assert seen == [10, 10]

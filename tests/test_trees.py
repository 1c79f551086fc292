from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from nightspark.operators import trees
from nightspark.operators.trees import Growth


def rows_of(n=600, owners=5, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        o = 0 if i % 3 == 0 else rng.randrange(owners)
        a, b, c = rng.gauss(0, 1), rng.randrange(5), None if rng.random() < 0.1 else rng.random()
        y = int((a > 0.2) != (b > 2)) if rng.random() < 0.9 else 1
        out.append((o, a, float(b), c, y, int(a > 0) + int(b > 1), i))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "owner long, a double, b double, c double, y int, k int, id long").repartition(4)


@pytest.mark.parametrize(("growth", "labels"), [
    (Growth(trees=10, depth=3, bins=16), ["y"]), (Growth(boosted=False, classes=3, trees=6, depth=6, leaf_rows=2, share=0.5, bins=16), ["k"])])
def test_both_ways_grow_the_same_trees(spark, growth, labels):
    df = table(spark, rows_of())
    got = {}
    for small in (10**6, 0):
        scored, grown = trees.out_of_fold(df, ["a", "b", "c"], labels, "owner", ["id"], growth, small=small)
        got[small] = {r.id: tuple(r.probability) for r in scored.collect()}
        assert len(grown) == 5 and all(len(t) == growth.trees for t in grown.values())
    assert got[0].keys() == got[10**6].keys()
    assert max(np.abs(np.subtract(got[0][i], got[10**6][i])).max() for i in got[0]) < 1e-9


def test_first_split_by_brute_force(spark):
    rows = rows_of(200, 3)
    growth = Growth(trees=1, depth=1, bins=64, share=1.0)
    _, grown = trees.out_of_fold(table(spark, rows), ["a", "b", "c"], ["y"], "owner", ["id"], growth)
    for out in range(3):
        train = [r for r in rows if r[0] != out]
        weight = {c: len(train) / (2 * sum(r[4] == c for r in train)) for c in (0, 1)}
        g = [weight[r[4]] * (0.5 - r[4]) for r in train]
        h = [weight[r[4]] / 4 for r in train]
        feature, cut, _, _, value, gained = grown["y", out][0]
        edges = trees.edges_of(table(spark, rows), ["a", "b", "c"], 64)
        gains = {}
        for j in range(3):
            codes = [0 if r[1 + j] is None else 1 + sum(e < r[1 + j] for e in edges[j]) for r in train]
            for border in range(64):
                sides = [[i for i, k in enumerate(codes) if k <= border], [i for i, k in enumerate(codes) if k > border]]
                if min(map(len, sides)) >= 20:
                    gains[j, border] = (sum(sum(g[i] for i in s) ** 2 / sum(h[i] for i in s) for s in sides), sides)
        best = max(x[0] for x in gains.values())
        gain, sides = gains[int(feature[0]), int(cut[0])]
        assert gain == pytest.approx(best) and gained[0] == pytest.approx(best - sum(g) ** 2 / sum(h))
        for s, v in zip(sides, value[1:, 0], strict=True):
            assert v == pytest.approx(-growth.rate * sum(g[i] for i in s) / sum(h[i] for i in s))


def test_held_out_accuracy_and_statuses(spark):
    df = table(spark, rows_of(900) + [(9, 1.0, 1.0, 1.0, None, None, -1), (None, 1.0, 1.0, 1.0, 1, 1, -2)])
    scored, _ = trees.out_of_fold(df, ["a", "b", "c"], ["y", "k"], "owner", ["id"], Growth(trees=80, depth=4))
    rows = scored.collect()
    assert {r.id for r in rows} == {*range(900), -1} and {r.target for r in rows} == {"y", "k"}
    y = [(r.prediction, r["_label"]) for r in rows if r.target == "y" and r["_label"] is not None]
    assert np.mean([a == b for a, b in y]) > 0.85
    forest, grown = trees.out_of_fold(df, ["a", "b", "c"], ["k"], "owner", ["id"], Growth(boosted=False, classes=3, trees=40, depth=8, leaf_rows=2, share=0.6))
    assert np.mean([r.prediction == r["_label"] for r in forest.collect() if r["_label"] is not None]) > 0.9
    shares = {r.feature: r.mean for r in trees.importances(spark, grown, ["a", "b", "c"]).collect()}
    assert shares.keys() == {"a", "b", "c"} and sum(shares.values()) == pytest.approx(1)
    one = spark.createDataFrame([("p", 1.0, 1, 1), ("q", 2.0, 0, 2), ("r", None, None, 3)], "owner string, a double, y int, id long")
    got = {r.owner: (r.fold_status, r.probability) for r in trees.out_of_fold(one, ["a"], ["y"], "owner", ["id"], Growth(trees=2))[0].collect()}
    assert got["p"] == ("one_class", [1.0, 0.0]) and got["q"] == ("one_class", [0.0, 1.0]) and got["r"][0] == "fitted"
    assert trees.out_of_fold(one.limit(0), ["a"], ["y"], "owner", ["id"], Growth(trees=2))[0].collect() == []


def test_draws_are_fair():
    w = trees.bagged_weights(np.arange(50_000), 7)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    used = np.zeros(6)
    for s in range(400):
        used += trees.Tree(trees.seeded(s), 1).allowed(6, Growth(share=0.5))[0]
    assert (abs(used - 200) < 50).all()
    assert len(set(itertools.starmap(trees.seeded, itertools.product(range(30), range(30))))) == 900


def test_deep_bagged_splits_and_equal_rows(spark, monkeypatch):
    """Splits over filled bins equal those over all bins; equal rows of a boosted fit are one row; bagged models are cut into tasks."""
    rng = np.random.default_rng(5)
    growth = Growth(boosted=False, classes=3, leaf_rows=2, bins=16)
    codes, y, times = rng.integers(0, 16, (400, 4)).astype(np.uint8), rng.integers(0, 3, 400), rng.integers(1, 5, 400).astype(float)
    slot, weight = np.concatenate([np.arange(60), rng.integers(0, 60, 340)]), np.array([1.0, 0.7, 1.9])
    picks = np.sort(np.stack([rng.permutation(4)[:2] for _ in range(60)]), 1)
    allowed = np.zeros((60, 4), bool)
    np.put_along_axis(allowed, picks, True, 1)
    sums = trees.row_sums(growth, y, weight, None, times)
    dense = trees.best_splits(trees.histogram(codes, slot, sums, 60, 16), allowed, growth)
    sparse = trees.bagged_splits(codes, slot, y, times, picks, weight, growth)
    assert np.array_equal(dense.feature, sparse.feature) and (dense.feature >= 0).any()
    found = dense.feature >= 0
    assert np.array_equal(dense.cut[found], sparse.cut[found]) and np.allclose(dense.left[found], sparse.left[found]) and np.allclose(dense.total, sparse.total)
    seen = []
    real = trees.in_tasks
    monkeypatch.setattr(trees, "in_tasks", lambda data, *a: seen.append(data.count()) or real(data, *a))
    thrice = [(*r[:6], 3 * r[6] + i) for r in rows_of(200) for i in range(3)]
    _, grown = trees.out_of_fold(table(spark, thrice), ["a", "b", "c"], ["y"], "owner", ["id"], Growth(trees=4, depth=3))
    assert seen[0] <= 200 and len(grown) == 5
    _, grown = trees.out_of_fold(table(spark, rows_of(200)), ["a", "b", "c"], ["k"], "owner", ["id"], Growth(boosted=False, classes=3, trees=25, depth=3))
    assert all(len(t) == 25 for t in grown.values())

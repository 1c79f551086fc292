from __future__ import annotations

import hashlib
import random
from unittest.mock import MagicMock

import numpy as np
import pytest

from nightspark.operators import resampling
from nightspark.plans import catalog, registry  # noqa: F401


@pytest.mark.parametrize("query, operator, given", [
    ("bootstrap_median_ci", "bootstrap_median", (1000,)), ("stabilization_curve", "stabilization_curve", ((1, 2, 3, 5, 7, 10), 1000, 10)),
    ("stabilization_curve_full", "stabilization_curve", ((1, 2, 3, 5, 7, 10, 14), 1000, 14))])
def test_registered_with_the_references_replicates(monkeypatch, query, operator, given):
    seen = []
    monkeypatch.setattr(registry, "layers", lambda *_: MagicMock())
    monkeypatch.setattr(registry, "tidy", lambda df: df)
    monkeypatch.setattr(resampling, operator, lambda *args: seen.append(args))
    registry.QUERIES[query](None, "")
    assert seen[0][-len(given):] == given


def test_stabilization_curve_equals_brute_force(spark):
    rng, ks, reps = random.Random(3), (1, 2, 3, 5, 7, 10, 14), 20
    nights = {p: {f"{p}-{i}": rng.uniform(0, 40) for i in range(n)} for p, n in (("a", 14), ("b", 20), ("c", 13), ("d", 17))}
    df = spark.createDataFrame([(p, k, v) for p, own in nights.items() for k, v in own.items()] + [("a", "a-null", None)], "p string, night string, v double")
    out = {r.k: r for r in resampling.stabilization_curve(df, "p", "night", "v", ks, reps, 14).collect()}
    kept = [own for own in nights.values() if len(own) >= 14]
    refs = np.array([np.mean(list(own.values())) for own in kept])
    level = lambda x: np.digitize(x, [5, 15, 30])
    assert set(out) == set(ks)
    for k in ks:
        mae, rmse, corr, same = [], [], [], []
        for rep in range(reps):
            picks = [sorted(own, key=lambda n: hashlib.md5(f"{rep}|{n}".encode()).hexdigest())[:k] for own in kept]
            mean = np.array([np.mean([own[n] for n in some]) for own, some in zip(kept, picks, strict=True)])
            mae.append(np.abs(mean - refs).mean())
            rmse.append(np.sqrt(((mean - refs) ** 2).mean()))
            corr.append(np.corrcoef(mean, refs)[0, 1])
            same.append((level(mean) == level(refs)).mean())
        for name, values in (("mae", mae), ("corr", corr), ("agreement", same)):
            for p, q in (("p025", 0.025), ("median", 0.5), ("p975", 0.975)):
                assert np.isclose(out[k][f"{name}_{p}"], np.quantile(values, q)), (k, name, p)
        assert np.isclose(out[k].rmse_median, np.median(rmse)) and out[k].n_patients == 3


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_median_places_follow_the_bootstrap(n):
    got = resampling.median_places(n, 40_000, 5)
    rng = np.random.default_rng(1)
    sample = np.sort(rng.integers(0, n, (40_000, n)), axis=1)
    for mine, want in zip(got, (sample[:, (n - 1) // 2], sample[:, n // 2]), strict=True):
        a, b = np.bincount(mine, minlength=n) / 40_000, np.bincount(want, minlength=n) / 40_000
        assert np.abs(a - b).max() < 0.015
    together = np.abs(np.bincount(got[1] - got[0], minlength=n) - np.bincount(sample[:, n // 2] - sample[:, (n - 1) // 2], minlength=n)).max() / 40_000
    assert together < 0.015


def test_bootstrap_median_intervals(spark):
    rng = np.random.default_rng(0)
    tied = [("g", float(v)) for v in (1, 2, 3) for _ in range(100)]
    spread = [("h", float(v)) for v in rng.normal(size=301)]
    df = spark.createDataFrame(tied + spread + [("h", None), (None, 4.0)], "g string, v double")
    got = {r.g: (r.med_lo, r.med_mid, r.med_hi) for r in resampling.bootstrap_median(df, "g", "v", 2000, cell=16).collect()}
    assert got["g"] == (2.0, 2.0, 2.0) and got[None] == (4.0, 4.0, 4.0)
    v = np.array([x for _, x in spread])
    want = np.quantile(np.median(rng.choice(v, (4000, 301)), axis=1), [0.025, 0.5, 0.975])
    assert np.abs(np.array(got["h"]) - want).max() < 0.05


def test_single_nights_against_brute_force(spark):
    rng = random.Random(1)
    nights = {p: [rng.uniform(0, 9) for _ in range(n)] for p, n in ((1, 5), (2, 3), (3, 2))}
    df = spark.createDataFrame([(p, f"{i:02}", v) for p, own in nights.items() for i, v in enumerate(own)], "p long, night string, v double")
    gaps = []
    for p, own in nights.items():
        if len(own) >= 3:
            for rep in range(50):
                u = int(hashlib.md5(f"{rep}|{p}".encode()).hexdigest()[:8], 16) / 2**32
                gaps.append(own[int(u * len(own))] - np.mean(own))
    row = resampling.simulated_agreement(df, "p", "night", "v", 50).first()
    assert row.n == 100 and np.isclose(row.bias, np.mean(gaps)) and np.isclose(row.sd, np.std(gaps, ddof=1)) and np.isclose(row.loa_high, np.mean(gaps) + 1.96 * np.std(gaps, ddof=1))

from __future__ import annotations

import pytest

from nightspark.operators import store
from nightspark.operators.checks import centroid_separation, model_fingerprint
from nightspark.operators.labels import CentroidModel
from nightspark.operators.ordering import shared_dir

SEED = CentroidModel(("a", "b"), (10.0, 0.0), (2.0, 1.0), ((0.0, 0.0), (1.0, 1.0), (5.0, 5.0)), ("S0", "S1", "S2"))


def rows(spark, shift=0.0):
    data = [(0, 10.0 + shift, 1.0), (0, 14.0, 3.0), (1, 8.0, -1.0), (-1, 0.0, 0.0)]
    return spark.createDataFrame(data, "cluster_int int, a double, b double")


def test_group_means_keep_unused_numbers(spark):
    model, counts = store.group_means(rows(spark), SEED)
    assert counts == (2, 1, 0)
    assert model.centroids == ((1.0, 2.0), (-1.0, -1.0), (5.0, 5.0))


def test_versions_round_trip_and_follow_the_data(spark):
    held = store.Store(spark, shared_dir(spark), "test-models")
    assert held.versions() == []
    with pytest.raises(FileNotFoundError):
        held.load()
    seen = store.snapshot(spark.createDataFrame([("N1", 1), ("N2", 1), ("N9", 2)], "n string, p long"), "n", "p")
    for shift in (0.0, 4.0):
        model, counts = store.group_means(rows(spark, shift), SEED)
        held.save({"s": model}, {"s": counts}, {"model_version": "v1", "snapshot": seen})
    one, two = held.load(1), held.load()
    assert held.versions() == [1, 2] and two.version == 2
    assert one.models["s"].centroids[0] == (1.0, 2.0) and one.models["s"].features == SEED.features and one.counts == {"s": (2, 1, 0)}
    assert one.meta["snapshot"] == {"n_records": 3, "n_owners": 2, "first": "N1", "last": "N9"} and one.meta["k"] == {"s": 3}
    assert one.meta["fingerprint"] != two.meta["fingerprint"]
    for x in (one, two):
        table = x.table(spark)
        assert table.count() == 4 and sorted(table.collect()) == sorted(held.centroids(x.version).collect())
        assert model_fingerprint(table).first().fingerprint == x.meta["fingerprint"]
    gap = {x.version: centroid_separation(x.table(spark)).first().min_dist for x in (one, two)}
    assert gap[1] == pytest.approx(13**0.5) and gap[2] == pytest.approx(18**0.5)

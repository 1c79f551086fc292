from __future__ import annotations

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nightspark.sources import publish

KEY = "night_record_id"


def test_versions_appear_whole(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, root, "a")
    for n in (3, 5):
        t = spark.range(n).select("id", (F.col("id") % 2).alias("side"))
        publish.publish(spark, root, {"a": t, "b": t.filter("id > 1")}, {"gate": spark.range(1).select(F.lit('{"ok":true}').alias("value"))}, {"a": "side"})
    assert publish.versions(spark, root) == [1, 2] and not [x for x in os.listdir(root) if x[0] == "." and not x.endswith(".crc")]
    assert publish.read_published(spark, root, "a").count() == 5 and publish.read_published(spark, root, "a", 1).count() == 3
    assert spark.read.text(f"{root}/v2/gate").first().value == '{"ok":true}' and publish.read_published(spark, root, "b").count() == 3


def test_only_stale_records_are_renewed(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/layer"
    versions = {f"N{i}": 1 for i in range(40)}
    built = []

    def build(records):
        names = sorted(r[0] for r in records.collect())
        built.append(names)
        rows = [(n, k, f"{n}-{versions[n]}-{len(built)}") for n in names for k in range(3)]
        return spark.createDataFrame(rows, f"{KEY} string, k long, made string")

    def run(model):
        inputs = spark.createDataFrame(sorted(versions.items()), f"{KEY} string, version long")
        return {r[0]: r.reason for r in publish.refresh(spark, path, inputs, build, model, groups=7).collect()}

    def files():
        return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    assert run("m1") == dict.fromkeys(versions, "missing") and len(built[0]) == 40
    before = files()
    assert run("m1") == {} and files() == before and len(built) == 1
    del versions["N5"]
    versions["NX"] = 1
    assert run("m1") == {"NX": "missing"} and built[-1] == ["NX"]
    # one group was written, the others are the files of before
    assert 0 < len(set(before) - set(files())) <= 2
    got = Counter((r[0], r.made) for r in spark.read.parquet(path).collect())
    assert len(got) == 41 and set(got.values()) == {3} and got["NX", "NX-1-2"] == 3 and got["N3", "N3-1-1"] == 3
    assert set(run("m2").values()) == {"model changed"} and len(built[-1]) == 40

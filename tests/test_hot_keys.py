from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightspark.config import Layout
from nightspark.operators import detect, series
from nightspark.operators.ranks import average_rank, carried_rank
from nightspark.operators.scans import with_constants

KEY = "night_record_id"


@pytest.fixture
def no_replanning(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("kind", ["levels", "many", "gaps"])
def test_sliding_median_by_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("a", 700), ("b", 3), ("c", 40), ("d", 260)):
        v = rng.integers(55, 100, n).astype(float) if kind != "many" else rng.normal(size=n)
        if kind == "gaps":
            v[rng.random(n) < 0.6] = np.nan
        frames.append(pd.DataFrame({KEY: name, "seq": np.arange(n), "v": v, "other": name * 2}))
    table = pd.concat(frames)
    df = spark.createDataFrame(table).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = detect.rolling_baseline(df, Layout(chunk_rows=100), "v", 25, 8).toPandas().sort_values([KEY, "seq"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = table.groupby(KEY)["v"].rolling(25, min_periods=8).median().to_numpy()
    assert len(got) == len(table) and np.allclose(got["baseline"], want, equal_nan=True) and (got["other"] == got[KEY] * 2).all()
    if kind != "many":
        many = detect.sliding_median(table["v"].to_numpy(), np.array([0, 700, 703, 743]), 25, 8, levels=3)
        assert np.allclose(many, want, equal_nan=True)
    assert detect.rolling_baseline(df.limit(0), Layout(), "v", 25, 8).collect() == []


def greedy(spans):
    kept, reach = [], -1
    for s, e in sorted(spans):
        if s > reach:
            kept.append(s)
            reach = e
    return kept


def test_long_chains_take_few_jobs(spark, no_replanning):
    rng = random.Random(3)
    # each event overlaps the next: one cluster of 50,000
    chain = [(10 * i, 10 * i + rng.choice([10, 11, 25, 31])) for i in range(50_000)]
    small = [(3 * i, 3 * i + rng.choice([0, 1, 4, 9])) for i in range(200)]
    df = spark.createDataFrame([("r", *x) for x in chain] + [("s", *x) for x in small], f"{KEY} string, start_idx long, end_idx long")
    spark.sparkContext.setJobGroup("chains", "chains")
    got = detect.dedup_overlaps(df, Layout(chunk_rows=50_000)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chains"))
    spark.sparkContext.setJobGroup("other", "other")
    assert sorted(r.start_idx for r in got if r[0] == "r") == greedy(chain)
    assert sorted(r.start_idx for r in got if r[0] == "s") == greedy(small)
    assert jobs <= 22, jobs


def test_ranks_of_a_hot_value(spark, no_replanning):
    rng = np.random.default_rng(1)
    v = np.where(rng.random(6000) < 0.35, 7.0, rng.normal(size=6000))
    table = pd.DataFrame({"k": rng.choice(["a", "b"], 6000, p=[0.9, 0.1]), "v": v, "id": np.arange(6000)})
    table.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(table).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    want = table.groupby("k")["v"].rank(na_option="keep")
    for out in (average_rank(df, ["k"], "v", "r", chunk_rows=500), carried_rank(df, ["k"], "v", "r", chunk_rows=10**6)):
        got = out.toPandas().sort_values("id")
        assert len(got) == 6000 and np.allclose(got["r"], want, equal_nan=True)
    assert largest(average_rank(df, ["k"], "v", "r", chunk_rows=500)) < 3 * 500
    alone = carried_rank(df.select("v"), [], "v", "r", chunk_rows=500).toPandas()
    assert np.allclose(np.sort(alone["r"].dropna()), np.sort(table["v"].rank().dropna()))


def test_constants_of_a_hot_record(spark, no_replanning):
    rows = spark.range(8000).select(
        F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 100).cast("string"))).alias(KEY), F.col("id").alias("_id"))
    numbered = rows.select(KEY, F.when(F.col(KEY) == "hot", F.col("_id")).otherwise(F.floor((F.col("_id") - 6000) / 100)).cast("long").alias("seq"))
    sizes = numbered.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    layout = Layout(chunk_rows=300).sized(numbered)
    out = with_constants(numbered, sizes, layout)
    assert out.count() == 8000 and out.filter("n <> CASE WHEN night_record_id = 'hot' THEN 6000 ELSE 20 END").count() == 0
    assert largest(out) < 5 * 300
    assert with_constants(numbered, sizes, Layout(chunk_rows=7200).sized(numbered)).count() == 8000
    staged = numbered.withColumn("sleep_stage", (F.col("seq") % 4).cast("long"))
    a, b = ({(r[0], r.quintile): r.frac_stage_1 for r in series.quintile_composition(staged, x).collect()} for x in (layout, Layout().sized(numbered)))
    assert a == b and len(a) == 101 * 5

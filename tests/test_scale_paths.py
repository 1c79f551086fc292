"""Chunk-crossing paths against brute force, with chunks of a few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightspark.config import Layout
from nightspark.operators.intervals import asof_join, interval_join, overlap_pairs
from nightspark.operators.ordering import order_rows
from nightspark.operators.ranks import average_rank, exact_percentiles, rank_table
from nightspark.operators.scans import framed, next_at_least, run_bounds, running

TINY = Layout(key="k", seq="seq", chunk_rows=5, fanout=2)


@pytest.fixture(scope="module")
def frame():
    """One key holds a third of the rows; some values are missing."""
    rng = np.random.default_rng(7)
    parts = []
    for k, n in (("hot", 120), ("a", 61), ("b", 90), ("c", 1), ("d", 88)):
        v = rng.integers(0, 12, n).astype(float)
        v[rng.random(n) < 0.15] = np.nan
        parts.append(pd.DataFrame({"k": k, "seq": np.arange(n), "v": v}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame, "k string, seq long, v double").withColumn("v", F.nanvl("v", F.lit(None)))


def fetched(df, *sort):
    return df.toPandas().sort_values(list(sort)).reset_index(drop=True)


def test_order_rows_numbers_each_key(df, frame):
    out = fetched(order_rows(df.select("k", F.col("seq").alias("o")), ["k"], [F.col("o").desc()], out="pos"), "k", "pos")
    for k, g in out.groupby("k"):
        assert list(g["pos"]) == list(range(len(g)))
        assert list(g["o"]) == sorted(g["o"], reverse=True)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_matches_brute_force(df, frame, reverse, inclusive):
    out = fetched(running(df, TINY, {
        "s": ("sum", F.col("v")), "last": ("last", F.col("v")), "top": ("max", F.col("v")), "low": ("min", F.col("v")),
    }, reverse=reverse, inclusive=inclusive), "k", "seq")
    for _, g in out.groupby("k"):
        v = g["v"].to_numpy()
        for i in range(len(v)):
            part = v[i:][::-1] if reverse else v[: i + 1]
            if not inclusive:
                part = part[:-1]
            part = part[~np.isnan(part)]
            row = g.iloc[i]
            assert row["s"] == part.sum()
            for name, want in (("last", part[-1:] if len(part) else []), ("top", [part.max()] if len(part) else []), ("low", [part.min()] if len(part) else [])):
                assert (pd.isna(row[name]) and len(want) == 0) or row[name] == want[0]


def test_framed_sees_rows_of_neighbour_chunks(df, frame):
    out = fetched(framed(df, TINY, 12, 0, lambda w: {"m": F.percentile("v", 0.5).over(w.rowsBetween(-12, 0))}), "k", "seq")
    want = frame.groupby("k")["v"].transform(lambda s: s.rolling(13, min_periods=1).median())
    got = out.merge(frame.assign(want=want), on=["k", "seq"])
    assert np.allclose(got["m"], got["want"], equal_nan=True)


def test_run_bounds_across_chunks(df, frame):
    flag = F.coalesce(F.col("v") < 9, F.lit(False))
    out = fetched(run_bounds(df, TINY, flag), "k", "run_start")
    want = []
    for k, g in frame.groupby("k"):
        b = (g["v"] < 9).to_numpy()
        start = 0
        for i in range(1, len(b) + 1):
            if i == len(b) or b[i] != b[start]:
                want.append((k, start, i - 1, b[start]))
                start = i
    assert [tuple(r) for r in out[["k", "run_start", "run_end", "run_value"]].itertuples(index=False)] == sorted(want)


def test_next_at_least_climbs_the_pyramid(spark, df, frame):
    q = df.select("k", F.col("seq").alias("at")).withColumn("thr", (F.col("at") % 13).cast("double"))
    out = fetched(next_at_least(q, df, TINY, "at", "thr", "v", "hit", fan=3), "k", "at")
    for r in out.itertuples():
        g = frame[(frame.k == r.k) & (frame.seq > r.at) & (frame.v >= r.thr)]
        assert (pd.isna(r.hit) and g.empty) or r.hit == g["seq"].min()


@pytest.mark.parametrize("small", [0, 10**6])
def test_percentiles_both_ways(df, frame, small):
    out = fetched(exact_percentiles(df, ["k"], ["v"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}, small=small), "k")
    want = frame.groupby("k")["v"].quantile([0.1, 0.5, 0.9]).unstack()
    assert np.allclose(out[["v_p10", "v_p50", "v_p90"]].to_numpy(), want.to_numpy(), equal_nan=True)


def test_percentile_of_all_null_group_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    for small in (0, 100):
        out = fetched(exact_percentiles(df, ["k"], ["v"], {"m": 0.5}, small=small), "k")
        assert out["v_m"].iloc[0] == 1.0 and pd.isna(out["v_m"].iloc[1])


def test_average_rank_and_rank_table(df, frame):
    out = fetched(average_rank(df, ["k"], "v", "r"), "k", "seq")
    want = frame.groupby("k")["v"].rank(na_option="keep")
    got = out.merge(frame.assign(want=want), on=["k", "seq"])
    assert np.allclose(got["r"], got["want"], equal_nan=True)
    a = fetched(rank_table(df, ["k"], "v", small=0, chunk_rows=3), "k", "v")
    b = fetched(rank_table(df, ["k"], "v"), "k", "v")
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_join(spark, direction, strict):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 40), "t": rng.integers(0, 30, 40), "id": np.arange(40)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 25), "u": rng.integers(0, 30, 25)}).drop_duplicates()
    out = fetched(asof_join(
        spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, u long"),
        "k", "t", "u", ["u"], ["id"], direction, strict, chunk_rows=4), "id")
    for r in out.itertuples():
        c = right[right.k == r.k]["u"]
        c = (c[c < r.t] if strict else c[c <= r.t]) if direction == "backward" else (c[c > r.t] if strict else c[c >= r.t])
        want = (c.max() if direction == "backward" else c.min()) if len(c) else None
        assert (pd.isna(r.u) and want is None) or r.u == want


def test_interval_and_overlap_joins(spark):
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"k": "a", "x": rng.integers(0, 200, 60).astype(float), "pid": range(60)})
    lo = rng.integers(0, 190, 30).astype(float)
    spans = pd.DataFrame({"k": "a", "lo": lo, "hi": lo + rng.integers(0, 40, 30), "sid": range(30)})
    p, s = spark.createDataFrame(pts), spark.createDataFrame(spans)
    for closed in ("left", "right", "both", "neither"):
        got = interval_join(p, s, ["k"], F.col("x"), F.col("lo"), F.col("hi"), 7.0, closed).select("pid", "sid").toPandas()
        left = (lambda x, a: x >= a) if closed in ("left", "both") else (lambda x, a: x > a)
        right = (lambda x, b: x <= b) if closed in ("right", "both") else (lambda x, b: x < b)
        want = {(i.pid, j.sid) for i in pts.itertuples() for j in spans.itertuples() if left(i.x, j.lo) and right(i.x, j.hi)}
        assert len(got) == len(want) and set(map(tuple, got.to_numpy())) == want
    o = s.select("k", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("sid").alias("o"))
    got = overlap_pairs(s, o, ["k"], (F.col("lo"), F.col("hi")), (F.col("a"), F.col("b")), 11.0).select("sid", "o").toPandas()
    want = {(i.sid, j.sid) for i in spans.itertuples() for j in spans.itertuples() if i.lo <= j.hi and i.hi >= j.lo}
    assert len(got) == len(want) and set(map(tuple, got.to_numpy())) == want

"""Results that the main fixtures cannot show: session zones, file names, sticky chains, ties, one-class folds."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightspark.config import Layout, Params
from nightspark.functions.scalars import add_seconds, parse_datetime, seconds_between
from nightspark.operators import analytics, checks, folds, qc, series
from nightspark.operators.intervals import epoch
from nightspark.sources import recordings


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_a_night_of_summer_time_is_as_long_in_every_zone(spark, zone):
    start = dt.datetime(2024, 3, 10, 1, 30)
    rows = [("N", 1, 1, i, start + dt.timedelta(seconds=i + (40 if i >= 3000 else 0)), 95, 70, 1, 2) for i in range(3600)]
    signal = spark.createDataFrame(rows, "night_record_id string, user_id long, patient_id long, seq long, timestamp timestamp_ntz, spo2 long, hr long, mov long, sleep_stage long")
    row = qc.night_qc(signal, Layout(), Params()).first()
    assert (row.n_samples, row.duration_s, row.max_contiguous_gap_s) == (3600, 3639.0, 40)
    gap = qc.signal_gaps(signal, Layout(), 30.0).collect()
    assert len(gap) == 1
    t = signal.filter("seq = 0").select(
        epoch(F.col("timestamp")).alias("e"), add_seconds(F.col("timestamp"), F.lit(3600.5)).alias("later"),
        seconds_between(F.lit("2024-03-10 04:00:00"), F.col("timestamp")).alias("s"),
        parse_datetime(F.lit("2024-03-10 02:15:00"), recordings.START_FORMATS).alias("p")).first()
    assert t.e == 1710034200.0 and t.later == dt.datetime(2024, 3, 10, 2, 30, 0, 500000) and t.s == 9000.0
    assert t.p == dt.datetime(2024, 3, 10, 2, 15)


def test_ingest_keeps_files_with_any_name(spark, tmp_path):
    body = "user_id;time_start\n7;2024-01-01 22:00:00\n\nodi\n3\n\ntime;spo2;bpm;acceleration_module;sleep_stage\n10:00:00 PM;95;60;1;2\n10:00:01 PM;94;61;1;2\n"
    names = ["plain.txt", "my rec.txt", "año 50%.txt", "a+b#c.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text(body.replace("95", str(90 + k)))
    recs, device, signals = recordings.ingest_recordings(spark, str(tmp_path), device_columns=["odi"])
    assert recs.count() == 4 and recs.select("night_record_id").distinct().count() == 4
    assert signals.count() == 8 and device.count() == 4


def test_stationary_distribution_of_a_sticky_chain(spark):
    rows = [("s", "a", "a", 0.9999999), ("s", "a", "b", 1e-7), ("s", "b", "a", 3e-7), ("s", "b", "b", 0.9999997)]
    got = {r.state: r.stationary for r in analytics.stationary_distribution(spark.createDataFrame(rows, "scale string, from_state string, to_state string, prob double")).collect()}
    assert abs(got["a"] - 0.75) < 1e-6 and abs(got["b"] - 0.25) < 1e-6


def test_all_stages_are_reported(spark):
    runs = spark.createDataFrame([("N", 0, 5), ("N", 0, 40), ("N", -1, 3)], "night_record_id string, stage int, run_rows int")
    got = {r.stage: (r.median_run_s, r.n_runs, r.pct_short) for r in series.run_length_stats(runs).collect()}
    assert got == {0: (22.5, 2, 0.5)} | {k: (None, 0, 0.0) for k in (1, 2, 3)}


def test_one_class_folds_keep_their_rows(spark):
    rows = [(i, i % 3, float(i % 7), 1 if i % 3 == 0 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, owner long, x double, y int")
    out, fitted = folds.out_of_fold(df, ["x"], "y", "owner", ["k"])
    got = out.collect()
    # without owner 0 there is one class
    assert len(got) == 60 and (fitted.only_class == -2).sum() == 3
    assert {(r.fold_status, tuple(r.probability)) for r in got if r.owner == 0} == {("one_class", (1.0, 0.0))}
    assert {r.fold_status for r in got if r.owner != 0} == {"fitted"}


def test_schema_lock_names_every_record(spark):
    good = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in {
        c: {"integer": "long", "timestamp": "timestamp_ntz"}.get(t, t) for c, t in checks.STATE_COLUMNS.items()}.items()))
    assert checks.schema_lock([good]).collect() == []
    bad = spark.createDataFrame([("N1", "1"), ("N2", "2"), ("N1", "3")], "night_record_id string, window_idx string").withColumn("more", F.lit(1))
    got = {r.night_record_id: (r.n_missing, r.n_extra, r.n_wrong, r.b1_status) for r in checks.schema_lock([good, bad]).collect()}
    assert got == {n: (15, 1, 1, "FAIL") for n in ("N1", "N2")}

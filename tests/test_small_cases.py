from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightspark.config import Layout, Params
from nightspark.functions import scalars as V
from nightspark.operators import indices, qc, windows
from nightspark.operators import series as S
from nightspark.sources import tables as B

P = Params()


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("12:00:00 AM", 0), ("12:00:00 PM", 43200), ("1:02:03 PM", 46923), ("11:59:59 pm", 86399), ("nope", None)])
def test_clock_text(spark, text, want):
    assert one(spark, V.parse_ampm_seconds(F.lit(text))) == want


@pytest.mark.parametrize("text,date,flag", [
    ("1/2/70", dt.date(1970, 2, 1), 0), ("1/2/05", dt.date(2005, 2, 1), 1), ("1/2/2005", dt.date(2005, 2, 1), 0),
    ("31/2/1990", None, 0), ("nan", None, 0), ("1/2", None, 0), ("01/12/26", dt.date(1926, 12, 1), 0)])
def test_birthdate(spark, text, date, flag):
    d, f = V.parse_birthdate(F.lit(text))
    assert (one(spark, d), one(spark, f)) == (date, flag)


@pytest.mark.parametrize("times", [
    ["11:59:58 PM", "11:59:59 PM", "12:00:00 AM", "12:00:01 AM"],
    ["11:59:50 PM", "11:59:55 PM", "12:00:10 AM", "12:01:00 AM"],
    ["2:00:00 AM", "2:00:01 AM"]])
def test_midnight(spark, times):
    start = dt.datetime(2024, 1, 1, 2 if len(times) == 2 else 23)
    df = spark.createDataFrame([("r", i, t, start) for i, t in enumerate(times)], "night_record_id string, seq long, t string, started timestamp_ntz")
    got = [r["timestamp"] for r in S.reconstruct_timestamps(df, Layout(chunk_rows=2), "t", "started").orderBy("seq").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    assert (got[-1].day == 2) == (len(times) == 4)


def test_range_bounds_are_inclusive_and_null_is_bad(spark):
    df = spark.createDataFrame([(55,), (54,), (None,)], "spo2 long")
    assert [r["spo2_invalid"] for r in qc.range_qc(df, "spo2", 55).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        V.out_of_range(F.col("x"))


def test_gap_metrics_of_one_row(make_signal):
    r = qc.gap_metrics(make_signal({"r": [95]}), Layout()).first()
    assert (r["coverage"], r["n_gaps"], r["max_contiguous_gap_s"], r["duration_s"]) == (1.0, 0, 0, 0.0)


def test_quality_flags_nest():
    with pytest.raises(ValueError):
        qc.duration_flags(F.col("d"), 10, 5)


def test_partial_window_kept_only_when_covered(make_signal):
    kept = windows.window_rows(qc.quality_signal(make_signal({"r": [95] * 50})), Layout(), P).filter("scale = 's'")
    assert [(r["window_idx"], r["is_tail"]) for r in kept.orderBy("window_idx").collect()] == [(0, False), (1, True)]
    cut = windows.window_rows(qc.quality_signal(make_signal({"r": [95] * 40})), Layout(), P).filter("scale = 's'")
    assert cut.count() == 1


def test_window_bounds_are_half_open(spark, make_signal):
    w = windows.window_rows(qc.quality_signal(make_signal({"r": [95] * 60})), Layout(), P)
    t = dt.datetime(2024, 1, 1, 22)
    ev = spark.createDataFrame([("r", t, None, 1.0), ("r", t + dt.timedelta(seconds=30), "α", 3.0)], "night_record_id string, ts_start timestamp_ntz, morphotype string, ird_event double")
    got = {r["window_idx"]: r for r in windows.event_density(w, ev, P).filter("scale = 's'").collect()}
    assert got[0]["n_edos_total"] == 1 and got[0]["n_alpha"] == 0 and got[1]["n_alpha"] == 1


def test_unknown_stage_dilutes(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (9,)], "s long")
    r = df.agg(*windows.stage_fractions(F.col("s"))).first()
    assert (r["frac_wake"], r["frac_light_sleep"], r["frac_deep_sleep"]) == (0.25, 0.25, 0.0)


@pytest.mark.parametrize("device,rel,flag", [(0.0, float("inf"), False), (None, None, False), (5.0, 1.0, True), (9.5, pytest.approx(0.5 / 9.5), False)])
def test_device_comparison(spark, device, rel, flag):
    q = indices.device_quintet(F.lit(10.0), F.lit(device).cast("double"), "x")
    r = spark.range(1).select(*[c.alias(n) for n, c in q.items()]).first()
    assert r["x_diff_flag"] is flag and (r["x_diff_rel"] == rel if rel is not None else r["x_diff_rel"] is None)


def test_no_staging_counts_the_whole_recording(make_signal):
    s = make_signal({"r": [95] * 20}).withColumn("sleep_stage", F.lit(None).cast("long"))
    r = indices.sample_indices(qc.quality_signal(s), Layout(), P).first()
    assert (r["tst_s"], r["waso_s"], r["sleep_efficiency"], r["n_stage_shifts"]) == (19.0, 0.0, 1.0, 0)


def test_register_unknown_ids_is_idempotent(spark):
    reg = spark.createDataFrame([("1", "x")], "patient_id string, nombre string")
    seen = spark.createDataFrame([("1",), ("2",)], "patient_id string")
    once = B.register_unknown_ids(reg, seen)
    assert once.count() == 2 and B.register_unknown_ids(once, seen).count() == 2


def test_schema_contract(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert B.validate_schema(df, {"x": "int", "y": "str"}) == []
    assert B.validate_schema(df, {"x": "float", "z": "int"}) == [("z", "missing"), ("x", "expected float, got int")]
    with pytest.raises(ValueError):
        B.validate_schema(df, {"z": "int"}, strict=True)


def test_exports_with_missing_block_fail_softly(spark, tmp_path):
    from nightspark.sources import recordings as R

    (tmp_path / "a.txt").write_text("user_id;time_start\n7;2024-01-01 23:59:59\n\nodi_3\n4,x\n\n\ntime;spo2;bpm;acceleration_module;sleep_stage\n11:59:59 PM;95;60;0;1\n12:00:00 AM;x;61;0;1\n")
    (tmp_path / "b.txt").write_text("user_id;time_start\n8;2024-01-01 22:00:00\n")
    rec, dev, sig = R.ingest_recordings(spark, str(tmp_path), Layout(chunk_rows=3), ["odi_3"])
    assert [r["user_id"] for r in rec.collect()] == ["7"] and dev.first()["odi_3"] is None
    rows = sig.orderBy("seq").collect()
    assert [r["spo2"] for r in rows] == [95.0, None] and rows[1]["timestamp"] == dt.datetime(2024, 1, 2)
    status = {r["file"][-5:]: r["status"] for r in R.ingest_status(R.split_blocks(R.read_lines(spark, str(tmp_path)))).collect()}
    assert status == {"a.txt": "OK", "b.txt": "FAIL"}

from __future__ import annotations

from nightspark.config import Layout
from nightspark.operators import detect


def test_samples_are_not_broadcast(spark, make_signal, tmp_path):
    make_signal({"r": [95, 85, 95]}).write.parquet(str(tmp_path / "s"))
    samples = spark.read.parquet(str(tmp_path / "s"))
    events = spark.createDataFrame([("r", 1)], "night_record_id string, nadir_idx long").repartition(2)
    seen = []
    held = detect.stable
    try:
        detect.stable = lambda df: seen.append(df) or df
        rows = detect.with_nadir_time(events, samples, Layout()).collect()
    finally:
        detect.stable = held
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r["nadir_idx"], r["ts_nadir"].second) for r in rows] == [(1, 1)]

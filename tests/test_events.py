from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nightspark.config import Layout, Params
from nightspark.operators import detect, qc

P = Params()


def find(signal, layout=Layout(max_seq=2000)):
    return detect.detect_events(qc.quality_signal(signal), layout, P)


def test_single_notch(make_signal):
    e = find(make_signal({"r": [95] * 150 + [85] * 30 + [95] * 150})).collect()
    assert len(e) == 1
    assert e[0]["nadir_spo2"] == 85 and 9 < e[0]["drop_pct"] < 12 and e[0]["duration_s"] >= 10


@pytest.mark.parametrize("shape", [
    [95] * 150 + [85] * 5 + [95] * 150,      # too short
    [95] * 150 + [94] * 30 + [95] * 150,     # too shallow
    [None] * 300,                            # nothing valid
    [95] * 300,                              # no drop
])
def test_nothing_found(make_signal, shape):
    assert find(make_signal({"r": shape})).count() == 0


def test_touching_drops_give_one_event(make_signal):
    assert find(make_signal({"r": [95] * 150 + [85] * 15 + [86] * 3 + [84] * 15 + [95] * 150})).count() == 1


def brute(values, rows=120, need=30):
    """Events of one record, straight from the definition."""
    base = []
    for i in range(len(values)):
        w = sorted(v for v in values[max(0, i - rows + 1): i + 1] if v is not None)
        n = len(w)
        base.append(None if n < need else (w[n // 2] if n % 2 else (w[n // 2 - 1] + w[n // 2]) / 2))
    below = [v is not None and b is not None and v < b for v, b in zip(values, base)]
    out, reach, i = [], -1, 0
    while i < len(values):
        if not below[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(values) and below[j + 1]:
            j += 1
        end = j
        for k in range(j + 1, len(values)):
            if values[k] is None:
                continue
            end = k
            if values[k] >= base[i] * 0.9:
                break
        low = min(v for v in values[i: end + 1] if v is not None)
        if (base[i] - low) / base[i] * 100 >= 2 and end - i >= 10 and i > reach:
            out.append((i, end, values.index(low, i)))
            reach = end
        i = j + 1
    return out


def test_random_records_match_brute_force_over_small_chunks(make_signal):
    rng = random.Random(11)
    records = {}
    for name, n in (("hot", 900), ("a", 320), ("b", 410)):
        level, v = 96, []
        for _ in range(n):
            if rng.random() < 0.02:
                level = rng.choice([96, 94, 88, 80, 84])
            v.append(None if rng.random() < 0.03 else max(56, min(100, level + rng.randint(-1, 1))))
        records[name] = v
    got = find(make_signal(records), Layout(chunk_rows=150, fanout=2))
    rows = {(r["night_record_id"], r["start_idx"], r["end_idx"], r["nadir_idx"]) for r in got.collect()}
    assert rows == {(k, *e) for k, v in records.items() for e in brute(v)}
    assert rows


def test_dedup_splits_oversized_clusters(spark):
    rng = random.Random(2)
    starts = sorted(rng.sample(range(2000), 60))
    spans = [(s, s + rng.choice([1, 3, 40, 120])) for s in starts]
    want, reach = [], -1
    for s, e in spans:
        if s > reach:
            want.append(s)
            reach = e
    df = spark.createDataFrame([("r", s, e) for s, e in spans], "night_record_id string, start_idx long, end_idx long")
    for limit in (6, 10000):
        got = detect.dedup_overlaps(df, Layout(chunk_rows=4000, max_seq=2000), max_fold=limit)
        assert sorted(r["start_idx"] for r in got.collect()) == want


def test_long_event_curve_equals_the_direct_one(make_signal):
    values = [95] * 150 + [85 + i % 3 for i in range(200)] + [95] * 50
    values[155] = None
    q = qc.quality_signal(make_signal({"r": values}))
    rows = q.select("night_record_id", "seq", F.col("spo2_clean").alias("_v"), F.col("hr_clean").alias("_hr"), F.col("mov").cast("double").alias("_mov"))
    ev = detect.detect_events(q, Layout(max_seq=2000), P)
    a = detect.event_curves(ev, rows, Layout()).first()["spo2_curve"]
    b = detect.event_curves(ev, rows, Layout(chunk_rows=20)).first()["spo2_curve"]
    assert len(a) == 30 and a == pytest.approx(b)

"""Night indices: one wide row per record from samples and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout, Params
from nightspark.functions.scalars import seconds_between
from nightspark.operators.ordering import stable
from nightspark.operators.ranks import exact_percentiles
from nightspark.operators.scans import run_bounds, running, with_constants


def per_hour(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count * 3600.0 / seconds).otherwise(0.0)


def under(value: Column, threshold: float) -> dict[str, Column]:
    """Share of non-null samples, and minutes, below a threshold (0 if none)."""
    share = F.coalesce(F.avg(F.when(value.isNotNull(), (value < threshold).cast("double"))), F.lit(0.0))
    return {f"t{threshold}_frac": share, f"ct{threshold}_min": F.count_if(value < threshold) / 60.0}


def deficit_area(value: Column, threshold: float, at_end: Column) -> Column:
    """Unit-step trapezoid of max(threshold - value, 0); null has no deficit."""
    gap = F.greatest(F.lit(threshold) - F.coalesce(value, F.lit(threshold)), F.lit(0.0))
    return F.sum(gap) - 0.5 * F.coalesce(F.sum(F.when(at_end, gap)), F.lit(0.0))


def level_stats(value: Column, suffix: str, with_max: bool) -> dict[str, Column]:
    """Channels hold small integers, so the exact median keeps few counters."""
    out = {
        f"mean_{suffix}": F.avg(value), f"median_{suffix}": F.percentile(value, 0.5),
        f"min_{suffix}": F.min(value), f"std_{suffix}": F.stddev_pop(value),
    }
    if with_max:
        out[f"max_{suffix}"] = F.max(value)
    return out


def record_span(qc: DataFrame, layout: Layout) -> DataFrame:
    stages = F.col("sleep_stage")
    return qc.groupBy(layout.key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(layout.seq).alias("_last"),
        F.min("timestamp").alias("ts_start"), F.max("timestamp").alias("ts_end"),
        F.min(F.when(stages != 0, F.col(layout.seq))).alias("_onset"),
        F.percentile("mov", 0.5).alias("_median_mov"),
    ).withColumn("duration_s", seconds_between(F.col("ts_end"), F.col("ts_start")))


def stage_shifts(qc: DataFrame, layout: Layout) -> DataFrame:
    """Stage changes between consecutive non-null samples of each record."""
    staged = qc.filter(F.col("sleep_stage").isNotNull()).select(layout.key, layout.seq, "sleep_stage")
    before = running(
        staged, layout, {"_prev": ("last", F.col("sleep_stage"))}, inclusive=False
    )
    return before.groupBy(layout.key).agg(
        F.count_if(F.col("_prev") != F.col("sleep_stage")).alias("n_stage_shifts")
    )


def sample_indices(qc: DataFrame, layout: Layout, p: Params, span: DataFrame | None = None) -> DataFrame:
    """Sleep, SpO2, heart-rate and movement indices (no events)."""
    span = stable(record_span(qc, layout)) if span is None else span
    key, stage = layout.key, F.col("sleep_stage")
    rows = with_constants(qc, span.select(key, "_last", "_onset"), layout)
    ends = F.col(layout.seq).isin(0) | (F.col(layout.seq) == F.col("_last"))
    spo2, hr, mov = F.col("spo2_clean"), F.col("hr_clean"), F.col("mov").cast("double")
    aggs = {
        "_sleep": F.count_if(stage != 0), "_staged": F.count(stage),
        "_waso": F.count_if((stage == 0) & (F.col(layout.seq) >= F.col("_onset"))),
        **level_stats(spo2, "spo2", False), **level_stats(hr, "hr", True), "mean_mov": F.avg(mov),
        "_hb90": deficit_area(spo2, 90.0, ends), "_hb88": deficit_area(spo2, 88.0, ends),
    }
    for t in C.T_UNDER_THRESHOLDS:
        aggs.update(under(spo2, t))
    agg = rows.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    out = span.join(agg, key).join(stage_shifts(qc, layout), key, "left")
    dur, n = F.col("duration_s"), F.col("_staged")
    blank = n == 0
    hour = lambda c: F.when(dur > 0, F.col(c) / 60.0 * 3600.0 / dur).otherwise(0.0)
    return out.withColumns({
        "tst_s": F.when(blank, dur).otherwise(F.col("_sleep").cast("double")),
        "waso_s": F.when(blank | F.col("_onset").isNull(), 0.0).otherwise(F.col("_waso").cast("double")),
        "sleep_efficiency": F.when(dur <= 0, 0.0).when(blank, 1.0).otherwise(F.col("_sleep") / dur),
        "sleep_latency_s": F.when(blank, 0.0).otherwise(F.coalesce(F.col("_onset").cast("double"), dur)),
        "n_stage_shifts": F.when(n < 2, F.lit(0)).otherwise(F.coalesce("n_stage_shifts", F.lit(0))).cast("long"),
        "hypoxic_burden_90": hour("_hb90"), "hypoxic_burden_88": hour("_hb88"),
    }).drop("_n", "_last", "_onset", "_sleep", "_staged", "_waso", "_hb90", "_hb88", "_median_mov")


def sustained_runs(df: DataFrame, layout: Layout, condition: Column, min_rows: int, out: str) -> DataFrame:
    """Number of runs of true ``condition`` with at least ``min_rows`` rows."""
    runs = run_bounds(df, layout, F.coalesce(condition, F.lit(False)), df)
    return runs.groupBy(layout.key).agg(
        F.count_if(F.col("run_value") & (F.col("run_rows") >= min_rows)).alias(out)
    )


def heart_rate_extremes(qc: DataFrame, layout: Layout, p: Params, slow: float = 50, fast: float = 100) -> DataFrame:
    """Sustained slow and fast episodes.

    A sample is slow, fast or neither, so one pass over runs of that class
    counts both.
    """
    cls = F.when(F.col("hr_clean") < slow, "slow").when(F.col("hr_clean") > fast, "fast").otherwise("none")
    runs = run_bounds(qc.select(layout.key, layout.seq, "hr_clean"), layout, cls, qc)
    long_enough = F.col("run_rows") >= p.sustained_rows
    return runs.groupBy(layout.key).agg(
        F.count_if((F.col("run_value") == "slow") & long_enough).alias("n_brady_episodes"),
        F.count_if((F.col("run_value") == "fast") & long_enough).alias("n_tachy_episodes"),
    )


def movement_index(qc: DataFrame, layout: Layout, p: Params, span: DataFrame, factor: float = 3.0) -> DataFrame:
    """Runs of movement over max(factor * median, 0.01 * factor), per recorded hour."""
    level = F.greatest(F.col("_median_mov") * factor, F.lit(0.01 * factor))
    rows = with_constants(qc.select(layout.key, layout.seq, "mov"), span.select(layout.key, level.alias("_level")), layout)
    n = sustained_runs(rows, layout, F.col("mov") > F.col("_level"), p.movement_rows, "_moves")
    return span.join(n, layout.key).select(
        layout.key, per_hour(F.col("_moves"), F.col("duration_s")).alias("movement_index_per_h"))


def event_indices(events: DataFrame, percentiles: bool = True) -> DataFrame:
    """Per-record event counts, shape means and reactivity statistics."""
    key = "night_record_id"
    aggs = [
        F.count(F.lit(1)).alias("n_edos_total"), F.avg("drop_pct").alias("mean_drop_pct"),
        F.avg("duration_s").alias("mean_duration_s_per_edo"), F.max("duration_s").alias("max_duration_s_per_edo"),
        F.sum(F.coalesce("ird_event", F.lit(0.0)) * F.col("duration_s")).alias("_ird_load"),
        F.avg("ird_event").alias("mean_ird_event"), F.avg("delta_hr_bpm").alias("mean_delta_hr_per_edo"),
    ]
    for t in C.DROP_THRESHOLDS_PCT:
        meets = F.coalesce(F.col(f"meets_{t}pct"), F.lit(False))
        aggs += [F.count_if(meets).alias(f"n_edos_{t}pct"),
                 F.count_if(meets & F.coalesce("in_sleep", F.lit(False))).alias(f"_n_sleep_{t}")]
    out = events.groupBy(key).agg(*aggs)
    if percentiles:
        tail = exact_percentiles(events, [key], ["ird_event", "delta_hr_bpm"], {"p90": 0.9})
        out = out.join(tail.select(
            key, F.col("ird_event_p90").alias("p90_ird_event"),
            F.col("delta_hr_bpm_p90").alias("p90_delta_hr_per_edo")), key, "left")
    return out


def rate_family(df: DataFrame, thresholds: Sequence[int] = C.DROP_THRESHOLDS_PCT) -> DataFrame:
    """Events per hour of sleep per drop threshold, overall and in sleep."""
    tst = F.col("tst_s")
    cols = {}
    for t in thresholds:
        cols[f"n_edos_{t}pct"] = F.coalesce(F.col(f"n_edos_{t}pct"), F.lit(0))
    df = df.withColumns(cols)
    rates = {}
    for t in thresholds:
        rates[f"odi_{t}"] = per_hour(F.col(f"n_edos_{t}pct"), tst)
        rates[f"ahi_{t}"] = per_hour(F.coalesce(F.col(f"_n_sleep_{t}"), F.lit(0)), tst)
    return df.withColumns(rates).drop(*[f"_n_sleep_{t}" for t in thresholds])


def device_quintet(ours: Column, device: Column, name: str, flag_at: float = C.DIFF_REL_FLAG) -> dict[str, Column]:
    """Ours, device, absolute and signed relative difference, flag.

    A zero device value makes the relative difference infinite (0 if equal)
    and never flags; a missing side leaves all differences null.
    """
    diff = F.abs(ours - device)
    rel = F.when(F.abs(device) < 1e-9, F.when(diff > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(
        (ours - device) / device)
    finite = rel < float("inf")
    return {
        f"{name}_ours": ours.cast("double"), f"{name}_device": device.cast("double"),
        f"{name}_diff_abs": diff, f"{name}_diff_rel": F.when(diff.isNotNull(), rel),
        f"{name}_diff_flag": F.coalesce(diff.isNotNull() & finite & (F.abs(rel) > flag_at), F.lit(False)),
    }


def night_indices(qc: DataFrame, events: DataFrame, layout: Layout, p: Params, device: DataFrame | None = None) -> DataFrame:
    """The wide index row of each record, with device comparison when given
    (``device`` has one row per record and a column per validated index)."""
    key = layout.key
    span = stable(record_span(qc, layout))
    out = (
        sample_indices(qc, layout, p, span)
        .join(heart_rate_extremes(qc, layout, p), key, "left")
        .join(movement_index(qc, layout, p, span), key, "left")
        .join(event_indices(events), key, "left")
    )
    load = F.coalesce("_ird_load", F.lit(0.0))
    out = out.withColumns({
        "n_edos_total": F.coalesce("n_edos_total", F.lit(0)),
        "n_brady_episodes": F.coalesce("n_brady_episodes", F.lit(0)),
        "n_tachy_episodes": F.coalesce("n_tachy_episodes", F.lit(0)),
        "ird_night": F.when(F.col("tst_s") > 0, load / F.col("tst_s")).otherwise(0.0),
    }).drop("_ird_load")
    out = rate_family(out)
    users = qc.groupBy(key).agg(F.min("user_id").alias("user_id"), F.min("patient_id").alias("patient_id"))
    out = out.join(users, key)
    if device is None:
        return out
    renamed = device.select(key, *[F.col(i).alias(f"_dev_{i}") for i in C.VALIDATED_INDICES])
    out = out.join(renamed, key, "left")
    source = {"hypoxic_burden_3": "hypoxic_burden_90", "hypoxic_burden_4": "hypoxic_burden_88"}
    for i in C.VALIDATED_INDICES:
        out = out.withColumns(device_quintet(F.col(source.get(i, i)), F.col(f"_dev_{i}"), i))
    return out.drop(*[f"_dev_{i}" for i in C.VALIDATED_INDICES])

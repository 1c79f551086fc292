"""Queries: signal, quality, events, windows, labels, night indices, gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.operators import cohorts, detect, indices, labels, qc, scans, windows
from nightspark.plans import fixtures as X
from nightspark.plans import gold as G
from nightspark.plans.oracle import runs_sql
from nightspark.plans.registry import d6, query
from nightspark.sources import adapter as A

KEY = "night_record_id"
SQLP = A.PARAMS


@query("signal", "SELECT night_record_id, user_id, patient_id, seq, CAST(epoch(timestamp) AS BIGINT) AS timestamp, spo2, hr, mov, CAST(sleep_stage AS DOUBLE) AS sleep_stage FROM sig")
def _(L):
    return L.signal.withColumn("sleep_stage", F.col("sleep_stage").cast("double"))


@query("range_qc", f"SELECT night_record_id, seq, spo2, spo2_invalid, {d6('spo2_clean')}, hr, hr_invalid, {d6('hr_clean')} FROM qcs")
def _(L):
    return L.qc.select(KEY, "seq", "spo2", "spo2_invalid", "spo2_clean", "hr", "hr_invalid", "hr_clean")


@query("signal_diagnostics", """SELECT night_record_id, count(*) AS n_samples, round(1.0 / quantile_cont(step_s, 0.5), 4) AS sampling_hz_median,
  count(*) FILTER (WHERE step_s > 1.5) AS n_gaps, CAST(epoch(min(timestamp)) AS BIGINT) AS ts_first, CAST(epoch(max(timestamp)) AS BIGINT) AS ts_last,
  epoch(max(timestamp)) - epoch(min(timestamp)) AS duration_s FROM steps GROUP BY night_record_id""")
def _(L):
    return qc.signal_diagnostics(L.signal, L.layout)


@query("gap_metrics", f"SELECT night_record_id, n_samples, duration_s, n_expected, {d6('coverage')}, n_gaps, max_contiguous_gap_s FROM nqc")
def _(L):
    return qc.gap_metrics(L.signal, L.layout).drop("ts_start", "ts_end")


@query("duration_flags", "SELECT night_record_id, qc_duration_aborted, qc_duration_short FROM nqc")
def _(L):
    return L.night_qc.select(KEY, *[c.alias(n) for n, c in qc.duration_flags(
        F.col("duration_s"), L.p.duration_aborted_s, L.p.duration_min_s).items()])


@query("coverage_flags", "SELECT night_record_id, qc_coverage_ok, qc_max_gap_ok FROM nqc")
def _(L):
    return L.night_qc.select(KEY, *[c.alias(n) for n, c in qc.coverage_flags(
        F.col("coverage"), F.col("max_contiguous_gap_s"), L.p.coverage_min, L.p.max_gap_s).items()])


@query("night_qc", f"""SELECT night_record_id, user_id, CAST(epoch(ts_start) AS BIGINT) AS ts_start, CAST(epoch(ts_end) AS BIGINT) AS ts_end, n_samples,
  {d6('duration_s', 'coverage')}, max_contiguous_gap_s, qc_coverage_ok, qc_max_gap_ok, qc_duration_aborted, qc_duration_short,
  n_spo2_invalid, n_hr_invalid, {d6('frac_spo2_invalid', 'frac_hr_invalid')} FROM nqc""")
def _(L):
    return qc.night_qc(L.signal, L.layout, L.p)


@query("rolling_baseline", f"SELECT night_record_id, seq, {d6('baseline')} FROM base")
def _(L):
    return detect.rolling_baseline(
        L.qc.select(KEY, "seq", "spo2_clean"), L.layout, "spo2_clean", L.p.baseline_rows, L.p.baseline_min_rows).select(KEY, "seq", "baseline")


@query("below_runs", f"SELECT night_record_id, run_start, run_end, run_end - run_start + 1 AS run_rows, {d6('baseline_spo2')} FROM bruns")
def _(L):
    base = detect.rolling_baseline(
        L.qc.select(KEY, "seq", "spo2_clean"), L.layout, "spo2_clean", L.p.baseline_rows, L.p.baseline_min_rows)
    return detect.below_runs(base, L.layout, rows=L.signal)


@query("detect_events", f"SELECT night_record_id, start_idx, end_idx, nadir_idx, {d6('baseline_spo2', 'nadir_spo2', 'drop_pct', 'duration_s')} FROM det")
def _(L):
    return detect.detect_events(L.qc, L.layout, L.p).select(
        KEY, "start_idx", "end_idx", "nadir_idx", "baseline_spo2", "nadir_spo2", "drop_pct", "duration_s")


@query("dedup_overlaps", "SELECT night_record_id, count(*) AS n_kept, CAST(sum(end_idx - start_idx) AS BIGINT) AS rows_kept FROM det GROUP BY night_record_id")
def _(L):
    from nightspark.operators.ordering import stable

    kept = detect.dedup_overlaps(stable(detect.candidate_events(L.qc, L.layout, L.p)), L.layout)
    return kept.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum(F.col("end_idx") - F.col("start_idx")).alias("rows_kept"))


@query("signal_gaps", "SELECT night_record_id, CAST(epoch(gap_start) AS BIGINT) AS gap_start, CAST(epoch(gap_end) AS BIGINT) AS gap_end, gap_s FROM gaps")
def _(L):
    return qc.signal_gaps(L.signal, L.layout, L.p.gap_s)


_SHAPE = ("slope_desat_pct_s", "slope_recov_pct_s", "auc_spo2_pct_s", "delta_hr_bpm", "baseline_hr_bpm", "peak_mov", "baseline_mov")


@query("characterize_events", f"SELECT night_record_id, start_idx, {d6(*_SHAPE)}, in_sleep, meets_2pct, meets_3pct, meets_4pct, meets_5pct, {d6('ird_event')} FROM evr")
def _(L):
    base = L.raw_events.select(
        KEY, "start_idx", "end_idx", "baseline_spo2", "nadir_spo2", "drop_pct", "duration_s", "ts_start", "ts_end", "nadir_idx")
    full = detect.characterize_events(detect.with_nadir_time(base, L.signal, L.layout), L.qc, L.layout, L.p, curves=False)
    return full.select(KEY, "start_idx", *_SHAPE, "in_sleep", *[f"meets_{t}pct" for t in C.DROP_THRESHOLDS_PCT], "ird_event")


@query("near_gap", "SELECT night_record_id, start_idx, near_gap FROM evr")
def _(L):
    return L.raw_events.select(KEY, "start_idx", "near_gap")


@query("in_sleep", "SELECT night_record_id, start_idx, in_sleep FROM evr")
def _(L):
    return L.raw_events.select(KEY, "start_idx", "in_sleep")


@query("meets_thresholds", "SELECT night_record_id, start_idx, meets_2pct, meets_3pct, meets_4pct, meets_5pct FROM evr")
def _(L):
    return L.raw_events.select(KEY, "start_idx", *[
        c.alias(n) for n, c in detect.meets_thresholds(F.col("drop_pct")).items()])


@query("ird_components", f"SELECT night_record_id, start_idx, {d6('ird_spo2_comp', 'ird_hr_comp', 'ird_mov_comp', 'ird_event')} FROM evr")
def _(L):
    from nightspark.functions.scalars import reactivity_components, reactivity_score

    parts = reactivity_components(*[F.col(c) for c in (
        "drop_pct", "baseline_spo2", "delta_hr_bpm", "baseline_hr_bpm", "peak_mov", "baseline_mov")])
    return L.raw_events.select(
        KEY, "start_idx", *[c.alias(n) for n, c in parts.items()],
        reactivity_score(*parts.values()).alias("ird_event"))


@query("resample_curve", f"SELECT night_record_id, start_idx, point, {d6('spo2', 'hr', 'mov')} FROM curvepts")
def _(L):
    e = L.raw_events.select(KEY, "start_idx", F.posexplode(F.arrays_zip("spo2_curve", "hr_curve", "mov_curve")))
    return e.select(KEY, "start_idx", F.col("pos").alias("point"), F.col("col.spo2_curve").alias("spo2"),
                    F.col("col.hr_curve").alias("hr"), F.col("col.mov_curve").alias("mov"))


@query("partition_windows", f"""SELECT night_record_id, scale, window_idx, CAST(epoch(t_start) AS BIGINT) AS t_start, CAST(epoch(t_end) AS BIGINT) AS t_end,
  n_samples_raw, {d6('coverage')}, is_tail FROM wbase""")
def _(L):
    return windows.window_rows(L.qc, L.layout, L.p).select(*windows.META)


_STATS = C.WINDOW_FEATURES[:15]


@query("window_signal_stats", f"SELECT night_record_id, scale, window_idx, {d6(*_STATS)} FROM wbase")
def _(L):
    return windows.window_rows(L.qc, L.layout, L.p).select(KEY, "scale", "window_idx", *_STATS)


@query("window_event_density", f"SELECT night_record_id, scale, window_idx, n_edos_total, n_alpha, n_beta, n_gamma, n_delta, {d6('ird_mean_local')} FROM wdens")
def _(L):
    return windows.event_density(L.windows, L.events, L.p)


@query("window_sleep_composition", f"SELECT night_record_id, scale, window_idx, {d6('frac_wake', 'frac_light_sleep', 'frac_deep_sleep')} FROM wbase")
def _(L):
    return L.windows.select(KEY, "scale", "window_idx", "frac_wake", "frac_light_sleep", "frac_deep_sleep")


@query("build_windows", f"""SELECT night_record_id, scale, window_idx, CAST(epoch(t_start) AS BIGINT) AS t_start, CAST(epoch(t_end) AS BIGINT) AS t_end,
  n_samples_raw, {d6('coverage')}, is_tail, {d6(*C.WINDOW_FEATURES[:15])}, n_edos_total, n_alpha, n_beta, n_gamma, n_delta, {d6('ird_mean_local', 'frac_wake', 'frac_light_sleep', 'frac_deep_sleep')} FROM win""")
def _(L):
    return windows.build_windows(L.qc, L.events, L.layout, L.p)


@query("fit_zscore", " UNION ALL ".join(
    f"SELECT '{s}' AS scale, '{f}' AS feature, r6(m_{f}) AS mean, r6(s_{f}) AS std FROM z_{s}" for s in C.STATE_K for f in C.WINDOW_FEATURES))
def _(L):
    models = {s: L.state_model(s) for s in C.STATE_K}
    rows = [(s, f, m, d) for s, x in models.items() for f, m, d in zip(x.features, x.mean, x.std)]
    return L.spark.createDataFrame(rows, "scale string, feature string, mean double, std double")


@query("assign_nearest", f"SELECT night_record_id, start_idx, morphotype_int, morphotype, {d6('morphotype_dist')} FROM evm")
def _(L):
    out = labels.assign_nearest(L.raw_events, L.morph_model, "morphotype_int", "morphotype_dist")
    return labels.with_label(out, L.morph_model, "morphotype_int", "morphotype").select(
        KEY, "start_idx", "morphotype_int", "morphotype", "morphotype_dist")


@query("assign_curve", f"SELECT night_record_id, start_idx, morphotype_curve, {d6('curve_dist')} FROM ev")
def _(L):
    return labels.label_events(L.raw_events, L.morph_model, X.CURVE_CENTROIDS, L.p.curve_max_s, places_per_unit=X.CURVE_PLACES_PER_UNIT).select(
        KEY, "start_idx", "morphotype_curve", "curve_dist")


@query("delta_curves", f"""SELECT p.night_record_id, p.start_idx, p.point, r6(p.spo2 - e.baseline_spo2) AS delta FROM curvepts p
  JOIN evr e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx
  WHERE e.duration_s <= {SQLP.curve_max_s} AND p.spo2 IS NOT NULL""")
def _(L):
    d = labels.delta_curve(F.col("spo2_curve"), F.col("baseline_spo2"))
    e = L.events.filter(F.col("duration_s") <= L.p.curve_max_s).select(KEY, "start_idx", d.alias("d")).filter("d is not null")
    return e.select(KEY, "start_idx", F.posexplode("d").alias("point", "delta"))


@query("label_windows", f"""SELECT night_record_id, user_id, scale, window_idx, CAST(epoch(t_start) AS BIGINT) AS t_start, CAST(epoch(t_end) AS BIGINT) AS t_end,
  {d6('t_start_s', 't_end_s')}, state_label, cluster_int, {d6('dist_to_centroid', 'coverage', 'frac_wake', 'frac_light_sleep', 'frac_deep_sleep')}, training_eligible FROM st""")
def _(L):
    models = {s: L.state_model(s) for s in C.STATE_K}
    return labels.label_windows(L.windows, models, L.nights_of, L.night_qc).drop("patient_id")


@query("sustained_extremes", "SELECT * FROM hrx")
def _(L):
    return indices.heart_rate_extremes(L.qc, L.layout, L.p)


@query("movement_index", f"SELECT night_record_id, {d6('movement_index_per_h')} FROM movx")
def _(L):
    return indices.movement_index(L.qc, L.layout, L.p, indices.record_span(L.qc, L.layout))


@query("hypoxic_burden", f"SELECT night_record_id, {d6('hypoxic_burden_90', 'hypoxic_burden_88')} FROM nsamp")
def _(L):
    return indices.sample_indices(L.qc, L.layout, L.p).select(KEY, "hypoxic_burden_90", "hypoxic_burden_88")


_UNDER = [f"{k}{t}_{u}" for t in C.T_UNDER_THRESHOLDS for k, u in (("t", "frac"), ("ct", "min"))]


@query("t_under", f"SELECT night_record_id, {d6(*_UNDER)} FROM nsamp")
def _(L):
    aggs = [c.alias(n) for t in C.T_UNDER_THRESHOLDS for n, c in indices.under(F.col("spo2_clean"), t).items()]
    return L.qc.groupBy(KEY).agg(*aggs)


_SLEEP = ("tst_s", "waso_s", "sleep_efficiency", "sleep_latency_s")


@query("sleep_stats", f"SELECT night_record_id, {d6(*_SLEEP)}, n_stage_shifts FROM nsamp")
def _(L):
    return indices.sample_indices(L.qc, L.layout, L.p).select(KEY, *_SLEEP, "n_stage_shifts")


_LEVEL = ("mean_spo2", "median_spo2", "min_spo2", "std_spo2", "mean_hr", "median_hr", "min_hr", "max_hr", "std_hr")


@query("spo2_hr_stats", f"SELECT night_record_id, {d6(*_LEVEL)} FROM nsamp")
def _(L):
    made = {**indices.level_stats(F.col("spo2_clean"), "spo2", False), **indices.level_stats(F.col("hr_clean"), "hr", True)}
    return L.qc.groupBy(KEY).agg(*[c.alias(n) for n, c in made.items()])


_RATES = [f"{k}_{t}" for t in C.DROP_THRESHOLDS_PCT for k in ("odi", "ahi")]


@query("odi_ahi_family", f"SELECT night_record_id, {d6(*_RATES)}, {', '.join(f'n_edos_{t}pct' for t in C.DROP_THRESHOLDS_PCT)} FROM nidx0")
def _(L):
    return L.indices.select(KEY, *_RATES, *[f"n_edos_{t}pct" for t in C.DROP_THRESHOLDS_PCT])


@query("delta_hr_stats", f"SELECT night_record_id, {d6('mean_delta_hr_per_edo', 'p90_delta_hr_per_edo', 'mean_ird_event', 'p90_ird_event')} FROM evx")
def _(L):
    return indices.event_indices(L.events).select(
        KEY, "mean_delta_hr_per_edo", "p90_delta_hr_per_edo", "mean_ird_event", "p90_ird_event")


@query("ird_night", f"SELECT night_record_id, {d6('ird_night')} FROM nidx0")
def _(L):
    load = L.events.groupBy(KEY).agg(F.sum(F.col("ird_event") * F.col("duration_s")).alias("load"))
    tst = L.indices.select(KEY, "tst_s").join(load, KEY, "left")
    return tst.select(KEY, F.when(F.col("tst_s") > 0, F.coalesce("load", F.lit(0.0)) / F.col("tst_s")).otherwise(0.0).alias("ird_night"))


@query("event_morphology_stats", f"SELECT night_record_id, n_edos_total, {d6('mean_drop_pct', 'mean_duration_s_per_edo', 'max_duration_s_per_edo')} FROM evx")
def _(L):
    return indices.event_indices(L.events, percentiles=False).select(
        KEY, "n_edos_total", "mean_drop_pct", "mean_duration_s_per_edo", "max_duration_s_per_edo")


_INDEX_D = (
    "duration_s", *_SLEEP, *_LEVEL, *_UNDER, "hypoxic_burden_90", "hypoxic_burden_88", "mean_mov", "movement_index_per_h",
    "mean_delta_hr_per_edo", "p90_delta_hr_per_edo", "mean_drop_pct", "mean_duration_s_per_edo", "max_duration_s_per_edo",
    "ird_night", "mean_ird_event", "p90_ird_event", *_RATES,
    *[f"{i}_{s}" for i in C.VALIDATED_INDICES for s in ("ours", "device", "diff_abs", "diff_rel")],
)
_INDEX_N = (
    "n_stage_shifts", "n_brady_episodes", "n_tachy_episodes", "n_edos_total", *[f"n_edos_{t}pct" for t in C.DROP_THRESHOLDS_PCT],
    *[f"{i}_diff_flag" for i in C.VALIDATED_INDICES],
)


@query("night_indices", f"SELECT night_record_id, user_id, patient_id, {d6(*_INDEX_D)}, {', '.join(_INDEX_N)} FROM nidx")
def _(L):
    return L.indices.select(KEY, "user_id", "patient_id", *_INDEX_D, *_INDEX_N)


@query("device_comparison", f"SELECT night_record_id, {d6(*[f'{i}_{s}' for i in C.VALIDATED_INDICES for s in ('diff_abs', 'diff_rel')])}, {', '.join(f'{i}_diff_flag' for i in C.VALIDATED_INDICES)} FROM nidx")
def _(L):
    out = L.indices.select(KEY, *[F.col(f"{i}_{s}") for i in C.VALIDATED_INDICES for s in ("ours", "device")])
    cols = [KEY]
    for i in C.VALIDATED_INDICES:
        q = indices.device_quintet(F.col(f"{i}_ours"), F.col(f"{i}_device"), i)
        cols += [q[f"{i}_{s}"].alias(f"{i}_{s}") for s in ("diff_abs", "diff_rel", "diff_flag")]
    return out.select(*cols)


@query("run_lengths", f"SELECT night_record_id, run_value AS stage, run_start, run_rows FROM ({runs_sql('coalesce(sleep_stage, -1)')})")
def _(L):
    runs = scans.run_bounds(L.signal.select(KEY, "seq", "sleep_stage"), L.layout, F.coalesce("sleep_stage", F.lit(-1)))
    return runs.select(KEY, F.col("run_value").alias("stage"), "run_start", "run_rows")


@query("cohort_flags", "SELECT night_record_id, in_quality, in_strict, in_high_tst, with_clinical, flag_for_review, b2_fail FROM flg")
def _(L):
    return L.flags


@query("cohort_summary", """SELECT 'all' AS cohort, count(*) AS n FROM flg UNION ALL SELECT 'quality', count(*) FROM flg WHERE in_quality
  UNION ALL SELECT 'strict', count(*) FROM flg WHERE in_strict UNION ALL SELECT 'high_tst', count(*) FROM flg WHERE in_high_tst
  UNION ALL SELECT 'with_clinical', count(*) FROM flg WHERE with_clinical""")
def _(L):
    return cohorts.cohort_sizes(L.flags)

"""Queries: plausibility checks, gates, drift, staleness, device agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.operators import checks as K
from nightspark.plans.analytic_queries import rank_sql
from nightspark.plans.oracle import cte
from nightspark.plans.registry import d6, query
from nightspark.sources.adapter import PARAMS as P
from nightspark.sources.footers import file_schema_lock

KEY = "night_record_id"


def centroid_table(L):
    """(scale, cluster, feature, z, value) of the stored model: K x features rows per scale."""
    return L.state_store.table(L.spark).select("scale", "cluster", "feature", "z", "value")


cte("cen AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{s}' AS scale, cluster, u.feature, u.z, u.value, u.mean, u.std, n AS n_training FROM (SELECT cluster, n, unnest(l) AS u FROM (SELECT CAST(cluster_int AS BIGINT) AS cluster, count(*) AS n, ["
    + ", ".join(f"{{'feature': '{f}', 'z': avg((CAST(w.{f} AS DOUBLE) - z.m_{f}) / z.s_{f}), 'value': avg(CAST(w.{f} AS DOUBLE)), 'mean': max(z.m_{f}), 'std': max(z.s_{f})}}" for f in C.WINDOW_FEATURES)
    + f"] AS l FROM st_{s} w CROSS JOIN z_{s} z WHERE cluster_int >= 0 AND frac_wake <= 0.5 AND coverage >= 0.5 GROUP BY cluster_int))" for s in C.STATE_K) + ")")
_B2 = {s: f"sum(t_end_s - t_start_s) FILTER (WHERE scale = '{s}') / nullif(max(t_end_s) FILTER (WHERE scale = '{s}'), 0)" for s in C.STATE_K}


def _st(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'WARN' WHEN {c} < 0.85 THEN 'FAIL' WHEN {c} < 0.95 THEN 'WARN' ELSE 'PASS' END"


cte("b2 AS (SELECT *, CASE WHEN 'FAIL' IN (" + ", ".join(_st(f"b2_coverage_{s}") for s in C.STATE_K) + ") THEN 'FAIL' WHEN 'WARN' IN (" + ", ".join(
    _st(f"b2_coverage_{s}") for s in C.STATE_K) + ") THEN 'WARN' ELSE 'PASS' END AS b2_status FROM (SELECT night_record_id, " + ", ".join(
    f"{e} AS b2_coverage_{s}" for s, e in _B2.items()) + " FROM st GROUP BY night_record_id))")
cte("b3 AS (SELECT night_record_id, " + ", ".join(f"max(share) FILTER (WHERE scale = '{s}') AS b3_max_dom_{s}" for s in C.STATE_K) + """, coalesce(max(share) > 0.95, false) AS flag_b3 FROM
  (SELECT night_record_id, scale, max(n) / sum(n) AS share FROM (SELECT night_record_id, scale, state_label, count(*) AS n FROM st WHERE cluster_int >= 0 GROUP BY night_record_id, scale, state_label) GROUP BY night_record_id, scale) GROUP BY night_record_id)""")
cte("b4 AS (SELECT *, greatest(" + ", ".join(f"b4_outlier_frac_{s}" for s in C.STATE_K) + ") > 0.20 AS flag_b4 FROM (SELECT s.night_record_id, " + ", ".join(
    f"coalesce(avg(CASE WHEN s.dist_to_centroid > t.p THEN 1.0 ELSE 0.0 END) FILTER (WHERE s.scale = '{x}'), 0.0) AS b4_outlier_frac_{x}" for x in C.STATE_K) + """
  FROM st s JOIN (SELECT scale, quantile_cont(dist_to_centroid, 0.95) AS p FROM st WHERE cluster_int >= 0 GROUP BY scale) t ON t.scale = s.scale WHERE s.cluster_int >= 0 GROUP BY s.night_record_id))""")
cte("""b5k AS (SELECT p.night_record_id, p.window_idx AS parent, c.scale, c.state_label, count(*) AS n FROM st p JOIN st c ON c.night_record_id = p.night_record_id AND c.scale IN ('s', 'm') AND c.cluster_int >= 0
  AND c.t_start_s >= p.t_start_s AND c.t_start_s < p.t_end_s WHERE p.scale = 'l' AND p.cluster_int >= 0 GROUP BY p.night_record_id, p.window_idx, c.scale, c.state_label)""")
cte("""b5 AS (SELECT night_record_id, avg(coh) FILTER (WHERE scale = 'm') AS coh_l_vs_m, avg(coh) FILTER (WHERE scale = 's') AS coh_l_vs_s FROM
  (SELECT night_record_id, parent, scale, 1 - sum(-p * log2(p + 1e-12)) / CASE WHEN scale = 'm' THEN log2(5) ELSE log2(7) END AS coh FROM (SELECT *, n / sum(n) OVER (PARTITION BY night_record_id, parent, scale) AS p FROM b5k) GROUP BY night_record_id, parent, scale) GROUP BY night_record_id)""")
cte("""b1 AS (SELECT DISTINCT night_record_id, CAST(user_id % 29 = 0 AS BIGINT) AS n_missing, CAST(user_id % 29 <> 0 AND user_id % 31 = 0 AS BIGINT) AS n_extra, CAST(user_id % 29 <> 0 AND user_id % 31 = 0 AS BIGINT) AS n_wrong,
  CASE WHEN user_id % 29 = 0 THEN 'coverage' WHEN user_id % 31 = 0 THEN 'note,window_idx' ELSE '' END AS columns, CASE WHEN user_id % 29 = 0 OR user_id % 31 = 0 THEN 'FAIL' ELSE 'PASS' END AS b1_status FROM st)""")
cte("""bchk AS (SELECT 'B1' AS check_id, CASE WHEN count(*) FILTER (WHERE b1_status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM b1 UNION ALL SELECT 'B2' AS check_id, CASE WHEN s = 'FAIL' AND k THEN 'WARN' ELSE s END AS status FROM (SELECT CASE WHEN count(*) FILTER (WHERE b2_status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE b2_status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS s,
   (SELECT count(*) > 0 AND count(*) FILTER (WHERE q.qc_coverage_ok AND q.qc_max_gap_ok) = 0 FROM b2 x JOIN nqc q ON q.night_record_id = x.night_record_id WHERE x.b2_status = 'FAIL') AS k FROM b2)
  UNION ALL SELECT 'B3', CASE WHEN count(*) FILTER (WHERE flag_b3) > 0 THEN 'WARN' ELSE 'PASS' END FROM b3 UNION ALL SELECT 'B4', CASE WHEN count(*) FILTER (WHERE flag_b4) > 0 THEN 'WARN' ELSE 'PASS' END FROM b4
  UNION ALL SELECT 'B5', CASE WHEN avg(coh_l_vs_m) < 0.3 OR avg(coh_l_vs_s) < 0.3 THEN 'WARN' ELSE 'PASS' END FROM b5)""")


def schema_lock(L):
    return file_schema_lock(L.spark, L.states_apart, K.STATE_COLUMNS, KEY, K.KINDS)


@query("b1_schema_lock", "SELECT * FROM b1")
def _(L):
    return schema_lock(L)


@query("b2_temporal_coverage", f"SELECT night_record_id, {d6(*[f'b2_coverage_{s}' for s in C.STATE_K])}, b2_status FROM b2")
def _(L):
    return K.temporal_coverage(L.states)


@query("b3_dominance", f"SELECT night_record_id, {d6(*[f'b3_max_dom_{s}' for s in C.STATE_K])}, flag_b3 FROM b3")
def _(L):
    return K.dominance(L.states)


@query("b4_outliers", f"SELECT night_record_id, {d6(*[f'b4_outlier_frac_{s}' for s in C.STATE_K])}, flag_b4 FROM b4")
def _(L):
    return K.outlier_share(L.states)


@query("b5_coherence", f"SELECT night_record_id, {d6('coh_l_vs_m', 'coh_l_vs_s')} FROM b5")
def _(L):
    return K.coherence(L.states, float(L.p.window_rows["l"]))


@query("b2_cross_check", """SELECT count(*) AS n_fail, count(*) FILTER (WHERE NOT q.qc_coverage_ok OR NOT q.qc_max_gap_ok) AS n_known_bad,
  count(*) > 0 AND count(*) FILTER (WHERE q.qc_coverage_ok AND q.qc_max_gap_ok) = 0 AS all_known_bad FROM b2 x JOIN nqc q ON q.night_record_id = x.night_record_id WHERE x.b2_status = 'FAIL'""")
def _(L):
    return K.cross_check(K.temporal_coverage(L.states), L.night_qc)


def _checks(L):
    return K.check_rows(schema_lock(L), K.temporal_coverage(L.states), K.dominance(L.states), K.outlier_share(L.states),
                        K.coherence(L.states, float(L.p.window_rows["l"])), L.night_qc)


@query("qa_checks", "SELECT check_id, status FROM bchk")
def _(L):
    return _checks(L)


@query("qa_gate", "SELECT NOT bool_or(check_id IN ('B1', 'B2') AND status = 'FAIL') AS apply_qa_proceed, NOT bool_or(status <> 'PASS') AS apply_qa_all_ok FROM bchk")
def _(L):
    return K.gate(_checks(L), ["B1", "B2"], "apply_qa")


@query("review_union", """SELECT b3.night_record_id, concat_ws('+', CASE WHEN flag_b3 THEN 'dominance' END, CASE WHEN flag_b4 THEN 'outliers' END) AS review_reason
  FROM b3 JOIN b4 ON b4.night_record_id = b3.night_record_id WHERE flag_b3 OR flag_b4""")
def _(L):
    return K.review_list(K.dominance(L.states), K.outlier_share(L.states))


@query("c1_cluster_sizes", """SELECT scale, r6(min(n) / sum(n) * 100) AS min_pct, r6(max(n) / sum(n) * 100) AS max_pct, CASE WHEN min(n) / sum(n) * 100 < 0.3 THEN 'FAIL' WHEN min(n) / sum(n) * 100 < 2 THEN 'WARN' ELSE 'PASS' END AS status
  FROM (SELECT scale, state_label, count(*) AS n FROM st WHERE training_eligible AND cluster_int >= 0 GROUP BY scale, state_label) GROUP BY scale""")
def _(L):
    return K.cluster_sizes(L.states)


@query("c2_centroid_separation", """SELECT scale, r6(min(d)) AS min_dist, CASE WHEN min(d) >= 1.0 THEN 'PASS' WHEN min(d) >= 0.7 THEN 'WARN' ELSE 'FAIL' END AS status FROM
  (SELECT a.scale, a.cluster AS i, b.cluster AS j, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d FROM cen a JOIN cen b ON b.scale = a.scale AND b.feature = a.feature AND a.cluster < b.cluster GROUP BY a.scale, a.cluster, b.cluster) GROUP BY scale""")
def _(L):
    return K.centroid_separation(centroid_table(L))


@query("c3_label_coherence", """WITH w AS (SELECT scale, cluster, max(value) FILTER (WHERE feature = 'n_alpha') AS a, max(value) FILTER (WHERE feature = 'n_beta') AS b, max(value) FILTER (WHERE feature = 'n_gamma') AS g, max(value) FILTER (WHERE feature = 'n_delta') AS d,
   max(value) FILTER (WHERE feature = 'n_edos_total') AS t FROM cen GROUP BY scale, cluster), x AS (SELECT *, CASE greatest(a, b, g, d) WHEN a THEN 'a' WHEN b THEN 'b' WHEN g THEN 'g' ELSE 'd' END AS dom FROM w)
  SELECT scale, r6(count(DISTINCT dom) / count(*)) AS diversity, r6(max(t) - min(t)) AS total_range, CASE WHEN count(DISTINCT dom) / count(*) >= 0.5 OR max(t) - min(t) >= 1 THEN 'PASS' ELSE 'WARN' END AS status FROM x GROUP BY scale""")
def _(L):
    return K.label_coherence(centroid_table(L))


@query("c4_sleep_coherence", """WITH x AS (SELECT scale, max(value) FILTER (WHERE feature = 'frac_light_sleep') > 0.3 AS has_light, max(value) FILTER (WHERE feature = 'frac_deep_sleep') > 0.3 AS has_deep FROM cen GROUP BY scale)
  SELECT scale, has_light, has_deep, CASE WHEN has_light AND (has_deep OR scale = 's') THEN 'PASS' ELSE 'WARN' END AS status FROM x""")
def _(L):
    return K.sleep_coherence(centroid_table(L))


_BOUNDS = ", ".join(f"('{f}', {lo}, {hi})" for f, (lo, hi) in K.FEATURE_BOUNDS.items())


@query("c5_physiological_ranges", f"""SELECT c.scale, count(*) FILTER (WHERE value < lo - 1e-3 OR value > hi + 1e-3) AS n_violators, CASE WHEN count(*) FILTER (WHERE value < lo - 1e-3 OR value > hi + 1e-3) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
  FROM cen c JOIN (VALUES {_BOUNDS}) b(feature, lo, hi) ON b.feature = c.feature GROUP BY c.scale""")
def _(L):
    return K.physiological_ranges(centroid_table(L))


@query("centroids_original_space", "SELECT scale, cluster, feature, r6(value) AS value FROM cen")
def _(L):
    return centroid_table(L).drop("z")


def _validation(L):
    cen = centroid_table(L)
    parts = {"C1": K.cluster_sizes(L.states), "C2": K.centroid_separation(cen), "C3": K.label_coherence(cen),
             "C4": K.sleep_coherence(cen), "C5": K.physiological_ranges(cen)}
    out = None
    for i, df in parts.items():
        one = df.select(F.lit(i).alias("check_id"), "scale", "status")
        out = one if out is None else out.union(one)
    return out


@query("validation_gate", f"""WITH c AS (SELECT 'C1' AS id, CASE WHEN min(n) / sum(n) * 100 < 0.3 THEN 'FAIL' WHEN min(n) / sum(n) * 100 < 2 THEN 'WARN' ELSE 'PASS' END AS s FROM (SELECT scale, state_label, count(*) AS n FROM st WHERE training_eligible AND cluster_int >= 0 GROUP BY scale, state_label) GROUP BY scale
  UNION ALL SELECT 'C5', CASE WHEN count(*) FILTER (WHERE value < lo - 1e-3 OR value > hi + 1e-3) > 0 THEN 'FAIL' ELSE 'PASS' END FROM cen c JOIN (VALUES {_BOUNDS}) b(feature, lo, hi) ON b.feature = c.feature GROUP BY c.scale)
  SELECT NOT bool_or(s = 'FAIL') AS validation_proceed FROM c""")
def _(L):
    return K.gate(_validation(L), ["C1", "C5"], "validation").select("validation_proceed")


@query("apply_vs_train_drift", """WITH a AS (SELECT scale, state_label, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY scale) AS p FROM st WHERE training_eligible AND state_label IS NOT NULL GROUP BY scale, state_label),
  b AS (SELECT scale, state_label, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY scale) AS p FROM st WHERE state_label IS NOT NULL GROUP BY scale, state_label)
  SELECT a.scale, r6(sum(abs(a.p - coalesce(b.p, 0)))) AS l1_distance_pct FROM a LEFT JOIN b ON b.scale = a.scale AND b.state_label = a.state_label GROUP BY a.scale""")
def _(L):
    return K.distribution_drift(L.states.filter("training_eligible"), L.states, "scale", "state_label")


@query("retrain_trigger", """SELECT count(*) - count(*) FILTER (WHERE in_strict) AS delta_nights, count(DISTINCT patient_id) - count(DISTINCT patient_id) FILTER (WHERE in_strict) AS delta_patients,
  count(*) - count(*) FILTER (WHERE in_strict) >= 10 OR count(DISTINCT patient_id) - count(DISTINCT patient_id) FILTER (WHERE in_strict) >= 2 AS should_retrain,
  concat_ws('+', CASE WHEN count(*) - count(*) FILTER (WHERE in_strict) >= 10 THEN 'nights' END, CASE WHEN count(DISTINCT patient_id) - count(DISTINCT patient_id) FILTER (WHERE in_strict) >= 2 THEN 'patients' END) AS reasons FROM flg""")
def _(L):
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n_nights"), F.count_distinct("patient_id").alias("n_patients"))
    nights = L.flags.join(L.nights_of, KEY)
    return K.retrain_trigger(size(nights), size(nights.filter("in_strict")), 10, 2)


@query("stale_records", """SELECT night_record_id, CASE WHEN user_id % 5 = 0 THEN 'missing' WHEN user_id % 5 = 1 THEN 'model changed' WHEN user_id % 5 = 2 AND n_samples > 60 THEN 'input newer' END AS reason FROM nqc
  WHERE user_id % 5 = 0 OR user_id % 5 = 1 OR (user_id % 5 = 2 AND n_samples > 60)""")
def _(L):
    q = L.night_qc
    inputs = q.select(KEY, F.col("n_samples").alias("version"))
    u = F.col("user_id") % 5
    model = F.when(u == 1, "old").when(u == 2, F.lit(None)).otherwise("current")
    outputs = q.filter(u != 0).select(KEY, F.lit(60).cast("long").alias("version"), model.alias("model"))
    return K.stale_records(inputs, outputs, "current")


@query("model_fingerprint", """SELECT substr(sha256(string_agg(t, '|' ORDER BY t)), 1, 16) AS fingerprint FROM
  (SELECT concat_ws(':', scale, CAST(cluster AS VARCHAR), feature, CAST(CAST(CASE WHEN z >= 0 THEN floor(z * 10000 + 0.5) ELSE ceil(z * 10000 - 0.5) END AS BIGINT) AS VARCHAR)) AS t FROM cen)""")
def _(L):
    return K.model_fingerprint(centroid_table(L))


cte("reps AS (SELECT f.night_record_id, f.in_quality, n.ahi_3, n.tst_s FROM flg f JOIN nidx0 n ON n.night_record_id = f.night_record_id WHERE f.in_quality)")


@query("representative_nights", """SELECT 'severe' AS tag, (SELECT night_record_id FROM reps ORDER BY ahi_3 DESC, night_record_id LIMIT 1) AS night_record_id
  UNION ALL SELECT 'control', (SELECT night_record_id FROM reps WHERE tst_s >= 50 ORDER BY ahi_3, night_record_id LIMIT 1)
  UNION ALL SELECT 'outlier_state', (SELECT night_record_id FROM st WHERE state_label = 'L3' GROUP BY night_record_id ORDER BY count(*) DESC, night_record_id LIMIT 1)
  UNION ALL SELECT 'flagged', (SELECT night_record_id FROM flg WHERE flag_for_review ORDER BY md5('42|' || night_record_id) LIMIT 1)""")
def _(L):
    nights = L.nights.filter("in_quality")
    far = L.states.filter(F.col("state_label") == "L3").groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return K.representative_nights(nights, far, L.flags.filter("flag_for_review"), 50.0)


def _agree(i: str) -> str:
    ok = f"{i}_ours IS NOT NULL AND {i}_device IS NOT NULL AND abs({i}_diff_rel) < CAST('inf' AS DOUBLE)"
    a, b = f"{i}_ours", f"{i}_device"
    q = lambda c, p: f"r6(quantile_cont({c}, {p}) FILTER (WHERE {ok}))"
    n = f"count(*) FILTER (WHERE {ok}) >= 3"
    return f"""SELECT '{i}' AS "index", count(*) AS n_nights, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_comparable, count(*) FILTER (WHERE {i}_diff_flag) AS n_diff_flag,
      r6(100.0 * count(*) FILTER (WHERE {i}_diff_flag) / count(*)) AS pct_diff_flag, {q(a, .5)} AS ours_median, {q(b, .5)} AS device_median, {q(f'{i}_diff_abs', .5)} AS diff_abs_median,
      {q(f'{i}_diff_rel', .5)} AS diff_rel_median, {q(f'{i}_diff_rel', .05)} AS diff_rel_p5, {q(f'{i}_diff_rel', .95)} AS diff_rel_p95,
      CASE WHEN {n} AND stddev_pop({a}) FILTER (WHERE {ok}) > 0 AND stddev_pop({b}) FILTER (WHERE {ok}) > 0 THEN r6(corr({a}, {b}) FILTER (WHERE {ok})) END AS pearson_r,
      CASE WHEN {n} AND stddev_pop(ra) FILTER (WHERE {ok}) > 0 AND stddev_pop(rb) FILTER (WHERE {ok}) > 0 THEN r6(corr(ra, rb) FILTER (WHERE {ok})) END AS spearman_r,
      CASE WHEN {n} AND stddev_pop({b}) FILTER (WHERE {ok}) > 1e-9 THEN r6(regr_slope({a}, {b}) FILTER (WHERE {ok})) END AS slope_ols,
      CASE WHEN {n} AND stddev_pop({b}) FILTER (WHERE {ok}) > 1e-9 THEN r6(regr_intercept({a}, {b}) FILTER (WHERE {ok})) END AS intercept_ols
      FROM (SELECT *, {rank_sql(a, ok)} AS ra, {rank_sql(b, ok)} AS rb FROM nidx)"""


@query("agreement_by_index", " UNION ALL ".join(_agree(i) for i in C.VALIDATED_INDICES))
def _(L):
    return K.agreement_by_index(L.indices)


@query("flag_vs_qc_crosstab", " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) FILTER (WHERE {c}) AS n, r6(coalesce(round(100.0 * count(*) FILTER (WHERE {c} AND i.odi_3_diff_flag) / nullif(count(*) FILTER (WHERE {c}), 0), 2), 0)) AS pct_with_diff_flag
  FROM nidx i JOIN nqc q ON q.night_record_id = i.night_record_id""" for n, c in (("qc_duration_aborted", "q.qc_duration_aborted"), ("qc_duration_short", "q.qc_duration_short"), ("qc_coverage_fail", "NOT q.qc_coverage_ok"), ("qc_max_gap_fail", "NOT q.qc_max_gap_ok"))))
def _(L):
    return K.flag_vs_quality(L.indices.select(KEY, "odi_3_diff_flag"), L.night_qc, "odi_3")

"""Queries: gold tables, distributions, cohort algebra, cross-night columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.operators import cohorts
from nightspark.plans import gold as G
from nightspark.plans.core_queries import _INDEX_D, _INDEX_N
from nightspark.plans.oracle import cte
from nightspark.plans.registry import d6, query
from nightspark.sources.adapter import PARAMS as P

KEY = "night_record_id"
FLAGS = ("in_quality", "in_strict", "in_high_tst", "flag_for_review", "b2_fail")
_MORPH = [f"frac_morpho_{n}" for n in C.GREEK_NAMES.values()]
_STATE = [f"frac_state_{s}_{v}" for s, vs in C.GOLD_STATE_LABELS.items() for v in vs]
_PCT = [f"{m}_pct_corpus" for m in G.CROSS_NIGHT_METRICS]
_DELTA = [f"delta_{m}_vs_baseline_patient" for m in G.CROSS_NIGHT_METRICS]


def _mdist(key: str, source: str) -> str:
    tot = " + ".join(f"count(*) FILTER (WHERE morphotype = '{g}')" for g in C.GREEK_NAMES)
    return f"SELECT {key}, " + ", ".join(
        f"count(*) FILTER (WHERE morphotype = '{g}') / greatest({tot}, 1) AS frac_morpho_{n}" for g, n in C.GREEK_NAMES.items()
    ) + f" FROM {source} GROUP BY {key}"


def _sdist(key: str, source: str) -> str:
    cols = []
    for s, labels in C.GOLD_STATE_LABELS.items():
        inn = ", ".join(f"'{v}'" for v in labels)
        cols += [
            f"count(*) FILTER (WHERE scale = '{s}' AND state_label = '{v}') / greatest(count(*) FILTER (WHERE scale = '{s}' AND state_label IN ({inn})), 1) AS frac_state_{s}_{v}"
            for v in labels]
    return f"SELECT {key}, {', '.join(cols)} FROM {source} WHERE cluster_int >= 0 GROUP BY {key}"


cte(f"mdist AS ({_mdist(KEY, 'ev')})")
cte(f"sdist AS ({_sdist(KEY, 'st')})")
cte("""strans AS (
  SELECT night_record_id, scale, count(*) FILTER (WHERE p <> state_label) AS n_transitions
  FROM (SELECT *, lag(state_label) OVER (PARTITION BY night_record_id, scale ORDER BY window_idx) AS p FROM st WHERE cluster_int >= 0)
  GROUP BY night_record_id, scale)""")
cte("""sent AS (
  SELECT night_record_id, scale, sum(-p * log2(p)) AS entropy
  FROM (SELECT night_record_id, scale, state_label, count(*) / sum(count(*)) OVER (PARTITION BY night_record_id, scale) AS p
        FROM st WHERE cluster_int >= 0 GROUP BY night_record_id, scale, state_label) GROUP BY night_record_id, scale)""")
cte("tent AS (SELECT t.night_record_id, " + ", ".join(
    f"coalesce(max(n_transitions) FILTER (WHERE t.scale = '{s}'), 0) AS n_transitions_state_{s}, coalesce(max(entropy) FILTER (WHERE t.scale = '{s}'), 0.0) AS entropy_state_{s}"
    for s in C.STATE_K) + " FROM strans t JOIN sent e ON e.night_record_id = t.night_record_id AND e.scale = t.scale GROUP BY t.night_record_id)")
cte("ngold0 AS MATERIALIZED (SELECT n.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*_MORPH, *_STATE)) + ", " + ", ".join(
    f"coalesce(n_transitions_state_{s}, 0) AS n_transitions_state_{s}, coalesce(entropy_state_{s}, 0) AS entropy_state_{s}" for s in C.STATE_K) + """,
  f.in_quality, f.in_strict, f.in_high_tst, f.with_clinical, f.flag_for_review, f.b2_fail, 'v1' AS model_version
  FROM nidx n LEFT JOIN mdist m ON m.night_record_id = n.night_record_id LEFT JOIN sdist s ON s.night_record_id = n.night_record_id
  LEFT JOIN tent t ON t.night_record_id = n.night_record_id LEFT JOIN flg f ON f.night_record_id = n.night_record_id)""")
cte("ngold AS (SELECT n.*, " + ", ".join(
    f"CASE WHEN n.{m} IS NOT NULL THEN (SELECT count(*) FILTER (WHERE r.{m} < n.{m}) + count(*) FILTER (WHERE r.{m} = n.{m}) / 2.0 FROM ngold0 r WHERE r.in_quality) "
    f"/ (SELECT count(r.{m}) FROM ngold0 r WHERE r.in_quality) END AS {m}_pct_corpus" for m in G.CROSS_NIGHT_METRICS) + ", " + ", ".join(
    f"CASE WHEN n.in_quality AND b.nn >= {P.baseline_min_nights} AND b.c_{m} > 1 THEN n.{m} - (b.s_{m} - n.{m}) / (b.c_{m} - 1) END AS delta_{m}_vs_baseline_patient" for m in G.CROSS_NIGHT_METRICS) + """
  FROM ngold0 n LEFT JOIN (SELECT patient_id, count(*) AS nn, """ + ", ".join(
    f"sum({m}) AS s_{m}, count({m}) AS c_{m}" for m in G.CROSS_NIGHT_METRICS) + """
    FROM ngold0 WHERE in_quality GROUP BY patient_id) b ON b.patient_id = n.patient_id)""")

_EV_D = ("duration_s", "baseline_spo2", "nadir_spo2", "drop_pct", "slope_desat_pct_s", "slope_recov_pct_s", "auc_spo2_pct_s", "delta_hr_bpm",
         "baseline_hr_bpm", "peak_mov", "baseline_mov", "ird_spo2_comp", "ird_hr_comp", "ird_mov_comp", "ird_event")
cte("evg AS (SELECT e.*, f.in_quality, f.in_strict, f.in_high_tst, f.flag_for_review, f.b2_fail FROM ev e LEFT JOIN flg f ON f.night_record_id = e.night_record_id)")
cte("stg AS (SELECT s.*, f.in_quality, f.in_strict, f.in_high_tst, f.flag_for_review, f.b2_fail FROM st s LEFT JOIN flg f ON f.night_record_id = s.night_record_id)")


@query("gold_events", f"""SELECT night_record_id, user_id, start_idx, CAST(epoch(ts_start) AS BIGINT) AS ts_start, CAST(epoch(ts_end) AS BIGINT) AS ts_end,
  {d6(*_EV_D)}, near_gap, in_sleep, morphotype, morphotype_curve, 'v1' AS model_version, {', '.join(FLAGS)} FROM evg""")
def _(L):
    return G.with_flags(L.events, L.flags).select(
        KEY, "user_id", "start_idx", "ts_start", "ts_end", *_EV_D, "near_gap", "in_sleep", "morphotype", "morphotype_curve",
        "model_version", *FLAGS)


@query("gold_events_curves", """SELECT p.night_record_id, CAST(epoch(e.ts_start) AS BIGINT) AS ts_start, r6(sum(p.spo2)) AS spo2_sum, r6(sum(p.hr)) AS hr_sum,
  r6(sum(p.mov)) AS mov_sum, 'v1' AS model_version FROM curvepts p JOIN ev e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx
  GROUP BY p.night_record_id, e.ts_start""")
def _(L):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return G.gold_curves(L.events).select(
        KEY, "ts_start", total("spo2_curve").alias("spo2_sum"), total("hr_curve").alias("hr_sum"),
        total("mov_curve").alias("mov_sum"), "model_version")


@query("join_events_curves", """SELECT e.night_record_id, e.start_idx, r6(avg(p.spo2) - e.nadir_spo2) AS mean_above_nadir
  FROM curvepts p JOIN ev e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx GROUP BY e.night_record_id, e.start_idx, e.nadir_spo2""")
def _(L):
    events = L.events.select(KEY, "ts_start", "start_idx", "nadir_spo2")
    pts = events.join(G.gold_curves(L.events), [KEY, "ts_start"], "inner")
    mean = F.aggregate("spo2_curve", F.lit(0.0), lambda a, x: a + x) / F.size("spo2_curve")
    return pts.select(KEY, "start_idx", (mean - F.col("nadir_spo2")).alias("mean_above_nadir"))


@query("gold_states", f"""SELECT night_record_id, user_id, scale, window_idx, {d6('t_start_s', 't_end_s')}, state_label, cluster_int, {d6('dist_to_centroid', 'coverage')},
  training_eligible, 'v1' AS model_version, {', '.join(FLAGS)} FROM stg""")
def _(L):
    return G.with_flags(L.states, L.flags).select(
        KEY, "user_id", "scale", "window_idx", "t_start_s", "t_end_s", "state_label", "cluster_int", "dist_to_centroid", "coverage",
        "training_eligible", "model_version", *FLAGS)


@query("morphotype_distribution", f"SELECT night_record_id, {d6(*_MORPH)} FROM mdist")
def _(L):
    return G.morphotype_distribution(L.events)


@query("morphotype_distribution_patient", f"SELECT patient_id, {d6(*_MORPH)} FROM ({_mdist('patient_id', '(SELECT * FROM evg WHERE in_quality)')})")
def _(L):
    return G.morphotype_distribution(L.events.join(L.flags.filter("in_quality"), KEY, "left_semi"), "patient_id")


@query("state_distribution", f"SELECT night_record_id, {d6(*_STATE)} FROM sdist")
def _(L):
    return G.state_distribution(L.states)


@query("state_distribution_patient", f"SELECT patient_id, {d6(*_STATE)} FROM ({_sdist('patient_id', '(SELECT * FROM stg WHERE in_quality)')})")
def _(L):
    return G.state_distribution(L.states.join(L.flags.filter("in_quality"), KEY, "left_semi"), "patient_id")


@query("shannon_entropy", f"SELECT night_record_id, scale, {d6('entropy')} FROM sent")
def _(L):
    return G.label_entropy(L.states)


@query("transition_count", "SELECT night_record_id, scale, n_transitions FROM strans")
def _(L):
    return G.label_changes(L.states, L.layout)


@query("gold_nights", f"""SELECT night_record_id, user_id, patient_id, {d6(*_INDEX_D)}, {', '.join(_INDEX_N)}, {d6(*_MORPH, *_STATE)},
  {', '.join(f'n_transitions_state_{s}' for s in C.STATE_K)}, {d6(*[f'entropy_state_{s}' for s in C.STATE_K])},
  {', '.join(FLAGS)}, with_clinical, model_version, {d6(*_PCT, *_DELTA)} FROM ngold""")
def _(L):
    return L.nights.drop("ts_start", "ts_end")


@query("reference_percentile", f"SELECT night_record_id, {d6(*_PCT)} FROM ngold")
def _(L):
    base = L.indices.join(L.flags, KEY)
    return G.percentile_of_reference(base, G.CROSS_NIGHT_METRICS, F.col("in_quality")).select(KEY, *_PCT)


@query("empirical_cdf_left", """SELECT night_record_id, r6((SELECT count(*) FROM ngold0 r WHERE r.in_quality AND r.odi_3 < n.odi_3)
  / (SELECT count(*) FROM ngold0 r WHERE r.in_quality)) AS odi_3_pct_corpus FROM ngold0 n""")
def _(L):
    base = L.indices.join(L.flags, KEY)
    return G.percentile_of_reference(base, ["odi_3"], F.col("in_quality"), strict=True).select(KEY, "odi_3_pct_corpus")


@query("leave_one_out_delta", f"SELECT night_record_id, {d6(*_DELTA)} FROM ngold")
def _(L):
    base = L.indices.join(L.flags, KEY)
    return G.leave_one_out_delta(base, G.CROSS_NIGHT_METRICS, "patient_id", F.col("in_quality"), L.p.baseline_min_nights).select(KEY, *_DELTA)


_COUNTS = """SELECT patient_id, count(*) AS n_nights_total, count(*) FILTER (WHERE in_quality) AS n_nights_quality, count(*) FILTER (WHERE in_strict) AS n_nights_strict,
  count(*) FILTER (WHERE in_high_tst) AS n_nights_high_tst, count(*) FILTER (WHERE flag_for_review) AS n_nights_flag_for_review FROM ngold0 GROUP BY patient_id"""


@query("patient_counts", _COUNTS)
def _(L):
    return G.patient_counts(L.nights)


_AGG = ", ".join(f"avg({m}) AS mean_{m}, quantile_cont(CAST({m} AS DOUBLE), 0.5) AS median_{m}, CASE WHEN count({m}) > 1 THEN stddev_samp({m}) END AS sd_{m}" for m in G.KEY_METRICS)
_AGG_N = [f"{a}_{m}" for m in G.KEY_METRICS for a in ("mean", "median", "sd")]
_CV = ", ".join(f"CASE WHEN count({m}) > 1 AND avg({m}) <> 0 THEN stddev_samp({m}) / avg({m}) END AS cv_{m}_intra_patient" for m in G.STABILITY_METRICS)
_CV_N = [f"cv_{m}_intra_patient" for m in G.STABILITY_METRICS]


@query("patient_metric_aggs", f"SELECT patient_id, {d6(*_AGG_N)} FROM (SELECT patient_id, {_AGG} FROM ngold0 WHERE in_quality GROUP BY patient_id)")
def _(L):
    return G.patient_metrics(L.nights)


@query("stability_cv", f"SELECT patient_id, {d6(*_CV_N)} FROM (SELECT patient_id, {_CV} FROM ngold0 WHERE in_quality GROUP BY patient_id)")
def _(L):
    return G.stability_cv(L.nights)


@query("gold_patients", f"""SELECT c.patient_id, n_nights_total, n_nights_quality, n_nights_strict, n_nights_high_tst, n_nights_flag_for_review,
  sexo, {d6('peso_kg', 'talla_cm')}, CAST(apnea_prev AS DOUBLE) AS apnea_prev, {d6(*_AGG_N, *_MORPH, *_STATE, *_CV_N)}, 'v1' AS model_version
  FROM ({_COUNTS}) c LEFT JOIN clin ON clin.patient_id = c.patient_id
  LEFT JOIN (SELECT patient_id, {_AGG}, {_CV} FROM ngold0 WHERE in_quality GROUP BY patient_id) a ON a.patient_id = c.patient_id
  LEFT JOIN ({_mdist('patient_id', '(SELECT * FROM evg WHERE in_quality)')}) m ON m.patient_id = c.patient_id
  LEFT JOIN ({_sdist('patient_id', '(SELECT * FROM stg WHERE in_quality)')}) s ON s.patient_id = c.patient_id""")
def _(L):
    return G.gold_patients(L.nights, L.events, L.states, L.clinical).withColumn("apnea_prev", F.col("apnea_prev").cast("double"))


@query("join_nights_left_chain", f"SELECT night_record_id, {d6(*_MORPH)}, {', '.join(f'n_transitions_state_{s}' for s in C.STATE_K)} FROM ngold0")
def _(L):
    out = L.indices.select(KEY)
    for part in (G.morphotype_distribution(L.events), G.transitions_and_entropy(L.states, L.layout)):
        out = out.join(part, KEY, "left").fillna(0)
    return out.select(KEY, *_MORPH, *[f"n_transitions_state_{s}" for s in C.STATE_K])


@query("join_patients_left", "SELECT c.patient_id, c.n_nights_total, clin.sexo FROM (" + _COUNTS + ") c LEFT JOIN clin ON clin.patient_id = c.patient_id")
def _(L):
    return G.patient_counts(L.nights).join(L.clinical, "patient_id", "left").select("patient_id", "n_nights_total", "sexo")


@query("lookup_join", "SELECT e.night_record_id, e.start_idx, n.user_id FROM det e LEFT JOIN nqc n ON n.night_record_id = e.night_record_id")
def _(L):
    return cohorts.with_user(L.raw_events.select(KEY, "start_idx"), L.nights_of).select(KEY, "start_idx", "user_id")


@query("semi_join", "SELECT night_record_id, start_idx FROM det WHERE night_record_id IN (SELECT night_record_id FROM flg WHERE in_strict)")
def _(L):
    return L.events.join(L.flags.filter("in_strict"), KEY, "left_semi").select(KEY, "start_idx")


@query("anti_join", "SELECT night_record_id, start_idx FROM det WHERE night_record_id NOT IN (SELECT night_record_id FROM flg WHERE in_strict)")
def _(L):
    return L.events.join(L.flags.filter("in_strict"), KEY, "left_anti").select(KEY, "start_idx")


@query("set_union", "SELECT night_record_id, scale, state_label FROM st WHERE scale = 's' UNION ALL SELECT night_record_id, scale, state_label FROM st WHERE scale = 'm'")
def _(L):
    part = lambda s: L.states.filter(F.col("scale") == s).select(KEY, "scale", "state_label")
    return part("s").unionByName(part("m"))


@query("set_intersect", "SELECT night_record_id FROM flg WHERE in_high_tst INTERSECT SELECT night_record_id FROM flg WHERE in_strict")
def _(L):
    return L.flags.filter("in_high_tst").select(KEY).intersect(L.flags.filter("in_strict").select(KEY))


@query("set_except", "SELECT night_record_id FROM flg WHERE in_quality EXCEPT SELECT night_record_id FROM flg WHERE flag_for_review")
def _(L):
    return L.flags.filter("in_quality").select(KEY).subtract(L.flags.filter("flag_for_review").select(KEY))


@query("distinct_labels", "SELECT DISTINCT scale, state_label FROM st")
def _(L):
    return L.states.select("scale", "state_label").distinct()


@query("cohort_min_nights", f"""SELECT night_record_id, patient_id FROM flg WHERE in_strict AND patient_id IN
  (SELECT patient_id FROM flg WHERE in_strict GROUP BY patient_id HAVING count(*) >= {P.min_strict_nights})""")
def _(L):
    return cohorts.with_enough_nights(
        L.flags.join(L.nights_of, KEY).filter("in_strict"), "patient_id", L.p.min_strict_nights).select(KEY, "patient_id")


@query("cohort_snapshot", """SELECT 'strict' AS cohort, (SELECT count(*) FROM flg WHERE in_strict) AS n, night_record_id FROM flg WHERE in_strict""")
def _(L):
    return cohorts.snapshot(L.flags.filter("in_strict").select(KEY), "strict")


@query("pool_layer", "SELECT night_record_id, start_idx, CAST(NULL AS VARCHAR) AS scale FROM det UNION ALL SELECT night_record_id, window_idx, scale FROM wbase")
def _(L):
    events = L.raw_events.select(KEY, "start_idx")
    spans = L.windows.select(KEY, F.col("window_idx").alias("start_idx"), "scale")
    return events.unionByName(spans, allowMissingColumns=True)


@query("read_columns", "SELECT night_record_id, r6(tst_s) AS tst_s FROM nsamp")
def _(L):
    return L.indices.select(KEY, "tst_s")


@query("clinical_coverage", """SELECT count(*) AS n_nights, count(*) FILTER (WHERE c.patient_id IS NOT NULL) AS n_nights_covered,
  count(DISTINCT f.patient_id) AS n_users, count(DISTINCT c.patient_id) AS n_users_covered, count(DISTINCT f.patient_id) - count(DISTINCT c.patient_id) AS n_users_missing
  FROM flg f LEFT JOIN clin c ON c.patient_id = f.patient_id""")
def _(L):
    return cohorts.clinical_coverage(L.nights_of, L.clinical)


@query("clinical_left_join", """SELECT n.night_record_id, c.sexo, r6(c.peso_kg / ((c.talla_cm / 100.0) * (c.talla_cm / 100.0))) AS bmi,
  CASE WHEN c.sexo = 'M' THEN 1.0 WHEN c.sexo = 'F' THEN 0.0 END AS sexo_bin FROM nqc n LEFT JOIN clin c ON c.patient_id = n.patient_id""")
def _(L):
    from nightspark.functions.scalars import bmi

    j = L.nights_of.withColumn("patient_id", F.col("patient_id").cast("string").try_cast("long")).join(L.clinical, "patient_id", "left")
    return j.select(KEY, "sexo", bmi(F.col("peso_kg"), F.col("talla_cm")).alias("bmi"),
                    F.when(F.col("sexo") == "M", 1.0).when(F.col("sexo") == "F", 0.0).alias("sexo_bin"))


@query("quality_event_filter", f"""SELECT night_record_id, start_idx FROM evg WHERE in_quality AND in_strict AND morphotype_curve IS NOT NULL AND patient_id IN
  (SELECT patient_id FROM flg WHERE in_strict GROUP BY patient_id HAVING count(*) >= {P.min_strict_nights})""")
def _(L):
    nights = L.flags.join(L.nights_of, KEY).filter("in_strict")
    owners = cohorts.with_enough_nights(nights, "patient_id", L.p.min_strict_nights)
    good = L.events.filter("morphotype_curve is not null").join(owners.filter("in_quality"), KEY, "left_semi")
    return good.select(KEY, "start_idx")

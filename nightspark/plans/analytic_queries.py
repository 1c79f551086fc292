"""Queries: reactivity, profiles, coupling, risk, Markov, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.functions.scalars import severity_left_closed, severity_right_closed
from nightspark.operators import analytics as N
from nightspark.operators import series as S
from nightspark.operators.qc import with_step
from nightspark.operators.ranks import average_rank, exact_percentiles, with_scalars
from nightspark.operators.scans import running
from nightspark.operators.ordering import order_rows, stable
from nightspark.config import Layout
from nightspark.plans.oracle import cte
from nightspark.plans.registry import d6, query
from nightspark.plans.series_queries import scored, small_windows

KEY = "night_record_id"
SEV = ("normal", "leve", "moderado", "severo")


def rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    p2 = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"CASE WHEN {col} IS NOT NULL THEN rank() OVER ({p}ORDER BY {col} NULLS LAST) + (count(*) OVER ({p2}) - 1) / 2.0 END"


cte("""gains AS (SELECT *, delta_hr_bpm / nullif(drop_pct, 0) AS hr_gain, (peak_mov - baseline_mov) / nullif(drop_pct, 0) AS mov_gain FROM evs WHERE in_quality)""")
cte(f"""ari AS MATERIALIZED (SELECT *, 0.6 * (rh / n) + 0.4 * (rm / n) AS ari FROM (SELECT *, {rank_sql('hr_gain')} AS rh, {rank_sql('mov_gain')} AS rm, count(*) OVER () AS n FROM gains))""")
cte("""nari AS (SELECT night_record_id, avg(ari) AS mean_ari, stddev_samp(ari) AS std_ari, quantile_cont(ari, 0.9) AS p90_ari, avg(hr_gain) AS mean_hr_gain, stddev_samp(hr_gain) AS std_hr_gain,
  avg(drop_pct) AS mean_drop_pct_ev, quantile_cont(drop_pct, 0.5) AS p90_drop_pct, count(*) AS n_events_quality, """ + ", ".join(
    f"count(*) FILTER (WHERE morphotype_curve = '{c}') / greatest(count(morphotype_curve), 1) AS frac_{c.lower()}" for c in C.CURVE_LABELS) + """,
  count(*) FILTER (WHERE morphotype_curve IN ('C4', 'C5')) / greatest(count(morphotype_curve), 1) AS frac_severe_morpho FROM ari GROUP BY night_record_id)""")
_NARI = ("mean_ari", "std_ari", "p90_ari", "mean_hr_gain", "std_hr_gain", "mean_drop_pct_ev", "p90_drop_pct", *[f"frac_{c.lower()}" for c in C.CURVE_LABELS], "frac_severe_morpho")
_CLASSIC = ("tst_s", "waso_s", "sleep_efficiency", "mean_spo2", "min_spo2", "std_spo2", "t90_frac", "ct90_min", "hypoxic_burden_90", "mean_hr", "std_hr",
            "mean_delta_hr_per_edo", "p90_delta_hr_per_edo", "mean_mov", "movement_index_per_h", "mean_drop_pct", "odi_3", "odi_4", "ahi_3")
cte(f"""nfeat AS MATERIALIZED (SELECT g.night_record_id, g.user_id, g.patient_id, {', '.join('g.' + c for c in _CLASSIC)}, g.n_edos_total, g.in_strict, a.* EXCLUDE (night_record_id),
  CASE WHEN g.odi_3 < 5 THEN 'normal' WHEN g.odi_3 < 15 THEN 'leve' WHEN g.odi_3 < 30 THEN 'moderado' ELSE 'severo' END AS severidad_odi3
  FROM ngold0 g LEFT JOIN nari a ON a.night_record_id = g.night_record_id WHERE g.in_quality)""")
cte("evstate AS (" + " UNION ALL ".join(f"SELECT night_record_id, start_idx, is_severe, morphotype_curve, '{s}' AS scale, state_{s} AS state FROM evs WHERE state_{s} IS NOT NULL" for s in C.STATE_K) + ")")
cte("srate AS (SELECT scale, state, count(*) AS n, avg(CASE WHEN is_severe THEN 1.0 ELSE 0.0 END) AS rate FROM evstate GROUP BY scale, state)")
cte("spath AS (SELECT s.*, s.rate > m.mid AS in_path FROM srate s JOIN (SELECT scale, quantile_cont(rate, 0.5) AS mid FROM srate GROUP BY scale) m ON m.scale = s.scale)")
cte("tpair AS MATERIALIZED (SELECT scale, state_label AS a, nxt AS b FROM (SELECT *, lead(state_label) OVER (PARTITION BY night_record_id, scale ORDER BY window_idx) AS nxt FROM st WHERE state_label IS NOT NULL) WHERE nxt IS NOT NULL)")
cte("""tmat AS MATERIALIZED (SELECT g.scale, g.a AS from_state, g.b AS to_state, coalesce(c.n, 0) AS count, CASE WHEN sum(coalesce(c.n, 0)) OVER (PARTITION BY g.scale, g.a) > 0 THEN coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.scale, g.a) ELSE 0.0 END AS prob
  FROM (SELECT x.scale, x.s AS a, y.s AS b FROM (SELECT scale, a AS s FROM tpair UNION SELECT scale, b FROM tpair) x JOIN (SELECT scale, a AS s FROM tpair UNION SELECT scale, b FROM tpair) y ON y.scale = x.scale) g
  LEFT JOIN (SELECT scale, a, b, count(*) AS n FROM tpair GROUP BY scale, a, b) c ON c.scale = g.scale AND c.a = g.a AND c.b = g.b)""")


def quality_events(L):
    return N.reactivity_index(scored(L).filter("in_quality"))


def night_features(L):
    nights = L.nights.filter("in_quality").select(KEY, "user_id", "patient_id", *_CLASSIC, "n_edos_total", "in_strict")
    out = nights.join(N.night_reactivity(quality_events(L)), KEY, "left")
    return out.withColumn("severidad_odi3", severity_left_closed(F.col("odi_3"), SEV))


@query("autonomic_gain", f"SELECT night_record_id, start_idx, {d6('hr_gain', 'mov_gain')} FROM gains")
def _(L):
    from nightspark.functions.scalars import gain

    e = scored(L).filter("in_quality")
    return e.select(KEY, "start_idx", gain(F.col("delta_hr_bpm"), F.col("drop_pct")).alias("hr_gain"),
                    gain(F.col("peak_mov") - F.col("baseline_mov"), F.col("drop_pct")).alias("mov_gain"))


@query("percentile_rank_avg", f"SELECT night_record_id, start_idx, {d6('ari')} FROM ari")
def _(L):
    return quality_events(L).select(KEY, "start_idx", "ari")


@query("percentile_rank_positive", f"""SELECT night_record_id, start_idx, r6(0.6 * (rh / n) + 0.4 * (rm / n)) AS ari FROM (SELECT *, {rank_sql('hr_gain')} AS rh, {rank_sql('mov_gain')} AS rm, count(*) OVER () AS n FROM gains WHERE drop_pct > 0)""")
def _(L):
    return N.reactivity_index(scored(L).filter("in_quality"), positive_only=True).select(KEY, "start_idx", "ari")


@query("night_ari", f"SELECT night_record_id, n_events_quality, {d6(*_NARI)} FROM nari")
def _(L):
    return N.night_reactivity(quality_events(L))


@query("night_features", f"SELECT night_record_id, user_id, patient_id, {d6(*_CLASSIC)}, n_edos_total, in_strict, {d6(*_NARI)}, CAST(n_events_quality AS DOUBLE) AS n_events_quality, severidad_odi3 FROM nfeat")
def _(L):
    return night_features(L).withColumn("n_events_quality", F.col("n_events_quality").cast("double"))


@query("state_profile", """SELECT scale, state_label, count(*) AS n, r6(avg(frac_wake)) AS frac_wake, r6(avg(frac_light_sleep)) AS frac_light, r6(avg(frac_deep_sleep)) AS frac_deep,
  r6(avg(dist_to_centroid)) AS dist_cent, r6(100 * count(*) / sum(count(*)) OVER (PARTITION BY scale)) AS pct_total FROM st WHERE state_label IS NOT NULL GROUP BY scale, state_label""")
def _(L):
    return N.state_profile(L.states)


_PHYSIOLOGY = ("hr_gain", "mov_gain", "ari", "drop_pct")
_QUARTILES = {"q25": .25, "median": .5, "q75": .75}


def by_scale(e, *columns):
    """Events once per scale, with the scale and its state."""
    states = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"state_{s}").alias("state")) for s in C.STATE_K])).alias("_s")
    return e.select(states, *columns).select("_s.*", *columns).filter("state is not null")


def scales_sql(columns: str, source: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{s}' AS scale, state_{s} AS state, {columns} FROM {source} WHERE state_{s} IS NOT NULL" for s in C.STATE_K) + ")"


@query("physiology_by_state", "SELECT scale, state, " + ", ".join(f"count({m}) AS n_{m}, " + ", ".join(
    f"CASE WHEN count({m}) >= 5 THEN r6(quantile_cont(CAST({m} AS DOUBLE), {p})) END AS {m}_{n}" for n, p in _QUARTILES.items()) for m in _PHYSIOLOGY)
    + f" FROM {scales_sql(', '.join(_PHYSIOLOGY), 'ari')} GROUP BY scale, state")
def _(L):
    """Quartiles of each measure per state of all scales, from five events on."""
    long = stable(by_scale(quality_events(L), *_PHYSIOLOGY))
    counts = long.groupBy("scale", "state").agg(*[F.count(m).alias(f"n_{m}") for m in _PHYSIOLOGY])
    out = exact_percentiles(long, ["scale", "state"], list(_PHYSIOLOGY), _QUARTILES).join(counts, ["scale", "state"])
    return out.select("scale", "state", *[f"n_{m}" for m in _PHYSIOLOGY], *[
        F.when(F.col(f"n_{m}") >= 5, F.col(f"{m}_{q}")).alias(f"{m}_{q}") for m in _PHYSIOLOGY for q in _QUARTILES])


@query("state_label_medians", f"SELECT scale, state, morphotype_curve, count(*) AS n, r6(quantile_cont(CAST(drop_pct AS DOUBLE), 0.5)) AS median_drop_pct, r6(quantile_cont(hr_gain, 0.5)) AS median_hr_gain FROM {scales_sql('morphotype_curve, drop_pct, hr_gain', 'ari')} WHERE morphotype_curve IS NOT NULL GROUP BY scale, state, morphotype_curve")
def _(L):
    long = stable(by_scale(quality_events(L), "morphotype_curve", "drop_pct", "hr_gain").filter("morphotype_curve is not null"))
    keys = ["scale", "state", "morphotype_curve"]
    mid = exact_percentiles(long, keys, ["drop_pct", "hr_gain"], {"m": 0.5})
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(mid, keys).select(
        *keys, "n", F.col("drop_pct_m").alias("median_drop_pct"), F.col("hr_gain_m").alias("median_hr_gain"))


@query("severity_interaction", "SELECT scale, state, " + ", ".join(f"r6(avg(drop_pct) FILTER (WHERE morphotype_curve = '{c}')) AS mean_{c.lower()}, r6(quantile_cont(drop_pct, 0.5) FILTER (WHERE morphotype_curve = '{c}')) AS median_{c.lower()}" for c in C.CURVE_LABELS)
       + f" FROM {scales_sql('morphotype_curve, drop_pct', 'evs')} GROUP BY scale, state")
def _(L):
    """Mean and median drop per state of all scales and curve label."""
    only = {c: F.when(F.col("morphotype_curve") == c, F.col("drop_pct")).alias(c) for c in C.CURVE_LABELS}
    long = stable(by_scale(L.event_states, "morphotype_curve", "drop_pct").select("scale", "state", *only.values()))
    wide = long.groupBy("scale", "state").agg(*[F.avg(c).alias(f"mean_{c.lower()}") for c in C.CURVE_LABELS])
    med = exact_percentiles(long, ["scale", "state"], list(C.CURVE_LABELS), {"m": 0.5})
    return wide.join(med, ["scale", "state"]).select(*wide.columns, *[F.col(f"{c}_m").alias(f"median_{c.lower()}") for c in C.CURVE_LABELS])


_XT = "SELECT {r}, {c}, count(*) AS n, r6(count(*) / sum(count(*)) OVER (PARTITION BY {r})) AS row_share, r6(count(*) / sum(count(*)) OVER (PARTITION BY {c})) AS col_share FROM {t} WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY {r}, {c}"


@query("crosstab", _XT.format(r="state_m", c="morphotype_curve", t="evs"))
def _(L):
    return N.crosstab(L.event_states, "state_m", "morphotype_curve")


@query("morph_stage_crosstab", _XT.format(r="morphotype", c="sleep_stage", t="(SELECT e.*, q.sleep_stage FROM evs e JOIN sig q ON q.night_record_id = e.night_record_id AND q.seq = e.start_idx)"))
def _(L):
    s = L.signal.select(KEY, F.col("seq").alias("start_idx"), "sleep_stage")
    return N.crosstab(L.events.join(s, [KEY, "start_idx"]), "morphotype", "sleep_stage")


@query("severity_strata_medians", f"SELECT severidad_odi3, {', '.join(f'r6(quantile_cont({c}, 0.5)) AS {c}_median' for c in ('mean_ari', 'mean_hr_gain', 't90_frac'))} FROM nfeat GROUP BY severidad_odi3")
def _(L):
    return exact_percentiles(night_features(L), ["severidad_odi3"], ["mean_ari", "mean_hr_gain", "t90_frac"], {"median": 0.5})


_SUMM = ("duration_s", "coverage", "frac_spo2_invalid")


@query("distribution_summary", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, r6(avg({m})) AS mean, r6(stddev_samp({m})) AS sd, r6(min({m})) AS min, r6(max({m})) AS max, " + ", ".join(f"r6(quantile_cont({m}, {p})) AS {n}" for n, p in (("p5", .05), ("median", .5), ("p95", .95))) + " FROM nqc" for m in _SUMM))
def _(L):
    return N.summary_percentiles(L.night_qc, _SUMM, {"p5": .05, "median": .5, "p95": .95})


@query("describe_table", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, r6(avg({m})) AS mean, r6(stddev_samp({m})) AS sd, r6(min({m})) AS min, r6(max({m})) AS max, r6(quantile_cont({m}, 0.5)) AS p50, r6(100 * stddev_samp({m}) / nullif(avg({m}), 0)) AS cv_pct FROM nfeat" for m in ("odi_3", "mean_ari", "t90_frac")))
def _(L):
    return N.summary_percentiles(night_features(L), ("odi_3", "mean_ari", "t90_frac"), {"p50": .5}).withColumn(
        "cv_pct", 100 * F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)))


_VAR = ("odi_3", "t90_frac", "sleep_efficiency")


@query("per_patient_variability", " UNION ALL ".join(f"SELECT patient_id, '{m}' AS metric, count({m}) AS n, r6(avg({m})) AS mean, r6(quantile_cont({m}, 0.5)) AS median, r6(stddev_samp({m})) AS sd, r6(min({m})) AS min, r6(max({m})) AS max, r6(stddev_samp({m}) / nullif(avg({m}), 0)) AS cv FROM nfeat GROUP BY patient_id" for m in _VAR))
def _(L):
    return N.variability(L.nights.filter("in_quality"), _VAR, "patient_id")


@query("flag_counts", "SELECT count(*) AS n_nights, count(*) FILTER (WHERE qc_coverage_ok) AS n_coverage_ok, count(*) FILTER (WHERE qc_max_gap_ok) AS n_gap_ok, count(*) FILTER (WHERE qc_duration_short) AS n_short FROM nqc")
def _(L):
    return L.night_qc.agg(F.count(F.lit(1)).alias("n_nights"), *[F.count_if(c).alias(n) for n, c in (
        ("n_coverage_ok", "qc_coverage_ok"), ("n_gap_ok", "qc_max_gap_ok"), ("n_short", "qc_duration_short"))])


@query("event_night_consistency", """SELECT n.night_record_id, r6(n.odi_3) AS odi_3, r6(CASE WHEN n.tst_s > 0 THEN coalesce(e.k, 0) * 3600.0 / n.tst_s ELSE 0.0 END) AS odi_3_events,
  r6(abs(n.odi_3 - CASE WHEN n.tst_s > 0 THEN coalesce(e.k, 0) * 3600.0 / n.tst_s ELSE 0.0 END)) AS diff FROM nidx0 n LEFT JOIN (SELECT night_record_id, count(*) FILTER (WHERE drop_pct >= 3) AS k FROM evr GROUP BY night_record_id) e ON e.night_record_id = n.night_record_id""")
def _(L):
    k = L.events.groupBy(KEY).agg(F.count_if(F.col("drop_pct") >= 3).alias("k"))
    again = F.when(F.col("tst_s") > 0, F.coalesce("k", F.lit(0)) * 3600.0 / F.col("tst_s")).otherwise(0.0)
    return L.indices.join(k, KEY, "left").select(KEY, "odi_3", again.alias("odi_3_events"), F.abs(F.col("odi_3") - again).alias("diff"))


@query("coupling_index", "SELECT e.night_record_id, " + ", ".join(f"r6(avg(CASE WHEN p.in_path THEN 1.0 ELSE 0.0 END) FILTER (WHERE x.scale = '{s}' AND x.is_severe)) AS ci_{s}" for s in C.STATE_K) + " FROM (SELECT DISTINCT night_record_id FROM evs) e LEFT JOIN evstate x ON x.night_record_id = e.night_record_id LEFT JOIN spath p ON p.scale = x.scale AND p.state = x.state GROUP BY e.night_record_id")
def _(L):
    return N.coupling_index(scored(L))


@query("severe_rates", f"SELECT scale, state, n, {d6('rate')}, in_path FROM spath")
def _(L):
    return N.severe_rates(scored(L))


@query("relative_risk", """WITH r AS (SELECT scale, state, count(*) AS n, CAST(sum(CAST(is_severe AS BIGINT)) AS BIGINT) AS n_severe, avg(CASE WHEN is_severe THEN 1.0 ELSE 0.0 END) AS p_severe,
   (SELECT avg(CASE WHEN is_severe THEN 1.0 ELSE 0.0 END) FROM evs) AS p, (SELECT sum(CAST(is_severe AS BIGINT)) FROM evs) AS s FROM evstate GROUP BY scale, state),
  q AS (SELECT *, p_severe / nullif(p, 0) AS rr, sqrt((1 - p_severe) / (n_severe + 0.5) + (1 - p) / (s + 0.5)) AS se FROM r)
  SELECT scale, state, n, n_severe, r6(p_severe) AS p_severe, r6(rr) AS rr, CASE WHEN rr > 0 THEN r6(exp(ln(CASE WHEN rr > 0 THEN rr END) - 1.96 * se)) END AS rr_lo, CASE WHEN rr > 0 THEN r6(exp(ln(CASE WHEN rr > 0 THEN rr END) + 1.96 * se)) END AS rr_hi FROM q""")
def _(L):
    return N.relative_risk(scored(L))


cte("evnb AS MATERIALIZED (SELECT *, " + ", ".join(f"lag(state_{s}) OVER w AS prev_{s}, lead(state_{s}) OVER w AS next_{s}" for s in C.STATE_K) + " FROM evs WINDOW w AS (PARTITION BY night_record_id ORDER BY start_idx))")


@query("pre_during_post", "SELECT is_severe, scale, moment, state, count(*) AS n, r6(count(*) / sum(count(*)) OVER (PARTITION BY is_severe, scale, moment)) AS share FROM (" + " UNION ALL ".join(
    f"SELECT is_severe, '{s}' AS scale, '{m}' AS moment, {c} AS state FROM evnb WHERE prev_{s} IS NOT NULL AND next_{s} IS NOT NULL" for s in C.STATE_K for m, c in (("pre", f"prev_{s}"), ("during", f"state_{s}"), ("post", f"next_{s}"))) + ") WHERE state IS NOT NULL GROUP BY is_severe, scale, moment, state")
def _(L):
    return N.context_distribution(scored(L), L.layout)


@query("resilience", "SELECT scale, morphotype_curve, count(*) AS n, r6(avg(CASE WHEN a AND NOT b THEN 1.0 ELSE 0.0 END)) AS pct_resilient, r6(avg(CASE WHEN a AND b THEN 1.0 ELSE 0.0 END)) AS pct_collapsed FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS scale, e.morphotype_curve, coalesce(p.in_path, false) AS a, coalesce(q.in_path, false) AS b FROM evnb e LEFT JOIN spath p ON p.scale = '{s}' AND p.state = e.state_{s} LEFT JOIN spath q ON q.scale = '{s}' AND q.state = e.next_{s} WHERE e.is_severe AND e.next_{s} IS NOT NULL" for s in C.STATE_K) + ") GROUP BY scale, morphotype_curve")
def _(L):
    return N.resilience(scored(L), L.layout)


@query("transition_matrices", "SELECT scale, from_state, to_state, r6(prob) AS prob, count FROM tmat")
def _(L):
    return N.transition_matrix(L.states, L.layout)


@query("markov_row_entropy", "SELECT scale, from_state, r6(sum(CASE WHEN prob > 0 THEN -prob * log2(prob) ELSE 0 END)) AS row_entropy FROM tmat GROUP BY scale, from_state")
def _(L):
    return N.transition_entropy(N.transition_matrix(L.states, L.layout))


_sq = ["m0 AS MATERIALIZED (SELECT scale, from_state AS a, to_state AS b, prob / 2 + CASE WHEN from_state <> to_state THEN 0.0 WHEN sum(prob) OVER (PARTITION BY scale, from_state) > 0 THEN 0.5 ELSE 1.0 END AS p FROM tmat)"]
_sq += [f"m{i} AS MATERIALIZED (SELECT x.scale, x.a, y.b, sum(x.p * y.p) AS p FROM m{i - 1} x JOIN m{i - 1} y ON y.scale = x.scale AND y.a = x.b GROUP BY x.scale, x.a, y.b)" for i in range(1, 21)]


@query("stationary_distribution", "WITH " + ", ".join(_sq) + " SELECT scale, b AS state, r6(avg(p)) AS stationary FROM m20 GROUP BY scale, b")
def _(L):
    return N.stationary_distribution(N.transition_matrix(L.states, L.layout))


@query("binned_profile", """WITH s AS (SELECT min(drop_pct) AS lo, max(drop_pct) AS hi FROM evs), b AS (SELECT e.*, CAST(least(greatest(ceil((drop_pct - lo) / ((hi - lo) / 10)), 1), 10) AS BIGINT) AS bin FROM evs e CROSS JOIN s)
  SELECT bin, count(*) AS n, r6(avg(duration_s)) AS mean_duration_s, r6(avg(ird_event)) AS mean_ird_event FROM b GROUP BY bin""")
def _(L):
    return N.equal_width_profile(L.event_states, "drop_pct", ["duration_s", "ird_event"])


@query("tercile_profile", """WITH c AS (SELECT quantile_cont(odi_3, 1.0 / 3) AS a, quantile_cont(odi_3, 2.0 / 3) AS b FROM nidx0)
  SELECT CASE WHEN odi_3 <= a THEN 'low' WHEN odi_3 <= b THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, r6(avg(sleep_efficiency)) AS mean_sleep_efficiency, r6(avg(odi_3)) AS mean_odi_3 FROM nidx0 CROSS JOIN c GROUP BY 1""")
def _(L):
    return N.tercile_profile(L.indices, "odi_3", ["sleep_efficiency", "odi_3"])


@query("sleep_architecture_checks", """WITH q AS (SELECT *, ntile(5) OVER (PARTITION BY night_record_id ORDER BY seq) AS g FROM sig), f AS (SELECT night_record_id, g, avg(CASE WHEN sleep_stage = 3 THEN 1.0 ELSE 0.0 END) AS deep FROM q GROUP BY night_record_id, g)
  SELECT r6(avg(deep) FILTER (WHERE g = 1)) AS deep_q1, r6(avg(deep) FILTER (WHERE g = 5)) AS deep_q5, avg(deep) FILTER (WHERE g = 1) > avg(deep) FILTER (WHERE g = 5) AS deep_decreases,
  (SELECT r6(quantile_cont(sleep_efficiency, 0.5)) FROM nsamp) AS median_efficiency, (SELECT r6(avg(CASE WHEN sleep_efficiency BETWEEN 0.7 AND 1.0 THEN 1.0 ELSE 0.0 END)) FROM nsamp) AS share_in_range FROM f""")
def _(L):
    f = S.quintile_composition(L.signal, L.layout)
    q = lambda i: F.avg(F.when(F.col("quintile") == i, F.col("frac_stage_3")))
    arch = f.agg(q(0).alias("deep_q1"), q(4).alias("deep_q5")).withColumn("deep_decreases", F.col("deep_q1") > F.col("deep_q5"))
    eff = exact_percentiles(L.indices, [], ["sleep_efficiency"], {"p50": 0.5}).withColumnRenamed("sleep_efficiency_p50", "median_efficiency")
    share = L.indices.agg(F.avg(F.col("sleep_efficiency").between(0.7, 1.0).cast("double")).alias("share_in_range"))
    return with_scalars(with_scalars(arch, eff), share)


@query("label_totals", "SELECT scale, state_label, count(*) AS n, count(*) FILTER (WHERE training_eligible) AS n_eligible, count(*) FILTER (WHERE cluster_int < 0) AS n_dropped FROM st GROUP BY scale, state_label")
def _(L):
    return L.states.groupBy("scale", "state_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("training_eligible").alias("n_eligible"), F.count_if(F.col("cluster_int") < 0).alias("n_dropped"))


@query("class_prevalence", "SELECT patient_id, count(*) AS n, r6(avg(CASE WHEN is_severe THEN 1.0 ELSE 0.0 END)) AS prevalence FROM evs GROUP BY patient_id")
def _(L):
    return scored(L).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_severe").cast("double")).alias("prevalence"))


@query("night_event_score", "SELECT night_record_id, r6(avg(score)) AS p_severe_mean, r6(quantile_cont(score, 0.9)) AS p_severe_p90 FROM evs GROUP BY night_record_id")
def _(L):
    e = scored(L)
    p90 = exact_percentiles(e, [KEY], ["score"], {"p90": 0.9})
    return e.groupBy(KEY).agg(F.avg("score").alias("p_severe_mean")).join(p90, KEY).withColumnRenamed("score_p90", "p_severe_p90")


@query("label_event_summary", "SELECT l.label, count(e.start_idx) AS n, r6(quantile_cont(drop_pct, 0.5)) AS median_drop, r6(quantile_cont(duration_s, 0.5)) AS median_duration FROM (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('C5')) l(label) LEFT JOIN evs e ON e.morphotype_curve = l.label GROUP BY l.label")
def _(L):
    e = L.event_states
    n = e.groupBy(F.col("morphotype_curve").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    q = exact_percentiles(e, ["morphotype_curve"], ["drop_pct", "duration_s"], {"m": 0.5}).select(
        F.col("morphotype_curve").alias("label"), F.col("drop_pct_m").alias("median_drop"), F.col("duration_s_m").alias("median_duration"))
    names = L.spark.createDataFrame([(c,) for c in C.CURVE_LABELS], "label string")
    return names.join(n, "label", "left").join(q, "label", "left").fillna(0, ["n"])


@query("half_night_pattern", """WITH m AS (SELECT night_record_id, quantile_cont(epoch(ts_start), 0.5) AS mid FROM evs GROUP BY night_record_id), r AS (SELECT e.night_record_id, count(*) AS n_flagged, avg(CASE WHEN epoch(ts_start) > mid THEN 1.0 ELSE 0.0 END) AS share_late
  FROM evs e JOIN m ON m.night_record_id = e.night_record_id WHERE score >= 0.5 GROUP BY e.night_record_id) SELECT night_record_id, n_flagged, r6(share_late) AS share_late, CASE WHEN share_late > 0.6 THEN 'second_half' WHEN share_late < 0.4 THEN 'first_half' ELSE 'spread' END AS pattern FROM r""")
def _(L):
    return N.half_night_pattern(scored(L), F.col("score") >= 0.5)


@query("group_transform", "SELECT night_record_id, window_idx, r6(max(t_start_s) OVER (PARTITION BY night_record_id)) AS night_max FROM sts")
def _(L):
    w = small_windows(L)
    return w.select(KEY, "window_idx").join(w.groupBy(KEY).agg(F.max("t_start_s").alias("night_max")), KEY)


@query("running_mean_stable", """WITH r AS (SELECT patient_id, night_record_id, odi_3, row_number() OVER w AS k, avg(odi_3) OVER w AS running, avg(odi_3) OVER (PARTITION BY patient_id) AS ref FROM nidx0 WINDOW w AS (PARTITION BY patient_id ORDER BY user_id))
  SELECT patient_id, r6(min(ref)) AS ref, CAST(min(k) FILTER (WHERE abs(running - ref) / (ref + 1e-9) < 0.10) AS DOUBLE) AS stable_at FROM r GROUP BY patient_id""")
def _(L):
    n = order_rows(L.indices.select("patient_id", "user_id", "odi_3"), ["patient_id"], ["user_id"], out="k")
    run = running(n, Layout(key="patient_id", seq="k"), {"_s": ("sum", F.col("odi_3"))})
    ref = n.groupBy("patient_id").agg(F.avg("odi_3").alias("ref"))
    ok = F.abs(F.col("_s") / (F.col("k") + 1) - F.col("ref")) / (F.col("ref") + 1e-9) < 0.10
    return run.join(ref, "patient_id").groupBy("patient_id").agg(
        F.min("ref").alias("ref"), F.min(F.when(ok, F.col("k") + 1)).cast("double").alias("stable_at"))


@query("top_k", "SELECT night_record_id, r6(odi_3) AS odi_3 FROM nidx0 ORDER BY odi_3 DESC, night_record_id LIMIT 10")
def _(L):
    return N.top_k(L.indices.select(KEY, "odi_3"), "odi_3", 10, KEY)


@query("mode_by_group", """SELECT patient_id, arg_min(sev, -n * 1000 + ord) AS mode FROM (SELECT patient_id, sev, count(*) AS n, CASE sev WHEN 'leve' THEN 0 WHEN 'moderado' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END AS ord FROM
  (SELECT patient_id, CASE WHEN odi_3 < 5 THEN 'normal' WHEN odi_3 < 15 THEN 'leve' WHEN odi_3 < 30 THEN 'moderado' ELSE 'severo' END AS sev FROM nidx0) GROUP BY patient_id, sev) GROUP BY patient_id""")
def _(L):
    return N.modal_value(L.indices.withColumn("sev", severity_left_closed(F.col("odi_3"), SEV)), "patient_id", "sev")


@query("severity_bins_cut", "SELECT night_record_id, CASE WHEN odi_3 > -1 AND odi_3 <= 5 THEN 'normal' WHEN odi_3 > 5 AND odi_3 <= 15 THEN 'leve' WHEN odi_3 > 15 AND odi_3 <= 30 THEN 'moderado' WHEN odi_3 > 30 AND odi_3 <= 999 THEN 'severo' END AS sev FROM nidx0")
def _(L):
    return L.indices.select(KEY, severity_right_closed(F.col("odi_3"), SEV).alias("sev"))


@query("severity_bins_left", "SELECT night_record_id, CASE WHEN odi_3 < 5 THEN 'normal' WHEN odi_3 < 15 THEN 'leve' WHEN odi_3 < 30 THEN 'moderado' ELSE 'severo' END AS sev FROM nidx0")
def _(L):
    return L.indices.select(KEY, severity_left_closed(F.col("odi_3"), SEV).alias("sev"))


@query("window_frames", """SELECT night_record_id, seq, r6(avg(hr_clean) OVER (PARTITION BY night_record_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS mean_10 FROM qcs""")
def _(L):
    from nightspark.operators.scans import framed

    return framed(L.qc.select(KEY, "seq", "hr_clean"), L.layout, 9, 0, lambda w: {"mean_10": F.avg("hr_clean").over(w.rowsBetween(-9, 0))}).select(KEY, "seq", "mean_10")


@query("sampling_steps", "SELECT night_record_id, seq, r6(step_s) AS step_s FROM steps")
def _(L):
    return with_step(L.signal, L.layout).select(KEY, "seq", "step_s")


@query("event_rank_in_patient", f"SELECT night_record_id, start_idx, r6({rank_sql('drop_pct', 'patient_id')}) AS rank_avg FROM evs")
def _(L):
    return average_rank(L.event_states.select(KEY, "start_idx", "patient_id", "drop_pct"), ["patient_id"], "drop_pct", "rank_avg").select(KEY, "start_idx", "rank_avg")


@query("night_multiscale_features", "SELECT n.night_record_id, r6(n.odi_3) AS odi_3, n.n_transitions_state_m, r6(n.entropy_state_m) AS entropy_state_m, r6(c.ci) AS coupling_index FROM ngold0 n LEFT JOIN (SELECT x.night_record_id, avg(CASE WHEN p.in_path THEN 1.0 ELSE 0.0 END) AS ci FROM evstate x JOIN spath p ON p.scale = x.scale AND p.state = x.state WHERE x.scale = 'm' AND x.is_severe GROUP BY x.night_record_id) c ON c.night_record_id = n.night_record_id")
def _(L):
    ci = N.coupling_index(scored(L)).select(KEY, F.col("ci_m").alias("coupling_index"))
    return L.nights.select(KEY, "odi_3", "n_transitions_state_m", "entropy_state_m").join(ci, KEY, "left")

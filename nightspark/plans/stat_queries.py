"""Queries: statistics and score metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.functions.scalars import severity_left_closed
from nightspark.operators import analytics as N
from nightspark.operators import resampling as R
from nightspark.operators import series as S
from nightspark.operators import stats as T
from nightspark.operators.ordering import stable
from nightspark.operators.ranks import with_scalars
from nightspark.plans.analytic_queries import SEV, night_features, quality_events, rank_sql
from nightspark.plans.oracle import cte
from nightspark.plans.registry import d6, query
from nightspark.plans.series_queries import scored, small_windows
from nightspark.sources.adapter import PARAMS as P

KEY = "night_record_id"
_SPEAR = "SELECT r6(corr(ra, rb)) AS rho FROM (SELECT {a} AS ra, {b} AS rb FROM {t})"


@query("spearman", _SPEAR.format(a=rank_sql("drop_pct"), b=rank_sql("ari"), t="(SELECT drop_pct, ari FROM ari WHERE ari IS NOT NULL AND drop_pct IS NOT NULL)"))
def _(L):
    return T.spearman(quality_events(L), [], "drop_pct", "ari")


_CORR = ("odi_3", "t90_frac", "mean_hr")


def _pairs(fn):
    return " UNION ALL ".join(fn(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:])


@query("pearson_matrix", _pairs(lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, r6(corr({a}, {b})) AS r FROM nidx0"))
def _(L):
    return T.correlation_pairs(L.indices, _CORR)


@query("spearman_matrix", _pairs(lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, r6(corr(ra, rb)) AS r FROM (SELECT {rank_sql(a)} AS ra, {rank_sql(b)} AS rb FROM nidx0)"))
def _(L):
    return T.correlation_pairs(L.indices, _CORR, "spearman")


@query("chi2_cramers_v", """WITH c AS (SELECT state_m AS r, morphotype_curve AS k, count(*) AS o FROM evs WHERE state_m IS NOT NULL AND morphotype_curve IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT x.r, y.k, x.nr * y.nk / (SELECT sum(o) FROM c) AS e FROM (SELECT r, sum(o) AS nr FROM c GROUP BY r) x CROSS JOIN (SELECT k, sum(o) AS nk FROM c GROUP BY k) y),
  s AS (SELECT sum((coalesce(c.o, 0) - g.e) * (coalesce(c.o, 0) - g.e) / g.e) AS chi2, count(DISTINCT g.r) AS a, count(DISTINCT g.k) AS b FROM g LEFT JOIN c ON c.r = g.r AND c.k = g.k)
  SELECT r6(chi2) AS chi2, (a - 1) * (b - 1) AS dof, (SELECT CAST(sum(o) AS BIGINT) FROM c) AS n, r6(sqrt(chi2 / ((SELECT sum(o) FROM c) * (least(a, b) - 1)))) AS cramers_v FROM s""")
def _(L):
    return T.chi2_cramers_v(L.event_states, "state_m", "morphotype_curve")


@query("kruskal_wallis", f"""WITH r AS (SELECT state_m AS g, hr_gain AS v FROM ari WHERE state_m IS NOT NULL AND hr_gain IS NOT NULL), k AS (SELECT g, v, {rank_sql('v')} AS rk FROM r),
  s AS (SELECT sum(sr * sr / n) AS q, sum(n) AS n, count(*) AS ng FROM (SELECT g, sum(rk) AS sr, count(*) AS n FROM k GROUP BY g)), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT v, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v))
  SELECT CAST(n AS BIGINT) AS n, ng AS n_groups, r6((12.0 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n))) AS h FROM s CROSS JOIN t""")
def _(L):
    return T.kruskal_h(quality_events(L).filter("state_m is not null"), "state_m", "hr_gain")


@query("mann_whitney", f"""WITH m AS (SELECT severidad_odi3, quantile_cont(mean_ari, 0.5) AS cut FROM nfeat WHERE mean_ari IS NOT NULL AND odi_3 IS NOT NULL GROUP BY severidad_odi3),
  r AS (SELECT f.severidad_odi3 AS g, f.mean_ari >= m.cut AS hi, f.odi_3 AS v FROM nfeat f JOIN m ON m.severidad_odi3 = f.severidad_odi3 WHERE f.mean_ari IS NOT NULL), k AS (SELECT *, {rank_sql('v', 'g')} AS rk FROM r),
  s AS (SELECT g, count(*) FILTER (WHERE hi) AS n1, count(*) FILTER (WHERE NOT hi) AS n2, sum(rk) FILTER (WHERE hi) AS sr FROM k GROUP BY g), t AS (SELECT g, sum(c * c * c - c) AS ties FROM (SELECT g, v, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY g, v) GROUP BY g)
  SELECT s.g AS severidad_odi3, n1, n2, r6(sr - n1 * (n1 + 1) / 2.0) AS u, r6((sr - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(nullif(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))), 0))) AS z FROM s JOIN t ON t.g = s.g""")
def _(L):
    from nightspark.operators.ordering import stable
    from nightspark.operators.ranks import exact_percentiles

    nf = stable(night_features(L).filter("mean_ari is not null and odi_3 is not null").select("severidad_odi3", "mean_ari", "odi_3"))
    cut = exact_percentiles(nf, ["severidad_odi3"], ["mean_ari"], {"cut": 0.5})
    rows = nf.join(cut, "severidad_odi3").withColumn("hi", F.col("mean_ari") >= F.col("mean_ari_cut"))
    return T.mann_whitney(rows, ["severidad_odi3"], "hi", "odi_3")


_MET = ("odi_3", "t90_frac", "sleep_efficiency")
cte("nmet AS (" + " UNION ALL ".join(f"SELECT patient_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS x FROM ngold0 WHERE in_quality AND {m} IS NOT NULL" for m in _MET) + ")")
cte("""msq AS (SELECT *, ssb / nullif(n_groups - 1, 0) AS ms_between, ssw / nullif(n_total - n_groups, 0) AS ms_within, n_total / n_groups AS k_mean, (n_total - n2 / n_total) / nullif(n_groups - 1, 0) AS n0 FROM
  (SELECT metric, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_groups, sum(n * (m - g) * (m - g)) AS ssb, sum(n * v) AS ssw, sum(n * n) AS n2 FROM
    (SELECT metric, patient_id, count(*) AS n, avg(x) AS m, var_pop(x) AS v, max(g) AS g FROM (SELECT *, avg(x) OVER (PARTITION BY metric) AS g FROM nmet) GROUP BY metric, patient_id) GROUP BY metric))""")
cte("""iccv AS (SELECT *, (ms_between - ms_within) / nullif(ms_between + (k_mean - 1) * ms_within, 0) AS icc_1_1, (ms_between - ms_within) / nullif(ms_between, 0) AS icc_1_k, (ms_between - ms_within) / nullif(ms_between + (n0 - 1) * ms_within, 0) AS icc_n0,
  greatest((ms_between - ms_within) / k_mean, 0) / nullif(greatest((ms_between - ms_within) / k_mean, 0) + ms_within, 0) AS icc_ratio FROM msq)""")
_ICC = ("ms_between", "ms_within", "k_mean", "n0", "icc_1_1", "icc_1_k", "icc_n0", "icc_ratio")


def metric_rows(L):
    n = L.nights.filter("in_quality")
    return n.select("patient_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in _MET])).alias("_m")).select(
        "patient_id", "_m.*").filter("x is not null")


@query("icc", f"SELECT metric, n_total, n_groups, {d6(*_ICC)} FROM iccv")
def _(L):
    return T.icc(metric_rows(L), "patient_id", "x", ["metric"]).drop("share_between", "share_within")


@query("variance_shares", "SELECT metric, r6(icc_ratio) AS share_between, r6(1 - icc_ratio) AS share_within FROM iccv")
def _(L):
    return T.icc(metric_rows(L), "patient_id", "x", ["metric"]).select("metric", "share_between", "share_within")


@query("spearman_brown", "SELECT metric, k, r6(k * icc_1_1 / (1 + (k - 1) * icc_1_1)) AS icc_k FROM iccv, range(1, 11) t(k)")
def _(L):
    i = T.icc(metric_rows(L), "patient_id", "x", ["metric"]).select("metric", "icc_1_1", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    return i.select("metric", "k", T.spearman_brown(F.col("icc_1_1"), F.col("k")).alias("icc_k"))


@query("variance_decomposition", """SELECT r6(var_samp(m)) AS "between", r6(avg(v)) AS within, r6(avg(cv)) AS cv_intra FROM (SELECT patient_id, avg(odi_3) AS m, var_samp(odi_3) AS v,
  CASE WHEN count(*) >= 3 AND avg(odi_3) > 0 THEN stddev_pop(odi_3) / avg(odi_3) END AS cv FROM ngold0 WHERE in_quality GROUP BY patient_id)""")
def _(L):
    return T.variance_parts(L.nights.filter("in_quality"), "patient_id", "odi_3")


@query("bland_altman", """WITH d AS (SELECT odi_3 - avg(odi_3) OVER (PARTITION BY patient_id) AS d FROM ngold0 WHERE in_quality)
  SELECT count(*) AS n, r6(avg(d)) AS bias, r6(stddev_samp(d)) AS sd, r6(avg(d) - 1.96 * stddev_samp(d)) AS loa_low, r6(avg(d) + 1.96 * stddev_samp(d)) AS loa_high FROM d""")
def _(L):
    out = T.bland_altman(L.nights.filter("in_quality"), "patient_id", "odi_3")
    return out.withColumn("bias", F.round("bias", 6) + 0.0)


_R2_TARGETS = ("frac_severe_morpho", "t90_frac", "sleep_efficiency", "hypoxic_burden_90", "movement_index_per_h")


@query("r2_incremental", " UNION ALL ".join(f"""SELECT '{y}' AS metric, n, r6(ya * ya) AS r2_one, r6((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab)) AS r2_two, r6((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) - ya * ya) AS r2_gain
  FROM (SELECT count(*) AS n, corr({y}, odi_3) AS ya, corr({y}, mean_ari) AS yb, corr(odi_3, mean_ari) AS ab FROM nfeat WHERE {y} IS NOT NULL AND odi_3 IS NOT NULL AND mean_ari IS NOT NULL)""" for y in _R2_TARGETS))
def _(L):
    """Gain of the reactivity index over the event rate, for each measure."""
    n = stable(night_features(L).select("odi_3", "mean_ari", *_R2_TARGETS))
    out = None
    for y in _R2_TARGETS:
        one = T.incremental_r2(n, y, "odi_3", "mean_ari").select(F.lit(y).alias("metric"), "*")
        out = one if out is None else out.union(one)
    return out


# --- fixed values: replicates and night counts, which must equal the published ones ---
_REPLICATES = 1000
_ALL_KS, _LEAST_NIGHTS = (1, 2, 3, 5, 7, 10, 14), 14
_SINGLE_DRAWS = 200
# --- end of fixed values ---
#: The small tables have some 12 nights a patient: the curve with a twin asks for ten.
_KS, _SOME_NIGHTS = (1, 2, 3, 5, 7, 10), 10
_CLASS = "CASE WHEN {0} < 5 THEN 0 WHEN {0} < 15 THEN 1 WHEN {0} < 30 THEN 2 ELSE 3 END"
_SPREAD = ", ".join(f"r6(quantile_cont({m}, {q})) AS {m}_{n}" for m in ("mae", "corr", "agreement") for n, q in (("median", 0.5), ("p025", 0.025), ("p975", 0.975)))


@query("stabilization_curve", f"""WITH b AS (SELECT patient_id, night_record_id, odi_3, avg(odi_3) OVER (PARTITION BY patient_id) AS ref, count(*) OVER (PARTITION BY patient_id) AS n FROM ngold0 WHERE in_quality AND odi_3 IS NOT NULL),
  p AS (SELECT b.*, r.rep, row_number() OVER (PARTITION BY patient_id, rep ORDER BY md5(rep || '|' || night_record_id), night_record_id) AS rn FROM b CROSS JOIN range({_REPLICATES}) r(rep) WHERE n >= {_SOME_NIGHTS}),
  q AS (SELECT patient_id, rep, k, avg(odi_3) AS pr, min(ref) AS ref FROM p CROSS JOIN (VALUES {', '.join(f'({k})' for k in _KS)}) ks(k) WHERE rn <= k AND k <= n GROUP BY patient_id, rep, k),
  c AS (SELECT k, rep, avg(abs(pr - ref)) AS mae, sqrt(avg((pr - ref) * (pr - ref))) AS rmse, CASE WHEN NOT isnan(corr(pr, ref)) THEN corr(pr, ref) END AS corr,
    avg(CASE WHEN ({_CLASS.format('pr')}) = ({_CLASS.format('ref')}) THEN 1.0 ELSE 0.0 END) AS agreement, count(*) AS n FROM q GROUP BY k, rep)
  SELECT CAST(k AS BIGINT) AS k, {_SPREAD}, r6(quantile_cont(rmse, 0.5)) AS rmse_median, r6(quantile_cont(n, 0.5)) AS n_patients FROM c GROUP BY k""")
def _(L):
    return R.stabilization_curve(L.nights.filter("in_quality"), "patient_id", KEY, "odi_3", _KS, _REPLICATES, _SOME_NIGHTS)


@query("stabilization_curve_full")
def _(L):
    return R.stabilization_curve(L.nights.filter("in_quality"), "patient_id", KEY, "odi_3", _ALL_KS, _REPLICATES, _LEAST_NIGHTS)


def _hash(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


_MEASURES = ("icc_1_1", "icc_1_k", "cv_mean", "cv_median")


_ICC_SQL = f"""WITH g AS (SELECT patient_id, count(*) AS n, avg(odi_3) AS m, var_pop(odi_3) AS v, CASE WHEN count(*) > 1 THEN stddev_samp(odi_3) END / nullif(avg(odi_3), 0) AS cv,
    row_number() OVER (ORDER BY patient_id) - 1 AS i FROM ngold0 WHERE in_quality AND odi_3 IS NOT NULL GROUP BY patient_id),
  s AS (SELECT rep, slot, CAST(floor({_hash('rep', 'slot')} * (SELECT count(*) FROM g)) AS BIGINT) AS i FROM range({_REPLICATES}) r(rep) CROSS JOIN (SELECT i AS slot FROM g)),
  d AS (SELECT s.rep, g.n, g.m, g.v, g.cv, sum(g.n * g.m) OVER (PARTITION BY rep) / sum(g.n) OVER (PARTITION BY rep) AS gm FROM s JOIN g ON g.i = s.i),
  a AS (SELECT rep, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) AS b, sum(n * v) / (sum(n) - count(*)) AS w, sum(n) / count(*) AS km, avg(cv) AS cv_mean, quantile_cont(cv, 0.5) AS cv_median FROM d GROUP BY rep),
  e AS (SELECT rep, (b - w) / (b + (km - 1) * w) AS icc_1_1, (b - w) / b AS icc_1_k, cv_mean, cv_median FROM a)
  """


def icc_replicates(L):
    if "_icc" not in L.__dict__:
        L.__dict__["_icc"] = stable(R.bootstrap_icc_cv(L.nights.filter("in_quality"), "patient_id", "odi_3", _REPLICATES))
    return L.__dict__["_icc"]


@query("bootstrap_icc_cv", _ICC_SQL + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, r6(quantile_cont({m}, 0.025)) AS p025, r6(quantile_cont({m}, 0.5)) AS median, r6(quantile_cont({m}, 0.975)) AS p975 FROM e" for m in _MEASURES))
def _(L):
    return R.interval(icc_replicates(L), _MEASURES)


@query("bootstrap_icc_cv_full", _ICC_SQL + "SELECT rep, r6(icc_1_1) AS icc_1_1, r6(icc_1_k) AS icc_1_k, r6(cv_mean) AS cv_mean, r6(cv_median) AS cv_median FROM e")
def _(L):
    """All replicates, one row each."""
    return icc_replicates(L).select("rep", *_MEASURES)


@query("simulated_agreement", f"""WITH b AS (SELECT patient_id, mean_ari, row_number() OVER (PARTITION BY patient_id ORDER BY night_record_id) - 1 AS i, avg(mean_ari) OVER (PARTITION BY patient_id) AS m,
    count(*) OVER (PARTITION BY patient_id) AS n FROM nfeat WHERE mean_ari IS NOT NULL),
  a AS (SELECT DISTINCT patient_id, n, m, rep, CAST(floor({_hash('rep', 'patient_id')} * n) AS BIGINT) AS i FROM b CROSS JOIN range({_SINGLE_DRAWS}) r(rep) WHERE n >= 3),
  d AS (SELECT b.mean_ari - a.m AS d FROM a JOIN b ON b.patient_id = a.patient_id AND b.i = a.i)
  SELECT count(*) AS n, r6(avg(d)) AS bias, r6(stddev_samp(d)) AS sd, r6(avg(d) - 1.96 * stddev_samp(d)) AS loa_low, r6(avg(d) + 1.96 * stddev_samp(d)) AS loa_high FROM d""")
def _(L):
    return R.simulated_agreement(night_features(L), "patient_id", KEY, "mean_ari", _SINGLE_DRAWS)


@query("bootstrap_median_ci")
def _(L):
    return R.bootstrap_median(L.event_states.filter("morphotype_curve is not null"), "morphotype_curve", "drop_pct", _REPLICATES)


@query("reclassification", """WITH r AS (SELECT patient_id, avg(odi_3) AS ref FROM ngold0 WHERE in_quality GROUP BY patient_id),
  c AS (SELECT CASE WHEN ref < 5 THEN 'normal' WHEN ref < 15 THEN 'leve' WHEN ref < 30 THEN 'moderado' ELSE 'severo' END AS ref_category, CASE WHEN odi_3 < 5 THEN 'normal' WHEN odi_3 < 15 THEN 'leve' WHEN odi_3 < 30 THEN 'moderado' ELSE 'severo' END AS night_category
    FROM ngold0 n JOIN r ON r.patient_id = n.patient_id WHERE n.in_quality)
  SELECT ref_category, night_category, count(*) AS n, r6(count(*) / sum(count(*)) OVER (PARTITION BY ref_category)) AS row_share, r6(count(*) / sum(count(*)) OVER (PARTITION BY night_category)) AS col_share FROM c GROUP BY 1, 2""")
def _(L):
    n = L.nights.filter("in_quality")
    ref = n.groupBy("patient_id").agg(F.avg("odi_3").alias("ref"))
    j = n.join(ref, "patient_id").select(severity_left_closed(F.col("ref"), SEV).alias("ref_category"), severity_left_closed(F.col("odi_3"), SEV).alias("night_category"))
    return N.crosstab(j, "ref_category", "night_category")


cte("nord AS (SELECT patient_id, night_record_id, odi_3, row_number() OVER (PARTITION BY patient_id ORDER BY user_id) AS k FROM ngold0 WHERE in_quality)")


def ordered_nights(L):
    from nightspark.operators.ordering import order_rows

    n = order_rows(L.nights.filter("in_quality").select("patient_id", KEY, "user_id", "odi_3"), ["patient_id"], ["user_id"], out="k")
    return n.withColumn("k", F.col("k") + 1)


@query("first_night_effect", "SELECT k = 1 AS is_first, count(*) AS n, r6(avg(odi_3)) AS mean, r6(stddev_samp(odi_3)) AS sd, r6(min(odi_3)) AS min, r6(max(odi_3)) AS max FROM nord GROUP BY 1")
def _(L):
    return ordered_nights(L).groupBy((F.col("k") == 1).alias("is_first")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("odi_3").alias("mean"), F.stddev_samp("odi_3").alias("sd"), F.min("odi_3").alias("min"), F.max("odi_3").alias("max"))


@query("trend_per_patient", "SELECT patient_id, count(*) AS n_nights, r6(regr_slope(odi_3, k)) AS slope_per_night, r6(corr(k, odi_3)) AS corr_order_metric FROM nord GROUP BY patient_id HAVING count(*) >= 3")
def _(L):
    k = F.col("k").cast("double")
    return ordered_nights(L).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_nights"), F.regr_slope(F.col("odi_3"), k).alias("slope_per_night"), F.corr(k, F.col("odi_3")).alias("corr_order_metric")).filter("n_nights >= 3")


@query("metric_validation_summary", """WITH v AS (SELECT metric, patient_id, CASE WHEN count(*) > 1 THEN stddev_samp(x) END / nullif(avg(x), 0) AS cv FROM nmet GROUP BY metric, patient_id)
  SELECT m.metric, m.n AS n_non_missing, r6(m.mean) AS overall_mean, r6(m.sd) AS overall_sd, r6(c.md) AS median_cv_patient, r6(c.av) AS mean_cv_patient, r6(i.icc_1_1) AS icc_1_1, r6(i.icc_1_k) AS icc_1_k
  FROM (SELECT metric, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM nmet GROUP BY metric) m JOIN (SELECT metric, quantile_cont(cv, 0.5) AS md, avg(cv) AS av FROM v GROUP BY metric) c ON c.metric = m.metric JOIN iccv i ON i.metric = m.metric""")
def _(L):
    from nightspark.operators.ranks import exact_percentiles

    rows = metric_rows(L)
    overall = rows.groupBy("metric").agg(F.count("x").alias("n_non_missing"), F.avg("x").alias("overall_mean"), F.stddev_samp("x").alias("overall_sd"))
    cv = N.variability(L.nights.filter("in_quality"), _MET, "patient_id")
    mid = exact_percentiles(cv, ["metric"], ["cv"], {"p50": 0.5}).withColumnRenamed("cv_p50", "median_cv_patient")
    mean = cv.groupBy("metric").agg(F.avg("cv").alias("mean_cv_patient"))
    icc = T.icc(rows, "patient_id", "x", ["metric"]).select("metric", "icc_1_1", "icc_1_k")
    return overall.join(mid, "metric").join(mean, "metric").join(icc, "metric")


# --- scores: every event carries a stand-in score and a severe label ---------
cte("""roc AS MATERIALIZED (SELECT *, sum(dp) OVER w AS tp, sum(dn - dp) OVER w AS fp, sum(dp) OVER (PARTITION BY patient_id) AS pos, sum(dn - dp) OVER (PARTITION BY patient_id) AS neg
  FROM (SELECT patient_id, score, count(*) AS dn, count(*) FILTER (WHERE is_severe) AS dp FROM (SELECT patient_id, score, is_severe FROM evs UNION ALL SELECT -1, score, is_severe FROM evs) GROUP BY patient_id, score)
  WINDOW w AS (PARTITION BY patient_id ORDER BY score DESC))""")


@query("roc_auc", "SELECT r6(sum((dn - dp) * (tp - dp / 2.0)) / nullif(max(pos) * max(neg), 0)) AS auc FROM roc WHERE patient_id = -1")
def _(L):
    return T.roc_auc(scored(L), [], "score", "is_severe")


@query("roc_auc_per_patient", "SELECT patient_id, r6(sum((dn - dp) * (tp - dp / 2.0)) / nullif(max(pos) * max(neg), 0)) AS auc FROM roc WHERE patient_id >= 0 GROUP BY patient_id")
def _(L):
    return T.roc_auc(scored(L), ["patient_id"], "score", "is_severe")


@query("average_precision", "SELECT r6(sum(dp / pos * tp / (tp + fp))) AS ap FROM roc WHERE patient_id = -1")
def _(L):
    return T.average_precision(scored(L), [], "score", "is_severe")


@query("youden_threshold", "SELECT r6(score) AS threshold FROM roc WHERE patient_id = -1 ORDER BY round(tp / pos - fp / neg, 12) DESC, score DESC LIMIT 1")
def _(L):
    return T.youden_threshold(scored(L), [], "score", "is_severe")


@query("youden_threshold_per_patient", """WITH g AS (SELECT score AS t FROM roc WHERE patient_id = -1 ORDER BY round(tp / pos - fp / neg, 12) DESC, score DESC LIMIT 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY round(tp / nullif(pos, 0) - fp / nullif(neg, 0), 12) DESC NULLS LAST, score DESC) AS rn FROM roc WHERE patient_id >= 0)
  SELECT patient_id, r6(CASE WHEN pos >= 5 AND neg >= 5 THEN score ELSE (SELECT t FROM g) END) AS threshold, pos < 5 OR neg < 5 AS is_fallback FROM p WHERE rn = 1""")
def _(L):
    own = T.youden_threshold(scored(L), ["patient_id"], "score", "is_severe", 5)
    everyone = T.youden_threshold(scored(L), [], "score", "is_severe").withColumnRenamed("threshold", "_all")
    return with_scalars(own, everyone).select(
        "patient_id", F.coalesce("threshold", "_all").alias("threshold"), F.col("threshold").isNull().alias("is_fallback"))


_TM = "count(*) FILTER (WHERE {p} AND y) AS tp, count(*) FILTER (WHERE {p} AND NOT y) AS fp, count(*) FILTER (WHERE NOT {p} AND y) AS fn, count(*) FILTER (WHERE {p}) AS activations"
_TS = "tp, fp, fn, activations, r6(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) AS sens, r6(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS ppv, CASE WHEN tp > 0 THEN r6(fp / tp) ELSE CAST('inf' AS DOUBLE) END AS ratio"


@query("threshold_metrics", f"SELECT {_TS} FROM (SELECT {_TM.format(p='(score >= 0.5)')} FROM (SELECT *, is_severe AS y FROM evs))")
def _(L):
    return T.threshold_metrics(scored(L), [], F.col("score") >= 0.5, "is_severe")


_GATE = f"""wg AS (SELECT w.night_record_id, w.window_idx, ((w.window_idx * 7919) % 1000) / 1000.0 AS p, EXISTS (SELECT 1 FROM evs e WHERE e.night_record_id = w.night_record_id AND e.is_severe AND e.ts_start > w.t_end AND e.ts_start <= w.t_end + to_seconds(10)) AS y,
  (SELECT count(*) FROM evs e WHERE e.night_record_id = w.night_record_id AND e.ts_start >= w.t_start - to_seconds({P.match_s}) AND e.ts_start <= w.t_end + to_seconds({P.match_s})) > 0 AS has_drop,
  (SELECT arg_min(score, start_idx) FROM evs e WHERE e.night_record_id = w.night_record_id AND e.ts_start >= w.t_start - to_seconds({P.match_s}) AND e.ts_start <= w.t_end + to_seconds({P.match_s})) AS early FROM sts w)"""


def gated(L):
    """Windows with a stand-in risk, the 10 s target, and the matched event."""
    w = small_windows(L)
    ids = [KEY, "window_idx"]
    y = S.lead_time_targets(w.select(*ids, "t_end"), scored(L).filter("is_severe").select(KEY, "ts_start"), [10], ids)
    m = S.earliest_event_near(w, scored(L), ids, float(L.p.match_s))
    return y.join(m, ids).withColumns({"p": (F.col("window_idx") * 7919) % 1000 / 1000.0, "y": F.col("y_10") == 1})


@query("and_gate_metrics", f"WITH {_GATE} SELECT {_TS} FROM (SELECT {_TM.format(p='(p >= 0.5 AND has_drop)')} FROM wg)")
def _(L):
    return T.threshold_metrics(gated(L), [], (F.col("p") >= 0.5) & F.col("has_drop"), "y")


@query("gate_union_metrics", f"WITH {_GATE} SELECT {_TS} FROM (SELECT {_TM.format(p='(p >= 0.8 OR coalesce(early, 0) >= 0.5)')} FROM wg)")
def _(L):
    return T.threshold_metrics(gated(L), [], (F.col("p") >= 0.8) | (F.coalesce("early_score", F.lit(0.0)) >= 0.5), "y")


@query("sens_at_80spec", "SELECT r6(coalesce(max(tp / pos) FILTER (WHERE 1 - fp / neg >= 0.8), 0)) AS sensitivity FROM roc WHERE patient_id = -1")
def _(L):
    return T.sensitivity_at_specificity(scored(L), "score", "is_severe")


@query("confusion_metrics", """WITH x AS (SELECT morphotype_curve AS t, CASE WHEN score < 0.4 THEN 'C3' WHEN score < 0.7 THEN 'C4' ELSE 'C5' END AS p FROM evs WHERE morphotype_curve IS NOT NULL),
  l AS (SELECT t AS c FROM x UNION SELECT p FROM x), k AS (SELECT c, (SELECT count(*) FROM x WHERE t = c) AS r, (SELECT count(*) FROM x WHERE p = c) AS q, (SELECT count(*) FROM x WHERE t = c AND p = c) AS d, (SELECT count(*) FROM x) AS n FROM l),
  a AS (SELECT max(n) AS n, sum(d) / max(n) AS acc, avg(CASE WHEN r > 0 THEN d / r END) AS bal, sum(r * q) / max(n * n) AS pe, sum(CASE WHEN r + q > 0 THEN 2 * d / (r + q) ELSE 0 END * r) / max(n) AS f1 FROM k)
  SELECT n, r6(acc) AS accuracy, r6(bal) AS balanced_accuracy, r6(f1) AS weighted_f1, r6((acc - pe) / (1 - pe)) AS kappa FROM a""")
def _(L):
    s = F.col("score")
    e = scored(L).filter("morphotype_curve is not null").withColumn("pred", F.when(s < 0.4, "C3").when(s < 0.7, "C4").otherwise("C5"))
    return T.confusion_metrics(e, "morphotype_curve", "pred")


_DB = ("drop_pct", "duration_s", "ird_event")


@query("davies_bouldin", f"""WITH c AS (SELECT morphotype AS l, {', '.join(f'avg({f}) AS c_{f}' for f in _DB)} FROM ev WHERE morphotype IS NOT NULL GROUP BY morphotype),
  s AS (SELECT c.*, d.s FROM c JOIN (SELECT e.morphotype AS l, avg(sqrt({' + '.join(f'(e.{f} - c.c_{f}) * (e.{f} - c.c_{f})' for f in _DB)})) AS s FROM ev e JOIN c ON c.l = e.morphotype GROUP BY e.morphotype) d ON d.l = c.l)
  SELECT r6(avg(w)) AS davies_bouldin FROM (SELECT a.l, max((a.s + b.s) / sqrt({' + '.join(f'(a.c_{f} - b.c_{f}) * (a.c_{f} - b.c_{f})' for f in _DB)})) AS w FROM s a JOIN s b ON a.l <> b.l GROUP BY a.l)""")
def _(L):
    return T.davies_bouldin(L.events, "morphotype", _DB)


@query("cluster_sizes", "SELECT morphotype, count(*) AS n, r6(avg(CASE WHEN meets_4pct THEN 1.0 ELSE 0.0 END)) AS share_meets_4 FROM ev WHERE morphotype IS NOT NULL GROUP BY morphotype")
def _(L):
    return L.events.filter("morphotype is not null").groupBy("morphotype").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("meets_4pct").cast("double")).alias("share_meets_4"))


_RS = ", ".join(f"'{c}'" for c in C.CURVE_LABELS)


@query("risk_score", """WITH p AS (SELECT night_record_id, avg(score) AS p FROM evs GROUP BY night_record_id), n AS (SELECT f.night_record_id, p.p, (f.user_id * 37 % 100) / 100.0 AS pn FROM flg f LEFT JOIN p ON p.night_record_id = f.night_record_id),
  q AS (SELECT quantile_cont(p, 0.99) AS p99, least(max(p), quantile_cont(p, 0.99)) AS top FROM n), s AS (SELECT night_record_id, round(least(greatest(100 * (0.4 * least(p, p99) / top + 0.6 * pn), 0), 100), 1) AS risk FROM n CROSS JOIN q WHERE p IS NOT NULL UNION ALL SELECT night_record_id, NULL FROM n WHERE p IS NULL)
  SELECT night_record_id, risk AS risk_score, CASE WHEN risk IS NULL THEN 'unknown' WHEN risk < 30 THEN 'low' WHEN risk < 60 THEN 'moderate' ELSE 'high' END AS risk_label FROM s""")
def _(L):
    from nightspark.functions.scalars import risk_label, risk_score
    from nightspark.operators.ranks import exact_percentiles

    p = scored(L).groupBy(KEY).agg(F.avg("score").alias("p"))
    n = L.nights_of.join(p, KEY, "left").withColumn("pn", F.col("user_id") * 37 % 100 / 100.0)
    cap = exact_percentiles(n, [], ["p"], {"p99": 0.99})
    top = with_scalars(n, cap).withColumn("_capped", F.least("p", "p_p99"))
    scored_ = with_scalars(top, top.agg(F.max("_capped").alias("top")))
    r = risk_score(F.col("p"), F.col("p_p99"), F.col("top"), F.col("pn"))
    return scored_.select(KEY, F.when(F.col("p").isNotNull(), r).alias("risk_score")).withColumn("risk_label", risk_label(F.col("risk_score")))

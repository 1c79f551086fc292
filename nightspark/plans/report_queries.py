"""Queries: staging report, coverage rows, whole feature tables, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.operators import analytics as N
from nightspark.operators import cohorts
from nightspark.operators import series as S
from nightspark.operators.ordering import stable
from nightspark.operators.ranks import exact_percentiles, with_scalars
from nightspark.plans import gold as G
from nightspark.plans.analytic_queries import night_features
from nightspark.plans.gold_queries import _STATE
from nightspark.plans.io_queries import fresh_path
from nightspark.plans.model_queries import fitted_store, night_predictions, phenotypes, risk
from nightspark.plans.oracle import cte
from nightspark.plans.registry import d6, query
from nightspark.plans.series_queries import scored, small_windows
from nightspark.sources import publish as P
from nightspark.sources import tables as B
from nightspark.sources.adapter import PARAMS
from nightspark.sources.tables import multiset_checksum

KEY = "night_record_id"
STAGES = ("wake", "rem", "light", "deep")
# --- fixed values: expected ranges of the staging report ---
EXPECTED_CYCLES = (4, 6)
EXPECTED_CYCLE_MIN = (70, 120)
EXPECTED_REM = (0.15, 0.25)
EXPECTED_DEEP = (0.10, 0.25)
SHORT_RUN_MAX = 0.40
# --- end of fixed values ---
LETTERS = tuple(C.GREEK_NAMES)

cte("""rlen AS MATERIALIZED (SELECT n.night_record_id, s.stage, quantile_cont(run_rows, 0.5) AS med, coalesce(avg(CASE WHEN run_rows <= 1 THEN 1.0 WHEN run_rows > 1 THEN 0.0 END), 0.0) AS short
  FROM (SELECT DISTINCT night_record_id FROM struns) n CROSS JOIN (SELECT unnest(range(4)) AS stage) s LEFT JOIN struns r ON r.night_record_id = n.night_record_id AND r.run_value = s.stage GROUP BY n.night_record_id, s.stage)""")
cte(f"""scyc AS MATERIALIZED (WITH a AS (SELECT *, sum(CASE WHEN run_value IN (2, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY night_record_id ORDER BY run_start) AS resets FROM struns),
  b AS (SELECT *, lag(resets, 1, 0) OVER (PARTITION BY night_record_id ORDER BY run_start) AS g FROM a),
  c AS (SELECT x.night_record_id, x.run_start, (SELECT coalesce(sum(y.run_rows), 0) FROM b y WHERE y.night_record_id = x.night_record_id AND y.run_value IN (2, 3) AND y.run_start < x.run_start AND y.g = x.g) AS nrem FROM b x WHERE x.run_value = 1),
  d AS (SELECT *, run_start - lag(run_start) OVER (PARTITION BY night_record_id ORDER BY run_start) AS step FROM c WHERE nrem >= {PARAMS.cycle_min_s})
  SELECT n.night_record_id, count(d.run_start) AS n_cycles, quantile_cont(d.step, 0.5) / 60.0 AS cyc FROM nqc n LEFT JOIN d ON d.night_record_id = n.night_record_id GROUP BY n.night_record_id)""")
cte("""quin AS MATERIALIZED (SELECT night_record_id, g, """ + ", ".join(f"avg(CASE WHEN sleep_stage = {i} THEN 1.0 ELSE 0.0 END) AS f{i}" for i in range(4)) + """ FROM
  (SELECT *, ntile(5) OVER (PARTITION BY night_record_id ORDER BY seq) AS g FROM sig) GROUP BY night_record_id, g)""")
cte("""sfra AS MATERIALIZED (SELECT night_record_id, patient_id, """ + ", ".join(f"avg(CASE WHEN sleep_stage = {i} THEN 1.0 ELSE 0.0 END) AS f{i}" for i in range(4)) + " FROM sig GROUP BY night_record_id, patient_id)")
cte("""mxs AS MATERIALIZED (SELECT e.morphotype, q.sleep_stage, count(*) AS n FROM evs e JOIN sig q ON q.night_record_id = e.night_record_id AND q.seq = e.start_idx WHERE e.morphotype IS NOT NULL AND q.sleep_stage IS NOT NULL GROUP BY ALL)""")


def _share(lo: float, hi: float, col: str) -> str:
    return f"avg(CASE WHEN {col} BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END)"


_REPORT = [
    *[("cycles", n, e, "scyc") for n, e in (
        ("nights_with_cycles", "count(cyc)"), ("n_cycles_median", "quantile_cont(n_cycles, 0.5)"), ("n_cycles_p25", "quantile_cont(n_cycles, 0.25)"), ("n_cycles_p75", "quantile_cont(n_cycles, 0.75)"),
        ("n_cycles_in_range", _share(*EXPECTED_CYCLES, "n_cycles")), ("cycle_min_median", "quantile_cont(cyc, 0.5)"), ("cycle_min_in_range", _share(*EXPECTED_CYCLE_MIN, "cyc")))],
    *[("quintiles", f"{s}_q{q}", f"avg(f{i}) FILTER (WHERE g = {q})", "quin") for q in range(1, 6) for i, s in enumerate(STAGES)],
    ("quintiles", "deep_decreases", "CAST(avg(f3) FILTER (WHERE g = 1) > avg(f3) FILTER (WHERE g = 5) AS DOUBLE)", "quin"),
    ("quintiles", "rem_increases", "CAST(avg(f1) FILTER (WHERE g = 1) < avg(f1) FILTER (WHERE g = 5) AS DOUBLE)", "quin"),
    *[("architecture", f"mean_{s}", f"avg(f{i})", "sfra") for i, s in enumerate(STAGES)],
    ("architecture", "rem_in_range", _share(*EXPECTED_REM, "f1"), "sfra"), ("architecture", "deep_in_range", _share(*EXPECTED_DEEP, "f3"), "sfra"),
    ("architecture", "nights_with_clinical", "count(c.patient_id)", "sfra f LEFT JOIN clin c ON c.patient_id = f.patient_id"),
    *[("apnea", f"{s}_{a}", f"avg(f{i}) FILTER (WHERE c.apnea_prev = {a})", "sfra f JOIN clin c ON c.patient_id = f.patient_id") for a in (0, 1) for i, s in enumerate(STAGES)],
    *[("runs", f"{s}_{n}", e.format(f"FILTER (WHERE stage = {i})"), "rlen") for i, s in enumerate(STAGES) for n, e in (
        ("median_s", "quantile_cont(med, 0.5) {0}"), ("pct_short", "quantile_cont(short, 0.5) {0}"), ("nights_short", f"avg(CASE WHEN short > {SHORT_RUN_MAX} THEN 1.0 ELSE 0.0 END) {{0}}"))],
    *[("morphotypes", f"{C.GREEK_NAMES[m]}_{s}", f"coalesce(sum(n) FILTER (WHERE morphotype = '{m}' AND sleep_stage = {i}), 0)", "mxs") for m in LETTERS for i, s in enumerate(STAGES)],
    ("morphotypes", "gamma_in_sleep", "coalesce(sum(n) FILTER (WHERE morphotype = 'γ' AND sleep_stage > 0) / nullif(sum(n) FILTER (WHERE morphotype = 'γ'), 0), 0)", "mxs"),
]


@query("staging_report", " UNION ALL ".join(f"SELECT '{a}' AS section, '{n}' AS name, r6({e}) AS value FROM {t}" for a, n, e, t in _REPORT))
def _(L):
    """The whole staging report, one figure a row: cycles, quintiles, architecture, run lengths, event labels by stage."""
    runs = stable(S.stage_runs(L.signal, L.layout))
    cyc = stable(S.sleep_cycles(runs, L.layout, L.p.cycle_min_s).select("n_cycles", F.col("median_cycle_min").alias("cyc")))
    share = lambda lo, hi, c: F.avg(F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("double"))
    pct = exact_percentiles(cyc, [], ["n_cycles", "cyc"], {"p25": .25, "p50": .5, "p75": .75})
    cycles = with_scalars(cyc.agg(F.count("cyc").alias("a"), share(*EXPECTED_CYCLES, "n_cycles").alias("b"), share(*EXPECTED_CYCLE_MIN, "cyc").alias("c")), pct).select(
        F.col("a").alias("nights_with_cycles"), F.col("n_cycles_p50").alias("n_cycles_median"), "n_cycles_p25", "n_cycles_p75", F.col("b").alias("n_cycles_in_range"),
        F.col("cyc_p50").alias("cycle_min_median"), F.col("c").alias("cycle_min_in_range"))
    quint = S.quintile_composition(L.signal, L.layout).agg(*[
        F.avg(F.when(F.col("quintile") == q - 1, F.col(f"frac_stage_{i}"))).alias(f"{s}_q{q}") for q in range(1, 6) for i, s in enumerate(STAGES)])
    quint = quint.withColumns({"deep_decreases": (F.col("deep_q1") > F.col("deep_q5")), "rem_increases": (F.col("rem_q1") < F.col("rem_q5"))})
    part = {s: F.avg((F.coalesce(F.col("sleep_stage") == i, F.lit(False))).cast("double")).alias(s) for i, s in enumerate(STAGES)}
    nights = stable(L.signal.groupBy(KEY, "patient_id").agg(*part.values()).join(
        L.clinical.select(F.col("patient_id").alias("_p"), F.col("apnea_prev").alias("_a")), F.col("patient_id") == F.col("_p"), "left"))
    arch = nights.agg(*[F.avg(s).alias(f"mean_{s}") for s in STAGES], share(*EXPECTED_REM, "rem").alias("rem_in_range"), share(*EXPECTED_DEEP, "deep").alias("deep_in_range"), F.count("_p").alias("nights_with_clinical"))
    apnea = nights.agg(*[F.avg(F.when(F.col("_a") == a, F.col(s))).alias(f"{s}_{a}") for a in (0, 1) for s in STAGES])
    lengths = stable(S.run_length_stats(runs, short_rows=1))
    mid = exact_percentiles(lengths, ["stage"], ["median_run_s", "pct_short"], {"m": 0.5})
    long = lengths.groupBy("stage").agg(F.avg((F.col("pct_short") > SHORT_RUN_MAX).cast("double")).alias("_n")).join(mid, "stage")
    run = long.agg(*[F.max(F.when(F.col("stage") == i, F.col(c))).alias(f"{s}_{n}") for i, s in enumerate(STAGES)
                     for n, c in (("median_s", "median_run_s_m"), ("pct_short", "pct_short_m"), ("nights_short", "_n"))])
    at = L.signal.select(KEY, F.col("seq").alias("start_idx"), "sleep_stage")
    cells = L.events.join(at, [KEY, "start_idx"]).filter("morphotype is not null and sleep_stage is not null").groupBy("morphotype", "sleep_stage").agg(F.count(F.lit(1)).alias("n"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    gamma = F.col("morphotype") == "γ"
    morph = cells.agg(*[count((F.col("morphotype") == m) & (F.col("sleep_stage") == i)).alias(f"{C.GREEK_NAMES[m]}_{s}") for m in LETTERS for i, s in enumerate(STAGES)],
                      F.coalesce(count(gamma & (F.col("sleep_stage") > 0)) / F.nullif(count(gamma), F.lit(0)), F.lit(0.0)).alias("gamma_in_sleep"))
    out = None
    for name, wide in (("cycles", cycles), ("quintiles", quint), ("architecture", arch), ("apnea", apnea), ("runs", run), ("morphotypes", morph)):
        one = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]).unpivot([], wide.columns, "name", "value").select(F.lit(name).alias("section"), "name", "value")
        out = one if out is None else out.union(one)
    return out


_CLINICAL = ("sexo", "peso_kg", "talla_cm", "apnea_prev")


@query("clinical_coverage_rows", """WITH c AS (SELECT patient_id, sexo, peso_kg, CASE WHEN patient_id % 5 <> 0 THEN talla_cm END AS talla_cm, CASE WHEN patient_id % 7 <> 0 THEN apnea_prev END AS apnea_prev FROM clin),
  p AS (SELECT patient_id, count(*) AS n_records FROM nqc GROUP BY patient_id)
  SELECT p.patient_id, n_records, concat_ws(',', CASE WHEN sexo IS NULL THEN 'sexo' END, CASE WHEN peso_kg IS NULL THEN 'peso_kg' END, CASE WHEN talla_cm IS NULL THEN 'talla_cm' END, CASE WHEN apnea_prev IS NULL THEN 'apnea_prev' END) AS missing,
  CASE WHEN c.patient_id IS NULL THEN 'missing' WHEN talla_cm IS NULL OR apnea_prev IS NULL OR sexo IS NULL OR peso_kg IS NULL THEN 'partial' ELSE 'complete' END AS status FROM p LEFT JOIN c ON c.patient_id = p.patient_id""")
def _(L):
    clinical = L.clinical.withColumns({"talla_cm": F.when(F.col("patient_id") % 5 != 0, F.col("talla_cm")), "apnea_prev": F.when(F.col("patient_id") % 7 != 0, F.col("apnea_prev"))})
    return cohorts.clinical_rows(L.nights_of, clinical, _CLINICAL)


_SEVERITY = ("odi_3", "ahi_3", "ct90_min", "t90_frac", "hypoxic_burden_90", "mean_ari", "p90_ari", "frac_severe_morpho")
_TRANSITIONS = tuple(f"n_transitions_state_{s}" for s in C.STATE_K)
_ENTROPY = tuple(f"entropy_state_{s}" for s in C.STATE_K)
_CI = tuple(f"ci_{s}" for s in C.STATE_K)


def multiscale(L):
    own = L.nights.select(KEY, *_STATE, *_TRANSITIONS, *_ENTROPY)
    return own.join(night_features(L).select(KEY, *_SEVERITY), KEY).join(N.coupling_index(scored(L)), KEY, "left")


cte("cidx AS MATERIALIZED (SELECT e.night_record_id, " + ", ".join(f"avg(CASE WHEN p.in_path THEN 1.0 ELSE 0.0 END) FILTER (WHERE x.scale = '{s}' AND x.is_severe) AS ci_{s}" for s in C.STATE_K)
    + " FROM (SELECT DISTINCT night_record_id FROM evs) e LEFT JOIN evstate x ON x.night_record_id = e.night_record_id LEFT JOIN spath p ON p.scale = x.scale AND p.state = x.state GROUP BY e.night_record_id)")


@query("night_multiscale_table", f"""SELECT n.night_record_id, {', '.join(f'r6(n.{c}) AS {c}' for c in (*_STATE, *_ENTROPY))}, {', '.join('n.' + c for c in _TRANSITIONS)}, {', '.join(f'r6(f.{c}) AS {c}' for c in _SEVERITY)}, {d6(*_CI)}
  FROM ngold0 n JOIN nfeat f ON f.night_record_id = n.night_record_id LEFT JOIN cidx c ON c.night_record_id = n.night_record_id""")
def _(L):
    """Night features of all scales, severity and coupling, by key."""
    return multiscale(L)


@query("night_multiscale_export")
def _(L):
    """The same table beside phenotype, night prediction and mean risk of a severe event (boosted, longest horizon)."""
    last = f"y_{max(L.p.horizons_s)}"
    p = risk(L).filter((F.col("model") == "boosted") & (F.col("target") == last)).groupBy(KEY).agg(F.avg(F.get("probability", F.lit(1))).alias("mean_risk"))
    predicted = night_predictions(L).select(KEY, F.col("prediction").alias("severity_predicted"), "correct")
    return multiscale(L).join(phenotypes(L), KEY, "left").join(predicted, KEY, "left").join(p, KEY, "left")


@query("class_prevalence_horizons", "SELECT w.patient_id, h.y AS horizon, count(*) AS n, r6(avg(h.v)) AS prevalence FROM (SELECT n.patient_id, "
       + ", ".join(f"CAST(EXISTS (SELECT 1 FROM evs e WHERE e.night_record_id = w.night_record_id AND e.is_severe AND e.ts_start > w.t_end AND e.ts_start <= w.t_end + to_seconds({h})) AS DOUBLE) AS y_{h}" for h in PARAMS.horizons_s)
       + " FROM sts w JOIN nqc n ON n.night_record_id = w.night_record_id) w CROSS JOIN LATERAL (VALUES " + ", ".join(f"('y_{h}', w.y_{h})" for h in PARAMS.horizons_s) + ") h(y, v) GROUP BY w.patient_id, h.y")
def _(L):
    """Share of windows with a severe event ahead, per patient and horizon."""
    w = small_windows(L).select(KEY, "window_idx", "t_end")
    y = S.lead_time_targets(w, scored(L).filter("is_severe").select(KEY, "ts_start"), L.p.horizons_s, [KEY, "window_idx"])
    names = [f"y_{h}" for h in L.p.horizons_s]
    long = y.join(L.nights_of, KEY).unpivot(["patient_id"], names, "horizon", "v")
    return long.groupBy("patient_id", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("prevalence"))


@query("pre_post_same", "SELECT is_severe, scale, count(*) AS n, r6(avg(CASE WHEN p = x THEN 1.0 ELSE 0.0 END)) AS same_share FROM (" + " UNION ALL ".join(
    f"SELECT is_severe, '{s}' AS scale, prev_{s} AS p, next_{s} AS x FROM evnb" for s in C.STATE_K) + ") WHERE p IS NOT NULL AND x IS NOT NULL GROUP BY is_severe, scale")
def _(L):
    """Share of events after which the record is in the state it was in before."""
    return N.returns_to_state(scored(L), L.layout)


GOLD = ("events", "events_curves", "states", "nights", "patients")


def gold_tables(L) -> dict:
    """Five gold and six analytic tables."""
    return {
        "events": G.with_flags(L.events, L.flags), "events_curves": G.gold_curves(L.events), "states": G.with_flags(L.states, L.flags), "nights": L.nights,
        "patients": G.gold_patients(L.nights, L.events, L.states, L.clinical), "event_states_multiscale": L.event_states, "night_features": night_features(L),
        "transition_matrices": N.transition_matrix(L.states, L.layout), "state_profile": N.state_profile(L.states), "coupling_index": N.coupling_index(scored(L)), "night_multiscale": multiscale(L)}


@query("write_gold", """SELECT 'events' AS name, patient_id, count(*) AS n FROM ev GROUP BY patient_id
  UNION ALL SELECT 'events_curves', q.patient_id, count(*) FROM (SELECT DISTINCT night_record_id, start_idx FROM curvepts) c JOIN nqc q ON q.night_record_id = c.night_record_id GROUP BY q.patient_id
  UNION ALL SELECT 'states', q.patient_id, count(*) FROM st s JOIN nqc q ON q.night_record_id = s.night_record_id GROUP BY q.patient_id
  UNION ALL SELECT 'nights', patient_id, count(*) FROM ngold0 GROUP BY patient_id UNION ALL SELECT 'patients', patient_id, 1 FROM ngold0 GROUP BY patient_id
  UNION ALL SELECT 'event_states_multiscale', q.patient_id, count(*) FROM evs e JOIN nqc q ON q.night_record_id = e.night_record_id GROUP BY q.patient_id
  UNION ALL SELECT 'night_features', patient_id, count(*) FROM nfeat GROUP BY patient_id
  UNION ALL SELECT 'transition_matrices', NULL, count(*) FROM tmat HAVING count(*) > 0
  UNION ALL SELECT 'state_profile', NULL, count(*) FROM (SELECT DISTINCT scale, state_label FROM st WHERE state_label IS NOT NULL) HAVING count(*) > 0
  UNION ALL SELECT 'coupling_index', q.patient_id, count(*) FROM cidx c JOIN nqc q ON q.night_record_id = c.night_record_id GROUP BY q.patient_id
  UNION ALL SELECT 'night_multiscale', n.patient_id, count(*) FROM ngold0 n JOIN nfeat f ON f.night_record_id = n.night_record_id GROUP BY n.patient_id""")
def _(L):
    """Five gold and six analytic tables written whole; rows of each one and each patient as they are read back (null: a table without nights)."""
    root, out = fresh_path(L, "gold"), None
    for name, t in gold_tables(L).items():
        B.write_layer(t, f"{root}/{name}", {"model_version": "v1"}, {"events": ["patient_id"], "states": ["scale"]}.get(name, ()))
        back = B.read_layer(L.spark, f"{root}/{name}")
        if "patient_id" not in back.columns and KEY in back.columns:
            back = back.join(L.nights_of.select(KEY, "patient_id"), KEY, "left")
        owner = F.col("patient_id") if "patient_id" in back.columns else F.lit(None)
        one = back.groupBy(owner.cast("long").alias("patient_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "patient_id", "n")
        out = one if out is None else out.union(one)
    return out


@query("publish_gold", """SELECT 'events' AS name, count(*) AS n_rows, true AS equal FROM ev UNION ALL SELECT 'events_curves', count(*), true FROM (SELECT DISTINCT night_record_id, start_idx FROM curvepts)
  UNION ALL SELECT 'states', count(*), true FROM st UNION ALL SELECT 'nights', count(*), true FROM ngold0 UNION ALL SELECT 'patients', count(DISTINCT patient_id), true FROM ngold0
  UNION ALL SELECT 'event_states_multiscale', count(*), true FROM evs UNION ALL SELECT 'night_features', count(*), true FROM nfeat UNION ALL SELECT 'transition_matrices', count(*), true FROM tmat
  UNION ALL SELECT 'state_profile', count(*), true FROM (SELECT DISTINCT scale, state_label FROM st WHERE state_label IS NOT NULL)
  UNION ALL SELECT 'coupling_index', count(*), true FROM cidx UNION ALL SELECT 'night_multiscale', count(*), true FROM ngold0 n JOIN nfeat f ON f.night_record_id = n.night_record_id
  UNION ALL SELECT 'gate', 1, true""")
def _(L):
    """Five gold and six analytic tables and the gate, published as one version and compared with what is read back."""
    from nightspark.operators import checks as K
    from nightspark.plans.check_queries import _checks

    root = fresh_path(L, "gold")
    tables = {n: stable(t) for n, t in gold_tables(L).items()}
    gate = K.gate(_checks(L), ["B1", "B2"], "apply_qa")
    P.publish(L.spark, root, tables, {"gate": gate.select(F.to_json(F.struct(*gate.columns)).alias("value"))}, {"states": "scale"})
    out = L.spark.read.text(f"{root}/v1/gate").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("gate").alias("name"), "n_rows", (F.col("n_rows") == 1).alias("equal"))
    for name, t in tables.items():
        back = multiset_checksum(P.read_published(L.spark, root, name).select(*t.columns))
        one = with_scalars(back, multiset_checksum(t).select(F.col("checksum").alias("_was"))).select(F.lit(name).alias("name"), "n_rows", (F.col("checksum") == F.col("_was")).alias("equal"))
        out = out.union(one)
    return out


@query("refresh_states", "SELECT run, reason, count(*) AS n FROM (SELECT 1 AS run, 'missing' AS reason FROM nqc WHERE user_id % 10 <> 3 UNION ALL SELECT 3, 'missing' FROM nqc WHERE user_id % 10 = 3) GROUP BY run, reason")
def _(L):
    """A layer of states made for nine records of ten, again without changes, then with the tenth: what each run renews."""
    path = fresh_path(L, "states-layer")
    q = L.night_qc.select(KEY, F.col("n_samples").cast("long").alias("version"), "user_id")
    build = lambda records: L.states.join(records, KEY, "left_semi")
    late = F.col("user_id") % 10 == 3
    model = L.state_store.meta["fingerprint"]
    out = None
    for run, inputs in ((1, q.filter(~late)), (2, q.filter(~late)), (3, q)):
        one = P.refresh(L.spark, path, inputs.drop("user_id"), build, model).withColumn("run", F.lit(run))
        out = one if out is None else out.union(one)
    return out.groupBy("run", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("stored_kmeans")
def _(L):
    """The K-means models of the three scales as the store gives them back, with their labels and sizes."""
    return fitted_store(L).table(L.spark)

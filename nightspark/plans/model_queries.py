"""Queries: clustering fits, out-of-fold models, scoring (rows-only checks)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.functions.scalars import index_of, risk_label, risk_score
from nightspark.operators import analytics as N
from nightspark.operators import folds as D
from nightspark.operators import labels as LB
from nightspark.operators import lloyd as V
from nightspark.operators import models as M
from nightspark.operators import series as S
from nightspark.operators import trees as T
from nightspark.operators.ordering import stable
from nightspark.operators.ranks import exact_percentiles, with_scalars
from nightspark.operators.store import Store, snapshot
from nightspark.operators.windows import training_events, training_windows
from nightspark.plans.analytic_queries import night_features
from nightspark.plans.io_queries import fresh_path
from nightspark.plans.registry import query
from nightspark.plans.series_queries import nested, scored, small_windows

KEY = "night_record_id"
IDS = [KEY, "window_idx"]
EVENT_FEATURES = ("drop_pct", "duration_s", "delta_hr_bpm", "peak_mov", "frac_path_prev", "recent_morph_mean", "ci_so_far", "event_position")
WINDOW_FEATURES = ("state_s_enc", "state_m_enc", "state_l_enc", "window_position", "n_ev_5min", "n_severe_5min",
                   "frac_severe_10min", "time_since_last_ev", "time_since_last_severe", "n_severe_sofar", "ci_sofar")


class Clustering:
    """Rows of one clustering, its features, K and restarts; fits are made once, all K and starts together."""

    def __init__(self, rows, features, key, k: int | None, restarts: int = 10, sweep: bool = True) -> None:
        self.rows, self.features, self.key, self.fixed, self.restarts, self.sweeps = rows, features, key, k, restarts, sweep

    @cached_property
    def fits(self):
        return V.fit_many(self.rows, range(2, 11) if self.sweeps else [self.fixed], self.restarts)

    @cached_property
    def rated(self):
        return V.measures(self.rows, [self.fits[k] for k in sorted(self.fits)])

    @cached_property
    def k(self) -> int:
        """The given K, or the one the sweep prefers."""
        if self.fixed:
            return self.fixed
        spark = self.rows.sparkSession
        return M.choose_k(spark.createDataFrame(sweep_rows("", self), SWEEP)).first().k or 2

    @property
    def fit(self):
        return self.fits[self.k]


def together(spark, work, items) -> list:
    """``work`` of each item, beside each other: fits are many short jobs, and one alone leaves most cores idle."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


SWEEP = "model string, k long, inertia double, silhouette double, davies_bouldin double"


def sweep_rows(name: str, c: Clustering) -> list[tuple]:
    return [(name, r["k"], r["inertia"], r["silhouette"], r["davies_bouldin"]) for r in c.rated]


def state_scaling(L, scale: str):
    w = L.windows.filter(F.col("scale") == scale).filter(training_windows(F.col("frac_wake"), F.col("coverage")))
    mean, std = LB.fit_zscore(w, C.WINDOW_FEATURES)
    return w, mean, std


def clusterings(L) -> dict[str, Clustering]:
    """Windows of the three scales, events by their features (K by the sweep), events by their curves."""
    if "_clusterings" not in L.__dict__:
        out = {}
        for scale, k in C.STATE_K.items():
            w, mean, std = state_scaling(L, scale)
            out[scale] = Clustering(V.prepared(w, LB.apply_zscore(C.WINDOW_FEATURES, mean, std), IDS), C.WINDOW_FEATURES, IDS, k)
        e = L.events.filter(training_events(F.col("in_sleep"), F.col("near_gap"), F.col("meets_3pct")))
        mean, std = LB.fit_zscore(e, C.EVENT_FEATURES)
        ids = [KEY, "start_idx"]
        out["events"] = Clustering(V.prepared(e, LB.apply_zscore(C.EVENT_FEATURES, mean, std), ids), C.EVENT_FEATURES, ids, None)
        d = stable(L.events.filter(F.col("duration_s") <= L.p.curve_max_s).select(
            *ids, LB.delta_curve(F.col("spo2_curve"), F.col("baseline_spo2")).alias("_d")))
        points = [F.get("_d", F.lit(i)) for i in range(C.CURVE_POINTS)]
        out["curves"] = Clustering(V.prepared(d, points, ids), tuple(f"p{i}" for i in range(C.CURVE_POINTS)), ids, 5, restarts=20, sweep=False)
        L.__dict__["_clusterings"] = out
    return L.__dict__["_clusterings"]


def event_dataset(L):
    if "_event_data" not in L.__dict__:
        in_path = F.coalesce(F.col("state_m").isin("M0", "M2"), F.lit(False))
        e = S.event_rolling(scored(L).filter("morphotype_curve is not null"), L.layout, in_path, L.p.rolling_events)
        L.__dict__["_event_data"] = stable(e.select(KEY, "start_idx", "patient_id", "is_severe", "score", *EVENT_FEATURES))
    return L.__dict__["_event_data"]


def window_dataset(L):
    """Small windows with nested states, position, event context, targets."""
    if "_window_data" not in L.__dict__:
        base = S.window_position(nested(L)).filter("state_label is not null").select(
            *IDS, "patient_id", "window_position", index_of(F.col("state_label")).alias("state_s_enc"),
            index_of(F.col("state_m_label")).alias("state_m_enc"), index_of(F.col("state_l_label")).alias("state_l_enc"))
        ctx = S.window_context(small_windows(L), scored(L), L.layout, L.p)
        sev = scored(L).filter("is_severe").select(KEY, "ts_start")
        y = S.lead_time_targets(small_windows(L).select(*IDS, "t_end"), sev, L.p.horizons_s, IDS)
        early = S.scores_before(small_windows(L), scored(L), IDS, 20.0, 3.0, 0.5)
        L.__dict__["_window_data"] = stable(base.join(ctx, IDS).join(y, IDS).join(early, IDS))
    return L.__dict__["_window_data"]


def night_dataset(L):
    n = night_features(L).join(L.nights.select(KEY, "n_transitions_state_m", "entropy_state_m", "frac_state_m_M1", "frac_state_m_M3"), KEY)
    ci = N.coupling_index(scored(L)).select(KEY, F.col("ci_m").alias("coupling_index"))
    return n.join(ci, KEY, "left")


@query("kmeans_sweep")
def _(L):
    swept = {n: c for n, c in clusterings(L).items() if c.sweeps}
    together(L.spark, lambda c: c.rated, swept.values())
    return L.spark.createDataFrame([r for n, c in swept.items() for r in sweep_rows(n, c)], SWEEP)


@query("choose_k")
def _(L):
    """The K that each sweep prefers, beside the K in use."""
    rows = []
    together(L.spark, lambda c: c.sweeps and c.rated, clusterings(L).values())
    for n, c in clusterings(L).items():
        if c.sweeps:
            best = M.choose_k(L.spark.createDataFrame(sweep_rows(n, c), SWEEP)).first().k
            rows.append((n, best, c.k))
    return L.spark.createDataFrame(rows, "model string, k long, k_used long")


@query("fit_kmeans")
def _(L):
    """Centres of all models (z-space; curves: differences to the baseline) with their sizes."""
    together(L.spark, lambda c: c.fit, clusterings(L).values())
    rows = [(n, j, int(size), f, float(v)) for n, c in clusterings(L).items()
            for j, (centre, size) in enumerate(zip(c.fit.centres, c.fit.counts, strict=True)) for f, v in zip(c.features, centre, strict=True)]
    return L.spark.createDataFrame(rows, "model string, cluster long, n long, feature string, z double")


@query("silhouette")
def _(L):
    rows = []
    together(L.spark, lambda c: c.rated, clusterings(L).values())
    for n, c in clusterings(L).items():
        rated = {r["k"]: r for r in c.rated}
        if c.k in rated:
            rows.append((n, c.k, int(c.fit.counts.sum()), rated[c.k]["silhouette"]))
    return L.spark.createDataFrame(rows, "model string, k long, n long, silhouette double")


def fitted_store(L):
    """The K-means models of the three scales in the store, read back."""
    if "_kmeans_store" not in L.__dict__:
        models, counts = {}, {}
        held = clusterings(L)
        together(L.spark, lambda scale: held[scale].fit, C.STATE_K)
        for scale in C.STATE_K:
            c = clusterings(L)[scale]
            _, mean, std = state_scaling(L, scale)
            names = tuple(f"{C.STATE_PREFIX[scale]}{j}" for j in range(len(c.fit.centres)))
            models[scale] = LB.CentroidModel(C.WINDOW_FEATURES, mean, std, tuple(tuple(map(float, v)) for v in c.fit.centres), names)
            counts[scale] = tuple(int(v) for v in c.fit.counts)
        kept = Store(L.spark, f"{L.root}/models", "kmeans")
        kept.save(models, counts, {"model_version": "v1", "random_state": 42, "snapshot": snapshot(L.nights_of, KEY, "patient_id"),
                                   "inertia": {s: clusterings(L)[s].fit.inertia for s in C.STATE_K}})
        L.__dict__["_kmeans_store"] = kept.load()
    return L.__dict__["_kmeans_store"]


@query("apply_fitted_states")
def _(L):
    """All windows labelled by the stored K-means models."""
    return LB.label_windows(L.windows, {s: m for s, m in fitted_store(L).models.items() if m.centroids}, L.nights_of, L.night_qc)


@query("apply_fitted_events")
def _(L):
    """Training events labelled by the fitted event and curve models, curve clusters named C1 (mild) to C5 by their depth."""
    c = clusterings(L)
    together(L.spark, lambda n: c[n].fit, ("events", "curves"))
    depth = sorted(range(len(c["curves"].fit.centres)), key=lambda j: -c["curves"].fit.centres[j].min())
    names = {j: f"C{i + 1}" for i, j in enumerate(depth)}
    shape = V.assigned(c["curves"].rows, c["curves"].fit, c["curves"].key)
    curve = F.coalesce(*[F.when(F.col("cluster") == j, n) for j, n in names.items()], F.lit(None).cast("string"))
    shape = shape.select(*c["curves"].key, curve.alias("morphotype_curve"), F.col("distance").alias("curve_dist"))
    scalar = V.assigned(c["events"].rows, c["events"].fit, c["events"].key)
    letters = F.array(*[F.lit(x) for x in C.GREEK])
    scalar = scalar.select(*c["events"].key, F.get(letters, F.col("cluster")).alias("morphotype"), F.col("distance").alias("morphotype_dist"))
    return scalar.join(shape, c["events"].key, "full_outer")


@query("order_clusters", """WITH m AS (SELECT e.morphotype, p.point, avg(p.spo2 - e.baseline_spo2) AS v FROM curvepts p JOIN ev e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx WHERE e.morphotype IS NOT NULL GROUP BY e.morphotype, p.point)
  SELECT morphotype, r6(min(v)) AS depth, row_number() OVER (ORDER BY min(v) DESC, morphotype) AS severity_rank FROM m GROUP BY morphotype""")
def _(L):
    d = LB.delta_curve(F.col("spo2_curve"), F.col("baseline_spo2"))
    pts = L.events.filter("morphotype is not null").select("morphotype", F.posexplode(d).alias("point", "v"))
    cent = pts.groupBy("morphotype", "point").agg(F.avg("v").alias("v")).groupBy("morphotype").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point", "v"))), lambda x: x["v"]).alias("centroid"))
    return LB.order_clusters(cent, "morphotype")


@query("bootstrap_cluster_agreement")
def _(L):
    """Ten refits on 80 % of the rows against each model: agreement of a run (cluster null) and of each cluster."""
    found = together(L.spark, lambda c: V.agreement(c.rows, c.fit), clusterings(L).values())
    rows = [(n, *r) for n, each in zip(clusterings(L), found, strict=True) for r in each]
    return L.spark.createDataFrame(rows, "model string, run long, cluster long, n long, agreement_pct double")


_PCA = ("odi_3", "mean_ari", "t90_frac", "mean_hr", "sleep_efficiency", "mean_hr_gain", "frac_severe_morpho", "n_transitions_state_m", "entropy_state_m", "coupling_index")


@query("pca")
def _(L):
    feats = ("odi_3", "mean_ari", "t90_frac", "mean_hr", "sleep_efficiency")
    scores, ratio = M.pca_scores(stable(night_dataset(L)), feats, 3, [KEY])
    return scores.withColumns({f"explained_{i + 1}": F.lit(v) for i, v in enumerate(ratio)})


@query("pca_loadings")
def _(L):
    """Loadings and explained variance of 2 and of 10 components."""
    n = stable(night_dataset(L))
    return M.pca_loadings(n, _PCA[:5], 2).withColumn("components", F.lit(2)).union(M.pca_loadings(n, _PCA, 10).withColumn("components", F.lit(10)))


PHENOTYPE = ("frac_state_m_M1", "frac_state_m_M3", "frac_severe_morpho", "mean_ari", "coupling_index", "n_transitions_state_m", "entropy_state_m")


def phenotypes(L):
    """Clusters of nights (K = 3, ten starts), numbered by the cluster median of severe events."""
    if "_phenotypes" not in L.__dict__:
        n = stable(night_dataset(L))
        mean, std = LB.fit_zscore(n, PHENOTYPE)
        rows = V.prepared(n, LB.apply_zscore(PHENOTYPE, mean, std), [KEY, "frac_severe_morpho"])
        named = V.assigned(rows, V.fit_many(rows, [3], 10)[3], [KEY, "frac_severe_morpho"])
        mid = exact_percentiles(named, ["cluster"], ["frac_severe_morpho"], {"m": 0.5})
        # three rows: the position of each cluster among the medians
        order = mid.agg(F.array_sort(F.collect_list(F.struct("frac_severe_morpho_m", "cluster"))).alias("_o"))
        rank = F.array_position(F.transform("_o", lambda x: x["cluster"]), F.col("cluster")) - 1
        L.__dict__["_phenotypes"] = stable(with_scalars(named, order).select(KEY, rank.alias("phenotype")))
    return L.__dict__["_phenotypes"]


@query("night_phenotypes")
def _(L):
    return phenotypes(L)


def event_folds(L):
    if "_event_folds" not in L.__dict__:
        L.__dict__["_event_folds"] = D.out_of_fold(event_dataset(L), EVENT_FEATURES, "is_severe", "patient_id", [KEY, "start_idx"])
    return L.__dict__["_event_folds"]


@query("lopo_logistic")
def _(L):
    return M.fold_scores(event_folds(L)[0], "patient_id")


@query("lopo_coefficients")
def _(L):
    """Coefficients of every fold, and of the model over all events (fold null)."""
    return D.coefficients(L.spark, event_folds(L)[1])


def event_trees(L):
    if "_event_trees" not in L.__dict__:
        e = event_dataset(L).withColumn("is_severe", F.col("is_severe").cast("int"))
        L.__dict__["_event_trees"] = T.out_of_fold(e, EVENT_FEATURES, ["is_severe"], "patient_id", [KEY, "start_idx"], T.Growth(trees=300, depth=5))
    return L.__dict__["_event_trees"]


@query("lopo_gbt")
def _(L):
    return M.fold_scores(event_trees(L)[0], "patient_id")


def _graded(L):
    """Nights with a 4-class severity by quartiles of the event index."""
    n = stable(night_dataset(L))
    q = exact_percentiles(n, [], ["odi_3"], {"a": 0.25, "b": 0.5, "c": 0.75})
    x = F.col("odi_3")
    grade = F.when(x <= F.col("odi_3_a"), 0).when(x <= F.col("odi_3_b"), 1).when(x <= F.col("odi_3_c"), 2).otherwise(3)
    return with_scalars(n, q).withColumn("y", grade)


_NIGHT = ("mean_ari", "mean_hr_gain", "frac_severe_morpho", "t90_frac", "mean_hr", "sleep_efficiency", "n_transitions_state_m", "entropy_state_m")


_NIGHT_GROUPS = {"reactivity": ("mean_ari", "mean_hr_gain"), "severity": ("frac_severe_morpho", "t90_frac"), "heart": ("mean_hr",),
                 "sleep": ("sleep_efficiency",), "dynamics": ("n_transitions_state_m", "entropy_state_m")}


def forest_folds(L):
    """(predictions, trees) of the night forest, one patient held out at a time; fitted once."""
    if "_forest" not in L.__dict__:
        growth = T.Growth(boosted=False, classes=4, trees=300, depth=15, leaf_rows=2, share=len(_NIGHT) ** 0.5 / len(_NIGHT))
        L.__dict__["_forest"] = T.out_of_fold(_graded(L), _NIGHT, ["y"], "patient_id", [KEY], growth)
    return L.__dict__["_forest"]


@query("lopo_random_forest")
def _(L):
    return M.multiclass_scores(forest_folds(L)[0])


@query("feature_importance")
def _(L):
    """Mean and deviation over folds of gain shares: of features, of groups of them, and of the boosted event model."""
    forest = forest_folds(L)[1]
    one = T.importances(L.spark, forest, _NIGHT).withColumn("model", F.lit("night"))
    two = T.importances(L.spark, forest, _NIGHT, _NIGHT_GROUPS).withColumn("model", F.lit("night groups"))
    return one.union(two).union(T.importances(L.spark, event_trees(L)[1], EVENT_FEATURES).withColumn("model", F.lit("events")))


def night_predictions(L):
    p, _ = forest_folds(L)
    return p.select(KEY, F.col("_label").alias("y"), "prediction", (F.col("_label") == F.col("prediction")).alias("correct"), "fold_status",
                    *[F.get("probability", F.lit(i)).alias(f"p{i}") for i in range(4)])


@query("export_night_predictions")
def _(L):
    """Out-of-fold predictions beside the night they belong to, joined by key."""
    n = L.nights.select(KEY, "user_id", "patient_id", "in_quality", "ahi_3", "tst_s", "sleep_efficiency")
    return n.join(night_predictions(L), KEY, "left")


@query("ablation")
def _(L):
    groups = {"shape": EVENT_FEATURES[:4], "history": EVENT_FEATURES[4:], "all": EVENT_FEATURES}
    return M.ablation(event_dataset(L), groups, ["is_severe"], "patient_id", [KEY, "start_idx"])


def horizons(L) -> list[str]:
    return [c for c in window_dataset(L).columns if c.startswith("y_")]


@query("stacked_comparison")
def _(L):
    early = ("early_score_mean", "early_score_max", "early_severe_count")
    groups = {"base": WINDOW_FEATURES, "base_early": (*WINDOW_FEATURES, *early), "early": early}
    return M.ablation(window_dataset(L), groups, horizons(L), "patient_id", IDS)


def risk(L):
    """Risk of a severe event within each horizon, by boosted and logistic models that never saw the patient."""
    if "_risk" not in L.__dict__:
        data = window_dataset(L).withColumns({y: F.col(y).cast("int") for y in horizons(L)})
        cols = [*IDS, "patient_id", "target", "_label", "probability", "fold_status"]
        out = T.out_of_fold(data, WINDOW_FEATURES, horizons(L), "patient_id", IDS, T.Growth(trees=300, depth=5))[0].select(*cols).withColumn("model", F.lit("boosted"))
        for y in horizons(L):
            p = D.out_of_fold(data, WINDOW_FEATURES, y, "patient_id", IDS)[0].withColumn("target", F.lit(y))
            out = out.unionByName(p.select(*cols).withColumn("model", F.lit("logistic")))
        L.__dict__["_risk"] = stable(out)
    return L.__dict__["_risk"]


@query("window_risk_predictions")
def _(L):
    return risk(L).select(*IDS, "patient_id", "model", F.col("target").alias("horizon"), F.col("_label").alias("y"), F.get("probability", F.lit(1)).alias("p_severe"), "fold_status")


@query("lead_time_scores")
def _(L):
    """Per model and horizon: prevalence, AUC, average precision and Youden's threshold over all patients."""
    return M.horizon_scores(risk(L).withColumnRenamed("target", "horizon"), ["model", "horizon"])


def unseen(L, data, features, name: str):
    """Scores of a model that is fitted on half of the patients, stored, loaded and applied to the other half."""
    out = None
    data = data.withColumns({f: F.col(f).cast("double") for f in features})
    for half in range(2):
        train = data.filter(F.pmod("patient_id", F.lit(2)) != half)
        path = fresh_path(L, f"{name}-{half}")
        M.save_model(M.pipeline(features, M.logistic("_label", rows=train.count())).fit(M.balanced_weights(train, "_label")), path)
        one = M.load_model(path).transform(data.filter(F.pmod("patient_id", F.lit(2)) == half)).select(KEY, M.vector_to_array("probability")[1].alias("p"))
        out = one if out is None else out.union(one)
    return out


@query("score_night")
def _(L):
    """Stored event and night models applied to nights of patients they never saw, then the risk score."""
    p_event = unseen(L, event_dataset(L).withColumn("_label", F.col("is_severe").cast("double")), EVENT_FEATURES, "event-model")
    nights = stable(_graded(L).withColumn("_label", (F.col("y") >= 2).cast("double")))
    p_night = unseen(L, nights, _NIGHT, "night-model").withColumnRenamed("p", "p_night")
    per = stable(p_night.join(p_event.groupBy(KEY).agg(F.avg("p").alias("p_mean")), KEY, "left"))
    capped = with_scalars(per, exact_percentiles(per, [], ["p_mean"], {"p99": 0.99}))
    top = with_scalars(capped, capped.agg(F.max(F.least("p_mean", "p_mean_p99")).alias("_top")))
    score = risk_score(F.col("p_mean"), F.col("p_mean_p99"), F.col("_top"), F.col("p_night"))
    return top.select(KEY, "p_mean", "p_night", F.when(F.col("p_mean").isNotNull(), score).alias("risk_score")).withColumn("risk_label", risk_label(F.col("risk_score")))


@query("persist_model", "SELECT scale, cluster, CASE scale " + " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in C.STATE_PREFIX.items())
       + " END || cluster AS label, feature, r6(z) AS z, r6(value) AS value, r6(mean) AS mean, r6(std) AS std, n_training FROM cen")
def _(L):
    """The stored state model of all scales as it is read back."""
    return L.state_store.table(L.spark)

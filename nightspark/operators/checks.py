"""Plausibility checks on label tables and centroids, gates, staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.operators.intervals import interval_join
from nightspark.operators.ordering import stable
from nightspark.operators.ranks import exact_percentiles, with_scalars

KEY = "night_record_id"
# --- fixed values: check limits ---
COVERAGE_FAIL, COVERAGE_WARN = 0.85, 0.95
MAX_DOMINANCE = 0.95
OUTLIER_PROB, OUTLIER_SHARE = 0.95, 0.20
COHERENCE_WARN = 0.30
SIZE_FAIL_PCT, SIZE_PASS_PCT = 0.3, 2.0
MIN_CENTROID_DIST = 1.0
MIN_DIVERSITY, MIN_TOTAL_RANGE = 0.5, 1.0
RANGE_EPSILON = 1e-3
FEATURE_BOUNDS = {
    "spo2_mean": (70.0, 100.0), "spo2_min": (50.0, 100.0), "spo2_max": (70.0, 100.0), "spo2_p10": (50.0, 100.0),
    "spo2_p90": (70.0, 100.0), "spo2_std": (0.0, 20.0), "hr_mean": (40.0, 120.0), "hr_min": (30.0, 120.0),
    "hr_max": (40.0, 180.0), "hr_p10": (30.0, 120.0), "hr_p90": (40.0, 150.0), "hr_std": (0.0, 30.0),
    "mov_mean": (0.0, 1000000.0), "mov_std": (0.0, 1000000.0), "mov_max": (0.0, 1000000.0),
    "n_edos_total": (0.0, 1000.0), "n_alpha": (0.0, 1000.0), "n_beta": (0.0, 1000.0), "n_gamma": (0.0, 1000.0),
    "n_delta": (0.0, 1000.0), "ird_mean_local": (0.0, 100.0), "frac_wake": (0.0, 1.0),
    "frac_light_sleep": (0.0, 1.0), "frac_deep_sleep": (0.0, 1.0),
}
STATE_COLUMNS = {
    "night_record_id": "string", "user_id": "integer", "patient_id": "integer", "scale": "string", "window_idx": "integer",
    "t_start": "timestamp", "t_end": "timestamp", "t_start_s": "double", "t_end_s": "double", "state_label": "string",
    "cluster_int": "integer", "dist_to_centroid": "double", "coverage": "double", "frac_wake": "double",
    "frac_light_sleep": "double", "frac_deep_sleep": "double", "training_eligible": "boolean",
}
KINDS = {"smallint": "integer", "int": "integer", "bigint": "integer", "float": "double", "timestamp_ntz": "timestamp"}
# --- end of fixed values ---


def coverage_status(ratio: Column, fail: float = COVERAGE_FAIL, warn: float = COVERAGE_WARN) -> Column:
    return F.when(ratio.isNull(), "WARN").when(ratio < fail, "FAIL").when(ratio < warn, "WARN").otherwise("PASS")


def worst(*statuses: Column) -> Column:
    """FAIL over WARN over PASS."""
    bad = lambda s: F.array_contains(F.array(*statuses), s)
    return F.when(bad("FAIL"), "FAIL").when(bad("WARN"), "WARN").otherwise("PASS")


def temporal_coverage(states: DataFrame) -> DataFrame:
    """Per record: covered seconds over the last window end, per scale, and status."""
    cols = {}
    for s in C.STATE_K:
        hit = F.col("scale") == s
        top = F.max(F.when(hit, F.col("t_end_s")))
        cols[f"b2_coverage_{s}"] = F.sum(F.when(hit, F.col("t_end_s") - F.col("t_start_s"))) / F.when(top > 0, top)
    out = states.groupBy(KEY).agg(*[c.alias(n) for n, c in cols.items()])
    return out.withColumn("b2_status", worst(*[coverage_status(F.col(n)) for n in cols]))


def dominance(states: DataFrame) -> DataFrame:
    """Per record: largest share of one label per scale, and whether it is too large."""
    n = states.filter(F.col("cluster_int") >= 0).groupBy(KEY, "scale", "state_label").agg(F.count(F.lit(1)).alias("n"))
    share = n.groupBy(KEY, "scale").agg((F.max("n") / F.sum("n")).alias("share"))
    out = share.groupBy(KEY).agg(*[F.max(F.when(F.col("scale") == s, F.col("share"))).alias(f"b3_max_dom_{s}") for s in C.STATE_K])
    return out.withColumn("flag_b3", F.coalesce(F.greatest(*[F.col(f"b3_max_dom_{s}") for s in C.STATE_K]) > MAX_DOMINANCE, F.lit(False)))


def outlier_share(states: DataFrame) -> DataFrame:
    """Per record: share of windows beyond the scale's overall p95 distance.

    The first pass gives one threshold per scale; the few of them come back as one map.
    """
    valid = states.filter(F.col("cluster_int") >= 0)
    limit = exact_percentiles(valid, ["scale"], ["dist_to_centroid"], {"p": OUTLIER_PROB})
    limits = limit.agg(F.map_from_entries(F.collect_list(F.struct("scale", "dist_to_centroid_p"))).alias("_p95"))
    far = (F.col("dist_to_centroid") > F.try_element_at("_p95", F.col("scale"))).cast("double")
    per = with_scalars(valid, limits).groupBy(KEY).agg(*[
        F.coalesce(F.avg(F.when(F.col("scale") == s, far)), F.lit(0.0)).alias(f"b4_outlier_frac_{s}") for s in C.STATE_K])
    return per.withColumn("flag_b4", F.greatest(*[F.col(f"b4_outlier_frac_{s}") for s in C.STATE_K]) > OUTLIER_SHARE)


def coherence(states: DataFrame, parent_s: float, k: dict[str, int] | None = None) -> DataFrame:
    """Per record: 1 - entropy / log2(K) of child labels in each long window, averaged."""
    k = k or C.STATE_K
    valid = states.filter(F.col("cluster_int") >= 0)
    parents = valid.filter(F.col("scale") == "l").select(
        KEY, F.col("window_idx").alias("_parent"), F.col("t_start_s").alias("_a"), F.col("t_end_s").alias("_b"))
    kids = valid.filter(F.col("scale") != "l").select(KEY, "scale", "state_label", F.col("t_start_s").alias("_c"))
    hit = interval_join(kids, parents, [KEY], F.col("_c"), F.col("_a"), F.col("_b"), parent_s)
    n = hit.groupBy(KEY, "_parent", "scale", "state_label").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy(KEY, "_parent", "scale").agg(F.sum("n").alias("_t"))
    p = F.col("n") / F.col("_t")
    top = F.when(F.col("scale") == "m", F.log2(F.lit(float(k["m"])))).otherwise(F.log2(F.lit(float(k["s"]))))
    idx = n.join(tot, [KEY, "_parent", "scale"]).groupBy(KEY, "_parent", "scale").agg(
        F.sum(-p * F.log2(p + 1e-12)).alias("_h")).withColumn("_coh", 1 - F.col("_h") / top)
    return idx.groupBy(KEY).agg(*[F.avg(F.when(F.col("scale") == s, F.col("_coh"))).alias(f"coh_l_vs_{s}") for s in ("m", "s")])


def cross_check(coverage: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: are all coverage failures already bad in the quality table."""
    failed = coverage.filter(F.col("b2_status") == "FAIL").select(KEY).join(quality, KEY, "left")
    known = F.coalesce(~F.col("qc_coverage_ok") | ~F.col("qc_max_gap_ok"), F.lit(False))
    return failed.agg(
        F.count(F.lit(1)).alias("n_fail"), F.count_if(known).alias("n_known_bad"),
        ((F.count(F.lit(1)) > 0) & (F.count_if(~known) == 0)).alias("all_known_bad"))


def schema_lock(tables: Sequence[DataFrame], expected: dict[str, str] = STATE_COLUMNS) -> DataFrame:
    """Per record: missing and extra columns, wrong types, B1 status.

    A table has one schema, which all its records share; records that were
    written apart come as tables of their own.  A table without the key column
    cannot name its records: it gives one row with a null record.
    """
    out = None
    for df in tables:
        own = {c: KINDS.get(t, t) for c, t in df.dtypes}
        missing = sorted(set(expected) - set(own))
        extra = sorted(set(own) - set(expected))
        wrong = sorted(c for c in own if c in expected and own[c] != expected[c])
        records = df.select(KEY).distinct() if KEY in own else df.sparkSession.range(1).select(F.lit(None).cast("string").alias(KEY))
        one = records.select(
            KEY, *[F.lit(len(x)).cast("long").alias(f"n_{n}") for n, x in (("missing", missing), ("extra", extra), ("wrong", wrong))],
            F.lit(",".join([*missing, *extra, *wrong])).alias("columns"), F.lit("FAIL" if missing or extra or wrong else "PASS").alias("b1_status"))
        out = one if out is None else out.union(one)
    return out


def check_rows(lock: DataFrame, cov: DataFrame, dom: DataFrame, out: DataFrame, coh: DataFrame, quality: DataFrame) -> DataFrame:
    """Check id and status, one row each, B2 relaxed when every failure is known."""
    status = F.col("b2_status")
    b2 = cov.agg(F.when(F.max((status == "FAIL").cast("int")) == 1, "FAIL").when(F.max((status == "WARN").cast("int")) == 1, "WARN").otherwise("PASS").alias("s"))
    known = cross_check(cov, quality).select("all_known_bad").scalar()
    b2 = b2.select(F.lit("B2").alias("check_id"), F.when((F.col("s") == "FAIL") & known, "WARN").otherwise(F.col("s")).alias("status"))
    flag = lambda df, c, i: df.agg(F.when(F.count_if(c) > 0, "WARN").otherwise("PASS").alias("status")).select(F.lit(i).alias("check_id"), "status")
    low = (F.avg("coh_l_vs_m") < COHERENCE_WARN) | (F.avg("coh_l_vs_s") < COHERENCE_WARN)
    b5 = coh.agg(F.when(low, "WARN").otherwise("PASS").alias("status")).select(F.lit("B5").alias("check_id"), "status")
    b1 = lock.agg(F.when(F.count_if(F.col("b1_status") == "FAIL") > 0, "FAIL").otherwise("PASS").alias("status")).select(F.lit("B1").alias("check_id"), "status")
    return b1.union(b2).union(flag(dom, F.col("flag_b3"), "B3")).union(flag(out, F.col("flag_b4"), "B4")).union(b5)


def gate(checks: DataFrame, blocking: Sequence[str], prefix: str) -> DataFrame:
    """Proceed unless a blocking check fails; all_ok when nothing warns either."""
    block = F.coalesce(F.bool_or(F.col("check_id").isin(*blocking) & (F.col("status") == "FAIL")), F.lit(False))
    warn = F.coalesce(F.bool_or((F.col("status") == "WARN") | ((F.col("status") == "FAIL") & ~F.col("check_id").isin(*blocking))), F.lit(False))
    return checks.agg((~block).alias(f"{prefix}_proceed"), (~block & ~warn).alias(f"{prefix}_all_ok"))


def review_list(dom: DataFrame, out: DataFrame) -> DataFrame:
    """Records flagged by either check, with the reason text."""
    j = dom.join(out, KEY, "full_outer")
    a, b = F.coalesce("flag_b3", F.lit(False)), F.coalesce("flag_b4", F.lit(False))
    return j.filter(a | b).select(KEY, F.concat_ws("+", F.when(a, "dominance"), F.when(b, "outliers")).alias("review_reason"))


def cluster_sizes(states: DataFrame) -> DataFrame:
    """Per scale: share of each label among eligible windows, status of the smallest."""
    n = states.filter("training_eligible and cluster_int >= 0").groupBy("scale", "state_label").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("scale").agg((F.min("n") / F.sum("n") * 100).alias("min_pct"), (F.max("n") / F.sum("n") * 100).alias("max_pct"))
    return per.withColumn("status", F.when(F.col("min_pct") < SIZE_FAIL_PCT, "FAIL").when(F.col("min_pct") < SIZE_PASS_PCT, "WARN").otherwise("PASS"))


def centroid_separation(centroids: DataFrame, min_dist: float = MIN_CENTROID_DIST) -> DataFrame:
    """Smallest distance between two centroids per scale.

    ``centroids`` (scale, cluster, feature, z) holds K x features rows; the
    pair join runs on (scale, feature) over that table alone.
    """
    a = centroids.select("scale", "feature", F.col("cluster").alias("i"), F.col("z").alias("a"))
    b = centroids.select("scale", "feature", F.col("cluster").alias("j"), F.col("z").alias("b"))
    d = a.join(b, ["scale", "feature"]).filter(F.col("i") < F.col("j")).groupBy("scale", "i", "j").agg(
        F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("d"))
    out = d.groupBy("scale").agg(F.min("d").alias("min_dist"))
    return out.withColumn("status", F.when(F.col("min_dist") >= min_dist, "PASS").when(F.col("min_dist") >= 0.7 * min_dist, "WARN").otherwise("FAIL"))


def _wide(centroids: DataFrame, features: Sequence[str]) -> DataFrame:
    return centroids.groupBy("scale", "cluster").agg(*[
        F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])


def label_coherence(centroids: DataFrame) -> DataFrame:
    """Per scale: variety of the dominant event label, or range of event counts."""
    letters = ["n_alpha", "n_beta", "n_gamma", "n_delta"]
    w = _wide(centroids, [*letters, "n_edos_total"])
    top = F.greatest(*letters)
    first = F.when(F.lit(False), F.lit(""))
    for c in letters:
        first = first.when(F.col(c) == top, c)
    out = w.withColumn("_dom", first).groupBy("scale").agg(
        (F.count_distinct("_dom") / F.count(F.lit(1))).alias("diversity"), (F.max("n_edos_total") - F.min("n_edos_total")).alias("total_range"))
    ok = (F.col("diversity") >= MIN_DIVERSITY) | (F.col("total_range") >= MIN_TOTAL_RANGE)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("WARN"))


def sleep_coherence(centroids: DataFrame) -> DataFrame:
    """Per scale: a light-sleep cluster, and a deep one except on the short scale."""
    w = _wide(centroids, ["frac_light_sleep", "frac_deep_sleep"]).groupBy("scale").agg(
        (F.max("frac_light_sleep") > 0.3).alias("has_light"), (F.max("frac_deep_sleep") > 0.3).alias("has_deep"))
    ok = F.col("has_light") & (F.col("has_deep") | (F.col("scale") == "s"))
    return w.withColumn("status", F.when(ok, "PASS").otherwise("WARN"))


def physiological_ranges(centroids: DataFrame, bounds=None, epsilon: float = RANGE_EPSILON) -> DataFrame:
    """Per scale: number of centroid values outside their plausible bounds."""
    bounds = bounds or FEATURE_BOUNDS
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    lo = F.coalesce(*[F.when(F.col("feature") == f, F.lit(b[0])) for f, b in bounds.items()])
    hi = F.coalesce(*[F.when(F.col("feature") == f, F.lit(b[1])) for f, b in bounds.items()])
    bad = (F.col("value") < lo - epsilon) | (F.col("value") > hi + epsilon)
    out = centroids.groupBy("scale").agg(F.count_if(bad).alias("n_violators"))
    return out.withColumn("status", F.when(F.col("n_violators") > 0, "FAIL").otherwise("PASS"))


def distribution_drift(train: DataFrame, applied: DataFrame, group: str, label: str) -> DataFrame:
    """L1 distance, in percent points, between two label distributions."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
        t = n.groupBy(group).agg(F.sum("_n").alias("_t"))
        return n.join(t, group).select(group, label, (100.0 * F.col("_n") / F.col("_t")).alias(name))

    j = shares(train, "_a").join(shares(applied, "_b"), [group, label], "left")
    return j.groupBy(group).agg(F.sum(F.abs(F.col("_a") - F.coalesce("_b", F.lit(0.0)))).alias("l1_distance_pct"))


def retrain_trigger(current: DataFrame, snapshot: DataFrame, min_nights: int, min_patients: int) -> DataFrame:
    """Deltas against the model's corpus snapshot and why to retrain.

    Both inputs are one-row tables (n_nights, n_patients).
    """
    old = snapshot.select(F.struct("n_nights", "n_patients")).scalar()
    nights, patients = F.col("n_nights") - old["n_nights"], F.col("n_patients") - old["n_patients"]
    why = F.concat_ws("+", F.when(nights >= min_nights, "nights"), F.when(patients >= min_patients, "patients"))
    return current.select(nights.alias("delta_nights"), patients.alias("delta_patients"), (why != "").alias("should_retrain"), why.alias("reasons"))


def stale_records(inputs: DataFrame, outputs: DataFrame, fingerprint: str) -> DataFrame:
    """Records to reprocess, with the reason.

    ``inputs`` (record, version); ``outputs`` (record, version, model).  A
    matching model fingerprint keeps a record fresh whatever its version; a
    record without one falls back to comparing versions.
    """
    o = outputs.select(KEY, F.col("version").alias("_done"), F.col("model").alias("_model"), F.lit(True).alias("_has"))
    reason = (
        F.when(F.col("_has").isNull(), "missing")
        .when(F.col("_model").isNotNull() & (F.col("_model") != fingerprint), "model changed")
        .when(F.col("_model").isNull() & (F.col("version") > F.col("_done")), "input newer"))
    return inputs.join(o, KEY, "left").select(KEY, reason.alias("reason")).filter("reason is not null")


def model_fingerprint(centroids: DataFrame) -> DataFrame:
    """16 hex digits over the sorted centroid values (K x features short rows)."""
    from nightspark.operators.store import fingerprint_column

    return centroids.agg(fingerprint_column(F.col("scale"), F.col("cluster"), F.col("feature"), F.col("z")).alias("fingerprint"))


def representative_nights(nights: DataFrame, outliers: DataFrame, flagged: DataFrame, min_tst_s: float, seed: int = 42) -> DataFrame:
    """Tag and record: most severe, quietest long enough, most outlier windows,
    and a hash-ordered pick of a flagged one."""
    worst_ = nights.orderBy(F.col("ahi_3").desc(), KEY).limit(1).select(F.lit("severe").alias("tag"), KEY)
    calm = nights.filter(F.col("tst_s") >= min_tst_s).orderBy("ahi_3", KEY).limit(1).select(F.lit("control"), KEY)
    far = outliers.orderBy(F.col("n").desc(), KEY).limit(1).select(F.lit("outlier_state"), KEY)
    pick = flagged.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(KEY)))).limit(1).select(F.lit("flagged"), KEY)
    return worst_.union(calm).union(far).union(pick)


def agreement_by_index(nights: DataFrame, indices: Sequence[str] = C.VALIDATED_INDICES) -> DataFrame:
    """Per index: comparable nights, flag share, medians, spread of the relative
    difference, Pearson, Spearman, and the line ours = a * device + b."""
    from nightspark.operators.stats import spearman

    parts = F.explode(F.array(*[F.struct(
        F.lit(i).alias("index"), F.col(f"{i}_ours").alias("ours"), F.col(f"{i}_device").alias("device"),
        F.col(f"{i}_diff_abs").alias("diff_abs"), F.col(f"{i}_diff_rel").alias("diff_rel"), F.col(f"{i}_diff_flag").alias("flag"),
    ) for i in indices])).alias("_i")
    long = stable(nights.select(KEY, parts).select(KEY, "_i.*"))
    counts = long.groupBy("index").agg(
        F.count(F.lit(1)).alias("n_nights"), F.count_if(F.col("ours").isNotNull() & F.col("device").isNotNull()).alias("n_comparable"),
        F.count_if("flag").alias("n_diff_flag"))
    ok = long.filter(F.col("ours").isNotNull() & F.col("device").isNotNull() & (F.abs("diff_rel") < float("inf")))
    q = exact_percentiles(ok, ["index"], ["ours", "device", "diff_abs", "diff_rel"], {"median": 0.5, "p5": 0.05, "p95": 0.95})
    line = ok.groupBy("index").agg(
        F.count(F.lit(1)).alias("_n"), F.corr("ours", "device").alias("pearson_r"),
        F.when(F.stddev_pop("device") > 1e-9, F.regr_slope("ours", "device")).alias("slope_ols"),
        F.when(F.stddev_pop("device") > 1e-9, F.regr_intercept("ours", "device")).alias("intercept_ols"))
    rho = spearman(ok, ["index"], "ours", "device")
    few = F.col("_n") >= 3
    j = counts.join(q, "index", "left").join(line, "index", "left").join(rho, "index", "left")
    return j.select(
        "index", "n_nights", "n_comparable", "n_diff_flag", (100.0 * F.col("n_diff_flag") / F.col("n_nights")).alias("pct_diff_flag"),
        F.col("ours_median").alias("ours_median"), "device_median", "diff_abs_median", "diff_rel_median", "diff_rel_p5", "diff_rel_p95",
        F.when(few, F.col("pearson_r")).alias("pearson_r"), F.when(few, F.col("rho")).alias("spearman_r"),
        F.when(few, F.col("slope_ols")).alias("slope_ols"), F.when(few, F.col("intercept_ols")).alias("intercept_ols"))


def flag_vs_quality(nights: DataFrame, quality: DataFrame, index: str) -> DataFrame:
    """Share of flagged comparisons among nights that fail each quality check."""
    j = nights.join(quality.drop("user_id", "duration_s"), KEY).withColumn("_f", F.col(f"{index}_diff_flag"))
    tests = {"qc_duration_aborted": F.col("qc_duration_aborted"), "qc_duration_short": F.col("qc_duration_short"),
             "qc_coverage_fail": ~F.col("qc_coverage_ok"), "qc_max_gap_fail": ~F.col("qc_max_gap_ok")}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), c.alias("bad")) for n, c in tests.items()])).alias("_t")
    long = j.select("_f", rows).select("_f", "_t.*")
    return long.groupBy("check").agg(
        F.count_if("bad").alias("n"), F.coalesce(
            F.round(100.0 * F.count_if(F.col("bad") & F.col("_f")) / F.nullif(F.count_if("bad"), F.lit(0)), 2), F.lit(0.0)).alias("pct_with_diff_flag"))

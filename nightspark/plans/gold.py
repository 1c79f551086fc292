"""Gold builders: events, curves, states, nights, patients, analytic tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout, Params
from nightspark.functions.scalars import entropy_term
from nightspark.operators.ranks import exact_percentiles, rank_table
from nightspark.operators.scans import running

KEY = "night_record_id"
# fixed values: metrics compared across nights, aggregated per patient, and
# checked for stability
CROSS_NIGHT_METRICS = ("ahi_3", "t90_frac", "odi_3")
KEY_METRICS = (
    "ahi_3", "t90_frac", "odi_3", "tst_s", "sleep_efficiency", "mean_spo2", "min_spo2", "mean_hr",
    "n_edos_total", "mean_drop_pct",
)
STABILITY_METRICS = ("ahi_3", "t90_frac", "odi_3")


def share(df: DataFrame, keys: Sequence[str], label: str, values: Sequence[str], name) -> DataFrame:
    """Wide fractions over a fixed label list; other and null labels are out of
    both numerator and denominator."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(label) == v).alias(f"_n_{i}") for i, v in enumerate(values)])
    total = sum((F.col(f"_n_{i}") for i in range(1, len(values))), F.col("_n_0"))
    return counts.select(*keys, *[
        (F.col(f"_n_{i}") / F.greatest(total, F.lit(1))).alias(name(v)) for i, v in enumerate(values)])


def morphotype_distribution(events: DataFrame, key: str = KEY) -> DataFrame:
    return share(events, [key], "morphotype", C.GREEK[:4], lambda v: f"frac_morpho_{C.GREEK_NAMES[v]}")


def state_distribution(states: DataFrame, key: str = KEY, label_lists=None) -> DataFrame:
    """Fractions per scale over the gold label lists, one pass for all scales."""
    label_lists = label_lists or C.GOLD_STATE_LABELS
    valid = states.filter(F.col("cluster_int") >= 0)
    aggs, shares = [], []
    for scale, labels in label_lists.items():
        hit = F.col("scale") == scale
        aggs += [F.count_if(hit & (F.col("state_label") == v)).alias(f"_n_{v}") for v in labels]
        total = sum((F.col(f"_n_{v}") for v in labels[1:]), F.col(f"_n_{labels[0]}"))
        shares += [(F.col(f"_n_{v}") / F.greatest(total, F.lit(1))).alias(f"frac_state_{scale}_{v}") for v in labels]
    return valid.groupBy(key).agg(*aggs).select(key, *shares)


def label_changes(states: DataFrame, layout: Layout) -> DataFrame:
    """Per record and scale: changes between consecutive valid windows."""
    valid = states.filter(F.col("cluster_int") >= 0).withColumn("_series", F.concat_ws("|", KEY, "scale"))
    by_window = layout.over("_series", "window_idx")
    seen = running(valid, by_window, {"_prev": ("last", F.col("state_label"))}, inclusive=False)
    return seen.groupBy(KEY, "scale").agg(F.count_if(F.col("_prev") != F.col("state_label")).alias("n_transitions"))


def label_entropy(states: DataFrame) -> DataFrame:
    """Per record and scale: Shannon entropy (bits) of the valid labels."""
    counts = states.filter(F.col("cluster_int") >= 0).groupBy(KEY, "scale", "state_label").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(KEY, "scale").agg(F.sum("n").alias("_total"))
    p = F.col("n") / F.col("_total")
    return counts.join(totals, [KEY, "scale"]).groupBy(KEY, "scale").agg(F.sum(entropy_term(p)).alias("entropy"))


def transitions_and_entropy(states: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Wide: ``n_transitions_state_{scale}`` and ``entropy_state_{scale}``."""
    long = label_changes(states, layout).join(label_entropy(states), [KEY, "scale"])
    aggs = []
    for s in C.STATE_K:
        hit = F.col("scale") == s
        aggs += [F.coalesce(F.max(F.when(hit, F.col("n_transitions"))), F.lit(0)).alias(f"n_transitions_state_{s}"),
                 F.coalesce(F.max(F.when(hit, F.col("entropy"))), F.lit(0.0)).alias(f"entropy_state_{s}")]
    return long.groupBy(KEY).agg(*aggs)


def percentile_of_reference(df: DataFrame, metrics: Sequence[str], reference: Column, strict: bool = False) -> DataFrame:
    """Add ``{m}_pct_corpus``: (left + right) / 2 / n against the rows where
    ``reference`` holds, for every row.  ``strict`` counts only lower values.

    One rank table serves all metrics; rows outside the reference add a zero
    count, so their rank falls out of the same scan.
    """
    long = df.select(KEY, reference.cast("long").alias("_ref"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    ).select(KEY, "_ref", "_m.metric", "_m.value")
    table = rank_table(long, ["metric"], "value", {"ref": F.col("_ref")})
    mid = F.col("ref_below") if strict else F.col("ref_below") + F.col("ref") / 2.0
    pct = table.select("metric", "value", (mid / F.nullif(F.col("ref_total"), F.lit(0))).alias("pct"))
    wide = long.join(pct, ["metric", "value"]).groupBy(KEY).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("pct"))).alias(f"{m}_pct_corpus") for m in metrics])
    return df.join(wide, KEY, "left")


def leave_one_out_delta(df: DataFrame, metrics: Sequence[str], owner: str, reference: Column, min_nights: int) -> DataFrame:
    """Add ``delta_{m}_vs_baseline_patient``: value less the mean of the owner's
    other reference nights (needs ``min_nights`` of them in all)."""
    sums = df.filter(reference).groupBy(owner).agg(
        F.count(F.lit(1)).alias("_nights"),
        *[F.sum(m).alias(f"_s_{m}") for m in metrics], *[F.count(m).alias(f"_c_{m}") for m in metrics])
    out = df.join(sums, owner, "left")
    ok = reference & (F.col("_nights") >= min_nights)
    cols = {}
    for m in metrics:
        rest = (F.col(f"_s_{m}") - F.col(m)) / F.nullif(F.col(f"_c_{m}") - 1, F.lit(0))
        cols[f"delta_{m}_vs_baseline_patient"] = F.when(ok, F.col(m) - rest)
    return out.withColumns(cols).drop("_nights", *[f"_s_{m}" for m in metrics], *[f"_c_{m}" for m in metrics])


def gold_nights(
    indices: DataFrame, events: DataFrame, states: DataFrame, flags: DataFrame, p: Params,
    model_version: str = "v1", owner: str = "patient_id", metrics: Sequence[str] = CROSS_NIGHT_METRICS,
) -> DataFrame:
    """Indices + label fractions + transitions + cohort flags + cross-night columns."""
    parts = [morphotype_distribution(events), state_distribution(states), transitions_and_entropy(states)]
    out = indices
    for part in parts:
        out = out.join(part, KEY, "left")
        out = out.fillna(0, subset=[c for c in part.columns if c != KEY])
    out = out.join(flags, KEY, "left").withColumn("model_version", F.lit(model_version))
    out = percentile_of_reference(out, metrics, F.col("in_quality"))
    return leave_one_out_delta(out, metrics, owner, F.col("in_quality"), p.baseline_min_nights)


def patient_counts(nights: DataFrame, owner: str = "patient_id") -> DataFrame:
    flag = {"quality": "in_quality", "strict": "in_strict", "high_tst": "in_high_tst", "flag_for_review": "flag_for_review"}
    return nights.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_nights_total"),
        *[F.count_if(c).alias(f"n_nights_{n}") for n, c in flag.items()])


def patient_metrics(nights: DataFrame, metrics: Sequence[str] = KEY_METRICS, owner: str = "patient_id") -> DataFrame:
    """Mean, exact median and sample sd of each metric over quality nights."""
    good = nights.filter("in_quality")
    moments = good.groupBy(owner).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        *[F.when(F.count(m) > 1, F.stddev_samp(m)).alias(f"sd_{m}") for m in metrics])
    medians = exact_percentiles(good, [owner], metrics, {"p50": 0.5})
    return moments.join(medians.select(owner, *[F.col(f"{m}_p50").alias(f"median_{m}") for m in metrics]), owner)


def stability_cv(nights: DataFrame, metrics: Sequence[str] = STABILITY_METRICS, owner: str = "patient_id") -> DataFrame:
    return nights.filter("in_quality").groupBy(owner).agg(*[
        F.when(F.count(m) > 1, F.stddev_samp(m) / F.nullif(F.avg(m), F.lit(0.0))).alias(f"cv_{m}_intra_patient")
        for m in metrics])


def gold_patients(
    nights: DataFrame, events: DataFrame, states: DataFrame, clinical: DataFrame,
    owner: str = "patient_id", model_version: str = "v1",
) -> DataFrame:
    """Counts, clinical data, metric aggregates, label fractions, stability."""
    good = nights.filter("in_quality").select(KEY)
    out = patient_counts(nights, owner).join(clinical, owner, "left")
    for part in (
        patient_metrics(nights, owner=owner),
        morphotype_distribution(events.join(good, KEY, "left_semi"), owner),
        state_distribution(states.join(good, KEY, "left_semi"), owner),
        stability_cv(nights, owner=owner),
    ):
        out = out.join(part, owner, "left")
    return out.withColumn("model_version", F.lit(model_version))


def event_states_multiscale(events: DataFrame, states: DataFrame, window_s: dict[str, int] | None = None) -> DataFrame:
    """Each event with the state of the window it starts in, per scale.

    Windows of one scale are disjoint, so the containing window is found by an
    interval join on (record, scale, time cell) rather than a sort per record.
    """
    from nightspark.operators.intervals import epoch, interval_join

    sizes = window_s or Params().window_rows
    width = F.coalesce(*[F.when(F.col("scale") == s, F.lit(float(r))) for s, r in sizes.items()])
    points = events.select(KEY, "ts_start", epoch(F.col("ts_start")).alias("_ts"), F.explode(
        F.array(*[F.lit(s) for s in C.STATE_K])).alias("scale"))
    spans = states.select(
        KEY, "scale", "state_label", "window_idx", "dist_to_centroid",
        epoch(F.col("t_start")).alias("_w0"), epoch(F.col("t_end")).alias("_w1"))
    hit = interval_join(points, spans, [KEY, "scale"], F.col("_ts"), F.col("_w0"), F.col("_w1"), width)
    best = hit.groupBy(KEY, "ts_start", "scale").agg(F.max_by(
        F.struct("state_label", "window_idx", "dist_to_centroid"), F.struct("_w0", "window_idx")).alias("_b"))
    wide = best.groupBy(KEY, "ts_start").agg(*[
        F.max(F.when(F.col("scale") == s, F.col(f"_b.{c}"))).alias(f"{n}_{s}")
        for s in C.STATE_K for c, n in (
            ("state_label", "state"), ("window_idx", "window_idx"), ("dist_to_centroid", "dist"))])
    return events.drop("spo2_curve", "hr_curve", "mov_curve").join(wide, [KEY, "ts_start"], "left")


def with_flags(df: DataFrame, flags: DataFrame, model_version: str = "v1") -> DataFrame:
    """Add the five gold cohort booleans and the model version."""
    cols = ("in_quality", "in_strict", "in_high_tst", "flag_for_review", "b2_fail")
    return df.join(flags.select(KEY, *cols), KEY, "left").withColumn("model_version", F.lit(model_version))


def gold_curves(events: DataFrame, model_version: str = "v1") -> DataFrame:
    return events.select(
        KEY, "ts_start", "spo2_curve", "hr_curve", "mov_curve").withColumn("model_version", F.lit(model_version))

"""Night, event and state analytics: reactivity, profiles, risk, Markov."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout
from nightspark.functions.scalars import entropy_term, gain
from nightspark.operators.intervals import epoch
from nightspark.operators.ranks import average_rank, exact_percentiles, with_scalars
from nightspark.operators.series import neighbours, transition_pairs

KEY = "night_record_id"


def reactivity_index(events: DataFrame, positive_only: bool = False, weights=(0.6, 0.4)) -> DataFrame:
    """Add ``hr_gain``, ``mov_gain`` and ``ari`` = weighted average-rank shares.

    The divisor is the number of rows, null gains included; ``positive_only``
    first drops events without a drop.
    """
    if positive_only:
        events = events.filter(F.col("drop_pct") > 0)
    df = events.withColumns({
        "hr_gain": gain(F.col("delta_hr_bpm"), F.col("drop_pct")),
        "mov_gain": gain(F.col("peak_mov") - F.col("baseline_mov"), F.col("drop_pct")),
    })
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    df = average_rank(df, [], "hr_gain", "_rh")
    df = average_rank(df, [], "mov_gain", "_rm")
    share = weights[0] * (F.col("_rh") / F.col("_n")) + weights[1] * (F.col("_rm") / F.col("_n"))
    return with_scalars(df, n).withColumn("ari", share).drop("_rh", "_rm", "_n")


def night_reactivity(events: DataFrame) -> DataFrame:
    """Per record: reactivity mean, sd, p90, gains, curve-label shares."""
    labelled = F.count("morphotype_curve")
    shares = [(F.count_if(F.col("morphotype_curve") == c) / F.greatest(labelled, F.lit(1))).alias(f"frac_{c.lower()}") for c in C.CURVE_LABELS]
    severe = F.count_if(F.col("morphotype_curve").isin("C4", "C5")) / F.greatest(labelled, F.lit(1))
    base = events.groupBy(KEY).agg(
        F.avg("ari").alias("mean_ari"), F.when(F.count("ari") > 1, F.stddev_samp("ari")).alias("std_ari"),
        F.avg("hr_gain").alias("mean_hr_gain"), F.when(F.count("hr_gain") > 1, F.stddev_samp("hr_gain")).alias("std_hr_gain"),
        F.avg("drop_pct").alias("mean_drop_pct_ev"), F.count(F.lit(1)).alias("n_events_quality"),
        *shares, severe.alias("frac_severe_morpho"))
    # the column called p90_drop_pct is a median by definition (default quantile)
    q = exact_percentiles(events, [KEY], ["ari", "drop_pct"], {"p90": 0.9, "p50": 0.5})
    return base.join(q.select(KEY, F.col("ari_p90").alias("p90_ari"), F.col("drop_pct_p50").alias("p90_drop_pct")), KEY)


def grouped_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], min_n: int = 0) -> DataFrame:
    counts = df.groupBy(*groups).agg(F.count(value).alias("n"))
    out = exact_percentiles(df, groups, [value], probs).join(counts, list(groups))
    return out.select(*groups, "n", *[
        F.when(F.col("n") >= min_n, F.col(f"{value}_{p}")).alias(p) for p in probs])


def state_profile(states: DataFrame) -> DataFrame:
    """Per scale and state: windows, mean stage shares, mean distance, % of scale."""
    agg = states.filter(F.col("state_label").isNotNull()).groupBy("scale", "state_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("frac_wake").alias("frac_wake"), F.avg("frac_light_sleep").alias("frac_light"),
        F.avg("frac_deep_sleep").alias("frac_deep"), F.avg("dist_to_centroid").alias("dist_cent"))
    total = agg.groupBy("scale").agg(F.sum("n").alias("_all"))
    return agg.join(total, "scale").withColumn("pct_total", F.col("n") / F.col("_all") * 100).drop("_all")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Long contingency table with row and column shares; null pairs are out.

    The margins come from the cell counts, so only one pass reads the rows.
    """
    cells = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(
        F.count(F.lit(1)).alias("n"))
    by_row = cells.groupBy(rows).agg(F.sum("n").alias("_r"))
    by_col = cells.groupBy(columns).agg(F.sum("n").alias("_c"))
    return cells.join(by_row, rows).join(by_col, columns).select(
        rows, columns, "n", (F.col("n") / F.col("_r")).alias("row_share"), (F.col("n") / F.col("_c")).alias("col_share"))


def unpivot_states(events: DataFrame, *keep: str) -> DataFrame:
    """One row per event and scale with the state of that scale."""
    return events.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(f"state_{s}").alias("state")) for s in C.STATE_K])).alias("_s")
    ).select(*keep, "_s.scale", "_s.state").filter(F.col("state").isNotNull())


def severe_rates(events: DataFrame) -> DataFrame:
    """Severe share per scale and state, flagged ``in_path`` above the scale's
    median state rate (a table of at most K rows per scale)."""
    rate = unpivot_states(events, "is_severe").groupBy("scale", "state").agg(
        F.avg(F.col("is_severe").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    mid = rate.groupBy("scale").agg(F.percentile("rate", 0.5).alias("_mid"))
    return rate.join(mid, "scale").select("scale", "state", "n", "rate", (F.col("rate") > F.col("_mid")).alias("in_path"))


def coupling_index(events: DataFrame) -> DataFrame:
    """Per record and scale: share of severe events that fall in path states;
    null without severe events."""
    rates = severe_rates(events).select("scale", "state", "in_path")
    long = unpivot_states(events, KEY, "is_severe").filter("is_severe").join(rates, ["scale", "state"])
    per = long.groupBy(KEY).agg(*[
        F.avg(F.when(F.col("scale") == s, F.col("in_path").cast("double"))).alias(f"ci_{s}") for s in C.STATE_K])
    return events.select(KEY).distinct().join(per, KEY, "left")


def relative_risk(events: DataFrame, z: float = 1.96) -> DataFrame:
    """Severe risk of each state over the overall risk, with a log-normal interval."""
    all_ = events.agg(F.avg(F.col("is_severe").cast("double")).alias("_p"), F.sum(F.col("is_severe").cast("long")).alias("_s"))
    per = unpivot_states(events, "is_severe").groupBy("scale", "state").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_severe").cast("long")).alias("n_severe"),
        F.avg(F.col("is_severe").cast("double")).alias("p_severe"))
    rr = F.col("p_severe") / F.nullif(F.col("_p"), F.lit(0.0))
    se = F.sqrt((1 - F.col("p_severe")) / (F.col("n_severe") + 0.5) + (1 - F.col("_p")) / (F.col("_s") + 0.5))
    log_rr = F.when(F.col("_rr") > 0, F.ln("_rr"))
    return with_scalars(per, all_).withColumns({"_rr": rr, "_se": se}).select(
        "scale", "state", "n", "n_severe", "p_severe", F.col("_rr").alias("rr"),
        F.exp(log_rr - z * F.col("_se")).alias("rr_lo"), F.exp(log_rr + z * F.col("_se")).alias("rr_hi"))


def context_distribution(events: DataFrame, layout: Layout) -> DataFrame:
    """Distribution of previous / current / next event state by severity, long."""
    cols = [f"state_{s}" for s in C.STATE_K]
    near = neighbours(events.select(KEY, "start_idx", "is_severe", *cols), layout, cols)
    parts = F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.lit(when).alias("moment"), F.col(f"{prefix}state_{s}").alias("state"),
                 (F.col(f"prev_state_{s}").isNotNull() & F.col(f"next_state_{s}").isNotNull()).alias("ok"))
        for s in C.STATE_K for when, prefix in (("pre", "prev_"), ("during", ""), ("post", "next_"))])).alias("_c")
    long = near.select("is_severe", parts).select("is_severe", "_c.*").filter(F.col("ok") & F.col("state").isNotNull())
    counts = long.groupBy("is_severe", "scale", "moment", "state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("is_severe", "scale", "moment").agg(F.sum("n").alias("_t"))
    return counts.join(total, ["is_severe", "scale", "moment"]).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def returns_to_state(events: DataFrame, layout: Layout) -> DataFrame:
    """Per severity and scale: events with a state before and after, and the share where both are the same."""
    cols = [f"state_{s}" for s in C.STATE_K]
    near = neighbours(events.select(KEY, "start_idx", "is_severe", *cols), layout, cols)
    parts = F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(f"prev_state_{s}").alias("p"), F.col(f"next_state_{s}").alias("x")) for s in C.STATE_K])).alias("_c")
    long = near.select("is_severe", parts).select("is_severe", "_c.*").filter("p is not null and x is not null")
    return long.groupBy("is_severe", "scale").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col("x")).cast("double")).alias("same_share"))


def resilience(events: DataFrame, layout: Layout) -> DataFrame:
    """After a severe event in a path state, is the next event's state outside
    (resilient) or still inside (collapsed) the path states; per curve label."""
    cols = [f"state_{s}" for s in C.STATE_K]
    near = neighbours(events.select(KEY, "start_idx", "is_severe", "morphotype_curve", *cols), layout, cols).filter("is_severe")
    pairs = near.select("morphotype_curve", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(f"state_{s}").alias("state"), F.col(f"next_state_{s}").alias("next"))
        for s in C.STATE_K])).alias("_p")).select("morphotype_curve", "_p.*").filter(F.col("next").isNotNull())
    path = severe_rates(events).select("scale", "state", "in_path")
    here = pairs.join(path.withColumnRenamed("in_path", "_a"), ["scale", "state"], "left")
    both = here.join(path.select("scale", F.col("state").alias("next"), F.col("in_path").alias("_b")), ["scale", "next"], "left")
    a, b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return both.groupBy("scale", "morphotype_curve").agg(
        F.count(F.lit(1)).alias("n"), F.avg((a & ~b).cast("double")).alias("pct_resilient"),
        F.avg((a & b).cast("double")).alias("pct_collapsed"))


def transition_matrix(states: DataFrame, layout: Layout) -> DataFrame:
    """Row-normalized transitions in long form, zero-filled over the seen states.

    The state grid is K x K per scale, from a table of at most K rows.
    """
    cells = transition_pairs(states, layout).groupBy("scale", "state_label", "state_next").agg(F.count(F.lit(1)).alias("count"))
    seen = cells.select("scale", F.col("state_label").alias("s")).union(cells.select("scale", "state_next")).distinct()
    grid = seen.withColumnRenamed("s", "from_state").join(seen.withColumnRenamed("s", "to_state"), "scale")
    out = grid.join(cells.select("scale", F.col("state_label").alias("from_state"), F.col("state_next").alias("to_state"), "count"),
                    ["scale", "from_state", "to_state"], "left").fillna(0, ["count"])
    total = out.groupBy("scale", "from_state").agg(F.sum("count").alias("_t"))
    prob = F.when(F.col("_t") > 0, F.col("count") / F.col("_t")).otherwise(0.0)
    return out.join(total, ["scale", "from_state"]).select("scale", "from_state", "to_state", prob.alias("prob"), "count")


def transition_entropy(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("scale", "from_state").agg(F.sum(entropy_term(F.col("prob"))).alias("row_entropy"))


def stationary_distribution(matrix: DataFrame, tolerance: float = 1e-14) -> DataFrame:
    """Stationary shares of each scale's chain, by squaring (P + I) / 2 until it stands still.

    The matrix is a parameter table of (number of labels)^2 rows per scale, so
    it is solved on the driver.  Squaring doubles the number of steps: a chain
    that changes state once in 10^9 steps takes some 40.  Shares are the mean
    over all starting states; a state without transitions keeps its mass.
    """
    chains: dict[str, dict[tuple[str, str], float]] = {}
    for r in matrix.select("scale", "from_state", "to_state", "prob").collect():
        chains.setdefault(r["scale"], {})[r["from_state"], r["to_state"]] = float(r["prob"] or 0.0)
    out = []
    for scale, prob in chains.items():
        states = sorted({s for pair in prob for s in pair})
        p = np.array([[prob.get((a, b), 0.0) for b in states] for a in states])
        p = (p + np.eye(len(states))) / 2
        p[p.sum(axis=1) < 0.75] = np.eye(len(states))[p.sum(axis=1) < 0.75]
        moved = 1.0
        while moved > tolerance:
            q = p @ p
            # rounding must not let the mass of a row drift
            q /= q.sum(axis=1, keepdims=True)
            moved, p = np.abs(q - p).max(), q
        out += [(scale, s, float(x)) for s, x in zip(states, p.mean(axis=0), strict=True)]
    return matrix.sparkSession.createDataFrame(out, "scale string, state string, stationary double")


def equal_width_profile(df: DataFrame, by: str, values: Sequence[str], bins: int = 10) -> DataFrame:
    """Means of ``values`` in equal-width, right-closed bins of ``by``."""
    span = df.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.ceil((F.col(by) - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    bin_ = F.least(F.greatest(F.coalesce(raw, F.lit(1)), F.lit(1)), F.lit(bins)).cast("long")
    rows = with_scalars(df.filter(F.col(by).isNotNull()), span).withColumn("bin", bin_)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def tercile_profile(df: DataFrame, by: str, values: Sequence[str], labels=("low", "mid", "high")) -> DataFrame:
    """Means by thirds of ``by``, cut at its exact 1/3 and 2/3 percentiles."""
    cut = exact_percentiles(df, [], [by], {"a": 1 / 3, "b": 2 / 3})
    x = F.col(by)
    which = F.when(x <= F.col(f"{by}_a"), labels[0]).when(x <= F.col(f"{by}_b"), labels[1]).when(x.isNotNull(), labels[2])
    rows = with_scalars(df, cut).withColumn("tercile", which).filter("tercile is not null")
    return rows.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def half_night_pattern(events: DataFrame, flag: Column) -> DataFrame:
    """Share of flagged events after each record's median event time, and its name."""
    t = epoch(F.col("ts_start"))
    ev = events.withColumn("_t", t)
    mid = exact_percentiles(ev, [KEY], ["_t"], {"mid": 0.5})
    rows = ev.filter(flag).join(mid, KEY)
    out = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_flagged"), F.avg((F.col("_t") > F.col("_t_mid")).cast("double")).alias("share_late"))
    late = F.col("share_late")
    return out.withColumn("pattern", F.when(late > 0.6, "second_half").when(late < 0.4, "first_half").otherwise("spread"))


def variability(df: DataFrame, metrics: Sequence[str], owner: str) -> DataFrame:
    """Long per-owner table: n, mean, median, sd, min, max, cv of each metric."""
    long = df.select(owner, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    ).select(owner, "_m.metric", "_m.value").filter("value is not null")
    v = F.col("value")
    agg = long.groupBy(owner, "metric").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    mid = exact_percentiles(long, [owner, "metric"], ["value"], {"p50": 0.5})
    return agg.join(mid, [owner, "metric"]).select(
        owner, "metric", "n", "mean", F.col("value_p50").alias("median"), "sd", "min", "max",
        (F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv"))


def summary_percentiles(df: DataFrame, metrics: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Long table: metric, n, mean, min, max and exact percentiles."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    ).select("_m.metric", "_m.value").filter("value is not null")
    v = F.col("value")
    agg = long.groupBy("metric").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_percentiles(long, ["metric"], ["value"], probs)
    return agg.join(q, "metric").select("metric", "n", "mean", "sd", "min", "max", *[F.col(f"value_{p}").alias(p) for p in probs])


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def modal_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, the smallest on a tie (two-step counts)."""
    n = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))



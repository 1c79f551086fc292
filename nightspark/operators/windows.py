"""Multi-scale feature windows of a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout, Params
from nightspark.functions.scalars import add_seconds, collapse_stage
from nightspark.operators.intervals import epoch, interval_join

META = ("night_record_id", "scale", "window_idx", "t_start", "t_end", "n_samples_raw", "coverage", "is_tail")


def scale_rows(scale: Column, p: Params) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rows in p.window_rows.items():
        out = out.when(scale == name, F.lit(rows))
    return out


def signal_stats(value: Column, stats: tuple[str, ...], prefix: str) -> list[Column]:
    """Null-skipping statistics; std divides by n."""
    made = {
        "mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value),
        "p10": F.percentile(value, 0.1), "p90": F.percentile(value, 0.9),
    }
    return [made[s].alias(f"{prefix}_{s}") for s in stats]


def stage_fractions(stage: Column) -> list[Column]:
    """Share of each collapsed stage among all rows; unknown dilutes."""
    name = collapse_stage(stage)
    return [F.avg(F.when(name == c, 1.0).otherwise(0.0)).alias(f"frac_{c}") for c in C.SLEEP_CATEGORIES]


def window_rows(qc: DataFrame, layout: Layout, p: Params) -> DataFrame:
    """Signal statistics of every window of every scale.

    Rows are shuffled once, by (record, chunk): a chunk is a multiple of the
    longest window, so the per-scale groups below need no further exchange.
    """
    if any(layout.chunk_rows % r for r in p.window_rows.values()):
        raise ValueError("chunk_rows must be a multiple of every window length")
    scales = F.array(*[
        F.struct(F.lit(s).alias("scale"), F.lit(r).alias("size")) for s, r in p.window_rows.items()
    ])
    rows = (
        qc.select(layout.key, layout.seq, "timestamp", "spo2_clean", "hr_clean", "mov", "sleep_stage")
        .withColumn("_chunk", F.floor(F.col(layout.seq) / layout.chunk_rows))
        .repartition(layout.key, "_chunk")
        .withColumn("_s", F.explode(scales))
        .select("*", "_s.scale", F.floor(F.col(layout.seq) / F.col("_s.size")).alias("window_idx"))
    )
    six = ("mean", "std", "min", "max", "p10", "p90")
    agg = rows.groupBy(layout.key, "_chunk", "scale", "window_idx").agg(
        F.min("timestamp").alias("t_start"),
        F.count(F.lit(1)).alias("n_samples_raw"),
        F.count("spo2_clean").alias("_valid"),
        *signal_stats(F.col("spo2_clean"), six, "spo2"),
        *signal_stats(F.col("hr_clean"), six, "hr"),
        *signal_stats(F.col("mov").cast("double"), ("mean", "std", "max"), "mov"),
        *stage_fractions(F.col("sleep_stage")),
    )
    size = scale_rows(F.col("scale"), p)
    out = agg.withColumns({
        "t_end": add_seconds(F.col("t_start"), size),
        "coverage": F.col("_valid") / size,
        "is_tail": F.col("n_samples_raw") < size,
    })
    return out.filter(~F.col("is_tail") | (F.col("coverage") >= p.tail_coverage_min)).drop("_chunk", "_valid")


def event_density(windows: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """Events that start in [t_start, t_end): total, per shape label, mean score.

    The mean is 0 without events; an event without label counts only in the
    total.  Returns one row per window that has events.
    """
    size = scale_rows(F.col("scale"), p).cast("double")
    scales = F.array(*[F.lit(s) for s in p.window_rows])
    points = events.select(
        "night_record_id", "morphotype", "ird_event", epoch(F.col("ts_start")).alias("_ts"),
        F.explode(scales).alias("scale"),
    )
    spans = windows.select(
        "night_record_id", "scale", "window_idx",
        epoch(F.col("t_start")).alias("_w0"), epoch(F.col("t_end")).alias("_w1"),
    )
    hits = interval_join(
        points, spans, ["night_record_id", "scale"], F.col("_ts"), F.col("_w0"), F.col("_w1"), size
    )
    return hits.groupBy("night_record_id", "scale", "window_idx").agg(
        F.count(F.lit(1)).alias("n_edos_total"),
        *[F.count_if(F.col("morphotype") == g).alias(f"n_{n}") for g, n in C.GREEK_NAMES.items()],
        F.avg("ird_event").alias("ird_mean_local"),
    )


def build_windows(qc: DataFrame, events: DataFrame, layout: Layout, p: Params) -> DataFrame:
    """Windows with their 24 features; ``events`` carries ``morphotype``."""
    base = window_rows(qc, layout, p)
    keys = ["night_record_id", "scale", "window_idx"]
    out = base.join(event_density(base, events, p), keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in C.WINDOW_FEATURES if c.startswith("n_")}
    zero["ird_mean_local"] = F.coalesce(F.col("ird_mean_local"), F.lit(0.0))
    return out.withColumns(zero).select(*META, *C.WINDOW_FEATURES)


def training_windows(frac_wake: Column, coverage: Column, wake_max: float = 0.5, coverage_min: float = 0.5) -> Column:
    return F.coalesce((frac_wake <= wake_max) & (coverage >= coverage_min), F.lit(False))


def training_events(in_sleep: Column, near_gap: Column, meets_3pct: Column) -> Column:
    no = F.lit(False)
    return F.coalesce(in_sleep, no) & ~F.coalesce(near_gap, no) & F.coalesce(meets_3pct, no)

"""Silver layer: range checks, gaps, coverage and the per-record quality row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout, Params
from nightspark.functions.scalars import clean, out_of_range, seconds_between
from nightspark.operators.scans import framed


def range_qc(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    bad = out_of_range(F.col(column), low, high)
    return df.withColumns({f"{column}_invalid": bad, f"{column}_clean": clean(F.col(column), bad)})


def quality_signal(signal: DataFrame) -> DataFrame:
    out = range_qc(signal, "spo2", C.SPO2_MIN_VALID)
    return range_qc(out, "hr", C.HR_MIN_VALID, C.HR_MAX_VALID)


def with_step(df: DataFrame, layout: Layout) -> DataFrame:
    """Add ``step_s`` = seconds since the previous sample (null on the first)."""
    return framed(
        df, layout, before=1, after=0,
        exprs=lambda w: {"step_s": seconds_between(F.col("timestamp"), F.lag("timestamp").over(w))},
    )


def signal_gaps(signal: DataFrame, layout: Layout, min_gap_s: float) -> DataFrame:
    """Pairs of consecutive samples at least ``min_gap_s`` apart."""
    paired = framed(
        signal, layout, before=1, after=0, exprs=lambda w: {"gap_start": F.lag("timestamp").over(w)}
    )
    gap = seconds_between(F.col("timestamp"), F.col("gap_start"))
    return paired.filter(gap >= min_gap_s).select(
        layout.key, "gap_start", F.col("timestamp").alias("gap_end"), gap.alias("gap_s")
    )


def signal_diagnostics(signal: DataFrame, layout: Layout) -> DataFrame:
    """Sample count, sampling rate from the median step, steps over 1.5 s, span."""
    steps = with_step(signal, layout)
    median = F.percentile("step_s", 0.5)  # steps are whole seconds: few distinct values
    return steps.groupBy(layout.key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(1.0 / F.when(median > 0, median), 4).alias("sampling_hz_median"),
        F.count_if(F.col("step_s") > 1.5).alias("n_gaps"),
        F.min("timestamp").alias("ts_first"),
        F.max("timestamp").alias("ts_last"),
        seconds_between(F.max("timestamp"), F.min("timestamp")).alias("duration_s"),
    )


def gap_metrics(signal: DataFrame, layout: Layout, hz: float = 1.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Coverage and gap figures per record; ``extra`` adds aggregates to the pass."""
    nominal = 1.0 / hz
    agg = with_step(signal, layout).groupBy(layout.key).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("timestamp").alias("ts_start"),
        F.max("timestamp").alias("ts_end"),
        F.count_if(F.col("step_s") > nominal + 1e-6).alias("_gaps"),
        F.max(F.when(F.col("step_s") > nominal + 1e-6, F.col("step_s") - nominal)).alias("_gap"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    ).withColumn("duration_s", seconds_between(F.col("ts_end"), F.col("ts_start")))
    single = (F.col("n_samples") == 1) | (F.col("duration_s") == 0)
    expected = F.when(single, F.col("n_samples")).otherwise(F.rint(F.col("duration_s") * hz).cast("long") + 1)
    return agg.withColumns({
        "n_expected": expected,
        "coverage": F.when(single, F.lit(1.0)).otherwise(F.col("n_samples") / expected),
        "n_gaps": F.when(single, F.lit(0)).otherwise(F.col("_gaps")).cast("long"),
        "max_contiguous_gap_s": F.when(single, F.lit(0)).otherwise(
            F.coalesce(F.rint("_gap"), F.lit(0.0))).cast("long"),
    }).drop("_gaps", "_gap")


def duration_flags(duration: Column, aborted_s: float, min_s: float) -> dict[str, Column]:
    if aborted_s > min_s:
        raise ValueError("aborted_s must not exceed min_s")
    return {"qc_duration_aborted": duration < aborted_s, "qc_duration_short": duration < min_s}


def coverage_flags(coverage: Column, max_gap: Column, coverage_min: float, max_gap_s: float) -> dict[str, Column]:
    return {"qc_coverage_ok": coverage >= coverage_min, "qc_max_gap_ok": max_gap <= max_gap_s}


def night_qc(signal: DataFrame, layout: Layout, p: Params) -> DataFrame:
    """The whole quality row of each record (one frame pass, one groupBy)."""
    extra = {
        "user_id": F.min("user_id"),
        "n_spo2_invalid": F.count_if("spo2_invalid"),
        "n_hr_invalid": F.count_if("hr_invalid"),
    }
    m = gap_metrics(quality_signal(signal), layout, extra=extra)
    n = F.col("n_samples")
    return m.withColumns({
        **coverage_flags(F.col("coverage"), F.col("max_contiguous_gap_s"), p.coverage_min, p.max_gap_s),
        **duration_flags(F.col("duration_s"), p.duration_aborted_s, p.duration_min_s),
        "frac_spo2_invalid": F.col("n_spo2_invalid") / n,
        "frac_hr_invalid": F.col("n_hr_invalid") / n,
    }).select(
        layout.key, "user_id", "ts_start", "ts_end", "n_samples", "duration_s", "coverage",
        "max_contiguous_gap_s", "qc_coverage_ok", "qc_max_gap_ok", "qc_duration_aborted",
        "qc_duration_short", "n_spo2_invalid", "n_hr_invalid", "frac_spo2_invalid", "frac_hr_invalid",
    )

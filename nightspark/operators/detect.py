"""Desaturation events: baseline, runs below it, recovery, overlap removal, shape."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout, Params
from nightspark.functions.curves import needed_offsets, resample, resample_pairs
from nightspark.functions.scalars import reactivity_components, reactivity_score, seconds_between
from nightspark.operators.intervals import near_any, spread_over_chunks
from nightspark.operators.ordering import stable
from nightspark.operators.qc import signal_gaps
from nightspark.operators.scans import next_at_least, run_bounds, running
from nightspark.operators.workers import visible


def rolling_baseline(df: DataFrame, layout: Layout, value: str, rows: int, min_rows: int) -> DataFrame:
    """Median of the last ``rows`` rows, the current one included; null when
    fewer than ``min_rows`` of them hold a value.

    Rows are dealt and sorted by (record, chunk), with the context of each
    chunk; counts of each level are then cumulated along the rows and two of
    them differ by what a frame holds, so nothing is sorted per row.
    """
    visible(df.sparkSession)
    key, seq = layout.key, layout.seq
    own = F.floor(F.col(seq) / layout.chunk_rows).cast("long")
    last = F.floor((F.col(seq) + rows - 1) / layout.chunk_rows).cast("long")
    dealt = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, last)))
    dealt = dealt.repartition(F.col(key), F.col("_chunk")).sortWithinPartitions(key, "_chunk", seq)
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if tail is None else pa.concat_tables([tail, new])
            held = held.combine_chunks()
            skip = held.num_rows - new.num_rows
            chunk, record = held.column("_chunk").to_numpy(), held.column(key)
            change = np.concatenate([[True], chunk[1:] != chunk[:-1]])
            change[1:] |= pc.fill_null(pc.not_equal(record[1:], record[:-1]), True).to_numpy(zero_copy_only=False) if len(change) > 1 else False
            x = held.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
            base = sliding_median(x, np.flatnonzero(change), rows, min_rows)
            mine = np.flatnonzero((chunk == held.column("_own").to_numpy()) & (np.arange(len(chunk)) >= skip))
            out = held.select(names).append_column("baseline", pa.array(base, mask=np.isnan(base))).take(pa.array(mine))
            yield from out.combine_chunks().to_batches()
            # the next batch may go on with the same chunk
            tail = held.slice(max(0, held.num_rows - (rows - 1)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt.select(*names, "_own", "_chunk").mapInArrow(work, f"{kinds}, baseline double")


def sliding_median(x: np.ndarray, starts: np.ndarray, rows: int, min_rows: int, levels: int = 256, block: int = 1 << 14) -> np.ndarray:
    """Median of the non-missing among the last ``rows`` values, frames cut at ``starts``; NaN below ``min_rows`` of them.

    Values of up to ``levels`` kinds are counted by kind; a stretch with more
    kinds is sorted frame by frame.
    """
    out = np.full(len(x), np.nan)
    first = np.zeros(len(x), np.int64)
    first[starts] = starts
    first = np.maximum(np.maximum.accumulate(first), np.arange(len(x)) - rows + 1)
    for lo in range(0, len(x), block):
        hi = min(lo + block, len(x))
        at = int(first[lo])
        part = x[at:hi]
        kinds = np.unique(part[~np.isnan(part)])
        begin, end = first[lo:hi] - at, np.arange(lo, hi) - at + 1
        if len(kinds) == 0:
            continue
        if len(kinds) <= levels:
            seen = np.zeros((len(part) + 1, len(kinds)), np.int32)
            full = np.flatnonzero(~np.isnan(part))
            seen[full + 1, np.searchsorted(kinds, part[full])] = 1
            np.cumsum(seen, axis=0, out=seen)
            upto = np.cumsum(seen[end] - seen[begin], axis=1)
            n = upto[:, -1]
            low = (upto > (np.maximum(n - 1, 0) // 2)[:, None]).argmax(1)
            high = (upto > (n // 2)[:, None]).argmax(1)
            middle = (kinds[low] + kinds[np.where(n > 0, high, 0)]) / 2
        else:
            n = np.zeros(hi - lo, np.int64)
            middle = np.zeros(hi - lo)
            for i, (a, b) in enumerate(zip(begin, end, strict=True)):
                frame = part[a:b]
                frame = frame[~np.isnan(frame)]
                n[i] = len(frame)
                middle[i] = np.median(frame) if len(frame) else 0
        out[lo:hi] = np.where(n >= max(min_rows, 1), middle, np.nan)
    return out


def below_runs(
    with_baseline: DataFrame, layout: Layout, value: str = "spo2_clean", rows: DataFrame | None = None,
) -> DataFrame:
    """Maximal runs of rows under the baseline, with the baseline at their start."""
    below = F.coalesce(F.col(value) < F.col("baseline"), F.lit(False))
    runs = run_bounds(with_baseline.select(layout.key, layout.seq, value, "baseline"), layout, below, rows)
    return runs.filter("run_value").select(
        layout.key, "run_start", "run_end", "run_rows", F.col("baseline").alias("baseline_spo2")
    )


def candidate_events(qc: DataFrame, layout: Layout, p: Params, value: str = "spo2_clean") -> DataFrame:
    """Runs extended to recovery, with nadir, that pass the drop and length
    limits; overlaps are still in.

    The event ends on the first later row at or above the recovery level
    (nulls neither extend nor stop it), or on the last non-null row.
    """
    key, seq = layout.key, layout.seq
    samples = qc.select(key, seq, "timestamp", value)
    base = rolling_baseline(samples.drop("timestamp"), layout, value, p.baseline_rows, p.baseline_min_rows)
    runs = stable(below_runs(base, layout, value, samples).filter("baseline_spo2 > 0").withColumn(
        "_recovery", F.col("baseline_spo2") * C.RECOVERY_FRACTION
    ))
    found = next_at_least(runs, samples, layout, "run_end", "_recovery", value, "_hit")
    last_valid = samples.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max(seq).alias("_last"))
    ext = found.join(last_valid, key).select(
        key, F.col("run_start").alias("start_idx"), "baseline_spo2",
        F.coalesce(F.col("_hit"), F.greatest("_last", "run_end")).alias("end_idx"),
    )
    rows = samples.withColumnRenamed(value, "_v")
    inside = spread_over_chunks(ext, layout, "start_idx", "end_idx", rows)
    first_min = F.min_by(F.struct(seq, "timestamp"), F.when(F.col("_v").isNotNull(), F.struct("_v", seq)))
    shaped = inside.groupBy(key, "start_idx", "end_idx", "baseline_spo2").agg(
        F.min("_v").alias("nadir_spo2"), first_min.alias("_n"),
        F.min("timestamp").alias("ts_start"), F.max("timestamp").alias("ts_end"),
    )
    b0 = F.col("baseline_spo2")
    return shaped.select(
        key, "start_idx", "end_idx", F.col(f"_n.{seq}").alias("nadir_idx"), "baseline_spo2", "nadir_spo2",
        ((b0 - F.col("nadir_spo2")) / b0 * 100.0).alias("drop_pct"),
        seconds_between(F.col("ts_end"), F.col("ts_start")).alias("duration_s"),
        "ts_start", F.col("_n.timestamp").alias("ts_nadir"), "ts_end",
    ).filter((F.col("drop_pct") >= C.MIN_DROP_PCT) & (F.col("duration_s") >= p.min_event_s))


def dedup_overlaps(
    events: DataFrame, layout: Layout, start: str = "start_idx", end: str = "end_idx", max_fold: int = 256,
) -> DataFrame:
    """Keep an event only if it starts after the end of the last kept one.

    An event that starts after every earlier end is kept whatever came before,
    so it opens an independent cluster.  Short clusters are folded in one
    expression.  If one is longer than ``max_fold``, every event points to the
    first one that starts after its end, and pointers are doubled: after k
    rounds the first 2^k kept events of each cluster are marked.
    """
    key = layout.key
    by_start = layout.over(key, start)
    seen = running(events.select(key, start, end), by_start, {"_reach": ("max", F.col(end))}, inclusive=False)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    seen = stable(seen.withColumn("_opens", F.when(opens, F.col(start))))
    pending = stable(running(seen, by_start, {"_cluster": ("last", F.col("_opens"))}).drop("_reach", "_opens"))
    largest = pending.groupBy(key, "_cluster").count().agg(F.max("count")).first()[0] or 0
    if largest > max_fold:
        chosen = chained(pending, layout, start, end, largest)
    else:
        members = pending.groupBy(key, "_cluster").agg(F.array_sort(F.collect_list(F.struct(start, end))).alias("_list"))
        fold = F.aggregate(
            "_list",
            F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast("array<bigint>").alias("keep")),
            lambda acc, e: F.when(
                e[start] > acc["reach"],
                F.struct(e[end].alias("reach"), F.array_append(acc["keep"], e[start]).alias("keep")),
            ).otherwise(acc),
            lambda acc: acc["keep"],
        )
        chosen = members.select(key, F.explode(fold).alias(start))
    return events.join(chosen, [key, start], "left_semi")


def chained(pending: DataFrame, layout: Layout, start: str, end: str, longest: int) -> DataFrame:
    """(record, start) of the events that each cluster's first one leads to by "next that starts after my end"."""
    key = layout.key
    # places of starts are even, those of ends odd: an event that starts on an end is not after it
    doubled = replace(layout, seq="_at", chunk_rows=2 * layout.chunk_rows, max_seq=None if layout.max_seq is None else 2 * layout.max_seq + 1)
    begin = pending.select(key, (2 * F.col(start)).alias("_at"), F.col(start).alias("_starts"), F.lit(None).cast("long").alias("_of"))
    stop = pending.select(key, (2 * F.col(end) + 1).alias("_at"), F.lit(None).cast("long").alias("_starts"), F.col(start).alias("_of"))
    ahead = running(begin.unionByName(stop), doubled, {"_next": ("last", F.col("_starts"))}, reverse=True)
    nodes = stable(ahead.filter("_of is not null").select(key, F.col("_of").alias("_id"), "_next").join(
        pending.select(key, F.col(start).alias("_id"), (F.col(start) == F.col("_cluster")).alias("_kept")), [key, "_id"]))
    for _ in range(max(1, (longest - 1).bit_length())):
        hop = nodes.select(key, F.col("_id").alias("_next"), F.col("_next").alias("_after"))
        met = nodes.join(hop, [key, "_next"], "left")
        none = F.lit(None).cast("long")
        rows = F.array(F.struct(F.col("_id").alias("id"), F.col("_after").alias("to"), F.col("_kept").alias("kept")),
                       F.struct(F.when(F.col("_kept"), F.col("_next")).alias("id"), none.alias("to"), F.lit(True).alias("kept")))
        nodes = stable(met.select(key, F.explode(rows).alias("x")).filter("x.id is not null").groupBy(key, F.col("x.id").alias("_id")).agg(
            F.max("x.to").alias("_next"), F.max("x.kept").alias("_kept")))
    return nodes.filter("_kept").select(key, F.col("_id").alias(start))


def detect_events(qc: DataFrame, layout: Layout, p: Params) -> DataFrame:
    return stable(dedup_overlaps(stable(candidate_events(qc, layout, p)), layout))


def with_nadir_time(events: DataFrame, samples: DataFrame, layout: Layout) -> DataFrame:
    """Events with the time of their lowest sample.

    Files of samples are small for their rows, so the join is told to sort:
    otherwise Spark collects every sample in the driver to broadcast it.
    """
    times = samples.select(layout.key, F.col(layout.seq).alias("nadir_idx"), F.col("timestamp").alias("ts_nadir"))
    return stable(events.join(times.hint("merge"), [layout.key, "nadir_idx"]))


def meets_thresholds(drop: Column, thresholds: Sequence[int] = C.DROP_THRESHOLDS_PCT) -> dict[str, Column]:
    return {f"meets_{t}pct": drop >= t for t in thresholds}


def characterize_events(
    events: DataFrame, qc: DataFrame, layout: Layout, p: Params, weights=C.IRD_WEIGHTS, curves: bool = True,
) -> DataFrame:
    """Slopes, deficit area, heart-rate and movement response, stage share and
    (``curves``) three fixed-length curves of each event.

    Event rows and the rows just before it are fetched in one join on
    (record, chunk).
    """
    key, seq = layout.key, layout.seq
    wide = events.select(
        key, "start_idx", "end_idx", "baseline_spo2",
        F.greatest(F.col("start_idx") - p.context_rows, F.lit(0)).alias("_from"),
    )
    rows = qc.select(key, seq, F.col("spo2_clean").alias("_v"), F.col("hr_clean").alias("_hr"),
                     F.col("mov").cast("double").alias("_mov"), F.col("sleep_stage").alias("_stage"))
    near = spread_over_chunks(wide, layout, "_from", "end_idx", rows)
    inside = F.col(seq) >= F.col("start_idx")
    before = ~inside
    deficit = F.greatest(F.col("baseline_spo2") - F.coalesce("_v", "baseline_spo2"), F.lit(0.0))
    edge = (F.col(seq) == F.col("start_idx")) | (F.col(seq) == F.col("end_idx"))
    # a trapezoid with unit steps is the plain sum less half of both ends
    area = F.sum(F.when(inside, deficit)) - 0.5 * F.sum(F.when(inside & edge, deficit)) * F.when(
        F.max("end_idx") == F.max("start_idx"), 2.0).otherwise(1.0)
    aggs = [
        F.max_by("_v", F.when(inside & F.col("_v").isNotNull(), F.col(seq))).alias("_last_v"),
        area.alias("auc_spo2_pct_s"),
        F.percentile(F.when(before, F.col("_hr")), 0.5).alias("baseline_hr_bpm"),
        F.coalesce(F.percentile(F.when(before, F.col("_mov")), 0.5), F.lit(0.0)).alias("baseline_mov"),
        F.max(F.when(inside, F.col("_hr"))).alias("_max_hr"),
        F.coalesce(F.max(F.when(inside, F.col("_mov"))), F.lit(0.0)).alias("peak_mov"),
        F.avg(F.when(inside, F.when(F.col("_stage") == 0, 0.0).otherwise(1.0))).alias("_asleep"),
    ]
    traits = near.groupBy(key, "start_idx").agg(*aggs)
    out = events.join(traits, [key, "start_idx"])
    down = seconds_between(F.col("ts_nadir"), F.col("ts_start"))
    up = seconds_between(F.col("ts_end"), F.col("ts_nadir"))
    out = out.withColumns({
        "slope_desat_pct_s": F.when(down > 0, (F.col("baseline_spo2") - F.col("nadir_spo2")) / down).otherwise(0.0),
        "slope_recov_pct_s": F.when(up > 0, (F.col("_last_v") - F.col("nadir_spo2")) / up).otherwise(0.0),
        "delta_hr_bpm": F.coalesce(F.col("_max_hr") - F.col("baseline_hr_bpm"), F.lit(0.0)),
        "in_sleep": F.col("_asleep") > 0.5,
        **meets_thresholds(F.col("drop_pct")),
    })
    parts = reactivity_components(
        F.col("drop_pct"), F.col("baseline_spo2"), F.col("delta_hr_bpm"), F.col("baseline_hr_bpm"),
        F.col("peak_mov"), F.col("baseline_mov"),
    )
    out = out.withColumns(parts).withColumn(
        "ird_event", reactivity_score(*[F.col(c) for c in parts], weights=weights)
    )
    out = out.drop("_last_v", "_max_hr", "_asleep", "ts_nadir")
    if curves:
        out = out.join(event_curves(events, rows, layout), [key, "start_idx"])
    return out


def event_curves(events: DataFrame, rows: DataFrame, layout: Layout, points: int = C.CURVE_POINTS) -> DataFrame:
    """Fixed-length curves of the three channels inside each event.

    An event up to one chunk long gathers its rows in an array.  A longer one
    first collapses its rows to the ``2 * points`` offsets that the
    interpolation reads, so no array grows with the length of an event.
    """
    key, seq = layout.key, layout.seq
    fields = (("spo2", "_v"), ("hr", "_hr"), ("mov", "_mov"))
    span = F.col("end_idx") - F.col("start_idx")
    spans = events.select(key, "start_idx", "end_idx")

    def pick(array: str, field: str) -> Column:
        return F.transform(array, lambda r: r[field])

    short = spread_over_chunks(spans.filter(span < layout.chunk_rows), layout, "start_idx", "end_idx", rows)
    gathered = short.groupBy(key, "start_idx").agg(
        F.array_sort(F.collect_list(F.struct(seq, *[f for _, f in fields]))).alias("_rows"))
    done = gathered.select(
        key, "start_idx", *[resample(pick("_rows", f), points).alias(f"{n}_curve") for n, f in fields])

    size = span + 1
    long = spread_over_chunks(spans.filter(span >= layout.chunk_rows), layout, "start_idx", "end_idx", rows)
    offset = F.col(seq) - F.col("start_idx")
    slot = F.size(F.filter(needed_offsets(size, points), lambda o: o < offset))
    valid = lambda f: F.when(F.col(f).isNotNull(), F.col(seq))
    slots = long.groupBy(key, "start_idx", "end_idx", slot.alias("_slot")).agg(
        *[F.max_by(f, valid(f)).alias(f) for _, f in fields],
        *[F.min_by(F.struct(seq, f), valid(f)).alias(f"_first{f}") for _, f in fields],
    )
    merged = slots.groupBy(key, "start_idx", "end_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", F.struct(*[f for _, f in fields])))).alias("_by_slot"),
        *[F.min(f"_first{f}").alias(f"_first{f}") for _, f in fields],
    )

    def needed(f: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(2 * points - 1)), lambda j: F.try_element_at("_by_slot", j)[f])

    stitched = merged.select(key, "start_idx", *[
        resample_pairs(needed(f), F.col(f"_first{f}")[f], size, points).alias(f"{n}_curve") for n, f in fields])
    return done.unionByName(stitched)


def event_table(signal_qc: DataFrame, layout: Layout, p: Params, curves: bool = True) -> DataFrame:
    """Detected, characterized events with the ``near_gap`` flag."""
    events = detect_events(signal_qc, layout, p)
    full = characterize_events(events, signal_qc, layout, p, curves=curves)
    gaps = signal_gaps(signal_qc, layout, p.gap_s)
    return near_any(full, gaps, [layout.key], "ts_start", "ts_end", "gap_start", "gap_end", p.near_gap_s, "near_gap")

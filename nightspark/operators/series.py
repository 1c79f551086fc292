"""Operators on ordered samples, windows and events of a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightspark.config import Layout, Params
from nightspark.functions.scalars import add_seconds, parse_ampm_seconds, severe_label
from nightspark.operators.intervals import asof_join, epoch, interval_join, near_any
from nightspark.operators.ordering import order_rows
from nightspark.operators.scans import framed, run_bounds, running, with_constants

KEY = "night_record_id"


def reconstruct_timestamps(df: DataFrame, layout: Layout, time_text: str, started: str) -> DataFrame:
    """Absolute ``timestamp`` from clock text: each backward step is a midnight.

    The base day is the day of ``started`` (one value per record).
    """
    day = framed(
        df.withColumn("_sec", parse_ampm_seconds(F.col(time_text))), layout, before=1, after=0,
        exprs=lambda w: {"_back": F.when(F.col("_sec") < F.lag("_sec").over(w), 1).otherwise(0)},
    )
    out = running(day, layout, {"_days": ("sum", F.col("_back"))})
    base = F.date_trunc("day", F.col(started)).cast("timestamp_ntz")
    return out.withColumn(
        "timestamp", add_seconds(base, F.col("_days") * 86400 + F.col("_sec"))).drop("_sec", "_back", "_days")


def stage_runs(signal: DataFrame, layout: Layout) -> DataFrame:
    """Runs of sleep stage; a missing stage is -1."""
    stage = F.coalesce(F.col("sleep_stage"), F.lit(-1))
    return run_bounds(signal.select(layout.key, layout.seq, "sleep_stage"), layout, stage).select(
        layout.key, F.col("run_value").alias("stage"), "run_start", "run_end", "run_rows")


def run_length_stats(runs: DataFrame, short_rows: int = 30) -> DataFrame:
    """Per record and each stage 0..3: median run (null without one), number of runs, share of short runs.

    Run lengths sum to the record length, so distinct lengths stay few and the
    exact median holds few counters.
    """
    made = []
    for stage in range(4):
        own = F.when(F.col("stage") == stage, F.col("run_rows"))
        made.append(F.struct(
            F.lit(stage).alias("stage"), F.percentile(own, 0.5).alias("median_run_s"), F.count(own).alias("n_runs"),
            F.coalesce(F.avg((own <= short_rows).cast("double")), F.lit(0.0)).alias("pct_short")))
    return runs.groupBy(KEY).agg(F.array(*made).alias("_all")).select(KEY, F.inline("_all"))


def sleep_cycles(runs: DataFrame, layout: Layout, min_nrem: int) -> DataFrame:
    """REM entries after at least ``min_nrem`` rows of NREM since the last
    REM or wake run, and the median minutes between entries."""
    by_start = layout.over(KEY, "run_start")
    nrem = F.col("stage").isin(2, 3)
    df = running(runs.withColumn("_nrem", F.when(nrem, F.col("run_rows")).otherwise(0)), by_start,
                 {"_cum": ("sum", F.col("_nrem"))})
    df = running(df, by_start, {"_mark": ("last", F.when(~nrem, F.col("_cum")))}, inclusive=False)
    gathered = F.col("_cum") - F.coalesce(F.col("_mark"), F.lit(0))
    entry = (F.col("stage") == 1) & (gathered >= min_nrem)
    df = running(df.withColumn("_entry", F.when(entry, F.col("run_start"))), by_start,
                 {"_before": ("last", F.col("_entry"))}, inclusive=False)
    step = F.when(F.col("_entry").isNotNull(), F.col("_entry") - F.col("_before"))
    return df.groupBy(KEY).agg(
        F.count("_entry").alias("n_cycles"), (F.percentile(step, 0.5) / 60.0).alias("median_cycle_min"))


def quintile_composition(signal: DataFrame, layout: Layout) -> DataFrame:
    """Stage shares in five near-equal row pieces of each record."""
    sizes = signal.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    q, r, seq = F.floor(F.col("_n") / 5), F.col("_n") % 5, F.col(layout.seq)
    head = r * (q + 1)
    piece = F.when(seq < head, F.floor(seq / (q + 1))).otherwise(
        r + F.floor((seq - head) / F.greatest(q, F.lit(1))))
    rows = with_constants(signal.select(KEY, layout.seq, "sleep_stage"), sizes, layout).withColumn("quintile", piece.cast("long"))
    share = lambda s: F.avg(F.when(F.col("sleep_stage") == s, 1.0).otherwise(0.0))
    return rows.groupBy(KEY, "quintile").agg(*[share(s).alias(f"frac_stage_{s}") for s in range(4)])


def lookback_features(
    samples: DataFrame, anchors: DataFrame, p: Params, anchor_id: str, anchor_time: str,
) -> DataFrame:
    """Statistics of the ``lookback_s`` seconds before each anchor.

    ``samples``: record, seq, timestamp, spo2, hr, mov (raw).  Anchors with too
    few rows, or too few plausible ones (spo2 > 50 and hr > 20), are dropped.
    A sample meets only the anchors whose window holds it, so the per-anchor
    numbering below orders at most ``lookback_s`` rows at 1 Hz.
    """
    points = samples.select(
        KEY, "seq", epoch(F.col("timestamp")).alias("_ts"), F.col("spo2").cast("double").alias("s"),
        F.col("hr").cast("double").alias("h"), F.col("mov").cast("double").alias("m"))
    spans = anchors.select(KEY, anchor_id, epoch(F.col(anchor_time)).alias("_t"))
    hit = interval_join(points, spans, [KEY], F.col("_ts"), F.col("_t") - p.lookback_s, F.col("_t"), float(p.lookback_s))
    group = [KEY, anchor_id]
    total = Window.partitionBy(*group)
    hit = hit.withColumn("_all", F.count(F.lit(1)).over(total)).filter((F.col("s") > 50) & (F.col("h") > 20))
    hit = hit.withColumns({
        "i": F.row_number().over(total.orderBy("seq")) - 1, "n": F.count(F.lit(1)).over(total),
    }).filter((F.col("_all") >= p.lookback_min_rows) & (F.col("n") >= p.lookback_min_rows))
    tail = F.greatest(F.lit(1), F.floor(F.lit(p.lookback_tail_rows) * F.col("n") / p.lookback_s))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    last = F.col("i") >= F.col("n") - tail
    early, late = F.col("i") < third, F.col("i") >= F.col("n") - third
    x = F.col("i").cast("double")
    slope = lambda c, when=None: F.coalesce(
        F.regr_slope(c if when is None else F.when(when, c), x), F.lit(0.0))
    mean = lambda c, when: F.avg(F.when(when, c))
    s, h, m = F.col("s"), F.col("h"), F.col("m")
    below = lambda t: F.avg((s < t).cast("double"))
    out = {
        "spo2_mean": F.avg(s), "spo2_std": F.stddev_pop(s), "spo2_min": F.min(s), "spo2_max": F.max(s),
        "spo2_range": F.max(s) - F.min(s), "spo2_slope": slope(s), "spo2_last30_mean": mean(s, last),
        "spo2_last30_min": F.min(F.when(last, s)), "spo2_last30_slope": slope(s, last),
        "spo2_drift": F.max_by(s, "i") - F.min_by(s, "i"),
        "spo2_pct_below92": below(92), "spo2_pct_below90": below(90), "spo2_pct_below88": below(88),
        "spo2_late_drop": mean(s, late) - mean(s, early),
        "hr_mean": F.avg(h), "hr_std": F.stddev_pop(h), "hr_max": F.max(h), "hr_min": F.min(h),
        "hr_range": F.max(h) - F.min(h), "hr_slope": slope(h), "hr_last30_mean": mean(h, last),
        "hr_last30_slope": slope(h, last), "hr_late_rise": mean(h, late) - mean(h, early),
        "mov_mean": F.avg(m), "mov_std": F.stddev_pop(m), "mov_max": F.max(m),
        "mov_last30_max": F.max(F.when(last, m)), "mov_last30_mean": mean(m, last),
        "mov_last30_std": F.stddev_pop(F.when(last, m)),
        "corr_spo2_hr": F.when(
            (F.count(s) > 5) & (F.stddev_pop(s) > 0) & (F.stddev_pop(h) > 0), F.corr(s, h)).otherwise(0.0),
        "hr_spo2_ratio": F.avg(h) / F.greatest(F.avg(s), F.lit(1.0)),
    }
    return hit.groupBy(*group).agg(*[c.alias(n) for n, c in out.items()])


def value_at(
    samples: DataFrame, anchors: DataFrame, anchor_time: str, columns: Sequence[str], tie: Sequence[str],
) -> DataFrame:
    """Values of the sample nearest in time to each anchor (later one on a tie)."""
    cols = ["timestamp", *columns]
    both = asof_join(anchors, samples, KEY, anchor_time, "timestamp", cols, tie, "backward", prefix="_b_")
    both = asof_join(both, samples, KEY, anchor_time, "timestamp", cols, tie, "forward", prefix="_f_")
    t = epoch(F.col(anchor_time))
    back, ahead = t - epoch(F.col("_b_timestamp")), epoch(F.col("_f_timestamp")) - t
    use_next = F.col("_b_timestamp").isNull() | (F.col("_f_timestamp").isNotNull() & (ahead <= back))
    return both.select(*anchors.columns, *[
        F.when(use_next, F.col(f"_f_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in columns])


def previous_event_context(events: DataFrame, anchors: DataFrame, anchor_time: str, tie: Sequence[str]) -> DataFrame:
    """Severity, drop and clipped gap of the latest event strictly before each
    anchor; (2, 3.0, 600, 0) when there is none."""
    prev = asof_join(
        anchors, events, KEY, anchor_time, "ts_start", ["ts_end", "severity", "drop_pct", "ts_start"], tie,
        "backward", strict=True, prefix="_p_")
    gap = epoch(F.col(anchor_time)) - epoch(F.col("_p_ts_end"))
    return prev.select(
        *anchors.columns,
        F.coalesce(F.col("_p_severity").cast("double"), F.lit(2.0)).alias("prev_morpho_sev"),
        F.coalesce("_p_drop_pct", F.lit(3.0)).alias("prev_drop_pct"),
        F.coalesce(F.least(F.greatest(gap, F.lit(0.0)), F.lit(600.0)), F.lit(600.0)).alias("prev_gap_s"),
        F.when(F.col("_p_ts_start").isNotNull(), 1.0).otherwise(0.0).alias("has_prev_event"))


def negative_samples(
    samples: DataFrame, events: DataFrame, margin_s: int, ratio: int, seed: int = 42,
) -> DataFrame:
    """``ratio`` samples per event of the record, outside every event widened
    by ``margin_s``, picked by a hash order (repeatable, no shuffle of state)."""
    free = near_any(
        samples.select(KEY, "seq", "timestamp", F.col("timestamp").alias("_t1")), events, [KEY], "timestamp", "_t1",
        "ts_start", "ts_end", margin_s, "_near").filter("not _near").select(KEY, "seq", "timestamp")
    wanted = events.groupBy(KEY).agg((F.count(F.lit(1)) * ratio).alias("_want"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(KEY), F.col("seq").cast("string")))
    ranked = order_rows(free.withColumn("_h", order), [KEY], ["_h", "seq"], out="_pick")
    return ranked.join(wanted, KEY).filter(F.col("_pick") < F.col("_want")).select(KEY, "seq", "timestamp")


def event_history(events: DataFrame, layout: Layout) -> DataFrame:
    """Running counts along the events of a record (current event included)."""
    by_start = layout.over(KEY, "start_idx")
    sev = F.coalesce(F.col("is_severe"), F.lit(False))
    return running(events, by_start, {
        "n_so_far": ("sum", F.lit(1)), "sev_so_far": ("sum", sev.cast("int")),
        "last_severe": ("last", F.when(sev, F.col("ts_start")))})


def window_context(windows: DataFrame, events: DataFrame, layout: Layout, p: Params) -> DataFrame:
    """Event context strictly before each window start.

    Recent counts come from an interval join over the last ``recent_long_s``
    seconds; totals so far come from one as-of join onto running counts, so no
    window meets all earlier events.
    """
    ids = [KEY, "window_idx"]
    ev = events.select(KEY, "ts_start", "is_severe", "morph_num", "start_idx")
    w = windows.select(*ids, "t_start")
    points = ev.select(KEY, epoch(F.col("ts_start")).alias("_ts"), "is_severe", "morph_num")
    spans = w.select(*ids, epoch(F.col("t_start")).alias("_t"))
    hit = interval_join(points, spans, [KEY], F.col("_ts"), F.col("_t") - p.recent_long_s, F.col("_t"), float(p.recent_long_s))
    near = F.col("_ts") >= F.col("_t") - p.recent_s
    recent = hit.groupBy(*ids).agg(
        F.count_if(near).alias("n_ev_5min"), F.count_if(near & F.col("is_severe")).alias("n_severe_5min"),
        F.avg(F.col("is_severe").cast("double")).alias("frac_severe_10min"),
        F.avg(F.when(near, F.col("morph_num"))).alias("morph_mean_5min"))
    past = asof_join(
        w, event_history(ev, layout), KEY, "t_start", "ts_start", ["ts_start", "n_so_far", "sev_so_far", "last_severe"],
        ids, "backward", strict=True, prefix="_p_")
    since = lambda c: F.coalesce(epoch(F.col("t_start")) - epoch(F.col(c)), F.lit(3600.0))
    past = past.select(
        *ids, since("_p_ts_start").alias("time_since_last_ev"), since("_p_last_severe").alias("time_since_last_severe"),
        F.coalesce("_p_sev_so_far", F.lit(0)).alias("n_severe_sofar"),
        F.coalesce(F.col("_p_sev_so_far") / F.col("_p_n_so_far"), F.lit(0.0)).alias("ci_sofar"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return past.join(recent, ids, "left").select(
        *ids, zero("n_ev_5min", 0), zero("n_severe_5min", 0), zero("frac_severe_10min", 0.0), "morph_mean_5min",
        "time_since_last_ev", "time_since_last_severe", "n_severe_sofar", "ci_sofar")


def next_event_lead(windows: DataFrame, events: DataFrame, ids: Sequence[str], strict: bool) -> DataFrame:
    """Seconds from each window end to the next event (null if none)."""
    nxt = asof_join(windows, events, KEY, "t_end", "ts_start", ["ts_start"], ids, "forward", strict=strict, prefix="_n_")
    return nxt.withColumn("lead_s", epoch(F.col("_n_ts_start")) - epoch(F.col("t_end"))).drop("_n_ts_start")


def lead_time_targets(windows: DataFrame, severe: DataFrame, horizons: Sequence[int], ids: Sequence[str]) -> DataFrame:
    """Whether a severe event starts in (t_end, t_end + H], per horizon."""
    lead = next_event_lead(windows, severe, ids, strict=True)
    return lead.select(*ids, *[
        F.coalesce((F.col("lead_s") <= h).cast("long"), F.lit(0)).alias(f"y_{h}") for h in horizons])


def event_rolling(events: DataFrame, layout: Layout, in_path: Column, window: int) -> DataFrame:
    """Features of the previous ``window`` events of the record, the current
    one left out: share in path states, mean severity, severe so far, position."""
    ev = order_rows(events.withColumn("_path", in_path.cast("double")), [KEY], ["start_idx"], out="ev_seq")
    by_event = layout.over(KEY, "ev_seq")

    def exprs(w):
        frame = w.rowsBetween(-window, -1)
        return {"frac_path_prev": F.avg("_path").over(frame), "recent_morph_mean": F.avg("morph_num").over(frame)}

    ev = framed(ev, by_event, before=window, after=0, exprs=exprs)
    ev = running(ev, by_event, {"n_severe_so_far": ("sum", F.col("is_severe").cast("int"))}, inclusive=False)
    sizes = events.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    seq = F.col("ev_seq")
    return with_constants(ev, sizes, by_event).withColumns({
        "ci_so_far": F.when(seq > 0, F.col("n_severe_so_far") / seq),
        "event_position": seq / F.greatest(F.col("_n") - 1, F.lit(1)),
    }).drop("_n", "_path")


def window_position(windows: DataFrame) -> DataFrame:
    """t / max(t) in the record, within 0..1; null when the maximum is 0."""
    # windows carry a number of their own, which cuts long records as rows do
    by_window = Layout(key=KEY, seq="window_idx")
    top = windows.groupBy(KEY).agg(F.max("t_start_s").alias("_top"))
    ratio = F.col("t_start_s") / F.nullif(F.col("_top"), F.lit(0.0))
    return with_constants(windows, top, by_window).withColumn(
        "window_position", F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).drop("_top")


def partial_curve(curve: Column, points: int) -> dict[str, Column]:
    """First ``points`` values over the first one, their slope and minimum."""
    first = F.get(curve, F.lit(0))
    base = F.when(first > 0, first).otherwise(first + 1e-6)
    norm = F.transform(F.slice(curve, 1, points), lambda v: v / base)
    out = {f"ratio_{i}": F.get(norm, F.lit(i)) for i in range(1, points)}
    out["slope"] = (F.get(norm, F.lit(points - 1)) - F.get(norm, F.lit(0))) / (points - 1)
    out["min_ratio"] = F.array_min(norm)
    return out


def scores_before(
    windows: DataFrame, scored: DataFrame, ids: Sequence[str], back_s: float, delay_s: float, threshold: float,
) -> DataFrame:
    """Mean, max and count over a threshold of event scores with a start in
    [t_end - back_s, t_end - delay_s]; zeros when there is none."""
    points = scored.select(KEY, epoch(F.col("ts_start")).alias("_ts"), "score")
    spans = windows.select(*ids, epoch(F.col("t_end")).alias("_t"))
    hit = interval_join(points, spans, [KEY], F.col("_ts"), F.col("_t") - back_s, F.col("_t") - delay_s, back_s, "both")
    agg = hit.groupBy(*ids).agg(
        F.avg("score").alias("early_score_mean"), F.max("score").alias("early_score_max"),
        F.count_if(F.col("score") >= threshold).alias("early_severe_count"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return windows.select(*ids).join(agg, list(ids), "left").select(
        *ids, zero("early_score_mean", 0.0), zero("early_score_max", 0.0), zero("early_severe_count", 0))


def earliest_event_near(windows: DataFrame, events: DataFrame, ids: Sequence[str], margin_s: float) -> DataFrame:
    """Earliest event starting in [t_start - margin, t_end + margin]: flag,
    severity and score."""
    points = events.select(KEY, "start_idx", epoch(F.col("ts_start")).alias("_ts"), "is_severe", "score")
    spans = windows.select(*ids, epoch(F.col("t_start")).alias("_a"), epoch(F.col("t_end")).alias("_b"))
    hit = interval_join(points, spans, [KEY], F.col("_ts"), F.col("_a") - margin_s, F.col("_b") + margin_s, 60.0, "both")
    best = hit.groupBy(*ids).agg(F.min_by(F.struct("is_severe", "score"), F.struct("_ts", "start_idx")).alias("_e"))
    return windows.select(*ids).join(best, list(ids), "left").select(
        *ids, F.col("_e").isNotNull().alias("has_drop"),
        F.coalesce(F.col("_e.is_severe"), F.lit(False)).alias("drop_is_severe"), F.col("_e.score").alias("early_score"))


def transition_pairs(states: DataFrame, layout: Layout) -> DataFrame:
    """Each valid window with the label of the next valid one of its scale."""
    valid = states.filter(F.col("state_label").isNotNull()).withColumn("_series", F.concat_ws("|", KEY, "scale"))
    by_window = layout.over("_series", "window_idx")
    ahead = running(valid, by_window, {"state_next": ("last", F.col("state_label"))}, reverse=True, inclusive=False)
    return ahead.filter(F.col("state_next").isNotNull()).drop("_series")


def neighbours(events: DataFrame, layout: Layout, columns: Sequence[str]) -> DataFrame:
    """Add ``prev_{c}`` / ``next_{c}``: the value at the previous and the next
    event of the record (null values are kept as they are)."""
    by_start = layout.over(KEY, "start_idx")
    held = F.struct(*columns)  # a struct is never null, so "last" is exactly one step
    out = running(events, by_start, {"_prev": ("last", held)}, inclusive=False)
    out = running(out, by_start, {"_next": ("last", held)}, reverse=True, inclusive=False)
    return out.withColumns({
        **{f"prev_{c}": F.col(f"_prev.{c}") for c in columns}, **{f"next_{c}": F.col(f"_next.{c}") for c in columns},
    }).drop("_prev", "_next")


def add_severity(events: DataFrame) -> DataFrame:
    """``is_severe``, ``severity`` (1..5) and ``morph_num`` (0..4) from the curve label."""
    level = F.substring("morphotype_curve", 2, 1).cast("int")
    return events.withColumns({
        "is_severe": F.coalesce(severe_label(F.col("morphotype_curve")), F.lit(False)),
        "severity": level, "morph_num": (level - 1).cast("double")})

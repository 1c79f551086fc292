"""Queries: ordered-sample operators, look-back features, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.functions.scalars import add_seconds
from nightspark.operators import series as S
from nightspark.operators.intervals import asof_join, epoch, first_labelled, interval_join
from nightspark.operators.ranks import exact_percentiles
from nightspark.plans import gold_queries  # noqa: F401  (defines the CTEs used here)
from nightspark.plans.oracle import cte, runs_sql
from nightspark.plans.registry import d6, query
from nightspark.sources.adapter import PARAMS as P

KEY = "night_record_id"
SCORE = "((start_idx * 7919) % 1000) / 1000.0"
cte(f"""evs AS MATERIALIZED (
  SELECT e.*, coalesce(e.morphotype_curve IN ('C4', 'C5'), false) AS is_severe, CAST(substr(e.morphotype_curve, 2, 1) AS BIGINT) AS severity,
         CAST(substr(e.morphotype_curve, 2, 1) AS BIGINT) - 1 AS morph_num, {SCORE} AS score,
         {', '.join(f'w{s}.state_label AS state_{s}, w{s}.window_idx AS window_idx_{s}, w{s}.dist_to_centroid AS dist_{s}' for s in C.STATE_K)}
  FROM evg e {' '.join(f"LEFT JOIN st w{s} ON w{s}.night_record_id = e.night_record_id AND w{s}.scale = '{s}' AND e.ts_start >= w{s}.t_start AND e.ts_start < w{s}.t_end" for s in C.STATE_K)})""")
cte("sts AS MATERIALIZED (SELECT * FROM st WHERE scale = 's')")
cte(f"struns AS ({runs_sql('coalesce(sleep_stage, -1)')})")


def scored(L):
    """Events with severity and a repeatable stand-in score."""
    score = (F.col("start_idx") * 7919) % 1000 / 1000.0
    return S.add_severity(L.event_states).withColumn("score", score)


def small_windows(L):
    return L.states.filter(F.col("scale") == "s")


@query("reconstruct_timestamps", "SELECT night_record_id, seq, CAST(epoch(timestamp) AS BIGINT) + 7170 AS timestamp FROM sig")
def _(L):
    moved = L.signal.select(KEY, "seq", add_seconds(F.col("timestamp"), F.lit(7170)).alias("t"))
    text = F.concat(F.date_format(F.col("t"), "h:mm:ss"), F.lit(" "), F.date_format(F.col("t"), "a"))
    starts = moved.groupBy(KEY).agg(F.min("t").alias("started"))
    raw = moved.select(KEY, "seq", text.alias("time_text")).join(starts, KEY)
    return S.reconstruct_timestamps(raw, L.layout, "time_text", "started").select(KEY, "seq", "timestamp")


@query("run_length_stats", """SELECT n.night_record_id, CAST(s.stage AS BIGINT) AS stage, r6(quantile_cont(run_rows, 0.5)) AS median_run_s, count(run_rows) AS n_runs,
  r6(coalesce(avg(CASE WHEN run_rows <= 1 THEN 1.0 WHEN run_rows > 1 THEN 0.0 END), 0.0)) AS pct_short FROM (SELECT DISTINCT night_record_id FROM struns) n CROSS JOIN (SELECT unnest(range(4)) AS stage) s
  LEFT JOIN struns r ON r.night_record_id = n.night_record_id AND r.run_value = s.stage GROUP BY n.night_record_id, s.stage""")
def _(L):
    return S.run_length_stats(S.stage_runs(L.signal, L.layout), short_rows=1)


@query("sleep_cycles", f"""WITH a AS (SELECT *, sum(CASE WHEN run_value IN (2, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY night_record_id ORDER BY run_start) AS resets FROM struns),
  b AS (SELECT *, lag(resets, 1, 0) OVER (PARTITION BY night_record_id ORDER BY run_start) AS g FROM a),
  c AS (SELECT x.night_record_id, x.run_start, (SELECT coalesce(sum(y.run_rows), 0) FROM b y WHERE y.night_record_id = x.night_record_id AND y.run_value IN (2, 3) AND y.run_start < x.run_start AND y.g = x.g) AS nrem
        FROM b x WHERE x.run_value = 1),
  d AS (SELECT *, run_start - lag(run_start) OVER (PARTITION BY night_record_id ORDER BY run_start) AS step FROM c WHERE nrem >= {P.cycle_min_s})
  SELECT n.night_record_id, count(d.run_start) AS n_cycles, r6(quantile_cont(d.step, 0.5) / 60.0) AS median_cycle_min
  FROM nqc n LEFT JOIN d ON d.night_record_id = n.night_record_id GROUP BY n.night_record_id""")
def _(L):
    return S.sleep_cycles(S.stage_runs(L.signal, L.layout), L.layout, L.p.cycle_min_s)


@query("quintile_composition", """SELECT night_record_id, q AS quintile, """ + ", ".join(
    f"r6(avg(CASE WHEN sleep_stage = {s} THEN 1.0 ELSE 0.0 END)) AS frac_stage_{s}" for s in range(4)) + """
  FROM (SELECT *, ntile(5) OVER (PARTITION BY night_record_id ORDER BY seq) - 1 AS q FROM sig) GROUP BY night_record_id, q""")
def _(L):
    return S.quintile_composition(L.signal, L.layout)


_LB = P.lookback_s
_LBF = ("spo2_mean", "spo2_std", "spo2_min", "spo2_max", "spo2_range", "spo2_slope", "spo2_last30_mean", "spo2_last30_min", "spo2_last30_slope",
        "spo2_drift", "spo2_pct_below92", "spo2_pct_below90", "spo2_pct_below88", "spo2_late_drop", "hr_mean", "hr_std", "hr_max", "hr_min",
        "hr_range", "hr_slope", "hr_last30_mean", "hr_last30_slope", "hr_late_rise", "mov_mean", "mov_std", "mov_max", "mov_last30_max",
        "mov_last30_mean", "mov_last30_std", "corr_spo2_hr", "hr_spo2_ratio")


@query("lookback_features", f"""WITH j AS (SELECT e.night_record_id, e.start_idx, q.seq, CAST(q.spo2 AS DOUBLE) AS s, CAST(q.hr AS DOUBLE) AS h, CAST(q.mov AS DOUBLE) AS m,
    count(*) OVER (PARTITION BY e.night_record_id, e.start_idx) AS allrows
    FROM det e JOIN sig q ON q.night_record_id = e.night_record_id AND q.timestamp >= e.ts_start - to_seconds({_LB}) AND q.timestamp < e.ts_start),
  v AS (SELECT *, row_number() OVER (PARTITION BY night_record_id, start_idx ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY night_record_id, start_idx) AS n FROM j WHERE s > 50 AND h > 20),
  k AS (SELECT *, i >= n - greatest(1, {P.lookback_tail_rows} * n // {_LB}) AS last, i < greatest(1, n // 3) AS early, i >= n - greatest(1, n // 3) AS late
        FROM v WHERE allrows >= {P.lookback_min_rows} AND n >= {P.lookback_min_rows}),
  f AS (SELECT night_record_id, start_idx, avg(s) AS spo2_mean, stddev_pop(s) AS spo2_std, min(s) AS spo2_min, max(s) AS spo2_max, max(s) - min(s) AS spo2_range,
    coalesce(regr_slope(s, i), 0) AS spo2_slope, avg(s) FILTER (WHERE last) AS spo2_last30_mean, min(s) FILTER (WHERE last) AS spo2_last30_min,
    coalesce(regr_slope(s, i) FILTER (WHERE last), 0) AS spo2_last30_slope, arg_max(s, i) - arg_min(s, i) AS spo2_drift,
    avg(CASE WHEN s < 92 THEN 1.0 ELSE 0.0 END) AS spo2_pct_below92, avg(CASE WHEN s < 90 THEN 1.0 ELSE 0.0 END) AS spo2_pct_below90, avg(CASE WHEN s < 88 THEN 1.0 ELSE 0.0 END) AS spo2_pct_below88,
    avg(s) FILTER (WHERE late) - avg(s) FILTER (WHERE early) AS spo2_late_drop, avg(h) AS hr_mean, stddev_pop(h) AS hr_std, max(h) AS hr_max, min(h) AS hr_min, max(h) - min(h) AS hr_range,
    coalesce(regr_slope(h, i), 0) AS hr_slope, avg(h) FILTER (WHERE last) AS hr_last30_mean, coalesce(regr_slope(h, i) FILTER (WHERE last), 0) AS hr_last30_slope,
    avg(h) FILTER (WHERE late) - avg(h) FILTER (WHERE early) AS hr_late_rise, avg(m) AS mov_mean, stddev_pop(m) AS mov_std, max(m) AS mov_max,
    max(m) FILTER (WHERE last) AS mov_last30_max, avg(m) FILTER (WHERE last) AS mov_last30_mean, stddev_pop(m) FILTER (WHERE last) AS mov_last30_std,
    CASE WHEN count(*) > 5 AND stddev_pop(s) > 0 AND stddev_pop(h) > 0 THEN corr(s, h) ELSE 0.0 END AS corr_spo2_hr, avg(h) / greatest(avg(s), 1.0) AS hr_spo2_ratio
    FROM k GROUP BY night_record_id, start_idx)
  SELECT night_record_id, start_idx, {d6(*_LBF)} FROM f""")
def _(L):
    return S.lookback_features(L.signal, L.raw_events.select(KEY, "start_idx", "ts_start"), L.p, "start_idx", "ts_start")


@query("stage_at_event", """WITH a AS (SELECT night_record_id, start_idx, ts_end + to_milliseconds(17500) AS at FROM det),
  r AS (SELECT a.night_record_id, a.start_idx, q.sleep_stage, row_number() OVER (PARTITION BY a.night_record_id, a.start_idx
        ORDER BY abs(epoch(q.timestamp) - epoch(a.at)), q.timestamp DESC) AS rn FROM a JOIN sig q ON q.night_record_id = a.night_record_id)
  SELECT night_record_id, start_idx, CAST(sleep_stage AS DOUBLE) AS sleep_stage FROM r WHERE rn = 1""")
def _(L):
    anchors = L.raw_events.select(KEY, "start_idx", add_seconds(F.col("ts_end"), F.lit(17.5)).alias("at"))
    out = S.value_at(L.signal.select(KEY, "timestamp", "sleep_stage"), anchors, "at", ["sleep_stage"], ["start_idx"])
    return out.select(KEY, "start_idx", F.col("sleep_stage").cast("double").alias("sleep_stage"))


@query("previous_event_context", """WITH p AS (SELECT *, lag(ts_end) OVER w AS pe, lag(severity) OVER w AS ps, lag(drop_pct) OVER w AS pd, lag(start_idx) OVER w AS pi FROM evs
    WINDOW w AS (PARTITION BY night_record_id ORDER BY ts_start))
  SELECT night_record_id, start_idx, coalesce(CAST(ps AS DOUBLE), 2.0) AS prev_morpho_sev, r6(coalesce(pd, 3.0)) AS prev_drop_pct,
  r6(coalesce(least(greatest(epoch(ts_start) - epoch(pe), 0), 600), 600)) AS prev_gap_s, CASE WHEN pi IS NULL THEN 0.0 ELSE 1.0 END AS has_prev_event FROM p""")
def _(L):
    ev = scored(L)
    return S.previous_event_context(
        ev.select(KEY, "ts_start", "ts_end", "severity", "drop_pct"), ev.select(KEY, "start_idx", "ts_start"),
        "ts_start", ["start_idx"]).drop("ts_start")


@query("negative_sampling", f"""WITH f AS (SELECT q.night_record_id, q.seq FROM sig q WHERE NOT EXISTS (SELECT 1 FROM det e WHERE e.night_record_id = q.night_record_id
    AND q.timestamp >= e.ts_start - to_seconds({P.match_s}) AND q.timestamp <= e.ts_end + to_seconds({P.match_s}))),
  r AS (SELECT *, row_number() OVER (PARTITION BY night_record_id ORDER BY md5('42|' || night_record_id || '|' || seq), seq) AS rn FROM f)
  SELECT r.night_record_id, r.seq FROM r JOIN (SELECT night_record_id, count(*) * {P.negative_ratio} AS want FROM det GROUP BY night_record_id) w ON w.night_record_id = r.night_record_id WHERE rn <= want""")
def _(L):
    return S.negative_samples(L.signal, L.raw_events, L.p.match_s, L.p.negative_ratio).select(KEY, "seq")


@query("window_context_features", f"""SELECT w.night_record_id, w.window_idx, count(e.start_idx) FILTER (WHERE r5) AS n_ev_5min, count(e.start_idx) FILTER (WHERE r5 AND is_severe) AS n_severe_5min,
  r6(coalesce(avg(CASE WHEN is_severe THEN 1.0 ELSE 0.0 END) FILTER (WHERE r10), 0)) AS frac_severe_10min, r6(avg(CAST(morph_num AS DOUBLE)) FILTER (WHERE r5)) AS morph_mean_5min,
  r6(coalesce(epoch(w.t_start) - epoch(max(e.ts_start)), 3600)) AS time_since_last_ev, r6(coalesce(epoch(w.t_start) - epoch(max(e.ts_start) FILTER (WHERE is_severe)), 3600)) AS time_since_last_severe,
  count(e.start_idx) FILTER (WHERE is_severe) AS n_severe_sofar, r6(coalesce(count(e.start_idx) FILTER (WHERE is_severe) / nullif(count(e.start_idx), 0), 0)) AS ci_sofar
  FROM sts w LEFT JOIN (SELECT s.window_idx AS wi, e.*, e.ts_start >= s.t_start - to_seconds({P.recent_s}) AS r5, e.ts_start >= s.t_start - to_seconds({P.recent_long_s}) AS r10
    FROM sts s JOIN evs e ON e.night_record_id = s.night_record_id AND e.ts_start < s.t_start) e ON e.night_record_id = w.night_record_id AND e.wi = w.window_idx
  GROUP BY w.night_record_id, w.window_idx, w.t_start""")
def _(L):
    return S.window_context(small_windows(L), scored(L), L.layout, L.p)


@query("lead_time_targets", f"""SELECT w.night_record_id, w.window_idx, {', '.join(f"CAST(EXISTS (SELECT 1 FROM evs e WHERE e.night_record_id = w.night_record_id AND e.is_severe AND e.ts_start > w.t_end AND e.ts_start <= w.t_end + to_seconds({h})) AS BIGINT) AS y_{h}" for h in P.horizons_s)} FROM sts w""")
def _(L):
    w = small_windows(L).select(KEY, "window_idx", "t_end")
    return S.lead_time_targets(w, scored(L).filter("is_severe").select(KEY, "ts_start"), L.p.horizons_s, [KEY, "window_idx"])


@query("event_rolling_features", f"""SELECT night_record_id, start_idx, r6(avg(CASE WHEN state_m IN ('M0', 'M2') THEN 1.0 ELSE 0.0 END) OVER w) AS frac_path_prev,
  r6(avg(CAST(morph_num AS DOUBLE)) OVER w) AS recent_morph_mean, CAST(coalesce(sum(CAST(is_severe AS BIGINT)) OVER u, 0) AS BIGINT) AS n_severe_so_far,
  r6(sum(CAST(is_severe AS BIGINT)) OVER u / nullif(row_number() OVER o - 1, 0)) AS ci_so_far, r6((row_number() OVER o - 1) / greatest(count(*) OVER (PARTITION BY night_record_id) - 1, 1)) AS event_position
  FROM evs WINDOW w AS (PARTITION BY night_record_id ORDER BY start_idx ROWS BETWEEN {P.rolling_events} PRECEDING AND 1 PRECEDING),
    u AS (PARTITION BY night_record_id ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY night_record_id ORDER BY start_idx)""")
def _(L):
    in_path = F.coalesce(F.col("state_m").isin("M0", "M2"), F.lit(False))
    return S.event_rolling(scored(L), L.layout, in_path, L.p.rolling_events).select(
        KEY, "start_idx", "frac_path_prev", "recent_morph_mean", "n_severe_so_far", "ci_so_far", "event_position")


@query("window_position", """SELECT night_record_id, window_idx, r6(least(greatest(t_start_s / nullif(max(t_start_s) OVER (PARTITION BY night_record_id), 0), 0), 1)) AS window_position FROM sts""")
def _(L):
    return S.window_position(small_windows(L)).select(KEY, "window_idx", "window_position")


@query("partial_curve_features", """WITH p AS (SELECT night_record_id, start_idx, point, spo2 / first_value(CASE WHEN spo2 > 0 THEN spo2 ELSE spo2 + 1e-6 END) OVER (PARTITION BY night_record_id, start_idx ORDER BY point) AS v FROM curvepts WHERE point < 4)
  SELECT night_record_id, start_idx, r6(max(v) FILTER (WHERE point = 1)) AS ratio_1, r6(max(v) FILTER (WHERE point = 2)) AS ratio_2, r6(max(v) FILTER (WHERE point = 3)) AS ratio_3,
  r6((max(v) FILTER (WHERE point = 3) - max(v) FILTER (WHERE point = 0)) / 3) AS slope, r6(min(v)) AS min_ratio FROM p GROUP BY night_record_id, start_idx""")
def _(L):
    return L.raw_events.select(KEY, "start_idx", *[c.alias(n) for n, c in S.partial_curve(F.col("spo2_curve"), 4).items()])


@query("early_score_lookback", """SELECT w.night_record_id, w.window_idx, r6(coalesce(avg(e.score), 0)) AS early_score_mean, r6(coalesce(max(e.score), 0)) AS early_score_max,
  count(*) FILTER (WHERE e.score >= 0.5) AS early_severe_count FROM sts w LEFT JOIN evs e ON e.night_record_id = w.night_record_id
  AND e.ts_start >= w.t_end - to_seconds(20) AND e.ts_start <= w.t_end - to_seconds(3) GROUP BY w.night_record_id, w.window_idx""")
def _(L):
    return S.scores_before(small_windows(L), scored(L), [KEY, "window_idx"], 20.0, 3.0, 0.5)


_NEAR = f"e.night_record_id = w.night_record_id AND e.ts_start >= w.t_start - to_seconds({P.match_s}) AND e.ts_start <= w.t_end + to_seconds({P.match_s})"


@query("drop_signal", f"SELECT w.night_record_id, w.window_idx, EXISTS (SELECT 1 FROM evs e WHERE {_NEAR}) AS has_drop_signal FROM sts w")
def _(L):
    return S.earliest_event_near(small_windows(L), scored(L), [KEY, "window_idx"], float(L.p.match_s)).select(
        KEY, "window_idx", F.col("has_drop").alias("has_drop_signal"))


@query("window_event_match", f"""SELECT w.night_record_id, w.window_idx, count(e.start_idx) > 0 AS has_drop, coalesce(arg_min(e.is_severe, e.start_idx), false) AS drop_is_severe,
  r6(arg_min(e.score, e.start_idx)) AS early_score FROM sts w LEFT JOIN evs e ON {_NEAR} GROUP BY w.night_record_id, w.window_idx""")
def _(L):
    return S.earliest_event_near(small_windows(L), scored(L), [KEY, "window_idx"], float(L.p.match_s))


_LEAD = """lead AS (SELECT w.night_record_id, w.window_idx, min(epoch(e.ts_start) - epoch(w.t_end)) AS lead_s FROM sts w JOIN evs e ON e.night_record_id = w.night_record_id
  AND e.is_severe AND e.ts_start >= w.t_end AND e.ts_start <= w.t_end + to_seconds(20) GROUP BY w.night_record_id, w.window_idx)"""


@query("lead_time_to_next", f"WITH {_LEAD} SELECT night_record_id, window_idx, r6(lead_s) AS lead_s FROM lead")
def _(L):
    w = small_windows(L).select(KEY, "window_idx", "t_end")
    lead = S.next_event_lead(w, scored(L).filter("is_severe").select(KEY, "ts_start"), [KEY, "window_idx"], strict=False)
    return lead.filter(F.col("lead_s") <= 20).select(KEY, "window_idx", "lead_s")


@query("lead_time_percentiles", f"WITH {_LEAD} SELECT " + ", ".join(f"r6(quantile_cont(lead_s, {p})) AS lead_s_{n}" for n, p in (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75))) + " FROM lead")
def _(L):
    w = small_windows(L).select(KEY, "window_idx", "t_end")
    lead = S.next_event_lead(w, scored(L).filter("is_severe").select(KEY, "ts_start"), [KEY, "window_idx"], strict=False)
    return exact_percentiles(lead.filter(F.col("lead_s") <= 20), [], ["lead_s"], {"p10": .1, "p25": .25, "p50": .5, "p75": .75})


@query("transition_pairs", """SELECT night_record_id, scale, window_idx, state_label, state_next FROM (SELECT *, lead(state_label) OVER (PARTITION BY night_record_id, scale ORDER BY window_idx) AS state_next
  FROM st WHERE state_label IS NOT NULL) WHERE state_next IS NOT NULL""")
def _(L):
    return S.transition_pairs(L.states, L.layout).select(KEY, "scale", "window_idx", "state_label", "state_next")


@query("mean_curve_profile", """SELECT e.morphotype, p.point, r6(avg(p.spo2)) AS mean, r6(quantile_cont(p.spo2, 0.1)) AS p10, r6(quantile_cont(p.spo2, 0.25)) AS p25,
  r6(quantile_cont(p.spo2, 0.75)) AS p75, r6(quantile_cont(p.spo2, 0.9)) AS p90 FROM curvepts p JOIN ev e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx
  WHERE e.morphotype IS NOT NULL GROUP BY e.morphotype, p.point""")
def _(L):
    pts = L.events.filter("morphotype is not null").select("morphotype", F.posexplode("spo2_curve").alias("point", "v"))
    q = exact_percentiles(pts, ["morphotype", "point"], ["v"], {"p10": .1, "p25": .25, "p75": .75, "p90": .9})
    mean = pts.groupBy("morphotype", "point").agg(F.avg("v").alias("mean"))
    return mean.join(q, ["morphotype", "point"]).select(
        "morphotype", "point", "mean", *[F.col(f"v_{n}").alias(n) for n in ("p10", "p25", "p75", "p90")])


@query("lag_lead", """SELECT night_record_id, start_idx, lag(state_m) OVER w AS prev_state_m, lead(state_m) OVER w AS next_state_m FROM evs WINDOW w AS (PARTITION BY night_record_id ORDER BY start_idx)""")
def _(L):
    return S.neighbours(L.event_states.select(KEY, "start_idx", "state_m"), L.layout, ["state_m"]).drop("state_m")


@query("row_ordinal", "SELECT night_record_id, start_idx, row_number() OVER (PARTITION BY night_record_id ORDER BY start_idx) AS event_order FROM det")
def _(L):
    from nightspark.operators.ordering import order_rows

    n = order_rows(L.raw_events.select(KEY, "start_idx"), [KEY], ["start_idx"], out="event_order")
    return n.withColumn("event_order", F.col("event_order") + 1)


@query("event_states_multiscale", f"""SELECT night_record_id, start_idx, {', '.join(f'state_{s}, CAST(window_idx_{s} AS DOUBLE) AS window_idx_{s}, r6(dist_{s}) AS dist_{s}' for s in C.STATE_K)} FROM evs""")
def _(L):
    cols = [c for s in C.STATE_K for c in (F.col(f"state_{s}"), F.col(f"window_idx_{s}").cast("double").alias(f"window_idx_{s}"), F.col(f"dist_{s}"))]
    return L.event_states.select(KEY, "start_idx", *cols)


@query("asof_backward", " UNION ALL ".join(f"SELECT night_record_id, start_idx, '{s}' AS scale, CASE WHEN state_{s} IS NOT NULL OR window_idx_{s} IS NOT NULL THEN state_{s} END AS state_label FROM evs" for s in C.STATE_K))
def _(L):
    """State of the last window of each scale that began before an event and had not ended."""
    out = None
    events = L.raw_events.select(KEY, "start_idx", "ts_start")
    for scale in C.STATE_K:
        w = L.states.filter(F.col("scale") == scale).select(KEY, "t_start", "t_end", "state_label")
        one = asof_join(events, w, KEY, "ts_start", "t_start", ["t_end", "state_label"], ["start_idx"])
        one = one.select(KEY, "start_idx", F.lit(scale).alias("scale"), F.when(F.col("t_end") > F.col("ts_start"), F.col("state_label")).alias("state_label"))
        out = one if out is None else out.union(one)
    return out


@query("interval_containment", """SELECT e.night_record_id, e.start_idx, w.scale, w.window_idx FROM det e JOIN st w ON w.night_record_id = e.night_record_id AND e.ts_start >= w.t_start AND e.ts_start < w.t_end""")
def _(L):
    e = L.raw_events.select(KEY, "start_idx", epoch(F.col("ts_start")).alias("_ts"))
    w = L.states.select(KEY, "scale", "window_idx", epoch(F.col("t_start")).alias("_a"), epoch(F.col("t_end")).alias("_b"))
    return interval_join(e, w, [KEY], F.col("_ts"), F.col("_a"), F.col("_b"), 45.0).select(KEY, "start_idx", "scale", "window_idx")


@query("closed_interval_lookup", """SELECT e.night_record_id, e.start_idx, min(w.window_idx) AS window_idx, arg_min(w.state_label, w.window_idx) AS state_label FROM det e JOIN sts w ON w.night_record_id = e.night_record_id
  AND e.ts_start >= w.t_start AND e.ts_start <= w.t_end GROUP BY e.night_record_id, e.start_idx""")
def _(L):
    e = L.raw_events.select(KEY, "start_idx", epoch(F.col("ts_start")).alias("_ts"))
    w = small_windows(L).select(KEY, "window_idx", "state_label", epoch(F.col("t_start")).alias("_a"), epoch(F.col("t_end")).alias("_b"))
    hit = interval_join(e, w, [KEY], F.col("_ts"), F.col("_a"), F.col("_b"), 30.0, "both")
    return first_labelled(hit, [KEY, "start_idx"], "window_idx", "state_label")


@query("interval_overlap", f"""SELECT e.night_record_id, e.start_idx, CAST(epoch(g.gap_start) AS BIGINT) AS gap_start FROM det e JOIN gaps g ON g.night_record_id = e.night_record_id
  AND e.ts_start <= g.gap_end + to_seconds({P.near_gap_s}) AND e.ts_end >= g.gap_start - to_seconds({P.near_gap_s})""")
def _(L):
    from nightspark.operators.intervals import overlap_pairs
    from nightspark.operators.qc import signal_gaps

    e = L.raw_events.select(KEY, "start_idx", "ts_start", "ts_end")
    g = signal_gaps(L.signal, L.layout, L.p.gap_s)
    m = float(L.p.near_gap_s)
    return overlap_pairs(e, g, [KEY], (epoch(F.col("ts_start")), epoch(F.col("ts_end"))),
                         (epoch(F.col("gap_start")) - m, epoch(F.col("gap_end")) + m), 3600.0).select(KEY, "start_idx", "gap_start")


@query("range_count_join", """SELECT w.night_record_id, w.window_idx, count(e.start_idx) AS n_ahead FROM sts w LEFT JOIN evs e ON e.night_record_id = w.night_record_id
  AND e.ts_start > w.t_end AND e.ts_start <= w.t_end + to_seconds(20) GROUP BY w.night_record_id, w.window_idx""")
def _(L):
    e = L.raw_events.select(KEY, epoch(F.col("ts_start")).alias("_ts"))
    w = small_windows(L).select(KEY, "window_idx", epoch(F.col("t_end")).alias("_b"))
    n = interval_join(e, w, [KEY], F.col("_ts"), F.col("_b"), F.col("_b") + 20, 20.0, "right").groupBy(KEY, "window_idx").agg(F.count(F.lit(1)).alias("n_ahead"))
    return small_windows(L).select(KEY, "window_idx").join(n, [KEY, "window_idx"], "left").fillna(0, ["n_ahead"])


def nested(L):
    """Small windows with the label of the larger windows they nest in."""
    big = {s: float(r) for s, r in L.p.window_rows.items()}
    out = small_windows(L)
    for s in ("m", "l"):
        w = L.states.filter(F.col("scale") == s).select(KEY, F.col("window_idx").alias(f"{s}_win_idx"), F.col("state_label").alias(f"state_{s}_label"))
        out = out.withColumn(f"{s}_win_idx", F.floor(F.col("t_start_s") / big[s])).join(w, [KEY, f"{s}_win_idx"], "left")
    return out


@query("scale_nesting", f"""SELECT w.night_record_id, w.window_idx, m.state_label AS state_m_label, l.state_label AS state_l_label FROM sts w
  LEFT JOIN st m ON m.night_record_id = w.night_record_id AND m.scale = 'm' AND m.window_idx = CAST(floor(w.t_start_s / {P.window_rows['m']}) AS BIGINT)
  LEFT JOIN st l ON l.night_record_id = w.night_record_id AND l.scale = 'l' AND l.window_idx = CAST(floor(w.t_start_s / {P.window_rows['l']}) AS BIGINT)""")
def _(L):
    return nested(L).select(KEY, "window_idx", "state_m_label", "state_l_label")


@query("child_windows", """SELECT p.night_record_id, p.window_idx AS parent_idx, c.scale, count(*) AS n_children FROM st p JOIN st c ON c.night_record_id = p.night_record_id AND c.scale IN ('s', 'm')
  AND c.t_start_s >= p.t_start_s AND c.t_start_s < p.t_end_s WHERE p.scale = 'l' GROUP BY p.night_record_id, p.window_idx, c.scale""")
def _(L):
    c = L.states.filter(F.col("scale") != "l").select(KEY, "scale", F.col("t_start_s").alias("_c"))
    p = L.states.filter(F.col("scale") == "l").select(KEY, F.col("window_idx").alias("parent_idx"), F.col("t_start_s").alias("_a"), F.col("t_end_s").alias("_b"))
    hit = interval_join(c, p, [KEY], F.col("_c"), F.col("_a"), F.col("_b"), float(L.p.window_rows["l"]))
    return hit.groupBy(KEY, "parent_idx", "scale").agg(F.count(F.lit(1)).alias("n_children"))

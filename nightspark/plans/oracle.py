"""DuckDB twins of the layers: named CTEs composed on demand."""

from __future__ import annotations

import re

from nightspark import config as C
from nightspark.plans import fixtures as X
from nightspark.sources.adapter import PARAMS as P
from nightspark.sources.adapter import SIGNAL_SQL

_CTE: dict[str, str] = {}


def cte(text: str) -> None:
    name = text.strip().split("(")[0].split(" AS")[0].strip()
    _CTE[name] = text.strip()


def r6(text: str) -> str:
    """Rewrite ``r6(x)`` to ``round(x, 6)``."""
    while "r6(" in text:
        i = text.index("r6(")
        depth, j = 0, i + 2
        while True:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            if depth == 0:
                break
            j += 1
        text = f"{text[:i]}round(CAST({text[i + 3:j]} AS DOUBLE), 6){text[j + 1:]}"
    return text


def sql(body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, in definition order."""
    need: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[A-Za-z_]\w*", todo.pop()))
        for name in words & _CTE.keys() - need:
            need.add(name)
            todo.append(_CTE[name])
    # definition order keeps dependencies first
    parts = [_CTE[n] for n in _CTE if n in need]
    body = body.strip()
    head = ""
    if parts:
        own = body[5:] if body[:5].upper() == "WITH " else None
        head = "WITH RECURSIVE " + ",\n".join(parts) + (",\n" if own else "\n")
        body = own or body
    return r6(head + body)


cte(SIGNAL_SQL)
cte(f"""qcs AS (
  SELECT *, coalesce(spo2 < {C.SPO2_MIN_VALID}, true) AS spo2_invalid,
         CASE WHEN spo2 >= {C.SPO2_MIN_VALID} THEN CAST(spo2 AS DOUBLE) END AS spo2_clean,
         coalesce(hr < {C.HR_MIN_VALID} OR hr > {C.HR_MAX_VALID}, true) AS hr_invalid,
         CASE WHEN hr BETWEEN {C.HR_MIN_VALID} AND {C.HR_MAX_VALID} THEN CAST(hr AS DOUBLE) END AS hr_clean
  FROM sig)""")
cte("""steps AS (
  SELECT *, epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY night_record_id ORDER BY seq)) AS step_s,
         lag(timestamp) OVER (PARTITION BY night_record_id ORDER BY seq) AS prev_ts
  FROM qcs)""")
cte(f"""nqc AS (
  SELECT night_record_id, user_id, patient_id, ts_start, ts_end, n_samples, duration_s, coverage, max_gap AS max_contiguous_gap_s,
         n_expected, n_gaps,
         coverage >= {P.coverage_min} AS qc_coverage_ok, max_gap <= {P.max_gap_s} AS qc_max_gap_ok,
         duration_s < {P.duration_aborted_s} AS qc_duration_aborted, duration_s < {P.duration_min_s} AS qc_duration_short,
         n_spo2_invalid, n_hr_invalid, n_spo2_invalid / n_samples AS frac_spo2_invalid, n_hr_invalid / n_samples AS frac_hr_invalid
  FROM (SELECT *, CASE WHEN n_samples = 1 OR duration_s = 0 THEN 1.0 ELSE n_samples / n_expected END AS coverage
    FROM (SELECT *, CASE WHEN n_samples = 1 OR duration_s = 0 THEN n_samples ELSE CAST(duration_s AS BIGINT) + 1 END AS n_expected
      FROM (SELECT night_record_id, min(user_id) AS user_id, min(patient_id) AS patient_id,
               count(*) AS n_samples, min(timestamp) AS ts_start, max(timestamp) AS ts_end,
               epoch(max(timestamp)) - epoch(min(timestamp)) AS duration_s,
               count(*) FILTER (WHERE step_s > 1.000001) AS n_gaps,
               CAST(coalesce(max(step_s - 1) FILTER (WHERE step_s > 1.000001), 0) AS BIGINT) AS max_gap,
               count(*) FILTER (WHERE spo2_invalid) AS n_spo2_invalid, count(*) FILTER (WHERE hr_invalid) AS n_hr_invalid
            FROM steps GROUP BY night_record_id))))""")
cte(f"""base AS (
  SELECT *, CASE WHEN count(spo2_clean) OVER w >= {P.baseline_min_rows} THEN quantile_cont(spo2_clean, 0.5) OVER w END AS baseline
  FROM qcs WINDOW w AS (PARTITION BY night_record_id ORDER BY seq ROWS BETWEEN {P.baseline_rows - 1} PRECEDING AND CURRENT ROW))""")
cte("""below AS (
  SELECT night_record_id, seq, baseline, coalesce(spo2_clean < baseline, false) AS is_below FROM base)""")
cte("""bruns AS (
  SELECT night_record_id, min(seq) AS run_start, max(seq) AS run_end, arg_min(baseline, seq) AS baseline_spo2
  FROM (SELECT *, sum(CASE WHEN is_below AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY night_record_id ORDER BY seq) AS grp
        FROM (SELECT *, coalesce(lag(is_below) OVER (PARTITION BY night_record_id ORDER BY seq), false) AS was FROM below))
  WHERE is_below GROUP BY night_record_id, grp)""")
cte("""ext AS (
  SELECT r.night_record_id, r.run_start AS start_idx, r.baseline_spo2,
         coalesce(h.hit, greatest(r.run_end, l.last_valid)) AS end_idx
  FROM bruns r
  LEFT JOIN (SELECT r.night_record_id, r.run_start, min(q.seq) AS hit FROM bruns r
             JOIN base q ON q.night_record_id = r.night_record_id AND q.seq > r.run_end
                        AND q.spo2_clean >= r.baseline_spo2 * 0.9
             GROUP BY r.night_record_id, r.run_start) h
    ON h.night_record_id = r.night_record_id AND h.run_start = r.run_start
  JOIN (SELECT night_record_id, max(seq) AS last_valid FROM base WHERE spo2_clean IS NOT NULL GROUP BY night_record_id) l
    ON l.night_record_id = r.night_record_id)""")
cte(f"""cand AS (
  SELECT * FROM (
    SELECT m.*, (baseline_spo2 - nadir_spo2) / baseline_spo2 * 100.0 AS drop_pct, epoch(ts_end) - epoch(ts_start) AS duration_s,
           n.nadir_idx, n.ts_nadir
    FROM (SELECT e.night_record_id, e.start_idx, e.end_idx, e.baseline_spo2, min(q.spo2_clean) AS nadir_spo2,
                 min(q.timestamp) AS ts_start, max(q.timestamp) AS ts_end
          FROM ext e JOIN base q ON q.night_record_id = e.night_record_id AND q.seq BETWEEN e.start_idx AND e.end_idx
          GROUP BY e.night_record_id, e.start_idx, e.end_idx, e.baseline_spo2) m
    JOIN (SELECT e.night_record_id, e.start_idx, arg_min(q.seq, q.spo2_clean * 1000000 + q.seq) AS nadir_idx,
                 arg_min(q.timestamp, q.spo2_clean * 1000000 + q.seq) AS ts_nadir
          FROM ext e JOIN base q ON q.night_record_id = e.night_record_id AND q.seq BETWEEN e.start_idx AND e.end_idx
          WHERE q.spo2_clean IS NOT NULL GROUP BY e.night_record_id, e.start_idx) n
      ON n.night_record_id = m.night_record_id AND n.start_idx = m.start_idx)
  WHERE drop_pct >= {C.MIN_DROP_PCT} AND duration_s >= {P.min_event_s})""")
cte("""cord AS (
  SELECT *, row_number() OVER (PARTITION BY night_record_id ORDER BY start_idx) AS rn FROM cand)""")
cte("""keep AS (
  SELECT night_record_id, rn, end_idx AS reach, true AS kept FROM cord WHERE rn = 1
  UNION ALL
  SELECT o.night_record_id, o.rn, CASE WHEN o.start_idx > k.reach THEN o.end_idx ELSE k.reach END, o.start_idx > k.reach
  FROM keep k JOIN cord o ON o.night_record_id = k.night_record_id AND o.rn = k.rn + 1)""")
cte("""det AS (
  SELECT c.* FROM cord c JOIN keep k ON k.night_record_id = c.night_record_id AND k.rn = c.rn WHERE k.kept)""")
cte(f"""gaps AS (
  SELECT night_record_id, prev_ts AS gap_start, timestamp AS gap_end, step_s AS gap_s FROM steps WHERE step_s >= {P.gap_s})""")
cte(f"""traits AS (
  SELECT d.night_record_id, d.start_idx,
         arg_max(q.spo2_clean, q.seq) FILTER (WHERE q.seq >= d.start_idx AND q.spo2_clean IS NOT NULL) AS last_v,
         sum(greatest(d.baseline_spo2 - coalesce(q.spo2_clean, d.baseline_spo2), 0)) FILTER (WHERE q.seq >= d.start_idx)
           - 0.5 * sum(greatest(d.baseline_spo2 - coalesce(q.spo2_clean, d.baseline_spo2), 0))
               FILTER (WHERE q.seq IN (d.start_idx, d.end_idx))
             * (CASE WHEN max(d.start_idx) = max(d.end_idx) THEN 2 ELSE 1 END) AS auc_spo2_pct_s,
         quantile_cont(q.hr_clean, 0.5) FILTER (WHERE q.seq < d.start_idx) AS baseline_hr_bpm,
         coalesce(quantile_cont(CAST(q.mov AS DOUBLE), 0.5) FILTER (WHERE q.seq < d.start_idx), 0) AS baseline_mov,
         max(q.hr_clean) FILTER (WHERE q.seq >= d.start_idx) AS max_hr,
         coalesce(max(CAST(q.mov AS DOUBLE)) FILTER (WHERE q.seq >= d.start_idx), 0) AS peak_mov,
         avg(CASE WHEN q.sleep_stage = 0 THEN 0.0 ELSE 1.0 END) FILTER (WHERE q.seq >= d.start_idx) AS asleep
  FROM det d JOIN base q ON q.night_record_id = d.night_record_id AND q.seq BETWEEN d.start_idx - {P.context_rows} AND d.end_idx
  GROUP BY d.night_record_id, d.start_idx)""")
cte(f"""evr AS (
  SELECT *, {C.IRD_WEIGHTS['spo2']} * ird_spo2_comp + {C.IRD_WEIGHTS['hr']} * ird_hr_comp + {C.IRD_WEIGHTS['mov']} * ird_mov_comp AS ird_event
  FROM (SELECT *, CASE WHEN abs(baseline_spo2) < 1e-6 THEN 0.0 ELSE drop_pct / baseline_spo2 END AS ird_spo2_comp,
           coalesce(CASE WHEN abs(coalesce(baseline_hr_bpm, 0)) < 1e-6 THEN 0.0 ELSE delta_hr_bpm / baseline_hr_bpm END, 0.0) AS ird_hr_comp,
           CASE WHEN abs(baseline_mov + 0.01) < 1e-6 THEN 0.0 ELSE (peak_mov - baseline_mov) / (baseline_mov + 0.01) END AS ird_mov_comp
    FROM (SELECT d.night_record_id, d.start_idx, d.end_idx, d.nadir_idx, d.ts_start, d.ts_end, d.duration_s, d.baseline_spo2, d.nadir_spo2, d.drop_pct,
           CASE WHEN epoch(ts_nadir) > epoch(ts_start) THEN (d.baseline_spo2 - d.nadir_spo2) / (epoch(ts_nadir) - epoch(ts_start)) ELSE 0.0 END AS slope_desat_pct_s,
           CASE WHEN epoch(ts_end) > epoch(ts_nadir) THEN (t.last_v - d.nadir_spo2) / (epoch(ts_end) - epoch(ts_nadir)) ELSE 0.0 END AS slope_recov_pct_s,
           t.auc_spo2_pct_s, coalesce(t.max_hr - t.baseline_hr_bpm, 0.0) AS delta_hr_bpm, t.baseline_hr_bpm, t.peak_mov, t.baseline_mov,
           t.asleep > 0.5 AS in_sleep,
           EXISTS (SELECT 1 FROM gaps g WHERE g.night_record_id = d.night_record_id
                   AND d.ts_start <= g.gap_end + to_seconds({P.near_gap_s}) AND d.ts_end >= g.gap_start - to_seconds({P.near_gap_s})) AS near_gap,
           d.drop_pct >= 2 AS meets_2pct, d.drop_pct >= 3 AS meets_3pct, d.drop_pct >= 4 AS meets_4pct, d.drop_pct >= 5 AS meets_5pct
          FROM det d JOIN traits t ON t.night_record_id = d.night_record_id AND t.start_idx = d.start_idx)))""")


def _squares(exprs: list[str], centroid) -> str:
    return "sqrt(" + " + ".join(f"({e} - ({float(c)})) * ({e} - ({float(c)}))" for e, c in zip(exprs, centroid)) + ")"


def nearest_sql(source: str, z: list[str], centroids, labels, out: str, dist: str, keep: str = "*") -> str:
    """Nearest-centroid SELECT; -1 / null label / null distance if a feature is null."""
    d = ", ".join(f"{_squares(z, c)} AS d{k}" for k, c in enumerate(centroids))
    names = [f"d{k}" for k in range(len(centroids))]
    pick = " ".join(f"WHEN {n} = near THEN {k}" for k, n in enumerate(names))
    lab = " ".join(f"WHEN {n} = near THEN '{labels[k]}'" for k, n in enumerate(names))
    return f"""SELECT * EXCLUDE (near, {', '.join(names)}), CAST(CASE WHEN near IS NULL THEN -1 {pick} END AS BIGINT) AS {out}_int,
      CASE WHEN near IS NULL THEN NULL {lab} END AS {out}, near AS {dist}
      FROM (SELECT *, CASE WHEN {' AND '.join(f'({n}) IS NOT NULL' for n in names)} THEN least({', '.join(names)}) END AS near
            FROM (SELECT {keep}, {d} FROM {source}))"""


def _z(features, alias: str = "z") -> list[str]:
    return [f"((CAST({f} AS DOUBLE) - {alias}.m_{f}) / {alias}.s_{f})" for f in features]


def _zfit(features, source: str, where: str, extra: str = "", group: str = "") -> str:
    whole = " AND ".join(f"{f} IS NOT NULL" for f in features)
    cols = ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) IS NULL OR stddev_pop({f}) < 1e-12 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
        for f in features)
    return f"SELECT {extra}{cols} FROM {source} WHERE {where} AND {whole}{group}"


cte(f"""mz AS ({_zfit(C.EVENT_FEATURES, 'evr', 'in_sleep AND NOT near_gap AND meets_3pct')})""")
cte(f"""evm AS ({nearest_sql('evr CROSS JOIN mz z', _z(C.EVENT_FEATURES), X.MORPH_CENTROIDS, X.MORPH_LABELS, 'morphotype', 'morphotype_dist', 'evr.*')})""")
cte("""evrows AS (
  SELECT d.night_record_id, d.start_idx, d.end_idx, d.end_idx - d.start_idx + 1 AS n, q.seq - d.start_idx AS pos,
         q.spo2_clean AS v, q.hr_clean AS h, CAST(q.mov AS DOUBLE) AS m
  FROM det d JOIN base q ON q.night_record_id = d.night_record_id AND q.seq BETWEEN d.start_idx AND d.end_idx)""")
cte("""evfill AS (
  SELECT night_record_id, start_idx, n, pos,
         coalesce(last_value(v IGNORE NULLS) OVER a, first_value(v IGNORE NULLS) OVER b) AS v,
         coalesce(last_value(h IGNORE NULLS) OVER a, first_value(h IGNORE NULLS) OVER b) AS h,
         coalesce(last_value(m IGNORE NULLS) OVER a, first_value(m IGNORE NULLS) OVER b) AS m
  FROM evrows
  WINDOW a AS (PARTITION BY night_record_id, start_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY night_record_id, start_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
cte("""curvepts AS (
  SELECT g.night_record_id, g.start_idx, g.i AS point,
         lo.v + (hi.v - lo.v) * (x - lo.pos) AS spo2, lo.h + (hi.h - lo.h) * (x - lo.pos) AS hr, lo.m + (hi.m - lo.m) * (x - lo.pos) AS mov
  FROM (SELECT night_record_id, start_idx, n, i, CAST(i AS DOUBLE) * (n - 1) / 29.0 AS x
        FROM (SELECT DISTINCT night_record_id, start_idx, n FROM evrows), range(30) t(i)) g
  JOIN evfill lo ON lo.night_record_id = g.night_record_id AND lo.start_idx = g.start_idx AND lo.pos = least(CAST(floor(g.x) AS BIGINT), g.n - 1)
  JOIN evfill hi ON hi.night_record_id = g.night_record_id AND hi.start_idx = g.start_idx AND hi.pos = least(least(CAST(floor(g.x) AS BIGINT), g.n - 1) + 1, g.n - 1))""")
cte("""curvec(k, point, c) AS (VALUES """ + ", ".join(
    f"({k}, {i}, CAST({v} AS DOUBLE))" for k, row in enumerate(X.CURVE_CENTROIDS) for i, v in enumerate(row)) + ")")
cte(f"""curvelab AS (
  SELECT night_record_id, start_idx, 'C' || (arg_min(k, round(d, 9) * 100 + k) + 1) AS morphotype_curve, min(d) AS curve_dist
  FROM (SELECT p.night_record_id, p.start_idx, c.k, sqrt(sum((p.spo2 - e.baseline_spo2 - c.c) * (p.spo2 - e.baseline_spo2 - c.c))) AS d
        FROM curvepts p JOIN evr e ON e.night_record_id = p.night_record_id AND e.start_idx = p.start_idx
        JOIN curvec c ON c.point = p.point
        WHERE e.duration_s <= {P.curve_max_s}
        GROUP BY p.night_record_id, p.start_idx, c.k HAVING count(p.spo2) = 30) GROUP BY night_record_id, start_idx)""")
cte("""ev AS (
  SELECT e.*, l.morphotype_curve, l.curve_dist, CAST(substr(e.night_record_id, 4) AS BIGINT) AS user_id,
         CAST(substr(e.night_record_id, 4) AS BIGINT) % 12 AS patient_id
  FROM evm e LEFT JOIN curvelab l ON l.night_record_id = e.night_record_id AND l.start_idx = e.start_idx)""")
cte("scales(scale, size) AS (VALUES " + ", ".join(f"('{s}', {r})" for s, r in P.window_rows.items()) + ")")


def _six(col: str, prefix: str, stats=("mean", "std", "min", "max", "p10", "p90")) -> str:
    f = {"mean": "avg({})", "std": "stddev_pop({})", "min": "min({})", "max": "max({})",
         "p10": "quantile_cont({}, 0.1)", "p90": "quantile_cont({}, 0.9)"}
    return ", ".join(f[s].format(col) + f" AS {prefix}_{s}" for s in stats)


cte(f"""wbase AS (
  SELECT * FROM (
    SELECT night_record_id, scale, seq // size AS window_idx, min(timestamp) AS t_start,
           min(timestamp) + to_seconds(max(size)) AS t_end, count(*) AS n_samples_raw,
           count(spo2_clean) / max(size) AS coverage, count(*) < max(size) AS is_tail,
           {_six('spo2_clean', 'spo2')}, {_six('hr_clean', 'hr')}, {_six('CAST(mov AS DOUBLE)', 'mov', ('mean', 'std', 'max'))},
           avg(CASE WHEN sleep_stage = 0 THEN 1.0 ELSE 0.0 END) AS frac_wake,
           avg(CASE WHEN sleep_stage IN (1, 2) THEN 1.0 ELSE 0.0 END) AS frac_light_sleep,
           avg(CASE WHEN sleep_stage = 3 THEN 1.0 ELSE 0.0 END) AS frac_deep_sleep
    FROM qcs CROSS JOIN scales GROUP BY night_record_id, scale, seq // size)
  WHERE NOT is_tail OR coverage >= {P.tail_coverage_min})""")
cte("""wdens AS (
  SELECT w.night_record_id, w.scale, w.window_idx, count(*) AS n_edos_total,
         count(*) FILTER (WHERE e.morphotype = 'α') AS n_alpha, count(*) FILTER (WHERE e.morphotype = 'β') AS n_beta,
         count(*) FILTER (WHERE e.morphotype = 'γ') AS n_gamma, count(*) FILTER (WHERE e.morphotype = 'δ') AS n_delta,
         avg(e.ird_event) AS ird_mean_local
  FROM wbase w JOIN evm e ON e.night_record_id = w.night_record_id AND e.ts_start >= w.t_start AND e.ts_start < w.t_end
  GROUP BY w.night_record_id, w.scale, w.window_idx)""")
cte("""win AS (
  SELECT w.*, coalesce(d.n_edos_total, 0) AS n_edos_total, coalesce(d.n_alpha, 0) AS n_alpha, coalesce(d.n_beta, 0) AS n_beta,
         coalesce(d.n_gamma, 0) AS n_gamma, coalesce(d.n_delta, 0) AS n_delta, coalesce(d.ird_mean_local, 0.0) AS ird_mean_local
  FROM wbase w LEFT JOIN wdens d ON d.night_record_id = w.night_record_id AND d.scale = w.scale AND d.window_idx = w.window_idx)""")
for _s in C.STATE_K:
    cte(f"""z_{_s} AS ({_zfit(C.WINDOW_FEATURES, 'win', f"scale = '{_s}' AND frac_wake <= 0.5 AND coverage >= 0.5")})""")
    cte(f"""st_{_s} AS ({nearest_sql(f"(SELECT * FROM win WHERE scale = '{_s}') w CROSS JOIN z_{_s} z", _z(C.WINDOW_FEATURES), X.STATE_CENTROIDS[_s], X.STATE_LABELS[_s], 'cluster', 'dist_to_centroid', 'w.*')})""")
cte("""st AS (
  SELECT w.night_record_id, n.user_id, n.patient_id, w.scale, w.window_idx, w.t_start, w.t_end,
         epoch(w.t_start) - epoch(n.ts_start) AS t_start_s, epoch(w.t_end) - epoch(n.ts_start) AS t_end_s,
         w.cluster AS state_label, w.cluster_int, w.dist_to_centroid, w.coverage, w.frac_wake, w.frac_light_sleep, w.frac_deep_sleep,
         coalesce(w.frac_wake <= 0.5 AND w.coverage >= 0.5, false) AS training_eligible
  FROM (SELECT * FROM st_s UNION ALL SELECT * FROM st_m UNION ALL SELECT * FROM st_l) w
  JOIN nqc n ON n.night_record_id = w.night_record_id)""")
cte(f"""nsamp AS (
  SELECT n.night_record_id, n.user_id, n.patient_id, n.duration_s,
         CASE WHEN a.staged = 0 THEN n.duration_s ELSE CAST(a.sleep AS DOUBLE) END AS tst_s,
         CASE WHEN a.staged = 0 OR a.onset IS NULL THEN 0.0 ELSE CAST(a.waso AS DOUBLE) END AS waso_s,
         CASE WHEN n.duration_s <= 0 THEN 0.0 WHEN a.staged = 0 THEN 1.0 ELSE a.sleep / n.duration_s END AS sleep_efficiency,
         CASE WHEN a.staged = 0 THEN 0.0 ELSE coalesce(CAST(a.onset AS DOUBLE), n.duration_s) END AS sleep_latency_s,
         CASE WHEN a.staged < 2 THEN 0 ELSE coalesce(s.shifts, 0) END AS n_stage_shifts,
         a.* EXCLUDE (night_record_id, staged, sleep, onset, waso, hb90, hb88),
         CASE WHEN n.duration_s > 0 THEN a.hb90 / 60.0 * 3600.0 / n.duration_s ELSE 0.0 END AS hypoxic_burden_90,
         CASE WHEN n.duration_s > 0 THEN a.hb88 / 60.0 * 3600.0 / n.duration_s ELSE 0.0 END AS hypoxic_burden_88
  FROM nqc n JOIN (
    SELECT q.night_record_id, count(q.sleep_stage) AS staged, count(*) FILTER (WHERE q.sleep_stage <> 0) AS sleep, min(o.onset) AS onset,
           count(*) FILTER (WHERE q.sleep_stage = 0 AND q.seq >= o.onset) AS waso,
           avg(spo2_clean) AS mean_spo2, quantile_cont(spo2_clean, 0.5) AS median_spo2, min(spo2_clean) AS min_spo2, stddev_pop(spo2_clean) AS std_spo2,
           avg(hr_clean) AS mean_hr, quantile_cont(hr_clean, 0.5) AS median_hr, min(hr_clean) AS min_hr, max(hr_clean) AS max_hr, stddev_pop(hr_clean) AS std_hr,
           avg(CAST(mov AS DOUBLE)) AS mean_mov, quantile_cont(CAST(mov AS DOUBLE), 0.5) AS median_mov,
           {', '.join(f"coalesce(avg(CASE WHEN spo2_clean < {t} THEN 1.0 WHEN spo2_clean IS NOT NULL THEN 0.0 END), 0.0) AS t{t}_frac, count(*) FILTER (WHERE spo2_clean < {t}) / 60.0 AS ct{t}_min" for t in C.T_UNDER_THRESHOLDS)},
           sum(greatest(90 - coalesce(spo2_clean, 90), 0)) - 0.5 * coalesce(sum(greatest(90 - coalesce(spo2_clean, 90), 0)) FILTER (WHERE q.seq IN (0, o.last)), 0) AS hb90,
           sum(greatest(88 - coalesce(spo2_clean, 88), 0)) - 0.5 * coalesce(sum(greatest(88 - coalesce(spo2_clean, 88), 0)) FILTER (WHERE q.seq IN (0, o.last)), 0) AS hb88
    FROM qcs q JOIN (SELECT night_record_id, max(seq) AS last, min(seq) FILTER (WHERE sleep_stage <> 0) AS onset FROM qcs GROUP BY night_record_id) o
      ON o.night_record_id = q.night_record_id GROUP BY q.night_record_id) a ON a.night_record_id = n.night_record_id
  LEFT JOIN (SELECT night_record_id, count(*) FILTER (WHERE p <> sleep_stage) AS shifts
             FROM (SELECT *, lag(sleep_stage) OVER (PARTITION BY night_record_id ORDER BY seq) AS p FROM qcs WHERE sleep_stage IS NOT NULL)
             GROUP BY night_record_id) s ON s.night_record_id = n.night_record_id)""")


def runs_sql(value: str, source: str = "qcs") -> str:
    """Maximal runs of a non-null expression: start, end, length, value."""
    return f"""SELECT night_record_id, run_value, min(seq) AS run_start, max(seq) AS run_end, count(*) AS run_rows
      FROM (SELECT *, sum(CASE WHEN run_value = was THEN 0 ELSE 1 END) OVER (PARTITION BY night_record_id ORDER BY seq) AS grp
            FROM (SELECT *, lag(run_value) OVER (PARTITION BY night_record_id ORDER BY seq) AS was
                  FROM (SELECT night_record_id, seq, {value} AS run_value FROM {source})))
      GROUP BY night_record_id, run_value, grp"""


cte(f"""hrruns AS ({runs_sql("CASE WHEN hr_clean < 50 THEN 'slow' WHEN hr_clean > 100 THEN 'fast' ELSE 'none' END")})""")
cte(f"""hrx AS (
  SELECT night_record_id, count(*) FILTER (WHERE run_value = 'slow' AND run_rows >= {P.sustained_rows}) AS n_brady_episodes,
         count(*) FILTER (WHERE run_value = 'fast' AND run_rows >= {P.sustained_rows}) AS n_tachy_episodes
  FROM hrruns GROUP BY night_record_id)""")
cte(f"""movruns AS ({runs_sql('coalesce(mov > lvl, false)', '(SELECT q.*, greatest(3.0 * n.median_mov, 0.03) AS lvl FROM qcs q JOIN nsamp n ON n.night_record_id = q.night_record_id)')})""")
cte(f"""movx AS (
  SELECT n.night_record_id, CASE WHEN n.duration_s > 0 THEN count(*) FILTER (WHERE r.run_value AND r.run_rows >= {P.movement_rows}) * 3600.0 / n.duration_s ELSE 0.0 END AS movement_index_per_h
  FROM nsamp n JOIN movruns r ON r.night_record_id = n.night_record_id GROUP BY n.night_record_id, n.duration_s)""")
cte("""evx AS (
  SELECT night_record_id, count(*) AS n_edos_total, avg(drop_pct) AS mean_drop_pct, avg(duration_s) AS mean_duration_s_per_edo,
         max(duration_s) AS max_duration_s_per_edo, sum(ird_event * duration_s) AS ird_load, avg(ird_event) AS mean_ird_event,
         quantile_cont(ird_event, 0.9) AS p90_ird_event, avg(delta_hr_bpm) AS mean_delta_hr_per_edo,
         quantile_cont(delta_hr_bpm, 0.9) AS p90_delta_hr_per_edo, """ + ", ".join(
    f"count(*) FILTER (WHERE meets_{t}pct) AS n{t}, count(*) FILTER (WHERE meets_{t}pct AND in_sleep) AS s{t}" for t in C.DROP_THRESHOLDS_PCT) + """
  FROM evr GROUP BY night_record_id)""")
_rates = ", ".join(
    f"coalesce(x.n{t}, 0) AS n_edos_{t}pct, CASE WHEN n.tst_s > 0 THEN coalesce(x.n{t}, 0) * 3600.0 / n.tst_s ELSE 0.0 END AS odi_{t}, "
    f"CASE WHEN n.tst_s > 0 THEN coalesce(x.s{t}, 0) * 3600.0 / n.tst_s ELSE 0.0 END AS ahi_{t}" for t in C.DROP_THRESHOLDS_PCT)
cte(f"""nidx0 AS (
  SELECT n.* EXCLUDE (median_mov), h.n_brady_episodes, h.n_tachy_episodes, m.movement_index_per_h, coalesce(x.n_edos_total, 0) AS n_edos_total,
         x.mean_drop_pct, x.mean_duration_s_per_edo, x.max_duration_s_per_edo, x.mean_ird_event, x.p90_ird_event,
         x.mean_delta_hr_per_edo, x.p90_delta_hr_per_edo,
         CASE WHEN n.tst_s > 0 THEN coalesce(x.ird_load, 0.0) / n.tst_s ELSE 0.0 END AS ird_night, {_rates}
  FROM nsamp n LEFT JOIN hrx h ON h.night_record_id = n.night_record_id LEFT JOIN movx m ON m.night_record_id = n.night_record_id
  LEFT JOIN evx x ON x.night_record_id = n.night_record_id)""")
_src = {"hypoxic_burden_3": "hypoxic_burden_90", "hypoxic_burden_4": "hypoxic_burden_88"}
cte("""nidx1 AS (
  SELECT *, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 0.0 ELSE 1 + (user_id % 7 - 3) / 10.0 END AS fac FROM nidx0)""")
cte("nidx AS (SELECT * EXCLUDE (fac), " + ", ".join(
    f"CAST({_src.get(i, i)} AS DOUBLE) AS {i}_ours, {_src.get(i, i)} * fac AS {i}_device, abs({_src.get(i, i)} - {_src.get(i, i)} * fac) AS {i}_diff_abs, "
    f"CASE WHEN fac IS NULL THEN NULL WHEN abs({_src.get(i, i)} * fac) < 1e-9 THEN CASE WHEN abs({_src.get(i, i)} - {_src.get(i, i)} * fac) > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END "
    f"ELSE ({_src.get(i, i)} - {_src.get(i, i)} * fac) / ({_src.get(i, i)} * fac) END AS {i}_diff_rel, "
    f"CASE WHEN fac IS NULL OR abs({_src.get(i, i)} * fac) < 1e-9 THEN false ELSE abs(({_src.get(i, i)} - {_src.get(i, i)} * fac) / ({_src.get(i, i)} * fac)) > {C.DIFF_REL_FLAG} END AS {i}_diff_flag"
    for i in C.VALIDATED_INDICES) + " FROM nidx1)")
cte("""clin AS (
  SELECT c_custkey AS patient_id, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sexo, CAST(60 + c_nationkey AS DOUBLE) AS peso_kg,
         CAST(150 + c_nationkey AS DOUBLE) AS talla_cm, CAST(CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS apnea_prev
  FROM customer WHERE c_acctbal > 0)""")
cte(f"""flg AS (
  SELECT *, in_quality AND NOT flag_for_review AS in_strict, in_quality AND tst_s >= {P.high_tst_s} AS in_high_tst,
         in_quality AND patient_id IN (SELECT patient_id FROM clin) AS with_clinical
  FROM (SELECT night_record_id, user_id, patient_id, tst_s, user_id % 29 = 0 AS b2_fail, user_id % 29 <> 0 AS in_quality,
               user_id % 17 = 0 AS flag_for_review FROM nsamp))""")

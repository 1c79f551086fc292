"""Queries: parsing, labels, masks, sources, sinks, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.functions import scalars as V
from nightspark.operators.ordering import shared_dir
from nightspark.operators.ranks import exact_percentiles, with_scalars
from nightspark.operators.windows import training_events, training_windows
from nightspark.plans.registry import d6, query
from nightspark.plans.series_queries import scored
from nightspark.sources import recordings as R
from nightspark.sources import tables as B
from nightspark.sources.footers import files_under, footers

KEY = "night_record_id"


def fresh_path(L, name: str) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_dir(L.spark)}/{name}-{uuid.uuid4().hex}"
    folder = L.spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(L.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def clock_text(L):
    """Clock text of each event, with a narrow or plain NBSP in it."""
    e = L.table("events").select("event_id", "ts")
    gap = F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, " ").otherwise(" ")
    return e.withColumn("text", F.concat(F.date_format("ts", "h:mm:ss"), gap, F.date_format("ts", "a")))


@query("parse_ampm", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS seconds FROM events")
def _(L):
    return clock_text(L).select("event_id", V.parse_ampm_seconds(F.col("text")).alias("seconds"))


@query("coerce_numeric", "SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 7 = 1 THEN ' ' || value ELSE CAST(value AS VARCHAR) END) AS DOUBLE) AS v FROM events")
def _(L):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 7 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return R.coerce_numeric(L.table("events").select("event_id", raw.alias("v")), ["v"])


@query("parse_datetime_multi", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS DOUBLE) END AS at FROM events")
def _(L):
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).when(
        i == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    e = L.table("events").select("event_id", V.parse_datetime(text, R.START_FORMATS).alias("t"))
    return e.select("event_id", F.unix_seconds(F.col("t").cast("timestamp")).cast("double").alias("at"))


_BD = """(SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 6 AS k FROM orders)"""


@query("parse_birthdate", f"""SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN strftime(TRY_CAST((CASE WHEN k = 1 THEN y - 30 ELSE y END) || '-' || m || '-' || d AS DATE), '%Y-%m-%d')
   WHEN k = 2 THEN strftime(make_date(2000 + d % 26, m, least(d, 28)), '%Y-%m-%d') ELSE NULL END AS born, CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS flag_audit FROM {_BD}""")
def _(L):
    o = L.table("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"), (F.col("o_orderkey") % 6).alias("k"))
    j = lambda *p: F.concat_ws("/", *[x.cast("string") for x in p])
    d, m, y = F.col("d"), F.col("m"), F.col("y")
    two = F.lpad(((y - 30) % 100).cast("string"), 2, "0")
    text = (F.when(F.col("k") == 0, j(d, m, y)).when(F.col("k") == 1, j(d, m, two))
            .when(F.col("k") == 2, j(F.least(d, F.lit(28)), m, F.lpad((d % 26).cast("string"), 2, "0")))
            .when(F.col("k") == 3, j(d, m + 12, y)).when(F.col("k") == 4, "nan").otherwise(j(d, m)))
    date, flag = V.parse_birthdate(text)
    return o.select("o_orderkey", date.cast("string").alias("born"), flag.alias("flag_audit"))


@query("record_id", "SELECT doc_id, 'NR_' || substr(md5(sha256(text) || '|' || '2024-01-01T22:00:00'), 1, 10) AS rid FROM documents")
def _(L):
    return L.table("documents").select("doc_id", V.record_id(F.sha2("text", 256), F.lit("2024-01-01T22:00:00")).alias("rid"))


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(L):
    return L.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("canonical_select", "SELECT night_record_id, user_id, seq, r6(spo2) AS spo2, r6(hr) AS hr, r6(mov) AS mov FROM sig")
def _(L):
    return R.canonical_select(L.signal.select("mov", "hr", "spo2", *[F.col(c) for c in ("sleep_stage", "timestamp", "seq", "user_id", KEY)]).withColumns(
        {c: F.col(c).cast("string") for c in ("spo2", "hr", "mov", "sleep_stage")})).select(KEY, "user_id", "seq", "spo2", "hr", "mov")


@query("collapse_stage", "SELECT CASE WHEN sleep_stage = 0 THEN 'wake' WHEN sleep_stage IN (1, 2) THEN 'light_sleep' WHEN sleep_stage = 3 THEN 'deep_sleep' END AS stage, count(*) AS n FROM sig GROUP BY 1")
def _(L):
    return L.signal.groupBy(V.collapse_stage(F.col("sleep_stage")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("label_maps", """SELECT night_record_id, start_idx, morphotype_curve, CAST(substr(morphotype_curve, 2) AS DOUBLE) AS idx, CASE WHEN morphotype_curve IS NULL THEN NULL WHEN morphotype_curve IN ('C4', 'C5') THEN 'high' ELSE 'low' END AS low_high,
  CASE morphotype_int WHEN 0 THEN 'α' WHEN 1 THEN 'β' WHEN 2 THEN 'γ' WHEN 3 THEN 'δ' END AS greek, CASE WHEN morphotype_int >= 0 THEN 'S' || morphotype_int END AS state_name FROM ev""")
def _(L):
    return L.events.select(KEY, "start_idx", "morphotype_curve", V.index_of(F.col("morphotype_curve")).cast("double").alias("idx"), V.low_high(F.col("morphotype_curve")).alias("low_high"),
                           V.greek_of(F.col("morphotype_int")).alias("greek"), V.label_of("S", F.col("morphotype_int")).alias("state_name"))


@query("bmi", "SELECT patient_id, r6(peso_kg / ((talla_cm / 100.0) * (talla_cm / 100.0))) AS bmi, CAST(CASE WHEN sexo = 'M' THEN 1 ELSE 0 END AS BIGINT) AS sexo_bin FROM clin")
def _(L):
    return L.clinical.select("patient_id", V.bmi(F.col("peso_kg"), F.col("talla_cm")).alias("bmi"), F.when(F.col("sexo") == "M", 1).otherwise(0).alias("sexo_bin"))


def legacy(L):
    """A legacy patient table made of the customers."""
    c, k = L.table("customer"), F.col("c_custkey")
    sex = F.element_at(F.array(*[F.lit(x) for x in ("Masculino", "femenino ", "M", "f", "otro")]), (k % 5 + 1).cast("int"))
    return c.select(
        k.alias("id_paciente"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("apellido"), sex.alias("sexo"),
        F.concat_ws("/", (k % 28 + 1).cast("string"), (k % 12 + 1).cast("string"), F.lit("1970")).alias("fecha_nacimiento"),
        F.when(k % 4 == 0, "nan").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("peso"),
        F.lit("170").alias("talla"), (k % 2).alias("apnea"), F.lit("").alias("diabetes"), F.lit("x").alias("hta"), F.lit("0").alias("marcapasos"))


@query("normalize_sex", "SELECT c_custkey AS patient_id, CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE '' END AS sexo, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS peso_kg FROM customer")
def _(L):
    return legacy(L).select(F.col("id_paciente").alias("patient_id"), V.normalize_sex(F.col("sexo")).alias("sexo"), V.to_int_string(F.col("peso")).alias("peso_kg"))


@query("migrate_legacy_patients", """SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS nombre, strftime(make_date(1970, CAST(c_custkey % 12 + 1 AS INT), CAST(c_custkey % 28 + 1 AS INT)), '%Y-%m-%d') AS fecha_nacimiento, CAST(0 AS BIGINT) AS flag_audit,
  CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'M' WHEN 3 THEN 'F' ELSE '' END AS sexo, '170' AS talla_cm, CAST(c_custkey % 2 AS VARCHAR) AS apnea_prev, '' AS diabetes, '' AS hta FROM customer""")
def _(L):
    registry, clinical = B.migrate_legacy(legacy(L))
    return registry.join(clinical, "patient_id").select("patient_id", "nombre", "fecha_nacimiento", "flag_audit", "sexo", "talla_cm", "apnea_prev", "diabetes", "hta")


@query("training_mask_windows", "SELECT night_record_id, scale, window_idx, coalesce(frac_wake <= 0.5 AND coverage >= 0.5, false) AS eligible FROM win")
def _(L):
    return L.windows.select(KEY, "scale", "window_idx", training_windows(F.col("frac_wake"), F.col("coverage")).alias("eligible"))


@query("training_mask_events", "SELECT night_record_id, start_idx, in_sleep AND NOT near_gap AND meets_3pct AS eligible FROM evr")
def _(L):
    return L.raw_events.select(KEY, "start_idx", training_events(F.col("in_sleep"), F.col("near_gap"), F.col("meets_3pct")).alias("eligible"))


@query("drop_incomplete", "SELECT night_record_id, start_idx FROM evr WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in (*C.EVENT_FEATURES, "baseline_hr_bpm")))
def _(L):
    return L.raw_events.dropna(subset=[*C.EVENT_FEATURES, "baseline_hr_bpm"]).select(KEY, "start_idx")


@query("relative_seconds", "SELECT night_record_id, scale, window_idx, r6(t_start_s) AS t_start_s, r6(t_end_s) AS t_end_s FROM st")
def _(L):
    from nightspark.functions.scalars import seconds_between

    t0 = L.signal.groupBy(KEY).agg(F.min("timestamp").alias("t0"))
    return L.windows.join(t0, KEY).select(KEY, "scale", "window_idx", seconds_between(F.col("t_start"), F.col("t0")).alias("t_start_s"),
                                          seconds_between(F.col("t_end"), F.col("t0")).alias("t_end_s"))


@query("impute_median", "SELECT night_record_id, start_idx, r6(coalesce(baseline_hr_bpm, (SELECT quantile_cont(baseline_hr_bpm, 0.5) FROM evr))) AS baseline_hr_bpm FROM evr")
def _(L):
    e = L.raw_events.select(KEY, "start_idx", "baseline_hr_bpm")
    return with_scalars(e, exact_percentiles(e, [], ["baseline_hr_bpm"], {"m": 0.5})).select(
        KEY, "start_idx", F.coalesce("baseline_hr_bpm", "baseline_hr_bpm_m").alias("baseline_hr_bpm"))


@query("clip_prob", """SELECT night_record_id, start_idx, r6(least(score, (SELECT quantile_cont(score, 0.99) FROM evs))) AS p, r6(least(greatest(duration_s * 50, 0), 600)) AS gap FROM evs""")
def _(L):
    e = scored(L).select(KEY, "start_idx", "score", "duration_s")
    capped = with_scalars(e, exact_percentiles(e, [], ["score"], {"p99": 0.99}))
    return capped.select(KEY, "start_idx", F.least("score", "score_p99").alias("p"), F.least(F.greatest(F.col("duration_s") * 50, F.lit(0.0)), F.lit(600.0)).alias("gap"))


@query("events_analysis", """SELECT night_record_id, user_id, start_idx, r6(drop_pct) AS drop_pct, r6(duration_s) AS duration_s, r6(delta_hr_bpm) AS delta_hr_bpm, r6(ird_event) AS ird_event, morphotype_curve,
  CASE morphotype_curve WHEN 'C1' THEN 'leve' WHEN 'C2' THEN 'leve' WHEN 'C3' THEN 'moderado' WHEN 'C4' THEN 'severo' WHEN 'C5' THEN 'severo' END AS severity_class FROM evs WHERE in_quality""")
def _(L):
    names = {"C1": "leve", "C2": "leve", "C3": "moderado", "C4": "severo", "C5": "severo"}
    to = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return L.event_states.filter("in_quality").select(
        KEY, "user_id", "start_idx", "drop_pct", "duration_s", "delta_hr_bpm", "ird_event", "morphotype_curve", F.try_element_at(to, F.col("morphotype_curve")).alias("severity_class"))


@query("pivot_rename", "SELECT night_record_id, " + ", ".join(f"count(*) FILTER (WHERE morphotype = '{g}') AS n_{n}" for g, n in C.GREEK_NAMES.items()) + " FROM ev GROUP BY night_record_id")
def _(L):
    wide = L.events.groupBy(KEY).pivot("morphotype", list(C.GREEK_NAMES)).agg(F.count(F.lit(1)))
    return wide.select(KEY, *[F.coalesce(F.col(g), F.lit(0)).alias(f"n_{n}") for g, n in C.GREEK_NAMES.items()])


# --- exports: written from the signal, read back through the text source ------


def exported(L) -> str:
    """Write every recording as a three-block export; returns the folder."""
    if "_export" not in L.__dict__:
        path = fresh_path(L, "exports")
        s = L.signal
        q = L.night_qc
        start = F.date_format("ts_start", "yyyy-MM-dd HH:mm:ss")
        head = q.select(KEY, F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("n"), t.alias("value")) for i, t in enumerate((
            F.lit("user_id;time_start"), F.concat_ws(";", F.col("user_id").cast("string"), start), F.lit(""), F.lit("odi_3;tst_s"),
            F.concat_ws(";", F.col("n_samples").cast("string"), F.when(F.col("user_id") % 9 == 0, "-").otherwise("100.5")),
            F.lit(""), F.lit("time;spo2;bpm;acceleration_module;sleep_stage;battery")))])).alias("_h")).select(KEY, "_h.n", "_h.value")
        # every 10th user's file loses its signal block, to exercise the failure path
        broken = F.substring(KEY, 4, 20).cast("long") % 10 == 9
        head = head.filter(~(broken & (F.col("n") > 4)))
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        body = s.filter(~broken).select(KEY, (F.col("seq") + 7).alias("n"), F.concat_ws(
            ";", F.concat(F.date_format("timestamp", "h:mm:ss"), F.lit(" "), F.date_format("timestamp", "a")), text("spo2"), text("hr"), text("mov"), text("sleep_stage"), F.lit("9")).alias("value"))
        lines = head.unionByName(body)
        # one export is one ordered file, so it has one writer
        R.write_exports(lines.withColumnRenamed(KEY, "rec"), path, q.count())
        L.__dict__["_export"] = path
    return L.__dict__["_export"]


def blocks_of(L):
    from nightspark.operators.ordering import stable

    if "_blocks" not in L.__dict__:
        L.__dict__["_blocks"] = stable(R.split_blocks(R.read_lines(L.spark, exported(L)), L.layout))
    return L.__dict__["_blocks"]


def record_of_file():
    return F.regexp_extract("file", r"rec=(NR_\d+)", 1)


@query("ingest_recordings", "SELECT user_id, seq, CAST(epoch(timestamp) AS BIGINT) AS timestamp, r6(spo2) AS spo2, r6(hr) AS hr, r6(mov) AS mov, CAST(sleep_stage AS DOUBLE) AS sleep_stage FROM sig WHERE user_id % 10 <> 9")
def _(L):
    _, _, signals = R.ingest_recordings(L.spark, exported(L), L.layout, ["odi_3", "tst_s"])
    return signals.select(F.col("user_id").cast("long").alias("user_id"), "seq", "timestamp", "spo2", "hr", "mov", F.col("sleep_stage").cast("double").alias("sleep_stage"))


@query("read_device_sidecar", "SELECT night_record_id, r6(n_samples) AS odi_3, CASE WHEN user_id % 9 <> 0 THEN 100.5 END AS tst_s FROM nqc")
def _(L):
    raw = R.block_rows(blocks_of(L), 1, ["odi_3", "tst_s"]).filter("row = 0")
    return R.read_device_sidecar(raw, ["odi_3", "tst_s"]).select(record_of_file().alias(KEY), "odi_3", "tst_s")


@query("scan_headers", "SELECT CAST(user_id AS VARCHAR) AS user_id, night_record_id FROM nqc")
def _(L):
    return R.scan_headers(R.read_headers(L.spark, exported(L))).select("user_id", record_of_file().alias(KEY))


@query("export_fingerprints", "SELECT night_record_id, 1 AS n_files, true AS named FROM nqc")
def _(L):
    """Digests of the written exports, by record: every file has one."""
    prints = R.fingerprints(L.spark, exported(L)).select(record_of_file().alias(KEY), "sha256")
    return prints.groupBy(KEY).agg(F.count_distinct("sha256").alias("n_files"), (F.min(F.length("sha256")) == 64).alias("named"))


@query("ingest_status", """SELECT night_record_id, CASE WHEN user_id % 10 = 9 THEN 'FAIL' WHEN user_id % 17 = 0 THEN 'SKIP_COHORT' ELSE 'OK' END AS status, CASE WHEN user_id % 10 = 9 THEN 'expected 3 blocks, found 2' END AS error FROM nqc""")
def _(L):
    cohort = L.nights_of.filter(F.col("user_id") % 17 != 0).select(F.col("user_id").cast("string").alias("user_id"))
    return R.ingest_status(blocks_of(L), cohort).select(record_of_file().alias(KEY), "status", "error")


@query("identity_csv", "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS nombre, '' AS apellido, '' AS fecha_nacimiento FROM customer")
def _(L):
    path = fresh_path(L, "identity")
    B.write_identity_csv(L.table("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("nombre")), path, B.REGISTRY_COLS)
    return B.read_identity_csv(L.spark, path, B.REGISTRY_COLS)


@query("register_unknown_ids", "SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS nombre FROM customer UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), '' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def _(L):
    registry = B.identity(L.table("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("nombre")), ["patient_id", "nombre"])
    return B.register_unknown_ids(registry, L.table("events").select(F.col("user_id").alias("patient_id")))


@query("rewrite_labelled", f"SELECT night_record_id, start_idx, morphotype, {d6('morphotype_dist')}, 'v2' AS model_version FROM evm")
def _(L):
    path = fresh_path(L, "relabelled")
    B.write_layer(L.events.select(KEY, "start_idx", "morphotype", "morphotype_dist"), path, {"model_version": "v2"})
    return B.read_layer(L.spark, path)


@query("write_layer", "SELECT night_record_id, r6(coverage) AS coverage, 'silver' AS pipeline_stage FROM nqc")
def _(L):
    path = fresh_path(L, "layer")
    B.write_layer(L.night_qc.select(KEY, "coverage"), path, {"pipeline_stage": "silver"})
    return B.read_layer(L.spark, path, "*.parquet", [KEY, "coverage", "pipeline_stage"])


@query("gate_json", """SELECT '{"n_nights":' || count(*) || ',"n_coverage_ok":' || count(*) FILTER (WHERE qc_coverage_ok) || '}' AS value FROM nqc""")
def _(L):
    return B.gate_json(L.night_qc.agg(F.count(F.lit(1)).alias("n_nights"), F.count_if("qc_coverage_ok").alias("n_coverage_ok")))


@query("summary_csv", "SELECT night_record_id, CAST(n_samples AS VARCHAR) AS n_samples, CAST(qc_coverage_ok AS VARCHAR) AS qc_coverage_ok FROM nqc")
def _(L):
    path = fresh_path(L, "summary")
    B.summary_csv(L.night_qc.select(KEY, "n_samples", "qc_coverage_ok"), path)
    return L.spark.read.option("header", True).csv(path)


@query("table_manifest")
def _(L):
    names = ("events", "states", "nights")
    tables = {n: getattr(L, n) for n in names}
    return B.table_manifest({n: t.drop("ts_start", "ts_end") for n, t in tables.items()}, "v1", {n: sum(size for _, size in files_under(L.spark, f"{L.root}/{n}")) for n in names})


@query("layer_footers", """SELECT 'events' AS layer, count(*) AS n_rows FROM ev UNION ALL SELECT 'states', count(*) FROM st UNION ALL SELECT 'nights', count(*) FROM ngold0 UNION ALL SELECT 'windows', count(*) FROM win""")
def _(L):
    """Rows of each layer by the footers of its files."""
    out = None
    for name in ("events", "states", "nights", "windows"):
        getattr(L, name)
        one = footers(L.spark, f"{L.root}/{name}").agg(F.sum("n_rows").alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
        out = one if out is None else out.union(one)
    return out


@query("column_dictionary")
def _(L):
    flags = ("in_quality", "in_strict", "in_high_tst", "with_clinical", "flag_for_review", "b2_fail")
    said = L.spark.createDataFrame([("odi_3", "events of 3 % an hour"), ("tst_s", "seconds asleep")], "column_name string, description string")
    return B.column_dictionary(L.nights, (KEY, "user_id", "patient_id", "model_version"), flags, said)


@query("corpus_manifest", """WITH c AS (SELECT count(*) AS n, count(DISTINCT patient_id) AS p, min(night_record_id) AS a, max(night_record_id) AS b FROM nqc),
  m AS (SELECT scale, count(DISTINCT cluster) AS k, sum(n_training) AS n FROM (SELECT DISTINCT scale, cluster, n_training FROM cen) GROUP BY scale),
  x AS (SELECT count(*) FILTER (WHERE b2_fail) AS f, count(*) FILTER (WHERE flag_for_review) AS r FROM flg)
  SELECT 'model ' || scale AS section, 'clusters_used' AS name, CAST(k AS VARCHAR) AS value FROM m UNION ALL SELECT 'model ' || scale, 'n_training', CAST(n AS VARCHAR) FROM m
  UNION ALL SELECT 'corpus', 'n_records', CAST(n AS VARCHAR) FROM c UNION ALL SELECT 'corpus', 'n_owners', CAST(p AS VARCHAR) FROM c UNION ALL SELECT 'corpus', 'first', a FROM c UNION ALL SELECT 'corpus', 'last', b FROM c
  UNION ALL SELECT 'exclusion', 'b2_fail', CAST(f AS VARCHAR) FROM x UNION ALL SELECT 'exclusion', 'flag_for_review', CAST(r AS VARCHAR) FROM x""")
def _(L):
    """What the stored model saw and what was left out, as the store tells it."""
    held = L.state_store
    models = {s: {"clusters_used": sum(n > 0 for n in held.counts[s]), "n_training": sum(held.counts[s])} for s in held.models}
    left = L.flags.agg(F.count_if("b2_fail").alias("b2_fail"), F.count_if("flag_for_review").alias("flag_for_review")).first().asDict()
    return B.corpus_manifest(models, held.meta["snapshot"], left, L.spark)


@query("model_manifest", "SELECT morphotype, count(*) AS n_training, 'v1' AS model_version, '4' AS k FROM evm WHERE in_sleep AND NOT near_gap AND meets_3pct GROUP BY morphotype")
def _(L):
    train = L.events.filter(training_events(F.col("in_sleep"), F.col("near_gap"), F.col("meets_3pct")))
    return B.model_manifest(train, "morphotype", {"model_version": "v1", "k": "4"})


@query("column_fill_profile", """SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE trim(lang) <> '') AS n_filled, count(*) - count(*) FILTER (WHERE trim(lang) <> '') AS n_blank,
  CASE WHEN count(*) FILTER (WHERE trim(lang) <> '') = 0 THEN 'none' ELSE 'some' END AS bucket FROM documents GROUP BY source""")
def _(L):
    return B.fill_profile(L.table("documents"), "source", "lang")


@query("validate_schema")
def _(L):
    """Problems of each layer against its contract beside the rows it covers."""
    contracts = {
        "signal": (L.signal, {KEY: "str", "timestamp": "ts", "spo2": "int", "hr": "int", "mov": "int", "sleep_stage": "int"}),
        "events": (L.events, {KEY: "str", "ts_start": "ts", "drop_pct": "float", "in_sleep": "bool", "spo2_curve": "list", "morphotype": "str"}),
        "states": (L.states, {KEY: "str", "scale": "str", "window_idx": "int", "dist_to_centroid": "float", "training_eligible": "bool"}),
    }
    out = None
    for name, (df, contract) in contracts.items():
        n = len(B.validate_schema(df, contract))
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows", F.lit(n).cast("long").alias("n_problems"))
        out = one if out is None else out.union(one)
    return out

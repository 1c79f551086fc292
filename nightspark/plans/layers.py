"""The medallion layers of the driver's recordings, each written once.

bronze ``signal`` -> silver ``qc`` -> ``events`` -> ``windows`` -> ``states``
-> ``nights``.  A layer is a parquet table in the shared folder, so a lost
executor costs a re-read, queries prune columns, and nothing is recomputed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark import config as C
from nightspark.config import Layout
from nightspark.operators import cohorts, detect, indices, labels, qc, store, windows
from nightspark.operators.checks import STATE_COLUMNS
from nightspark.operators.ordering import shared_dir, stable
from nightspark.plans import fixtures as X
from nightspark.sources import adapter as A

_OPEN: dict[tuple, Layers] = {}


def input_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Names and times of the input tables; a table that is written anew makes new layers."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(folder)))


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    key = (spark.sparkContext.applicationId, sf_dir, input_version(spark, sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Layers(spark, sf_dir)
    return _OPEN[key]


class Layers:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.root = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.p = A.PARAMS

    @cached_property
    def layout(self) -> Layout:
        return A.LAYOUT.sized(self.signal)

    def table(self, name: str) -> DataFrame:
        return A.table(self.spark, self.sf_dir, name)

    def _layer(self, name: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            writer = build().write.mode("overwrite")
            (writer.partitionBy(partition) if partition else writer).parquet(path)
        return self.spark.read.parquet(path)

    @property
    def signal(self) -> DataFrame:
        return self._layer("signal", lambda: A.signal(self.spark, self.sf_dir))

    @property
    def qc(self) -> DataFrame:
        return qc.quality_signal(self.signal)

    @property
    def night_qc(self) -> DataFrame:
        return self._layer("night_qc", lambda: qc.night_qc(self.signal, self.layout, self.p))

    @property
    def raw_events(self) -> DataFrame:
        """Detected events with shape, context flags and curves; no labels."""
        return self._layer("raw_events", lambda: detect.event_table(self.qc, self.layout, self.p))

    @cached_property
    def morph_model(self) -> labels.CentroidModel:
        e = self.raw_events
        train = e.filter(windows.training_events(F.col("in_sleep"), F.col("near_gap"), F.col("meets_3pct")))
        mean, std = labels.fit_zscore(train, C.EVENT_FEATURES)
        return labels.CentroidModel(C.EVENT_FEATURES, mean, std, X.MORPH_CENTROIDS, X.MORPH_LABELS)

    @property
    def events(self) -> DataFrame:
        """Events with both label columns."""
        return self._layer("events", lambda: cohorts.with_user(
            labels.label_events(self.raw_events, self.morph_model, X.CURVE_CENTROIDS, self.p.curve_max_s,
                                places_per_unit=X.CURVE_PLACES_PER_UNIT),
            self.nights_of))

    @property
    def nights_of(self) -> DataFrame:
        """record -> user, patient."""
        return self.night_qc.select("night_record_id", "user_id", (F.col("user_id") % 12).alias("patient_id"))

    @property
    def windows(self) -> DataFrame:
        return self._layer(
            "windows", lambda: windows.build_windows(self.qc, self.events, self.layout, self.p), "scale")

    def state_model(self, scale: str) -> labels.CentroidModel:
        w = self.windows.filter(F.col("scale") == scale)
        train = w.filter(windows.training_windows(F.col("frac_wake"), F.col("coverage")))
        mean, std = labels.fit_zscore(train, C.WINDOW_FEATURES)
        return labels.CentroidModel(C.WINDOW_FEATURES, mean, std, X.STATE_CENTROIDS[scale], X.STATE_LABELS[scale])

    @property
    def states(self) -> DataFrame:
        def build() -> DataFrame:
            models = {s: self.state_model(s) for s in C.STATE_K}
            return labels.label_windows(self.windows, models, self.nights_of, self.night_qc)

        return self._layer("states", build, "scale")

    @property
    def states_apart(self) -> str:
        """Folder of state files that were written apart: some lack a column, some hold another type and one column more."""
        path, u = f"{self.root}/states-apart", F.col("user_id")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/good/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            st = self.states.select(*STATE_COLUMNS)
            short, typed = F.coalesce(u % 29 == 0, F.lit(False)), F.coalesce(u % 31 == 0, F.lit(False))
            st.filter(short).drop("coverage").write.mode("overwrite").parquet(f"{path}/short")
            st.filter(typed & ~short).withColumn("window_idx", F.col("window_idx").cast("string")).withColumn("note", F.lit("")).write.mode("overwrite").parquet(f"{path}/typed")
            st.filter(~short & ~typed).write.mode("overwrite").parquet(f"{path}/good")
        return path

    @cached_property
    def state_store(self) -> store.Stored:
        """Centroids fitted as means of the labelled training windows, written to the store and read from it."""
        models, counts = {}, {}
        eligible = windows.training_windows(F.col("frac_wake"), F.col("coverage"))
        for s in C.STATE_K:
            seed = self.state_model(s)
            rows = labels.assign_nearest(self.windows.filter(F.col("scale") == s).filter(eligible), seed)
            # cut between labels and means: together they outgrow one generated method
            models[s], counts[s] = store.group_means(stable(rows.select("cluster_int", *C.WINDOW_FEATURES)), seed)
        held = store.Store(self.spark, f"{self.root}/models", "states")
        held.save(models, counts, {"snapshot": store.snapshot(self.nights_of, "night_record_id", "patient_id"), "model_version": "v1",
                                   "training_mask": {"frac_wake_max": 0.5, "coverage_min": 0.5}})
        return held.load()

    @property
    def device(self) -> DataFrame:
        """Stand-in device indices: own value times a per-user factor."""
        base = indices.night_indices(self.qc, self.raw_events, self.layout, self.p)
        u = F.col("user_id")
        factor = F.when(u % 11 == 0, F.lit(None)).when(u % 13 == 0, 0.0).otherwise(1 + (u % 7 - 3) / 10.0)
        source = {"hypoxic_burden_3": "hypoxic_burden_90", "hypoxic_burden_4": "hypoxic_burden_88"}
        return base.select("*", *[
            (F.col(source.get(i, i)) * factor).alias(f"_dev_{i}") for i in C.VALIDATED_INDICES])

    @property
    def indices(self) -> DataFrame:
        def build() -> DataFrame:
            out = self.device
            source = {"hypoxic_burden_3": "hypoxic_burden_90", "hypoxic_burden_4": "hypoxic_burden_88"}
            for i in C.VALIDATED_INDICES:
                out = out.withColumns(indices.device_quintet(F.col(source.get(i, i)), F.col(f"_dev_{i}"), i))
            return out.drop(*[f"_dev_{i}" for i in C.VALIDATED_INDICES])

        return self._layer("indices", build)

    @property
    def clinical(self) -> DataFrame:
        c = self.table("customer")
        k = F.col("c_nationkey")
        return c.select(
            F.col("c_custkey").alias("patient_id"),
            F.when(k % 2 == 0, "M").otherwise("F").alias("sexo"),
            (60 + k).cast("double").alias("peso_kg"), (150 + k).cast("double").alias("talla_cm"),
            (k % 3 == 0).cast("long").alias("apnea_prev"), F.col("c_acctbal").alias("_acctbal"),
        ).filter(F.col("_acctbal") > 0).drop("_acctbal")

    @property
    def flags(self) -> DataFrame:
        return self._layer("flags", lambda: cohorts.cohort_flags(
            all_ids=self.nights_of.select("night_record_id"),
            b2_fail=self.nights_of.filter(F.col("user_id") % 29 == 0).select("night_record_id"),
            review=self.nights_of.filter(F.col("user_id") % 17 == 0).select("night_record_id"),
            sleep=self.indices.select("night_record_id", "tst_s"), high_tst_s=self.p.high_tst_s,
            owners=self.nights_of.select("night_record_id", "patient_id"),
            clinical=self.clinical.select("patient_id"),
        ))

    @property
    def nights(self) -> DataFrame:
        from nightspark.plans.gold import gold_nights

        return self._layer("nights", lambda: gold_nights(self.indices, self.events, self.states, self.flags, self.p))

    @property
    def event_states(self) -> DataFrame:
        from nightspark.plans.gold import event_states_multiscale

        return self._layer("event_states", lambda: event_states_multiscale(
            self.events.join(self.flags, "night_record_id"), self.states, self.p.window_rows))

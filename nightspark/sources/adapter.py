"""Recordings derived from the driver's ``events`` table (see FIXTURES.md).

One user is one recording, one event is one sample.  Parameters are scaled
down because these recordings are ~67 samples long; ``chunk_rows`` is scaled
too, so that the cross-chunk paths run on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.config import Layout, Params
from nightspark.operators.ordering import order_rows

PARAMS = Params(
    baseline_rows=20, baseline_min_rows=5, min_event_s=3.0, context_rows=10,
    window_rows={"s": 5, "m": 15, "l": 45}, near_gap_s=10, sustained_rows=3,
    high_tst_s=40.0, min_strict_nights=5, baseline_min_nights=3, horizons_s=(5, 10, 15, 20),
    duration_aborted_s=30.0, duration_min_s=90.0, max_gap_s=34.0, coverage_min=0.65,
    curve_max_s=18.0, cycle_min_s=3, lookback_s=12, lookback_min_rows=6,
    lookback_tail_rows=4, match_s=3, recent_s=15, recent_long_s=30, rolling_events=3,
)
LAYOUT = Layout(chunk_rows=45)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze samples: record, user, patient, seq, timestamp and four channels."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    tenths = F.floor(F.col("value") * 10 + 0.5).cast("long")
    samples = ev.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_id") % 41 == 0, F.lit(0).cast("long")).otherwise(80 + cents % 21).alias("spo2"),
        (30 + (F.col("event_id") * 37 + tenths) % 190).alias("hr"),
        F.get_json_object("props", "$.k").cast("long").alias("mov"),
        F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3)
        .cast("long").alias("sleep_stage"),
    )
    numbered = order_rows(samples, ["user_id"], ["ts", "event_id"])
    seconds = F.col("seq") + F.when(F.col("seq") >= 40, 35).otherwise(0)
    return numbered.select(
        F.concat(F.lit("NR_"), F.col("user_id").cast("string")).alias("night_record_id"),
        "user_id", (F.col("user_id") % 12).alias("patient_id"), "seq",
        F.timestamp_seconds(F.lit(1704146400) + seconds).cast("timestamp_ntz").alias("timestamp"),
        "spo2", "hr", "mov", "sleep_stage",
    )


SIGNAL_SQL = """
sig AS (
  SELECT 'NR_' || user_id AS night_record_id, user_id, user_id % 12 AS patient_id, seq,
         TIMESTAMP '2024-01-01 22:00:00' + to_seconds(seq + CASE WHEN seq >= 40 THEN 35 ELSE 0 END) AS timestamp,
         spo2, hr, mov, sleep_stage
  FROM (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
           CASE WHEN event_id % 41 = 0 THEN 0 ELSE 80 + CAST(floor(value * 100 + 0.5) AS BIGINT) % 21 END AS spo2,
           30 + (event_id * 37 + CAST(floor(value * 10 + 0.5) AS BIGINT)) % 190 AS hr,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS mov,
           CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                WHEN 'signup' THEN 3 END AS BIGINT) AS sleep_stage
    FROM events))"""

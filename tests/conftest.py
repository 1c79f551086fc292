from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("nightspark-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_signal(spark):
    """Signal rows from per-record lists of spo2 (None = missing)."""
    import datetime as dt

    def make(records: dict[str, list], hr=70, mov=1, stage=2, step=1):
        start = dt.datetime(2024, 1, 1, 22)
        rows = []
        for name, values in records.items():
            for i, v in enumerate(values):
                rows.append((name, 1, 1, i, start + dt.timedelta(seconds=i * step), v, hr, mov, stage))
        return spark.createDataFrame(
            rows, "night_record_id string, user_id long, patient_id long, seq long, timestamp timestamp_ntz, "
                  "spo2 long, hr long, mov long, sleep_stage long")

    return make

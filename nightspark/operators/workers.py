"""What Python workers of the fitting operators need."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def visible(spark: SparkSession) -> None:
    """Workers find this package where the driver found it (on a cluster: also by --py-files)."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Rows of doubles; null is NaN."""
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


def summed(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """Sum of partial matrices, sent as (row, values); ``rows`` x ``width`` numbers reach the driver."""
    out = np.zeros((rows, width))
    cells = parts.select("row", F.posexplode("values").alias("at", "v")).groupBy("row", "at").agg(F.sum("v").alias("v"))
    table = cells.toArrow()
    if table.num_rows:
        out[table.column("row").to_numpy(), table.column("at").to_numpy()] = table.column("v").to_numpy()
    return out


def partial(values: np.ndarray) -> pa.RecordBatch:
    """A matrix as rows (row, values)."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(list(values), pa.list_(pa.float64()))], ["row", "values"])


PARTIAL = "row int, values array<double>"

"""Dense per-key row numbers without a per-key task.

``row_number() over (partition by key)`` sends a whole key to one task.  Here
the rows are range-partitioned on (key, order), so a key that holds a third of
the data is spread over a third of the partitions; only one row per
(partition, key) is then scanned to turn partition-local positions into
record-wide ones.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's, else (local master only) one of this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so later reads see one version."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "seq",
) -> DataFrame:
    """Add ``out`` = 0-based position of each row in its key, by ``order``.

    ``order`` must be a total order inside a key (add a tie-breaker column).
    """
    key_cols = [F.col(k) for k in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = (
        df.repartitionByRange(*key_cols, *order_cols)
        .sortWithinPartitions(*key_cols, *order_cols)
        .withColumn("_rid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_rid", 33))
    )
    placed = stable(placed)
    pieces = placed.groupBy("_part", *keys).agg(
        F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # one row per (partition, key): at most as many rows per key as partitions
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_part").alias("_opart"),
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    cond = [F.col("_part") == F.col("_opart")] + [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return placed.join(offsets, cond, "inner").select(
        *df.columns, (F.col("_rid") + F.col("_shift")).alias(out)
    )

"""Publishing of tables: whole versions, and layers of records that are renewed in part.

``publish`` writes a set of tables beside its place and moves them there in one
step, so a reader sees all of a version or nothing of it.  ``refresh`` keeps a
layer of records in groups and rewrites only the groups that hold a record which
is missing, was made by another model, or has newer input; fresh records of such
a group are carried over as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.operators.checks import stale_records
from nightspark.operators.ordering import stable


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    p, fs = _at(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], texts: Mapping[str, DataFrame] = {}, partition: Mapping[str, str] = {}) -> int:
    """Write all tables (parquet) and texts (one value per line) as the next version; its number."""
    beside = f"{root}/.{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write
        (writer.partitionBy(partition[name]) if name in partition else writer).parquet(f"{beside}/{name}")
    for name, df in texts.items():
        df.select(F.col(df.columns[0]).cast("string").alias("value")).coalesce(1).write.text(f"{beside}/{name}")
    source, fs = _at(spark, beside)
    while True:
        version = (versions(spark, root) or [0])[-1] + 1
        target, _ = _at(spark, f"{root}/v{version}")
        if not fs.exists(target) and fs.rename(source, target):
            return version


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, the latest if none is named."""
    have = versions(spark, root)
    if not have or version not in (None, *have):
        raise FileNotFoundError(f"{root} has no version {version or ''}")
    return spark.read.parquet(f"{root}/v{version or have[-1]}/{name}")


def refresh(
    spark: SparkSession, path: str, inputs: DataFrame, build: Callable[[DataFrame], DataFrame], fingerprint: str,
    record: str = "night_record_id", groups: int = 64,
) -> DataFrame:
    """Renew the stale records of a layer; (record, reason) of what was renewed.

    ``inputs`` (record, version: a number that rises with newer input);
    ``build`` gets the records to make (record) and gives their rows.  Rows are
    stored with ``_version`` and ``_model`` in folders by record group, which
    are overwritten one by one.  A second call without changes writes nothing.
    """
    group = F.pmod(F.xxhash64(record), F.lit(groups)).cast("int")
    p, fs = _at(spark, path)
    written = fs.exists(p) and any(s.getPath().getName().startswith("_group=") for s in fs.listStatus(p))
    held = spark.read.parquet(path) if written else None
    if held is None:
        done = inputs.limit(0).select(record, F.lit(0).cast("long").alias("version"), F.lit("").alias("model"))
    else:
        # a record is as old as its oldest row
        done = held.groupBy(record).agg(F.min("_version").alias("version"), F.min("_model").alias("model"))
    stale = stable(stale_records(inputs, done, fingerprint))
    if stale.isEmpty():
        return stale
    made = build(stale.select(record)).join(inputs.select(record, F.col("version").cast("long").alias("_version")), record)
    out = made.withColumns({"_model": F.lit(fingerprint), "_group": group})
    if held is not None:
        touched = stale.select(group.alias("_group")).distinct()
        fresh = held.join(touched, "_group", "left_semi").join(stale.select(record), record, "left_anti")
        # read in full before its folders are replaced
        out = out.unionByName(stable(fresh.select(*out.columns)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_group").parquet(path)
    return stale

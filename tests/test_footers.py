from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from nightspark.sources import footers, tables

WANT = {"night_record_id": "string", "n": "integer", "v": "double"}
KINDS = {"int": "integer", "bigint": "integer", "float": "double"}


@pytest.fixture
def folder(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    good = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 3, None)], "night_record_id string, n long, v float")
    good.coalesce(1).write.parquet(f"{path}/good")
    good.filter("n = 1").withColumn("night_record_id", F.lit("C")).drop("v").coalesce(1).write.parquet(f"{path}/short")
    good.filter("n = 3").withColumns({"n": F.lit("3"), "more": F.lit(1)}).coalesce(1).write.parquet(f"{path}/typed")
    good.drop("night_record_id").coalesce(1).write.parquet(f"{path}/nameless")
    with open(f"{path}/broken.parquet", "w") as f:
        f.write("no parquet")
    return path


def test_files_name_their_own_faults(spark, folder):
    got = {r.night_record_id: tuple(r)[1:] for r in footers.file_schema_lock(spark, folder, WANT, "night_record_id", KINDS).collect()}
    assert got == {"A": (0, 0, 0, "", "PASS"), "B": (0, 1, 1, "more,n", "FAIL"), "C": (1, 0, 0, "v", "FAIL"), None: (3, 0, 0, "n,night_record_id,v", "FAIL")}
    rows = {r.file.split("/")[-2]: r for r in footers.footers(spark, folder).collect()}
    assert rows["good"].n_rows == 3 and rows["good"].columns == {"night_record_id": "string", "n": "bigint", "v": "float"} and rows["good"].records is None
    assert [r.error is None for r in rows.values()].count(False) == 1 and all(r.bytes > 0 for r in rows.values())
    assert footers.footers(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp")).collect() == []


def test_checksum_counts_equal_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, None)], "n long, s string")
    one = tables.multiset_checksum(df).first()
    assert one == tables.multiset_checksum(df.orderBy(F.desc("n")).repartition(3)).first() and len(one.checksum) == 32
    twice = df.union(df.filter("n = 1")).union(df.filter("n = 1"))
    assert len({tables.multiset_checksum(x).first().checksum for x in (df, twice, df.distinct(), df.limit(0))}) == 4
    row = tables.table_manifest({"t": df}, "v1", {"t": 77}).first()
    assert (row.n_rows, row.n_cols, row.n_bytes) == (4, 2, 77)

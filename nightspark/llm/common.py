"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.operators.ordering import shared_dir

#: Words of the text contracts.  Both patterns hold in Java, RE2 and Python.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
SPACE_GAP = r"[\x20\x09-\x0D]+"
PLAIN_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def sql_ascii_lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: a lost executor costs a re-read, and what is read twice is
    computed once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more: all that came from them is written itself.

    Spark deletes the shuffle files of ended jobs when the driver collects garbage, so that is done here too.
    """
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def binary_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a text column; null stays None."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def space_table() -> bytes:
    """Byte table: A-Z lower-cased, white space to blanks, all else as it is."""
    keep = bytearray(range(256))
    for i in (0x20, *range(0x09, 0x0E)):
        keep[i] = 0x20
    keep[0x41:0x5B] = string.ascii_lowercase.encode()
    return bytes(keep)


def plain_table() -> bytes:
    """Byte table: A-Z lower-cased; ASCII digits, letters and bytes over 7F stay, all else to blanks."""
    keep = bytearray(b" " * 256)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        keep[lo:hi] = bytes(range(lo, hi))
    keep[0x41:0x5B] = string.ascii_lowercase.encode()
    return bytes(keep)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13), in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x

"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightspark.operators.intervals import epoch
from nightspark.plans import oracle
from nightspark.plans.layers import Layers, layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and show timestamps as epoch seconds, for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.floor(epoch(c)).cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_seconds(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(layers) -> DataFrame`` and its SQL under ``name``."""

    def wrap(fn: Callable[[Layers], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(layers(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = oracle.sql(sql)
        return fn

    return wrap


def d6(*names: str) -> str:
    """SQL list that rounds each named column."""
    return ", ".join(f"r6({n}) AS {n}" for n in names)

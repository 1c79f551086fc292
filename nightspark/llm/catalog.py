"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightspark.llm import (
    alignment, decontaminate, licenses, lines, near, packing, preferences, quality, repeats, scoring, separators, urls, whitening,
)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def visible(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (on a cluster: also by --py-files)."""
    # rows that go to Python in one batch: some MB, however long the texts
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    # workers live on after a task: they give freed memory back
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "131072")):
        spark.sparkContext.environment.setdefault(name, value)


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        visible(spark)
        return fn(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _query(fn) for name, fn in {
        "op1_token_counts": separators.op1_token_counts,
        "op2_lm_scoring": scoring.op2_lm_scoring,
        "op3_url_filter": urls.op3_url_filter,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_near_duplicates": near.op5_near_duplicates,
        "op6_packing": packing.op6_packing,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_preference_formatting": preferences.op10_preference_formatting,
        "op11_suffix_dedup": repeats.op11_suffix_dedup,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_whitening": whitening.op13_whitening,
    }.items()
}
ORACLE: dict[str, str] = {
    "op4_decontamination": decontaminate.OP4_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_preference_formatting": preferences.OP10_SQL,
}

from __future__ import annotations

import os

from nightspark.plans import io_queries, report_queries
from nightspark.plans.catalog import QUERIES


def test_all_gold_tables_are_written_whole(spark, monkeypatch):
    """Every column of all eleven tables is in the folder, and rows are counted from what was written."""
    paths, tables = [], {}
    real_path, real_tables = io_queries.fresh_path, report_queries.gold_tables
    monkeypatch.setattr(report_queries, "fresh_path", lambda L, name: paths.append(real_path(L, name)) or paths[-1])
    monkeypatch.setattr(report_queries, "gold_tables", lambda L: tables.update(real_tables(L)) or tables)
    rows = QUERIES["write_gold"](spark, "/root/testdata/sf0.001").collect()
    assert len(tables) == 11 and sorted(os.listdir(paths[0])) == sorted(tables)
    for name, t in tables.items():
        back = spark.read.parquet(f"{paths[0]}/{name}")
        assert set(back.columns) == {*t.columns, "model_version"} and back.count() == t.count()
        assert sum(r.n for r in rows if r.name == name) == t.count()
    assert {r.patient_id for r in rows if r.name == "patients"} == {r.patient_id for r in rows if r.name == "nights"}

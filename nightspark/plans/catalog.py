"""Imports every query module so that the registry is complete."""

from nightspark.plans import (  # noqa: F401
    analytic_queries,
    check_queries,
    core_queries,
    gold_queries,
    io_queries,
    model_queries,
    report_queries,
    series_queries,
    stat_queries,
)
from nightspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

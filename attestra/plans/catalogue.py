"""All queries of the audit engine; importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, cohorts, flows, panels, tables
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audit", "cohorts", "flagship", "flows", "panels", "tables"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile the keys of orders and customers and classify their overlap."""
    return tables.linkage_cards(spark, sf_dir)

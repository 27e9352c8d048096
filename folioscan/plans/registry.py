"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import assess
from folioscan.plans import fixtures, oracles
from folioscan.plans.queries import AS_OF, QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: oracles.SQL[name] for name in QUERIES if name in oracles.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by type and status, with their mean confidence."""
    scanned = assess.scan_results(fixtures.regions(spark, sf_dir), AS_OF)
    return scanned.groupBy("document_type", "status").agg(F.count("*").alias("documents"), F.bround(F.avg("confidence"), 4).alias("mean_confidence"))

"""All queries outside the optional subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import oracle_sql, problems, reference


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return reference.periodical_enhanced_topk(spark, sf)


def queries() -> dict:
    return reference.QUERIES | problems.QUERIES


def oracles() -> dict[str, str]:
    return oracle_sql.REFERENCE | oracle_sql.PROBLEMS

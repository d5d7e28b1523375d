"""Ranks, heads and summaries (OP-17, OP-18, OP-66 to OP-69, OP-75)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.skew import attach
from citeloom.session import materialize


def ranked(df: DataFrame, score: str, name: str = "periodical") -> DataFrame:
    """Add rank 1..n by falling score, ties by name.

    The rows are cut into ranges of the order; each is numbered by itself and moved on by the rows of
    the ranges before it, so that no task gets all rows. The driver holds a number per range.
    """
    order = (F.desc_nulls_last(score), F.asc(name))
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted(map(tuple, parts.groupBy("__part").agg(F.count("*")).collect()))
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    offset = F.element_at(F.create_map(*(F.lit(x) for p in before.items() for x in p)), F.col("__part")) if before else F.lit(0)
    return parts.withColumn("rank", (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + offset).cast("int")).drop("__part")


def head(df: DataFrame, score: str, n: int, name: str = "periodical") -> DataFrame:
    """The n rows with the highest score, ties by name; a top-k of each partition, then of those."""
    return df.orderBy(F.desc_nulls_last(score), name).limit(n)


def top_periodicals(papers: DataFrame, n: int) -> DataFrame:
    """OP-66: (periodical, n_papers) of the n periodicals with most rows, null excluded."""
    sizes = papers.where("periodical is not null").groupBy("periodical").agg(F.count("*").alias("n_papers"))
    return sizes.orderBy(F.desc("n_papers"), "periodical").limit(n)


def of_periodicals(papers: DataFrame, periodicals: DataFrame, null_matches: bool = False) -> DataFrame:
    """OP-18, OP-37: rows whose periodical is among `periodicals` (periodical); null only matches null if asked."""
    key = F.struct("periodical")  # equal also where both are null
    names = periodicals.select(key.alias("__key")).distinct()
    if not null_matches:
        names = names.where("__key.periodical is not null")
    return attach(papers.withColumn("__key", key), names, "__key", "inner").drop("__key")


def from_year(papers: DataFrame, least: int | None) -> DataFrame:
    """OP-17: rows from `least` on; rows without a year go, unless `least` is null or 0."""
    return papers.where(F.col("year") >= least) if least else papers


def summary(df: DataFrame, score: str) -> DataFrame:
    """OP-75: one row of n, mean, sample deviation, most and least."""
    return df.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.max(score).alias("most"), F.min(score).alias("least"))

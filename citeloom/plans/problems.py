"""Queries of the general data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.citations import with_cited_keys
from citeloom.functions.text import pick, plain_form
from citeloom.operators.orphans import orphan_period_counts, orphan_references
from citeloom.operators.packed_fields import unpack_fields
from citeloom.operators.skew import compress, key_percentile, key_stats, key_sums
from citeloom.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(table(spark, sf, "data_with_citing"), table(spark, sf, "target_data"), table(spark, sf, "withdrawn_papers"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_rows(spark, sf).select(F.col("id").alias("record_id"), "cited_doi", "state")


def p2_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_period_counts(table(spark, sf, "data_with_citing"), table(spark, sf, "target_data"), table(spark, sf, "withdrawn_papers"))


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the papers by title, with each row's number of distinct cited papers."""
    papers = pick(table(spark, sf, "data_with_citing"), {"title": "Source Title", "citing": "citing"})
    return with_cited_keys(papers, "citing", "keys").select(plain_form(F.col("title")).alias("title"), F.size("keys").alias("n_refs"))


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """(cited key, title of the citing row), once per row and key."""
    papers = pick(table(spark, sf, "data_with_citing"), {"title": "Source Title", "citing": "citing"})
    return with_cited_keys(papers, "citing", "keys").select(plain_form(F.col("title")).alias("title"), F.explode_outer("keys").alias("cited")).where("cited is not null")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of more than 3 % of all rows, cited papers of more than 1 % of all cited keys.

    One pass over the table: title and cited keys of a row become (field, key) pairs together, and
    (key, value) pairs are counted before keys.
    """
    papers = pick(table(spark, sf, "data_with_citing"), {"title": "Source Title", "citing": "citing"})
    papers = with_cited_keys(papers, "citing", "keys").withColumn("plain", plain_form(F.col("title")))
    title = F.struct(F.lit("Source Title").alias("field_name"), F.col("plain").alias("key_value"), F.col("title").alias("value"))
    cited = F.transform("keys", lambda k: F.struct(F.lit("citing").alias("field_name"), k.alias("key_value"), F.col("plain").alias("value")))
    rows = papers.select(F.inline(F.concat(F.array(title), cited)))
    weighted = compress(rows, F.struct("field_name", "key_value"), F.col("value"))
    per_key = materialize(weighted.groupBy("key").agg(F.sum("weight").alias("n")))
    totals = {r[0]: r[1] for r in per_key.groupBy("key.field_name").agg(F.sum("n")).collect()}  # two rows
    few = F.when(F.col("key.field_name") == "citing", F.lit(totals.get("citing", 0) * 0.01)).otherwise(F.lit(totals.get("Source Title", 0) * 0.03))
    return per_key.where((F.col("n") > few) & F.col("key.key_value").isNotNull() & (F.col("key.key_value") != "")).select("key.field_name", "key.key_value")


def p5_title_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per title: rows, sum, mean, median, least and most cited papers of a row, distinct and most usual number of them."""
    weighted = materialize(compress(_titles(spark, sf), F.col("title"), F.col("n_refs")))
    parts = [key_stats(weighted), key_sums(weighted), key_percentile(weighted, 0.5)]
    out = parts[0]
    for i, x in enumerate(parts[1:]):
        x = x.withColumnRenamed("key", f"k{i}")
        out = out.join(x, out["key"].eqNullSafe(x[f"k{i}"]), "left").drop(f"k{i}")
    return out.select(
        F.col("key").alias("title"), "n_rows", F.col("total").cast("bigint").alias("sum_refs"), F.round("mean", 6).alias("mean_refs"), F.col("percentile").cast("bigint").alias("median_refs"),
        F.col("low").cast("bigint").alias("min_refs"), F.col("high").cast("bigint").alias("max_refs"), F.col("n_values").alias("distinct_counts"), F.col("top_value").cast("bigint").alias("usual_refs"),
    )


def p5_cited_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per cited paper: citing rows, distinct citing titles, the title that cites it most and its rows."""
    stats = key_stats(compress(_cited(spark, sf), F.col("cited"), F.col("title")))
    return stats.select(F.col("key").alias("cited_doi"), "n_rows", F.col("n_values").alias("n_titles"), "top_value", "top_weight")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return unpack_fields(table(spark, sf, "data_with_citing"))


QUERIES = {f.__name__: f for f in (p2_found, p2_orphans_by_month, p5_found, p5_title_stats, p5_cited_stats, p7_found)}

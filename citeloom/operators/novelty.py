"""Combinatorial novelty of keyword pairs (OP-43 to OP-45, OP-52 to OP-55, OP-74, OP-76, OP-77)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs_of(keywords: Column) -> Column:
    """ARRAY<STRUCT<k1, k2>> of all two places of an array, each pair in order; made in the row, without a join."""
    n = F.size(keywords)
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def later(i: Column) -> Column:
        a = F.get(keywords, i - 1)
        rest = F.slice(keywords, i + 1, n)
        return F.transform(rest, lambda b: F.struct(F.least(a, b).alias("k1"), F.greatest(a, b).alias("k2")))

    return F.flatten(F.transform(at, later))


def timeline(background: DataFrame) -> DataFrame:
    """OP-52: (k1, k2, first_year) of rows (keywords, year); rows without a year don't count. One shuffle, combined before it."""
    rows = background.where("year is not null").select("year", F.explode_outer(pairs_of(F.col("keywords"))).alias("p")).where("p is not null")
    return rows.groupBy("p.k1", "p.k2").agg(F.min("year").alias("first_year"))


def reference_year(target: DataFrame, default: int) -> int:
    """OP-53: the last year of the target rows, one number; `default` where none has a year."""
    last = target.agg(F.max("year")).first()[0]
    return default if last is None else last


def papers_by_doi(papers: DataFrame) -> DataFrame:
    """(id, keywords, year, periodical) of rows (row, id, keywords, year, periodical, row_no): per DOI the last row's keywords, the first row's year and periodical.

    OP-32: a row without a DOI is a paper of its own, `paper_` and its row; its year and periodical, which are looked up by DOI, stay null.
    """
    known = papers.where("id is not null").groupBy("id").agg(F.max_by("keywords", "row_no").alias("keywords"), F.min_by("year", "row_no").alias("year"), F.min_by("periodical", "row_no").alias("periodical"))
    alone = papers.where("id is null").select(F.concat(F.lit("paper_"), F.col("row").cast("string")).alias("id"), "keywords")
    return known.unionByName(alone, allowMissingColumns=True)


def paper_novelty(target: DataFrame, first_years: DataFrame, reference_year: int, within: int = 1, absolute: bool = False) -> DataFrame:
    """OP-54: (row, n_pairs, n_novel, novelty) of rows (row, keywords).

    A pair is novel if the background never had it, or first had it no more than `within` years before
    the reference year; with `absolute` no more than so many years before or after. Rows with fewer than
    two keywords have no pairs and don't come out.
    """
    pairs = target.select("row", F.explode_outer(pairs_of(F.col("keywords"))).alias("p")).where("p is not null").select("row", "p.k1", "p.k2")
    met = pairs.join(first_years, ["k1", "k2"], "left")
    age = F.lit(reference_year) - F.col("first_year")
    novel = F.col("first_year").isNull() | ((F.abs(age) if absolute else age) <= within)
    per = met.groupBy("row").agg(F.count("*").alias("n_pairs"), F.count(F.when(novel, 1)).alias("n_novel"))
    return per.withColumn("novelty", F.col("n_novel").cast("double") / F.col("n_pairs"))


def periodical_novelty(rows: DataFrame, unknown: bool) -> DataFrame:
    """OP-55: (periodical, novelty_mean, n_papers, novelty_std); rows without a periodical count as Unknown, or not at all."""
    periodical = F.coalesce("periodical", F.lit("Unknown")) if unknown else F.col("periodical")
    kept = rows.withColumn("periodical", periodical).where("periodical is not null")
    return kept.groupBy("periodical").agg(F.avg("novelty").alias("novelty_mean"), F.count("*").alias("n_papers"), F.stddev_pop("novelty").alias("novelty_std"))


def drill_down(target: DataFrame, first_years: DataFrame, row: int | None, reference_year: int, within: int = 1) -> DataFrame:
    """OP-77: (row, k1, k2, first_year, novel) of the pairs of one row, or of every row; here a pair the background never had is not novel."""
    rows = target if row is None else target.where(F.col("row") == row)
    pairs = rows.select("row", F.explode_outer(pairs_of(F.col("keywords"))).alias("p")).where("p is not null").select("row", "p.k1", "p.k2")
    novel = F.coalesce(F.abs(F.lit(reference_year) - F.col("first_year")) <= within, F.lit(False))
    return pairs.join(first_years, ["k1", "k2"], "left").select("row", "k1", "k2", "first_year", novel.alias("novel"))


def timeline_report(first_years: DataFrame, n: int = 5, since: int | None = None) -> DataFrame:
    """OP-76: the n earliest pairs, or the n earliest of those first seen in `since` or later; ties by the pair."""
    rows = first_years if since is None else first_years.where(F.col("first_year") >= since)
    return rows.orderBy("first_year", "k1", "k2").limit(n)


def corpus_stats(papers: DataFrame, first_years: DataFrame) -> DataFrame:
    """OP-74: one row of rows (keywords, year, dois) and their timeline.

    Papers, those with keywords, keywords and distinct ones, papers without a year, those of them that
    have pairs, distinct dated pairs, and DOIs found in reference texts.
    """
    size = F.size("keywords")
    n = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    total = lambda c, name: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint").alias(name)
    undated = F.col("year").isNull()
    counts = papers.agg(F.count("*").alias("n_papers"), n(size > 0, "n_with_keywords"), total("keywords", "n_keywords"), n(undated, "n_without_year"), n(undated & (size > 1), "n_skipped"), total("dois", "n_dois"))
    distinct = papers.select(F.explode_outer("keywords").alias("k")).where("k is not null").distinct().agg(F.count("*").alias("n_distinct"))
    pairs = first_years.agg(F.count("*").alias("n_pairs"))
    return counts.join(F.broadcast(distinct)).join(F.broadcast(pairs))  # one row each

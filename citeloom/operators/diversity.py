"""Category similarity and interdisciplinarity (OP-42, OP-48, OP-56 to OP-60, OP-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.parsing import percent
from citeloom.session import materialize

#: A wide matrix with more columns is refused; its cells in long form have no bound.
MOST_COLUMNS = 10_000


def category_counts(papers: DataFrame, distinct: bool, least: int) -> DataFrame:
    """OP-56: (i, j, n): symmetric co-occurrence of rows (categories), with the diagonal.

    Each place adds 1 to its diagonal and each two places 1 to both sides. With `distinct` places of
    equal categories count once. Rows with fewer than `least` categories don't count. Pairs are made in
    the row and combined before the one shuffle.
    """
    cats = F.array_sort(F.array_distinct("categories")) if distinct else F.col("categories")
    rows = papers.select(cats.alias("cs")).where(F.size("cs") >= least)
    places = F.sequence(F.lit(0), F.size("cs") - 1)
    cells = F.flatten(F.transform("cs", lambda a, i: F.transform(places, lambda j: F.struct(a.alias("i"), F.get(F.col("cs"), j).alias("j"), (i == j).alias("same")))))
    cell = rows.select(F.explode_outer(cells).alias("c")).where("c is not null")
    # Two places of one category add 2 to the diagonal cell, as both sides fall on it.
    return cell.groupBy("c.i", "c.j").agg(F.count("*").alias("n"))


def salton(counts: DataFrame) -> DataFrame:
    """OP-57: (i, j, s): cosine of co-occurrence rows, 1 on the diagonal, only cells above 0.

    Sparse: rows meet on their common columns. Its size is that of the category list squared.
    """
    norms = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    a, b = counts.select("i", F.col("j").alias("k"), F.col("n").alias("x")), counts.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("n").alias("y"))
    dots = a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    other = norms.select(F.col("i").alias("j"), F.col("norm").alias("norm_j"))
    s = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("dot") / (F.col("norm") * F.col("norm_j")))
    return dots.join(norms, "i").join(other, "j").select("i", "j", s.alias("s"))


def reference_categories(papers: DataFrame, categories: DataFrame) -> DataFrame:
    """OP-42: (row, category, n): how often each category stands among a row's references; (row, refs) with (id, categories)."""
    refs = papers.select("row", F.explode_outer("refs").alias("id")).where("id is not null")
    return refs.join(categories, "id").select("row", F.explode_outer("categories").alias("category")).where("category is not null").groupBy("row", "category").agg(F.count("*").alias("n"))


def shared(counts: DataFrame, similarity: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """(row, n_categories, z): z = sum over category pairs of similarity and both shares.

    The similarity table is broadcast if it has at most `most_broadcast` cells, and shuffled otherwise.
    """
    similarity = materialize(similarity)
    total = counts.groupBy("row").agg(F.sum("n").alias("total"), F.count("*").alias("n_categories"))
    p = counts.join(total, "row").select("row", "category", (F.col("n") / F.col("total")).alias("p"), "n_categories")
    cells = F.broadcast(similarity) if similarity.count() <= most_broadcast else similarity
    mine = p.select("row", F.col("category").alias("i"), F.col("p").alias("p_i"), "n_categories")
    theirs = p.select("row", F.col("category").alias("j"), F.col("p").alias("p_j"))
    met = mine.join(theirs, "row").join(cells, ["i", "j"], "left")
    return met.groupBy("row", "n_categories").agg(F.sum(F.coalesce("s", (F.col("i") == F.col("j")).cast("double")) * F.col("p_i") * F.col("p_j")).alias("z"))


def td_from_diversity(z: Column, n_categories: Column) -> Column:
    """OP-58, OP-59: 1 / (1 - z) with two categories or more and a positive diversity, else 1."""
    rs = F.when(n_categories > 1, 1 - z).otherwise(0.0)
    return F.coalesce(F.when(rs > 0, 1 / rs), F.lit(1.0))


def td_from_similarity(z: Column) -> Column:
    """OP-59: 1 / z, 1 where z isn't positive or unknown."""
    return F.coalesce(F.when(z > 0, 1 / z), F.lit(1.0))


def periodical_td(rows: DataFrame) -> DataFrame:
    """OP-60: (periodical, td_mean, td_std, percent_mean, percent_std, n_papers) of rows (periodical, td), sample deviations; percents are each paper's, to one place (OP-33)."""
    rows = rows.where("periodical is not null").withColumn("percent", F.round(percent(F.col("td"), 5), 1))
    spread = [f(c).alias(f"{c if c == 'percent' else 'td'}_{name}") for c in ("td", "percent") for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return rows.groupBy("periodical").agg(*spread, F.count("*").alias("n_papers"))


def names_of(similarity: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """All categories of the similarity table in order; more than `most` raise."""
    names = [r[0] for r in similarity.select("i").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} categories; take the cells in long form")
    return sorted(names)


def wide(similarity: DataFrame, names: list[str]) -> DataFrame:
    """OP-09: one row per category, one column per name, 0 where nothing is known."""
    return similarity.groupBy(F.col("i").alias("category")).pivot("j", names).agg(F.first("s")).na.fill(0.0)

"""Citation graph and disruption (OP-36 to OP-41, OP-49 to OP-51, OP-71, OP-72, OP-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.skew import heavy_keys, lookup, spread_join
from citeloom.session import materialize


def edges(papers: DataFrame) -> DataFrame:
    """(src, dst): distinct citations of rows (id, refs); rows without an id cite nothing."""
    return papers.where("id is not null").select(F.col("id").alias("src"), F.explode("refs").alias("dst")).distinct()


def last_row(papers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the last row of each non-null key by row_no."""
    return papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, "row_no").alias(value))


def first_row(papers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the first row of each non-null key by row_no."""
    return papers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, "row_no").alias(value))


def d_index(background: DataFrame, target: DataFrame) -> DataFrame:
    """(id, ni, nj, nk, d) of every distinct non-null id of `target`.

    `background` (id, refs, row_no) makes the graph. Of a paper in several rows the last row's
    references count as its own, while its citations count from all rows. With R its references and C
    its citers: nj citers that cite R, ni the others, nk papers citing R that aren't in C (itself among
    them), d = (ni - nj) / (ni + nj + nk), 0 if nothing counts.

    The graph is written once, as three branches read it. One large join (references of the targets with
    all citations of them), in which the pairs of a hub are formed in many parts, and one aggregation on
    (paper, citer); distinct pairs are combined before the shuffle, and a hub's citers are spread over
    the pairs' hash.
    """
    focal = target.where("id is not null").select("id").distinct()
    cites = background.where("id is not null").select("id", "row_no", F.explode("refs").alias("dst"))
    newest = background.where("id is not null").groupBy("id").agg(F.max("row_no").alias("newest"))
    graph = materialize(cites.join(newest, "id").groupBy(F.col("id").alias("src"), "dst").agg(F.max(F.col("row_no") == F.col("newest")).alias("own")))
    refs = graph.where("own").join(focal, graph["src"] == focal["id"], "left_semi").select(F.col("src").alias("f"), "dst")
    heavy = heavy_keys(graph, "dst")
    # Citers of the references, with whether it is a current reference of the citer.
    around = spread_join(refs, graph, "dst", heavy).select("f", F.col("src").alias("c"), F.lit(False).alias("citer"), F.lit(True).alias("near"), "own")
    citers = lookup(graph, focal.select(F.col("id").alias("dst")), "dst", "inner", heavy).select(F.col("dst").alias("f"), F.col("src").alias("c"), F.lit(True).alias("citer"), F.lit(False).alias("near"), F.lit(False).alias("own"))
    pairs = around.unionByName(citers).groupBy("f", "c").agg(F.max("citer").alias("citer"), F.max("near").alias("near"), F.max("own").alias("own"))
    n = lambda cond: F.count(F.when(cond, 1))
    counts = pairs.groupBy("f").agg(n(F.col("citer") & ~F.col("own")).alias("ni"), n(F.col("citer") & F.col("own")).alias("nj"), n(F.col("near") & ~F.col("citer")).alias("nk"))
    out = focal.join(counts, focal["id"] == counts["f"], "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ni", "nj", "nk")))
    return out.withColumn("d", F.coalesce(F.try_divide((F.col("ni") - F.col("nj")).cast("double"), F.col("ni") + F.col("nj") + F.col("nk")), F.lit(0.0)))


def score_rows(target: DataFrame, scores: DataFrame, null_keys: str = "skip") -> DataFrame:
    """OP-36: (id, periodical, d), a row per target row and score of its id.

    `skip` leaves out rows without an id. `match` keeps the faithful form: one score of 0 per row, and
    null matches null, so k rows without an id give k times k rows and equal ids square as well.
    """
    if null_keys == "skip":
        return target.where("id is not null").select("id", "periodical").join(scores.select("id", "d"), "id")
    if null_keys != "match":
        raise ValueError(null_keys)
    per_row = target.select(F.col("id").alias("sid")).join(scores.select("id", "d"), F.col("sid") == F.col("id"), "left").select("sid", F.coalesce("d", F.lit(0.0)).alias("d"))
    return per_row.join(target.select("id", "periodical"), F.col("sid").eqNullSafe(F.col("id")), "left").select("id", "periodical", "d")


def periodical_mean(rows: DataFrame) -> DataFrame:
    """OP-50: (periodical, disruption_mean, paper_count); null periodicals don't count, null ids don't add to paper_count."""
    return rows.where("periodical is not null").groupBy("periodical").agg(F.avg("d").alias("disruption_mean"), F.count("id").alias("paper_count"))


def periodical_enhanced(rows: DataFrame, top_k: int = 10, volume_weight: float = 0.4) -> DataFrame:
    """OP-51: (periodical, n_papers, top_k_mean, enhanced_disruption).

    The mean of the periodical's top scores, damped by its size n: (1 - w) m + w m / ln(1 + n). The rows
    of a periodical are cut to their top_k in each part of the data before they meet.
    """
    rows = rows.where("periodical is not null and d is not null")
    # Two-level: top_k per salted part, then per periodical, so a large periodical isn't one task's sort.
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id", "d"), F.lit(32)))
    within = F.row_number().over(Window.partitionBy("periodical", "salt").orderBy(F.desc("d")))
    few = part.withColumn("r", within).where(F.col("r") <= top_k)
    best = few.withColumn("r", F.row_number().over(Window.partitionBy("periodical").orderBy(F.desc("d")))).where(F.col("r") <= top_k)
    mean = best.groupBy("periodical").agg(F.avg("d").alias("top_k_mean"))
    size = rows.groupBy("periodical").agg(F.count("*").alias("n_papers"))
    m, w = F.col("top_k_mean"), volume_weight
    return size.join(mean, "periodical").select("periodical", "n_papers", "top_k_mean", (m * (1 - w) + w * m / F.log1p("n_papers")).alias("enhanced_disruption"))


def network(background: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-08: nodes (id, type, n_references, disruption_index), edges (source cited, target citing)."""
    own = last_row(background, "id", "refs")
    nodes = own.join(scores.select("id", "d"), "id", "left").select("id", F.lit("paper").alias("type"), F.size("refs").alias("n_references"), F.col("d").alias("disruption_index"))
    return nodes, edges(background).select(F.col("dst").alias("source"), F.col("src").alias("target"))

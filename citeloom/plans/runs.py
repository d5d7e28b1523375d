"""Whole runs: from exports to rankings and files. Each takes tables with the export's column names and gives its results by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import parsing as P
from citeloom.operators import citation, diversity, entropy, ingest, novelty, ranking, themes
from citeloom.session import materialize
from citeloom.sources import readers, sinks

COLUMNS = {
    "id": "DOI", "periodical": "Source Title", "typed_year": "Publication Year", "typed_keywords": "Keywords", "typed_categories": "WoS Categories", "citing": "citing",
    "references": "Cited References", "abstract": "Abstract",
}


def papers(df: DataFrame) -> DataFrame:
    """Rows of an export under short names, absent columns and texts null, with year, row and row_no.

    A column `row_no` of the export gives the order of its rows; without one it is that in which Spark reads them.
    """
    known = {c: F.col(f"`{c}`") for c in df.columns}
    rows = df.select(*(known.get(c, F.lit(None)).cast("string").alias(n) for n, c in COLUMNS.items()), known.get("row_no", F.monotonically_increasing_id()).cast("bigint").alias("row"))
    gone = lambda c: F.when(~F.col(c).isin("", "nan"), F.col(c))
    return materialize(rows.withColumns({"id": gone("id"), "periodical": gone("periodical"), "year": P.year_of(F.col("typed_year")), "row_no": F.col("row")}))


def clean_export(spark: SparkSession, config: Mapping, folder: str) -> tuple[str, str]:
    """E1: source, aliases, DOIs of the reference texts, filters; writes the background and the target as CSV and returns their paths."""
    cleaning, source, aliases = ingest.Cleaning.from_config(config), config["data_source"], config["field_mapping"]
    kind = str(source.get("type", "")).lower()
    if kind == "excel":
        df = readers.read_excel_folder(spark, source["excel_dir"], aliases)
    elif kind == "database":
        df = readers.read_database(spark, source["database"], aliases)
    elif kind == "csv":
        df = readers.read_csv(spark, source["path"])
    elif kind == "parquet":
        df = readers.read_parquet(spark, source["path"])
    else:
        raise ValueError(f"unknown source {kind!r}")
    df = ingest.map_columns(df, aliases, list(aliases))
    missing = [c for c in ("Source Title", "Publication Year", "Cited References") if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing})
    df = df.withColumns({"citing": F.to_json(P.dois_of_text(F.col("Cited References"))), "periodical": F.col("Source Title"), "year": P.year_of(F.col("Publication Year"))})
    df = materialize(df)
    background, target = ingest.clean(df, cleaning, title="Source Title")
    paths = f"{folder}/background", f"{folder}/target"
    for out, path in zip((background, target), paths):
        sinks.write_large_csv(out.drop("periodical", "year", *missing), path)
    return paths


def disruption(background: DataFrame, target: DataFrame, top_k: int = 10, volume_weight: float = 0.4, null_keys: str = "match") -> dict[str, DataFrame]:
    """E2: scores of papers, both rankings, the citation network. The graph is built once."""
    rows, mine = (papers(df).withColumn("refs", P.refs_of_literal(F.col("citing"))) for df in (background, target))
    scores = materialize(citation.d_index(rows, mine))
    merged = materialize(citation.score_rows(mine, scores, null_keys))
    enhanced = citation.periodical_enhanced(merged, top_k, volume_weight).withColumn("percent_score", P.percent(F.col("enhanced_disruption"), 100))
    nodes, edges = citation.network(rows, scores)
    return {"scores": scores, "mean": ranking.ranked(citation.periodical_mean(merged), "disruption_mean"), "enhanced": ranking.ranked(enhanced, "enhanced_disruption"), "nodes": nodes, "edges": edges}


def pair_novelty(background: DataFrame, target: DataFrame, by_doi: bool = False, within: int = 1) -> dict[str, DataFrame]:
    """E3: timeline of the background's pairs, novelty of the target's papers, ranking; with `by_doi` papers are told by DOI and stop words left out."""
    rows, mine = papers(background), papers(target)
    last = novelty.reference_year(mine, 2024)
    if by_doi:
        parse = P.keywords_without_stops(F.col("typed_keywords"))
        rows, mine = (novelty.papers_by_doi(df.withColumn("keywords", parse)).withColumn("row", F.col("id")) for df in (rows, mine))
    else:
        rows, mine = (df.withColumn("keywords", P.keywords_by_first_separator(F.col("typed_keywords"))) for df in (rows, mine))
    first = materialize(novelty.timeline(rows))
    scored = materialize(novelty.paper_novelty(mine, first, last, within, absolute=by_doi).join(mine.select("row", "periodical"), "row"))
    means = novelty.periodical_novelty(scored, unknown=not by_doi).withColumn("percent_score", P.percent(F.col("novelty_mean"), 600))
    return {"timeline": first, "papers": scored, "ranking": ranking.ranked(means, "novelty_mean")}


def category_diversity(background: DataFrame, target: DataFrame) -> dict[str, DataFrame]:
    """E4, from the diversity of the references' categories: similarity, papers, ranking by the percent's mean."""
    rows, mine = papers(background), papers(target).withColumn("refs", P.refs_with_repeats(F.col("citing")))
    named = rows.withColumn("categories", P.categories_list(F.col("typed_categories"))).where(F.size("categories") > 0)
    known = materialize(citation.last_row(named, "id", "categories"))
    similarity = materialize(diversity.salton(diversity.category_counts(known, distinct=False, least=2)))
    z = diversity.shared(diversity.reference_categories(mine, known), similarity)
    scored = mine.select("row", "id", "periodical").join(z, "row", "left").withColumn("td", diversity.td_from_diversity(F.col("z"), F.col("n_categories")))
    scored = materialize(scored)
    return {"similarity": similarity, "papers": scored, "ranking": ranking.ranked(diversity.periodical_td(scored), "percent_mean")}


def category_similarity(background: DataFrame, target: DataFrame) -> dict[str, DataFrame]:
    """E4, from the similarity of whole categories of cited target papers, over the background of the target's periodicals."""
    rows, mine = papers(background), papers(target)
    own = mine.where("id is not null and typed_categories is not null").withColumn("bare", P.bare_doi(F.col("id"))).where("bare not in ('', 'nan')")
    names = citation.last_row(own, "bare", "typed_categories").select(F.col("bare").alias("id"), F.array(F.trim("typed_categories")).alias("categories"))
    chosen = ranking.of_periodicals(rows, mine, null_matches=True).select("row", "periodical", F.transform(P.refs_lenient(F.col("citing")), P.bare_doi).alias("refs"))
    found = materialize(diversity.reference_categories(chosen, names))
    sets = found.groupBy("row").agg(F.collect_list("category").alias("categories"))
    similarity = materialize(diversity.salton(diversity.category_counts(sets, distinct=True, least=1)))
    scored = materialize(chosen.select("row", "periodical").join(diversity.shared(found, similarity), "row", "left").withColumn("td", diversity.td_from_similarity(F.col("z"))))
    means = scored.where("periodical is not null").groupBy("periodical").agg(F.avg("td").alias("td_mean"))
    return {"similarity": similarity, "papers": scored, "ranking": ranking.ranked(means, "td_mean"), "categories": similarity.select(F.col("i").alias("category")).distinct().orderBy("category")}


def field_entropy(target: DataFrame, dictionary: DataFrame, source: str = "keywords", least: float = 0.75) -> dict[str, DataFrame]:
    """E5: fields of the terms of each paper, exactly or by similarity, their entropy, ranking. `dictionary` (field, term); terms of keywords, abstract or both."""
    rows = papers(target)
    typed = rows.select("row", P.keywords_by_comma_or_semicolon(F.col("typed_keywords")).alias("k"))
    top = themes.top_terms(rows.where("abstract is not null").select(F.col("row").alias("id"), F.col("abstract").alias("text")), k=15)
    words = top.groupBy(F.col("id").alias("row")).agg(F.collect_list("word").alias("a"))
    both = typed if source == "keywords" else typed.join(words, "row", "left")
    abstract = P.empty() if source == "keywords" else F.coalesce("a", P.empty())
    terms = materialize(both.select("row", F.explode(themes.terms_from(F.col("k"), abstract, source)).alias("keyword")))
    matches = materialize(entropy.match_fields(terms.select("keyword"), dictionary.select("field", F.lower("term").alias("term")), least))
    scored = materialize(entropy.entropy(entropy.field_shares(terms, matches)))
    means = entropy.periodical_entropy(rows.select("row", "periodical"), scored).withColumn("percent_score", P.percent(F.col("entropy_mean"), 500))
    return {"papers": scored, "ranking": ranking.ranked(means, "entropy_mean")}


def keyword_themes(target: DataFrame, min_papers: int = 5, k: int = 5, ask: Callable[[str], Iterable[str]] | None = None) -> dict[str, DataFrame]:
    """E6: the k most usual keywords of each periodical, and replies about them; nothing is asked without `ask`."""
    rows = papers(target).select("periodical", "row_no", P.keywords_of_themes(F.col("typed_keywords")).alias("keywords"))
    top = materialize(themes.top_keywords(themes.periodical_keywords(rows, min_papers), k))
    return {"keywords": top, "replies": themes.describe(themes.prompts(top), ask)}


def save(results: Mapping[str, DataFrame], folder: str, *, score: str | None = None, decimals: int | None = None) -> None:
    """The ranking of a run as CSV, list and chart; matrix, categories, network and themes where the run has them; everything else as Parquet."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    left = dict(results)
    for name in [n for n in ("ranking", "mean", "enhanced") if n in left]:
        table = left.pop(name).orderBy("rank")
        by = score or [c for c in table.columns if c not in ("rank", "periodical") and not c.startswith("n_")][0]
        sinks.write_csv(table, f"{folder}/{name}.csv", decimals)
        sinks.write_list(table, f"{folder}/{name}.txt")
        sinks.write_scores_json(table, f"{folder}/{name}.json", "periodical", by)
        sinks.write_bars(ranking.head(table, by, 20), f"{folder}/{name}.svg", "periodical", by, name)
    if "similarity" in left:
        sinks.write_matrix(left.pop("similarity"), f"{folder}/similarity.csv")
    if "categories" in left:
        sinks.write_csv(left.pop("categories"), f"{folder}/categories.csv")
    if "nodes" in left:
        sinks.write_network(left.pop("nodes"), left.pop("edges"), f"{folder}/network")
    if "replies" in left:
        words = left.pop("keywords").groupBy("periodical").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
        sinks.write_themes_json(words, f"{folder}/keywords.json", "target")
        sinks.write_themes_json(left.pop("replies"), f"{folder}/themes.json", "target")
    for name, table in left.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")

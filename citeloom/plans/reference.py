"""Queries of the bibliometric operators over the test tables; names and IDs follow the survey."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import parsing as P
from citeloom.functions.text import pick
from citeloom.operators import citation, diversity, entropy, ingest, novelty, ranking, themes
from citeloom.session import discard, materialize, work_dir
from citeloom.sources import readers, sinks

FIELDS = {
    "doi": "DOI", "title": "Source Title", "typed_year": "Publication Year", "typed_keywords": "Keywords", "typed_categories": "WoS Categories", "citing": "citing",
    "citations": "citations", "name": "Article Title", "abstract": "Abstract",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def background(spark: SparkSession, sf: str) -> DataFrame:
    """OP-73: rows of both exports; absent texts are null.

    `row_no` orders them, the earlier export first; `row` names a row of either export, twice its number
    there and one more in the later export.
    """
    old = pick(table(spark, sf, "target_data"), FIELDS | {"row_no": "row_no"})
    new = pick(table(spark, sf, "data_with_citing"), FIELDS | {"row_no": "record_id"})
    rows = old.withColumn("is_target", F.lit(True)).unionByName(new.withColumn("is_target", F.lit(False)), allowMissingColumns=True)
    gone = lambda c: F.when(~c.isin("", "nan"), c)
    return rows.withColumns({"id": gone(F.col("doi")), "periodical": gone(F.col("title")), "year": P.year_of(F.col("typed_year")),
        "row": 2 * F.col("row_no") + (~F.col("is_target")).cast("int"), "row_no": F.struct(~F.col("is_target"), "row_no"),
    })


def target(rows: DataFrame) -> DataFrame:
    return rows.where("is_target")


def r6(*names: str):
    return [F.round(F.col(c), 6).alias(c) for c in names]


# Parsers

def _parsed(column: str, parse, kind: str = "items"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return background(spark, sf).select("row", F.to_json(parse(F.col(column))).alias(kind))

    return run


keywords_parse_h = _parsed("typed_keywords", P.keywords_by_first_separator)
keywords_parse_i = _parsed("typed_keywords", P.keywords_without_stops)
keywords_parse_topic = _parsed("typed_keywords", P.keywords_by_comma_or_semicolon)
keywords_parse_theme = _parsed("typed_keywords", P.keywords_of_themes)
keywords_parse_notebook = _parsed("typed_keywords", lambda c: P.keywords_of_themes(c, "whole"))
categories_parse = _parsed("typed_categories", P.categories_list)
refs_parse = _parsed("citing", lambda c: F.array_sort(P.refs_of_literal(c)))
refs_parse_repeats = _parsed("citing", P.refs_with_repeats)
refs_parse_lenient = _parsed("citing", P.refs_lenient)
doi_extract = _parsed("citations", P.dois_of_text)


def doi_normalise(spark, sf):
    return background(spark, sf).where("id is not null").select("row", P.bare_doi(F.col("id")).alias("doi"))


def conference_filter(spark, sf):
    return background(spark, sf).where(~P.is_conference(F.col("title"))).select("row", "title")


def year_filter(spark, sf):
    return ranking.from_year(background(spark, sf), 2010).select("row", "year")


def text_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.clean_text(F.col("text")).alias("cleaned"))


def doc_top_terms(spark, sf):
    return themes.top_terms(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), k=15).withColumnRenamed("id", "doc_id")


def term_source_both(spark, sf):
    rows = background(spark, sf)
    top = themes.top_terms(rows.where("abstract is not null").select(F.col("row").alias("id"), F.col("abstract").alias("text")), k=15)
    words = top.groupBy(F.col("id").alias("row")).agg(F.collect_list("word").alias("a"))
    both = rows.select("row", P.keywords_by_comma_or_semicolon(F.col("typed_keywords")).alias("k")).join(words, "row", "left")
    return both.select("row", F.explode(themes.terms_from(F.col("k"), F.coalesce("a", P.empty()), "both")).alias("term"))


def label_truncation(spark, sf):
    return background(spark, sf).where("periodical is not null").select("periodical", P.shortened(F.col("periodical"), 28).alias("label")).distinct()


# Rows and periodicals

def union_by_name(spark, sf):
    return background(spark, sf).groupBy("is_target").agg(F.count("*").alias("n_rows"), F.count("id").alias("n_ids"))


def top_n_periodicals(spark, sf):
    return ranking.top_periodicals(background(spark, sf), 10)


def semi_join_target(spark, sf):
    rows = background(spark, sf)
    return ranking.of_periodicals(rows, target(rows), null_matches=True).select("row", "periodical")


def clean_pipeline(spark, sf):
    _, chosen = ingest.clean(background(spark, sf), ingest.Cleaning(min_year=2000, top_n=5))
    return chosen.groupBy("periodical").agg(F.count("*").alias("n_papers"), F.min("year").alias("first_year"))


def clean_listed(spark, sf):
    """OP-18: the target is the periodicals of a list, here those of the earlier export."""
    rows = background(spark, sf)
    listed = tuple(r[0] for r in target(rows).where("periodical is not null").select("periodical").distinct().collect())  # a configured list
    return ingest.clean(rows, ingest.Cleaning(drop_conference=False, target_periodicals=listed))[1].select("row", "periodical")


def csv_round_trip(spark, sf):
    """OP-01, OP-05, OP-13, OP-14: the export written as CSV under other names, read back and renamed."""
    other = {"DOI": "doi ", "Source Title": "Publication Title", "Keywords": "Author Keywords", "citing": "citing", "Publication Year": "Year"}
    path = f"{work_dir(spark)}/citeloom-csv-{uuid.uuid4().hex}"
    sinks.write_large_csv(table(spark, sf, "data_with_citing").select("record_id", *(F.col(f"`{a}`").alias(b) for a, b in other.items())), path)
    discard(spark, path)
    aliases = {"DOI": ["DOI", "doi"], "Source Title": ["Source Title", "Publication Title"], "Keywords": ["Keywords", "Author Keywords"], "Publication Year": ["Publication Year", "Year"], "citing": ["citing"]}
    back = readers.read_papers(readers.read_csv(spark, path), aliases)
    return back.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("DOI").alias("doi"), F.col("Source Title").alias("title"), F.col("Publication Year").alias("year"), F.col("Keywords").alias("keywords"), "citing")


def dup_doi_last_wins(spark, sf):
    return citation.last_row(background(spark, sf), "id", "typed_categories").select("id", F.col("typed_categories").alias("category"))


def first_row_per_doi(spark, sf):
    return citation.first_row(background(spark, sf), "id", "periodical")


# Citations

def _graph(spark, sf) -> DataFrame:
    return background(spark, sf).withColumn("refs", P.refs_of_literal(F.col("citing"))).select("id", "periodical", "row_no", "refs", "is_target")


def edges_explode(spark, sf):
    return citation.edges(_graph(spark, sf))


def citers_two_hop(spark, sf):
    rows = _graph(spark, sf)
    graph = citation.edges(rows)
    own = target(rows).where("id is not null").select("id").distinct()
    refs = graph.join(own, graph["src"] == own["id"]).select(F.col("id"), "dst")
    return refs.join(graph, "dst").select("id", "src").distinct().groupBy("id").agg(F.count("*").alias("n_around"))


def _scores(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _graph(spark, sf)
    return rows, citation.d_index(rows, target(rows))


def dindex_components(spark, sf):
    return _scores(spark, sf)[1].select("id", "ni", "nj", "nk")


def dindex_paper(spark, sf):
    return _scores(spark, sf)[1].select("id", *r6("d"))


def _periodical_rows(spark, sf, null_keys="skip") -> DataFrame:
    rows, scores = _scores(spark, sf)
    return citation.score_rows(target(rows), scores, null_keys)


def dindex_nulldoi_merge(spark, sf):
    return _periodical_rows(spark, sf, "match").groupBy("periodical").agg(F.count("*").alias("n_rows"), F.count("id").alias("n_ids"), F.round(F.avg("d"), 6).alias("mean_d"))


def periodical_disruption_mean(spark, sf):
    return citation.periodical_mean(_periodical_rows(spark, sf)).select("periodical", *r6("disruption_mean"), "paper_count")


def periodical_enhanced_topk(spark, sf):
    return citation.periodical_enhanced(_periodical_rows(spark, sf)).select("periodical", "n_papers", *r6("top_k_mean", "enhanced_disruption"))


def periodical_percent_rank(spark, sf):
    scores = citation.periodical_enhanced(_periodical_rows(spark, sf)).withColumn("percent_score", F.round(P.percent(F.col("enhanced_disruption"), 100), 4))
    return ranking.ranked(scores, "percent_score").select("rank", "periodical", "percent_score")


def ranking_summary(spark, sf):
    return ranking.summary(citation.periodical_mean(_periodical_rows(spark, sf)), "disruption_mean").select("n", *r6("mean", "std", "most", "least"))


def graph_nodes(spark, sf):
    rows, scores = _scores(spark, sf)
    return citation.network(rows, scores)[0].withColumn("disruption_index", F.round("disruption_index", 6))


def graph_edges(spark, sf):
    rows = _graph(spark, sf)
    return citation.network(rows, spark.createDataFrame([], "id string, d double"))[1]


# Novelty

def _keywords_h(spark, sf) -> DataFrame:
    return background(spark, sf).withColumn("keywords", P.keywords_by_first_separator(F.col("typed_keywords"))).select("row", "id", "periodical", "year", "keywords", "is_target")


def _keywords_i(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """Papers by DOI of all rows and of the target's, and the target's last year."""
    rows = background(spark, sf).withColumn("keywords", P.keywords_without_stops(F.col("typed_keywords"))).select("row", "row_no", "id", "periodical", "year", "keywords", "is_target")
    return novelty.papers_by_doi(rows), novelty.papers_by_doi(target(rows)).withColumn("row", F.col("id")), _last_year(target(rows))


def _last_year(rows: DataFrame) -> int:
    return novelty.reference_year(rows, 2024)


def pair_timeline(spark, sf):
    return novelty.timeline(_keywords_h(spark, sf))


def pair_timeline_recent(spark, sf):
    return novelty.timeline_report(novelty.timeline(_keywords_h(spark, sf)), since=2022)


def pair_timeline_earliest(spark, sf):
    return novelty.timeline_report(novelty.timeline(_keywords_h(spark, sf)))


def _novelty_h(spark, sf) -> DataFrame:
    rows = _keywords_h(spark, sf)
    return novelty.paper_novelty(target(rows), novelty.timeline(rows), _last_year(target(rows))).join(rows.select("row", "periodical"), "row")


def paper_novelty_h(spark, sf):
    return _novelty_h(spark, sf).select("row", "n_pairs", "n_novel", *r6("novelty"))


def periodical_novelty_h(spark, sf):
    out = novelty.periodical_novelty(_novelty_h(spark, sf), unknown=True)
    return out.select("periodical", *r6("novelty_mean", "novelty_std"), "n_papers", F.round(P.percent(F.col("novelty_mean"), 600), 4).alias("percent_score"))


def _novelty_i(spark, sf) -> DataFrame:
    every, mine, last = _keywords_i(spark, sf)
    return novelty.paper_novelty(mine, novelty.timeline(every), last, absolute=True).join(mine.select("row", "periodical"), "row")


def paper_novelty_i(spark, sf):
    return _novelty_i(spark, sf).select(F.col("row").alias("id"), "n_pairs", "n_novel", *r6("novelty"))


def periodical_novelty_i(spark, sf):
    return novelty.periodical_novelty(_novelty_i(spark, sf), unknown=False).select("periodical", *r6("novelty_mean"))


def novel_pair_drilldown(spark, sf):
    rows = _keywords_h(spark, sf)
    return novelty.drill_down(target(rows), novelty.timeline(rows), None, _last_year(target(rows)))


def keyword_corpus_stats(spark, sf):
    rows = background(spark, sf).select("year", P.keywords_by_first_separator(F.col("typed_keywords")).alias("keywords"), P.dois_of_text(F.col("citations")).alias("dois"))
    return novelty.corpus_stats(rows, novelty.timeline(rows))


# Diversity

def _categories(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Categories of each paper (the last row with any), and the targets' references."""
    rows = background(spark, sf).withColumns({"categories": P.categories_list(F.col("typed_categories")), "refs": P.refs_with_repeats(F.col("citing"))})
    named = rows.where(F.size("categories") > 0)
    return citation.last_row(named.select("id", "categories", "row_no"), "id", "categories"), target(rows).select("row", "periodical", "refs")


def cooc_in(spark, sf):
    return diversity.category_counts(_categories(spark, sf)[0], distinct=False, least=2)


def _td_in(spark, sf) -> DataFrame:
    papers, mine = _categories(spark, sf)
    similarity = diversity.salton(diversity.category_counts(papers, distinct=False, least=2))
    z = diversity.shared(diversity.reference_categories(mine, papers), similarity)
    return mine.select("row", "periodical").join(z, "row", "left")


def salton_similarity(spark, sf):
    return diversity.salton(diversity.category_counts(_categories(spark, sf)[0], distinct=False, least=2)).select("i", "j", *r6("s"))


def rao_stirling(spark, sf):
    rs = F.when(F.col("n_categories") > 1, 1 - F.col("z")).otherwise(0.0)
    return _td_in(spark, sf).select("row", F.round(rs, 6).alias("diversity"))


def td_in(spark, sf):
    return _td_in(spark, sf).select("row", F.round(diversity.td_from_diversity(F.col("z"), F.col("n_categories")), 4).alias("td"))


def periodical_td_in(spark, sf):
    rows = _td_in(spark, sf).withColumn("td", diversity.td_from_diversity(F.col("z"), F.col("n_categories"))).where("periodical is not null")
    return diversity.periodical_td(rows).select("periodical", *(F.round(c, 4).alias(c) for c in ("td_mean", "td_std", "percent_mean", "percent_std")), "n_papers")


def _ku(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Category of each target paper by bare DOI, whole text, last row; rows of target periodicals with bare references."""
    rows = background(spark, sf)
    own = target(rows).where("id is not null and typed_categories is not null").withColumn("bare", P.bare_doi(F.col("id")))
    names = citation.last_row(own, "bare", "typed_categories").select(F.col("bare").alias("id"), F.array(F.trim("typed_categories")).alias("categories"))
    refs = F.transform(P.refs_lenient(F.col("citing")), P.bare_doi)
    return names, ranking.of_periodicals(rows, target(rows), null_matches=True).select("row", "periodical", refs.alias("refs"))


def _ku_counts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    names, rows = _ku(spark, sf)
    found = materialize(diversity.reference_categories(rows, names))
    sets = found.groupBy("row").agg(F.collect_list("category").alias("categories"))
    return diversity.category_counts(sets, distinct=True, least=1), found, rows


def cooc_ku(spark, sf):
    return _ku_counts(spark, sf)[0]


def _td_ku(spark, sf) -> DataFrame:
    counts, found, rows = _ku_counts(spark, sf)
    z = diversity.shared(found, diversity.salton(counts))
    return rows.select("row", "periodical").join(z, "row", "left").withColumn("td", diversity.td_from_similarity(F.col("z")))


def td_ku(spark, sf):
    return _td_ku(spark, sf).select("row", *r6("td"))


def periodical_td_ku(spark, sf):
    return _td_ku(spark, sf).where("periodical is not null").groupBy("periodical").agg(F.round(F.avg("td"), 4).alias("td_mean"))


def similarity_matrix_wide(spark, sf):
    """All categories by all categories; column s<k> belongs to the category at place k, as spellings that differ in case can't name columns."""
    cells = materialize(diversity.salton(diversity.category_counts(_categories(spark, sf)[0], distinct=False, least=2)).select("i", "j", *r6("s")))
    names = diversity.names_of(cells)
    place = {n: k for k, n in enumerate(names)}
    numbered = spark.createDataFrame(list(place.items()), "category string, place int")
    columns = numbered.select(F.col("category").alias("j"), F.concat(F.lit("s"), "place").alias("column"))
    placed = cells.join(F.broadcast(columns), "j").select("i", F.col("column").alias("j"), "s")
    return diversity.wide(placed, [f"s{k}" for k in place.values()]).join(F.broadcast(numbered), "category")


# Entropy

def _field_rows(spark, sf) -> DataFrame:
    rows = background(spark, sf).select("row", F.array_distinct(P.keywords_by_comma_or_semicolon(F.col("typed_keywords"))).alias("ks"))
    return rows.select("row", F.explode_outer("ks").alias("keyword")).where("keyword is not null")


def _dictionary(spark, sf) -> DataFrame:
    return table(spark, sf, "field_terms").select("field", F.lower("term").alias("term"))


def field_match_exact(spark, sf):
    return entropy.match_exact(_field_rows(spark, sf).select("keyword"), _dictionary(spark, sf))


def field_match_fuzzy(spark, sf):
    return entropy.match_fields(_field_rows(spark, sf).select("keyword"), _dictionary(spark, sf))


def _shares(spark, sf) -> DataFrame:
    return entropy.field_shares(_field_rows(spark, sf), field_match_fuzzy(spark, sf))


def field_shares(spark, sf):
    return _shares(spark, sf).select("row", "field", "n", *r6("share"))


def paper_entropy(spark, sf):
    return entropy.entropy(_shares(spark, sf)).select("row", "n_fields", *r6("entropy"))


def periodical_entropy(spark, sf):
    out = entropy.periodical_entropy(background(spark, sf).select("row", "periodical"), entropy.entropy(_shares(spark, sf)))
    return out.select("periodical", *r6("entropy_mean", "fields_mean"), "n_papers", F.round(P.percent(F.col("entropy_mean"), 500), 3).alias("percent_score"))


# Themes

def _theme_counts(spark, sf) -> DataFrame:
    rows = background(spark, sf).select("periodical", "row_no", P.keywords_of_themes(F.col("typed_keywords")).alias("keywords"))
    return themes.periodical_keywords(rows, 5)


def periodical_keyword_counts(spark, sf):
    return _theme_counts(spark, sf).select("periodical", "keyword", "n")


def periodical_topk_keywords(spark, sf):
    return themes.top_keywords(_theme_counts(spark, sf), 5)


def theme_prompt(spark, sf):
    return themes.prompts(themes.top_keywords(_theme_counts(spark, sf), 5), "%s: %s").select("periodical", "keywords", "prompt")


NAMES = (
    "keywords_parse_h keywords_parse_i keywords_parse_topic keywords_parse_theme keywords_parse_notebook categories_parse refs_parse refs_parse_repeats refs_parse_lenient doi_extract doi_normalise "
    "conference_filter year_filter text_clean doc_top_terms term_source_both label_truncation union_by_name top_n_periodicals semi_join_target clean_pipeline clean_listed csv_round_trip dup_doi_last_wins first_row_per_doi "
    "edges_explode citers_two_hop dindex_components dindex_paper dindex_nulldoi_merge periodical_disruption_mean periodical_enhanced_topk periodical_percent_rank ranking_summary graph_nodes graph_edges "
    "pair_timeline pair_timeline_recent pair_timeline_earliest paper_novelty_h periodical_novelty_h paper_novelty_i periodical_novelty_i novel_pair_drilldown keyword_corpus_stats "
    "cooc_in salton_similarity rao_stirling td_in periodical_td_in cooc_ku td_ku periodical_td_ku similarity_matrix_wide "
    "field_match_exact field_match_fuzzy field_shares paper_entropy periodical_entropy periodical_keyword_counts periodical_topk_keywords theme_prompt"
).split()
QUERIES = {name: globals()[name] for name in NAMES}

"""Top keywords of periodicals and texts, prompts and replies (OP-30, OP-31, OP-64, OP-65, OP-78, OP-79)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.parsing import TEXT_STOPS, clean_text
from citeloom.operators.skew import attach


def periodical_keywords(papers: DataFrame, min_papers: int = 5) -> DataFrame:
    """OP-64: (periodical, keyword, n, first_seen) of periodicals with at least `min_papers` rows; rows (periodical, keywords, row_no)."""
    sizes = papers.where("periodical is not null").groupBy("periodical").agg(F.count("*").alias("n_papers")).where(F.col("n_papers") >= min_papers)
    words = papers.where("periodical is not null").select("periodical", "row_no", F.posexplode_outer("keywords").alias("pos", "keyword")).where("keyword is not null")
    counts = words.groupBy("periodical", "keyword").agg(F.count("*").alias("n"), F.min(F.struct("row_no", "pos")).alias("first_seen"))
    return attach(counts, sizes.select("periodical"), "periodical", "inner")


def top_keywords(counts: DataFrame, k: int = 5) -> DataFrame:
    """OP-65: (periodical, place, keyword, n): the k most frequent, ties by first occurrence."""
    place = F.row_number().over(Window.partitionBy("periodical").orderBy(F.desc("n"), "first_seen"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("periodical", "place", "keyword", "n")


def top_terms(texts: DataFrame, k: int = 20, least: int = 3, stops: tuple[str, ...] = TEXT_STOPS) -> DataFrame:
    """OP-30: (id, place, word, n): most frequent words of letters only in the cleaned text of rows (id, text), ties by first occurrence."""
    words = texts.select("id", F.posexplode(F.split(clean_text(F.col("text")), " ")).alias("pos", "word"))
    kept = words.where((F.char_length("word") >= least) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*stops))
    counts = kept.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("id", "place", "word", "n")


def terms_from(keywords: Column, abstract: Column, source: str) -> Column:
    """OP-31: terms by source `keywords`, `abstract` (both arrays) or `both`, without repeats."""
    if source not in ("keywords", "abstract", "both"):
        raise ValueError(source)
    return F.array_distinct({"keywords": keywords, "abstract": abstract, "both": F.concat(keywords, abstract)}[source])


def prompts(top: DataFrame, template: str = "Periodical: %s\nTop keywords: %s\nDescribe the periodical's theme in one sentence.") -> DataFrame:
    """OP-78: (periodical, keywords, prompt); k keywords a periodical, joined in order."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), ", ")
    return top.groupBy("periodical").agg(words.alias("keywords")).withColumn("prompt", F.format_string(template, "periodical", "keywords"))


def stream_text(lines: Iterable[str]) -> str:
    """OP-79: the text of a reply streamed as `data: ` lines; `[DONE]`, other and broken lines and null contents are skipped."""
    out = []
    for line in lines:
        if not line.startswith("data: ") or line[6:].strip() == "[DONE]":
            continue
        try:
            choices = json.loads(line[6:]).get("choices") or [{}]
            out.append((choices[0].get("delta") or {}).get("content") or "")
        except (ValueError, AttributeError):
            continue
    return "".join(out)


def describe(asked: DataFrame, ask: Callable[[str], Iterable[str]] | None = None) -> DataFrame:
    """(periodical, keywords, reply): `ask` gets a prompt and returns the reply's lines; errors come back as text.

    Without `ask` nothing is sent anywhere and the reply is a placeholder.
    """

    def run(batches):
        for frame in batches:
            replies = []
            for prompt in frame["prompt"]:
                try:
                    replies.append(stream_text(ask(prompt)) if ask else "no description")
                except Exception as e:
                    replies.append(f"error: {e}")
            yield frame[["periodical", "keywords"]].assign(reply=replies)

    return asked.select("periodical", "keywords", "prompt").mapInPandas(run, "periodical string, keywords string, reply string")

"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.packed import CATEGORIES, KEYWORDS, split_packed
from citeloom.functions.text import pick, plain_form
from citeloom.llm.cooccurrence import cooccurrence
from citeloom.llm.dedup import collapse_copies, copy_pairs
from citeloom.llm.mapping import map_values
from citeloom.llm.mixing import mix
from citeloom.llm.term_frequency import marked, term_frequencies
from citeloom.llm.tokenizer import decoded, encode_corpus, public_vocabulary, token_counts
from citeloom.llm.visual import alike_pairs, one_form
from citeloom.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return copy_pairs(table(spark, sf, "data_with_citing"))


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapse_copies(table(spark, sf, "data_with_citing"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return map_values(table(spark, sf, "data_with_citing"), table(spark, sf, "field_terms"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).where(~F.col("exact")).select("record_id", "pos", "term_id")


def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that stand for no term, and how often each stands."""
    return _mapped(spark, sf).where("term_id = -1").groupBy("plain").agg(F.count("*").alias("n_values"))


def _item_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(field_name, items): distinct plain forms of each row and field."""
    rows = pick(table(spark, sf, "data_with_citing"), {"k": "Keywords", "c": "WoS Categories"})
    rows = split_packed(split_packed(rows, "k", "ks", KEYWORDS), "c", "cs", CATEGORIES)
    plain = lambda c: F.array_distinct(F.transform(c, plain_form))
    fields = F.array(
        F.struct(F.lit("Keywords").alias("field_name"), plain("ks").alias("items")),
        F.struct(F.lit("WoS Categories").alias("field_name"), plain("cs").alias("items")),
    )
    return materialize(rows.select(F.explode(fields).alias("f")).select("f.field_name", "f.items"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence(_item_rows(spark, sf), min_rows=3, min_share=0.0025)
    return pairs.where("n_ab * n >= 6 * n_a * n_b").select("field_name", "item_a", "item_b")


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair with its counts, ratio to chance and log-likelihood."""
    pairs = cooccurrence(_item_rows(spark, sf))
    return pairs.withColumns({"ratio": F.round("ratio", 6), "llr": F.round("llr", 4)})


def _keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_packed(pick(table(spark, sf, "data_with_citing"), {"id": "record_id", "k": "Keywords"}), "k", "ks", KEYWORDS)
    return rows.select("id", F.transform("ks", plain_form).alias("terms"))


def _keyword_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """The empty term stands for all rows that hold any keyword; no value has an empty plain form."""
    rows = _keyword_rows(spark, sf)
    held = F.when(F.size("terms") > 0, F.concat(F.array(F.lit("")), "terms")).otherwise(F.col("terms"))
    found = materialize(term_frequencies(rows.select("id", held.alias("terms"))))
    total = found.where("term = ''").select("n_rows").first()
    return marked(found.where("term <> ''"), total[0] if total else 0)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_frequencies(spark, sf).where("mark is not null").select(F.col("term").alias("keyword"), "mark")


def p6_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_frequencies(spark, sf).select(F.col("term").alias("keyword"), "occurrences", "n_rows", "mark")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether decoding their ids gives the text back."""
    path, pattern = public_vocabulary()
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode_corpus(docs).withColumn("back", decoded(F.col("ids"), path, pattern))
    return ids.join(docs, "doc_id").groupBy((F.col("back") == F.col("text")).alias("same")).agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path, pattern = public_vocabulary()
    return mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"), lambda text: token_counts(text, path, pattern))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_mix_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return alike_pairs(table(spark, sf, "documents"))


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    return one_form(table(spark, sf, "documents")).select("doc_id", "form")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_collapsed, p3_found, p3_unmatched, p4_found, p4_pairs, p6_found, p6_frequencies, p8_ids, p8_round_trip, p9_mix, p9_mix_documents, p10_found, p10_forms)
}

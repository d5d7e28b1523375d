"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citations import with_cited_keys
from citeloom.functions.text import doi_key, pick
from citeloom.llm.pairs import class_pairs, hot_keys, salt
from citeloom.operators.skew import lookup
from citeloom.session import materialize


def canonical_rows(df: DataFrame, id_column: str = "record_id", doi_column: str = "DOI", refs_column: str = "citing") -> DataFrame:
    """(id, key BINARY): what is left of a row when spelling and order don't count.

    The key is the SHA-256 of the doi_key and the sorted set of cited keys; null for a row without a
    DOI. Rows whose lists differ only in order, repetition, layout or spelling get the same key.
    """
    rows = with_cited_keys(pick(df, {"id": id_column, "doi": doi_column, "refs": refs_column}), "refs", "keys")
    whole = F.concat_ws("\n", doi_key(F.col("doi")), F.array_join(F.array_sort("keys"), "\n"))
    return rows.select("id", F.when(doi_key(F.col("doi")).isNotNull(), F.unhex(F.sha2(whole, 256))).alias("key"))


def collapse(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, record_id, n_copies): one row per class, represented by its least id.

    Hot keys are salted into a two-level aggregation, all others take one shuffle. Rows with a null
    key stand for themselves. Null ids count as copies but never represent others.
    """
    few = F.broadcast(hot)  # at most `skew.most_heavy` rows
    size, first = F.count("*").alias("n_copies"), F.min("id").alias("record_id")
    salted = rows.join(few, "key", "left_semi").withColumn("salt", salt())
    hot_classes = salted.groupBy("key", "salt").agg(size, first).groupBy("key").agg(F.sum("n_copies").alias("n_copies"), F.min("record_id").alias("record_id"))
    rest = rows.where("key is not null").join(few, "key", "left_anti").groupBy("key").agg(size, first)
    alone = rows.where("key is null").select("key", F.lit(1).cast("bigint").alias("n_copies"), F.col("id").alias("record_id"))
    return hot_classes.unionByName(rest).unionByName(alone).select("key", "record_id", "n_copies")


def collapse_copies(df: DataFrame, **columns: str) -> DataFrame:
    """(record_id, n_copies): every record once, with the number of rows it stood for."""
    rows = materialize(canonical_rows(df, **columns))
    return collapse(rows, hot_keys(rows)).select("record_id", "n_copies")


def copy_pairs(df: DataFrame, **columns: str) -> DataFrame:
    """(record_id_a, record_id_b), a < b: every two rows of one class.

    The operator's result is the classes; pairs are formed last, and the caller asks for them all. The
    rows of hot classes never meet in one task: they find their class by broadcast and pair in salted parts.
    Rows with a null id are in no pair.
    """
    rows = materialize(canonical_rows(df, **columns))
    hot = hot_keys(rows)
    classes = collapse(rows, hot).where("n_copies > 1 and key is not null").select("key")
    members = materialize(lookup(rows.where("id is not null"), classes, "key", "inner", heavy=hot))
    return class_pairs(members, hot, "record_id_a", "record_id_b")

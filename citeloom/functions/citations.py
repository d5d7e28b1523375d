"""Cited papers of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.packed import REFERENCES, Layout, split_packed
from citeloom.functions.text import doi_key_or_empty


def with_cited_keys(df: DataFrame, column: str, out: str, layout: Layout = REFERENCES) -> DataFrame:
    """Add `out`: the distinct doi_keys among the values packed in `column`, in order of first place.

    Values without a DOI are left out; null, empty and `[]` give an empty array.
    """
    df = split_packed(df, column, "__cited", layout)
    keys = F.transform("__cited", doi_key_or_empty)
    return df.withColumn(out, F.array_distinct(F.filter(keys, lambda k: k != ""))).drop("__cited")

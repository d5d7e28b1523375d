"""Pairs within classes, also where a class holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import heavy_keys

#: A hot key has more than one part in so many of all rows, or in twice as many as there are shuffle partitions.
HOT_KEYS = 1000
SALTS = 64


def salt(column: str = "id"):
    """A place by the column, or by the row where it is null."""
    return F.pmod(F.when(F.col(column).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(column)), F.lit(SALTS)).cast("int")


def hot_keys(rows: DataFrame) -> DataFrame:
    """(key): exactly the hot keys, from counts combined before the shuffle."""
    return heavy_keys(rows, least=HOT_KEYS)


def class_pairs(members: DataFrame, hot: DataFrame, a: str, b: str, differ: str | None = None) -> DataFrame:
    """(a, b), a < b: ids of every two members (key, id) of one class, with different `differ` if given.

    A class of g rows has up to g (g - 1) / 2 pairs; the caller asks for them all. Pairs of hot classes
    are formed in SALTS parts: each row goes to one part on the left and to all on the right.
    """
    few = F.broadcast(hot)

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        left = left.withColumnRenamed("id", a)
        right = right.withColumnRenamed("id", b)
        if differ:
            left, right = left.withColumnRenamed(differ, "x"), right.withColumnRenamed(differ, "y")
        met = left.join(right, on).where(F.col(a) < F.col(b))
        return (met.where("x <> y") if differ else met).select(a, b)

    rest = members.join(few, "key", "left_anti")
    large = members.join(few, "key", "left_semi")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return pairs(rest, rest, ["key"]).unionByName(pairs(large.withColumn("salt", salt()), large.withColumn("salt", parts), ["key", "salt"]))

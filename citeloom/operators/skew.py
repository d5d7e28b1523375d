"""Per-key results when a few keys hold most rows.

Value-frequency compression: rows are grouped by key and value before key. A hot key is thereby
spread over its values, equal pairs are combined before the shuffle, and every result that follows
is derived from weighted values: exact distinct counts, sums, modes and percentiles.

For joins the keys that hold most rows are found exactly (`heavy_keys`) and taken another way than the
rest (`lookup`, `spread_join`), so that neither needs the planner to notice them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.session import materialize

#: A heavy key holds more than one part in so many of all rows, so there are fewer heavy keys than that.
HEAVY_KEYS = 1000
#: The rows of a heavy key are spread over SIDE x SIDE tasks where two large sides meet.
SIDE = 8


def most_heavy(spark: SparkSession, least: int | None = None) -> int:
    """How many heavy keys there may be: `least` (HEAVY_KEYS), or twice the shuffle partitions, so that a key that isn't heavy has less than half a partition's share of the rows."""
    return max(HEAVY_KEYS if least is None else least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(rows: DataFrame, key: str = "key", least: int | None = None, weight: str | None = None) -> DataFrame:
    """(key): exactly the non-null keys with more than their part of all rows, or of all `weight`, from counts combined before the shuffle."""
    size = F.count("*") if weight is None else F.sum(weight)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(size.alias("n"))
    n_rows = rows.agg(size).first()[0] or 0
    return materialize(counts.where(F.col("n") > max(n_rows / most_heavy(rows.sparkSession, least), 1)).select(key))


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", heavy: DataFrame | None = None) -> DataFrame:
    """`rows` with the columns of `table`, which has one row per key; `how` is left or inner.

    Rows with a heavy key, of which there are at most `most_heavy`, meet their answers in a broadcast and
    stay where they are; the others are shuffled. Rows with a null key have no answer and aren't shuffled.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    few = F.broadcast(heavy_keys(rows, key) if heavy is None else heavy)
    answers = F.broadcast(table.join(few, key, "left_semi"))
    known = rows.where(F.col(key).isNotNull())
    out = known.join(few, key, "left_semi").join(answers, key, how).unionByName(known.join(few, key, "left_anti").join(table, key, how))
    return out if how == "inner" else out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


#: A table of so many rows, one per key, is broadcast whole.
SMALL = 1_000_000


def attach(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """As `lookup`; a table of at most SMALL rows is broadcast whole, so that nothing is shuffled."""
    table = materialize(table)
    return rows.join(F.broadcast(table), key, how) if table.count() <= SMALL else lookup(rows, table, key, how)


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None = None) -> DataFrame:
    """Inner join of two sides that may both hold many rows of one key.

    The pairs of a key that is heavy on either side are formed in SIDE x SIDE parts: each row has a place
    on its side and goes to all places of the other. All other keys take a plain join.
    """
    heavy = heavy_keys(left.select(key).unionByName(right.select(key)), key) if heavy is None else heavy
    few = F.broadcast(heavy)
    places = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    place = lambda side: F.pmod(F.xxhash64(*(c for c in side.columns if c != key), F.lit(0)), F.lit(SIDE)).cast("int")
    large = left.join(few, key, "left_semi").withColumn("__a", place(left)).withColumn("__b", places)
    other = right.join(few, key, "left_semi").withColumn("__b", place(right)).withColumn("__a", places)
    rest = left.join(few, key, "left_anti").join(right.join(few, key, "left_anti"), key)
    return rest.unionByName(large.join(other, [key, "__a", "__b"]).drop("__a", "__b"))


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight BIGINT): how often each value stands with each key; null is a key and a value of its own."""
    return df.groupBy(key.alias("key"), value.alias("value")).agg(F.count("*").alias("weight"))


def key_stats(weighted: DataFrame) -> DataFrame:
    """(key, n_rows, n_values, top_value, top_weight): rows, distinct non-null values, the mode and its rows.

    The mode is over non-null values; of equal ones the smallest value wins. A key with null values
    only has n_values 0 and a null mode.
    """
    # The least struct is the value with the greatest weight, of equal ones the smallest value.
    ranked = F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))
    per = weighted.groupBy("key").agg(
        F.sum("weight").alias("n_rows"), F.count("value").alias("n_values"), F.min(F.when(F.col("value").isNotNull(), ranked)).alias("top")
    )
    return per.select("key", "n_rows", "n_values", F.col("top.v").alias("top_value"), (-F.col("top.w")).alias("top_weight"))


def key_sums(weighted: DataFrame) -> DataFrame:
    """(key, total DOUBLE, mean DOUBLE, low, high) of numeric values; nulls don't count, a key without values has nulls."""
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    x = F.col("value").cast("double")
    per = weighted.groupBy("key").agg(F.sum(x * w).alias("total"), F.sum(w).alias("w"), F.min("value").alias("low"), F.max("value").alias("high"))
    return per.select("key", "total", F.try_divide("total", "w").alias("mean"), "low", "high")


def _place(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts lie below x, by halving."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    below = _place(x, cuts[:mid])
    return F.when(x > cuts[mid], _place(x, cuts[mid + 1 :]) + (mid + 1)).otherwise(below)


def key_percentile(weighted: DataFrame, p: float, parts: int = 256) -> DataFrame:
    """(key, percentile): per key the smallest value whose cumulative weight reaches `p` of the key's non-null rows.

    Exact. Values are first cut into at most `parts` ranges, the same for all keys; per key only the
    ranges' weights are accumulated, and then the values of the one range that holds the answer. So
    no task gets all values of a key.
    """
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    held = weighted.where("value is not null").withColumn("x", F.col("value").cast("double"))
    cuts = held.agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = _place(F.col("x"), cuts)
    held = held.withColumn("part", part)
    ranges = held.groupBy("key", "part").agg(F.sum("weight").alias("w"))
    by_key = Window.partitionBy("key")
    upto = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("w").over(upto), F.lit(0)), "need": F.ceil(F.round(F.sum("w").over(by_key) * F.lit(p), 6))})
    ranges = ranges.where("before < need and before + w >= need").select(F.col("key").alias("k"), F.col("part").alias("r"), "before", "need")
    inside = held.join(ranges, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("r")))
    run = Window.partitionBy("key", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.sum("weight").over(run) + F.col("before"))
    return inside.where("run >= need").groupBy("key").agg(F.min("x").alias("percentile"))

import datetime as dt
import random
from collections import Counter, defaultdict
from statistics import median_low

import pytest
from pyspark.sql import functions as F

from citeloom.operators import orphans, skew

T = dt.datetime


def states(spark, papers, old=(), gone=()):
    p = spark.createDataFrame([(i, d, c, t, "x") for i, d, c, t in papers], "record_id long, DOI string, citing string, loaded_at timestamp, state string")
    o = spark.createDataFrame([(d,) for d in old], "DOI string")
    g = spark.createDataFrame([(d,) for d in gone], "DOI string")
    return orphans.orphan_references(p, o, g)


def test_states(spark):
    rows = [
        (1, "10.1/a", "10.1/b; 10.1/c; 10.1/d; 10.1/e; 10.1/E.; in press", T(2021, 1, 5)),
        (2, "10.1/b", None, T(2021, 2, 1)),
        (3, "10.1/c", "[]", T(2020, 12, 1)),
        (4, "10.1/c", "10.1/a", T(2022, 1, 1)),
        (5, "nan", "10.1/b", None),
        (6, "10.1/f", "10.1/f", None),
        (7, None, "10.1/f", T(2000, 1, 1)),
    ]
    got = {(r.id, r.cited_doi, r.state) for r in states(spark, rows, old=["doi:10.1/D", None], gone=["10.1/C", ""]).collect()}
    assert got == {(1, "101b", "late"), (1, "101c", "withdrawn"), (1, "101e", "missing")}


def test_repeated_and_empty(spark):
    rows = 2 * [(1, "10.1/a", "10.1/zz", T(2021, 1, 5))]
    got = states(spark, rows)
    assert got.count() == 2
    assert orphans.orphan_counts(got).collect() == [("data_with_citing", "2021-01", "missing", 2)]
    assert states(spark, []).count() == 0


def test_heavy_keys_go_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HEAVY_KEYS", 3)
    rows = [(i, f"10.1/p{i}", f"10.1/hub; 10.1/p{i + 1}", T(2021, 1, 1) + dt.timedelta(days=i)) for i in range(60)]
    got = Counter(r.state + ("*" if r.cited_doi == "101hub" else "") for r in states(spark, rows).collect())
    assert got == {"missing*": 60, "late": 59, "missing": 1}


@pytest.mark.parametrize("p", [0.1, 0.5, 0.9, 1.0])
def test_key_results_against_brute_force(spark, p):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.choice([None, *range(-20, 40)])) for _ in range(3000)] + [(None, 7), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    weighted = skew.compress(df, F.col("k"), F.col("v"))
    held = defaultdict(list)
    for k, v in rows:
        held[k] += [v] if v is not None else []
    stats = {r.key: (r.n_rows, r.n_values, r.top_value) for r in skew.key_stats(weighted).collect()}
    for k, vs in held.items():
        top = min(Counter(vs).items(), key=lambda x: (-x[1], x[0]), default=(None, 0))[0]
        assert stats[k] == (sum(a == k for a, _ in rows), len(set(vs)), top)
    sums = {r.key: r.total for r in skew.key_sums(weighted).collect()}
    assert all(sums[k] == (sum(vs) if vs else None) for k, vs in held.items())
    got = {r.key: r.percentile for r in skew.key_percentile(weighted, p, parts=7).collect()}
    want = {k: float(sorted(vs)[-(-int(round(p * 1000)) * len(vs) // 1000) - 1]) for k, vs in held.items() if vs}
    assert got == want


def test_percentile_of_nothing(spark):
    none = skew.compress(spark.createDataFrame([], "k string, v int"), F.col("k"), F.col("v"))
    assert skew.key_percentile(none, 0.5).count() == 0 and skew.key_stats(none).count() == 0
    with pytest.raises(ValueError):
        skew.key_percentile(none, 0)


def test_lookups_and_joins_with_one_key_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_KEYS", 2)
    rng = random.Random(2)
    left = [("hot" if rng.random() < 0.9 else rng.choice([None, *"abcdefgh"]), i) for i in range(500)]
    right = [("hot" if rng.random() < 0.5 else rng.choice([None, *"abcxyz"]), -i) for i in range(80)]
    a, b = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    assert {r[0] for r in skew.heavy_keys(a, "k").collect()} == {"hot"}
    want = Counter((k, x, y) for k, x in left for q, y in right if k is not None and k == q)
    assert Counter(map(tuple, skew.spread_join(a, b, "k").select("k", "x", "y").collect())) == want
    table = {k: y for k, y in right if k is not None}
    one = spark.createDataFrame(list(table.items()), "k string, y int")
    got = Counter((r.k, r.x, r.y) for r in skew.lookup(a, one, "k").collect())
    assert got == Counter((k, x, table.get(k)) for k, x in left)
    assert skew.lookup(a, one, "k", "inner").count() == sum(k in table for k, _ in left)
    assert skew.lookup(a.limit(0), one, "k").count() == skew.spread_join(a, b.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        skew.lookup(a, one, "k", "right")


def test_no_task_gets_most_rows_of_a_hot_key(spark):
    """Without AQE, one key in 90 % of the rows: the joined rows are spread over the tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
        b = spark.range(400).select(F.when(F.col("id") % 10 < 5, F.lit(0)).otherwise(F.col("id") * 10 + 9).alias("k"), F.col("id").alias("y"))
        sizes = [r[1] for r in skew.spread_join(a, b, "k").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) >= 18_000 * 200 and max(sizes) < sum(sizes) / 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("held", [3, 10**6])
def test_counts_from_counts(spark, monkeypatch, held):
    monkeypatch.setattr(orphans, "HEAVY_KEYS", 3)
    monkeypatch.setattr(orphans, "HELD", held)
    rng = random.Random(11)
    day = lambda: rng.choice([None, T(2021, 1, 1) + dt.timedelta(hours=rng.randint(0, 3000))])
    rows = [(n, rng.choice([None, "", *(f"10.1/p{k}" for k in range(20))]), "; ".join(["10.1/hub"] * (rng.random() < 0.6) + [f"10.1/p{rng.randint(0, 30)}" for _ in range(rng.randint(0, 4))]), day()) for n in range(200)]
    rows += [(900, "10.1/hub", None, T(2021, 3, 15, 12))] + rows[:3]
    df = spark.createDataFrame(rows, "record_id long, DOI string, citing string, loaded_at timestamp")
    o, g = spark.createDataFrame([("10.1/p3",)], "DOI string"), spark.createDataFrame([("10.1/p4",), ("10.1/p29",)], "DOI string")
    want = Counter({tuple(r)[:3]: r.n_refs for r in orphans.orphan_counts(orphans.orphan_references(df, o, g)).collect()})
    assert Counter({tuple(r)[:3]: r.n_refs for r in orphans.orphan_period_counts(df, o, g).collect()}) == want and len(want) > 8
    assert orphans.orphan_period_counts(df.limit(0), o, g).count() == 0

"""References to records that don't exist."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.citations import with_cited_keys
from citeloom.functions.text import doi_key, pick
from citeloom.operators.skew import attach, heavy_keys
from citeloom.session import materialize

#: A heavy key has more than one part in so many of all references, or in twice as many as there are shuffle partitions.
HEAVY_KEYS = 1000
#: (key, month) pairs that a task holds before it hands their counts on.
HELD = 1_000_000


def _status(papers: DataFrame, earlier: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(key, first_loaded, earlier, withdrawn): what is known of each key; one shuffle, combined before it."""
    never, always = F.lit(None).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")
    rows = (
        papers.select(doi_key(F.col("doi")).alias("key"), F.coalesce("at", always).alias("first_loaded"), F.lit(False).alias("earlier"), F.lit(False).alias("withdrawn"))
        .unionByName(earlier.select(doi_key(F.col("doi")).alias("key"), never.alias("first_loaded"), F.lit(True).alias("earlier"), F.lit(False).alias("withdrawn")))
        .unionByName(withdrawn.select(doi_key(F.col("doi")).alias("key"), never.alias("first_loaded"), F.lit(False).alias("earlier"), F.lit(True).alias("withdrawn")))
    )
    return rows.where("key is not null").groupBy("key").agg(F.min("first_loaded").alias("first_loaded"), F.max("earlier").alias("earlier"), F.max("withdrawn").alias("withdrawn"))


def _earlier() -> Column:
    return F.coalesce("earlier", F.lit(False))


def _state_of() -> Column:
    known = _earlier() | F.col("first_loaded").isNotNull()
    return (
        F.when(F.coalesce("withdrawn", F.lit(False)), "withdrawn")
        .when(~known, "missing")
        .when(~_earlier() & (F.col("first_loaded") > F.col("at")), "late")
    )


def _state(refs: DataFrame) -> DataFrame:
    return refs.withColumn("state", _state_of()).where("state is not null").select("table_name", "id", "at", F.col("key").alias("cited_doi"), "state")


def orphan_references(papers: DataFrame, earlier: DataFrame, withdrawn: DataFrame, *, table_name: str = "data_with_citing", id_column: str = "record_id", doi_column: str = "DOI", refs_column: str = "citing", time_column: str = "loaded_at") -> DataFrame:
    """(table_name, id, at, cited_doi, state): each distinct cited key of each row that leads nowhere.

    `withdrawn`: listed in `withdrawn`, whatever the dates. `missing`: in neither `papers` nor
    `earlier`. `late`: not in `earlier`, and all rows of `papers` with it were loaded after the
    citing row.

    Method, against keys that hold a large part of all references: references are first counted per
    key and period (combined before the shuffle). Keys with more than 1/HEAVY_KEYS of all
    references, hence at most HEAVY_KEYS, are looked up once and their answer is broadcast to the
    references; the references of all other keys are shuffled to the table of known keys. Both
    results are united. No reference is dropped on either way.

    A paper with a null load time counts as there from the start; a citing row with a null load time
    is never late. Null, empty and unreadable reference fields give no row. Repeated rows come out
    as often as they stand. Empty tables are allowed. Other columns aren't read.
    """
    refs, status = _references(papers, earlier, withdrawn, id_column, doi_column, refs_column, time_column)
    refs = materialize(refs.withColumn("table_name", F.lit(table_name)))  # read twice below; splitting the fields is the dearest step
    heavy = heavy_keys(refs, least=HEAVY_KEYS)
    heavy_status = F.broadcast(F.broadcast(heavy).join(status, "key", "left"))
    light = refs.join(F.broadcast(heavy), "key", "left_anti").join(status, "key", "left")
    return _state(refs.join(heavy_status, "key")).unionByName(_state(light))


def _references(papers, earlier, withdrawn, id_column, doi_column, refs_column, time_column) -> tuple[DataFrame, DataFrame]:
    """(id, at, key) of all references, and what is known of each key."""
    source = pick(papers, {"id": id_column, "doi": doi_column, "refs": refs_column, "at": time_column})
    status = _status(source.select("doi", "at"), pick(earlier, {"doi": doi_column}), pick(withdrawn, {"doi": doi_column}))
    refs = with_cited_keys(source.select("id", "refs", "at"), "refs", "keys").select("id", "at", F.explode_outer("keys").alias("key")).where("key is not null")
    return refs, status


def _per_period(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, period) to the task's counts of them."""
    names = ["key", "period", "n"]
    held: list[pa.Table] = []

    def counted() -> pa.Table:
        both = pa.concat_tables(held).group_by(names[:2], use_threads=False).aggregate([("n", "sum")])
        return both.select(["key", "period", "n_sum"]).rename_columns(names)

    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(names[:2], use_threads=False).aggregate([([], "count_all")])
        held.append(table.select(["key", "period", "count_all"]).rename_columns(names))
        if sum(t.num_rows for t in held) > HELD:
            held = [counted()]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from counted().to_batches()


def orphan_period_counts(papers: DataFrame, earlier: DataFrame, withdrawn: DataFrame, *, table_name: str = "data_with_citing", id_column: str = "record_id", doi_column: str = "DOI", refs_column: str = "citing", time_column: str = "loaded_at") -> DataFrame:
    """(table_name, period, state, n_refs): as `orphan_counts` of `orphan_references`, without forming its rows.

    References are counted per key and month in each task, before any shuffle. The counts of heavy keys
    meet what is known of them in a broadcast, all others are shuffled to it, and both orphan counts are
    united. A month before that of a key's first load is late as a whole; only references of that very
    month are looked at one by one.
    """
    refs, status = _references(papers, earlier, withdrawn, id_column, doi_column, refs_column, time_column)
    refs = materialize(refs.select("key", "at", F.trunc("at", "month").alias("period")))
    groups = materialize(refs.select("key", "period").mapInArrow(_per_period, "key string, period date, n bigint"))
    heavy = F.broadcast(heavy_keys(groups, least=HEAVY_KEYS, weight="n"))
    met = groups.join(heavy, "key", "left_semi").join(F.broadcast(status.join(heavy, "key", "left_semi")), "key", "left")
    met = materialize(met.unionByName(groups.join(heavy, "key", "left_anti").join(status, "key", "left")))  # read twice below

    # A month's counts have the state of its first day; the month of the first load is taken apart.
    first = F.trunc("first_loaded", "month")
    here = F.coalesce(~_earlier() & ~F.coalesce("withdrawn", F.lit(False)) & (F.col("period") == first), F.lit(False))
    whole = met.withColumns({"at": F.when(~here, F.col("period").cast("timestamp")), "first_loaded": F.when(F.col("first_loaded").isNotNull(), first.cast("timestamp"))})
    counts = whole.withColumn("state", _state_of()).where("state is not null").groupBy("period", "state").agg(F.sum("n").alias("n_refs"))
    split = attach(refs, met.where(here).select("key", "first_loaded").distinct(), "key", "inner").where((F.col("period") == first) & (F.col("first_loaded") > F.col("at")))
    late = split.groupBy("period").agg(F.count("*").alias("n_refs")).withColumn("state", F.lit("late"))
    both = counts.unionByName(late).groupBy("period", "state").agg(F.sum("n_refs").alias("n_refs"))
    return both.select(F.lit(table_name).alias("table_name"), F.date_format("period", "yyyy-MM").alias("period"), "state", "n_refs")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(table_name, period, state, n_refs): orphan references per table and month of the citing row's load time; rows without one count under a null period."""
    period = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    return orphans.groupBy("table_name", period.alias("period"), "state").agg(F.count("*").alias("n_refs"))

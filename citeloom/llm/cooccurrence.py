"""Items that appear together, by stripes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import lookup
from citeloom.session import materialize

#: A partition's associative arrays are handed on when they hold this many entries.
ENTRIES = 2_000_000
#: Neighbours in one row of a long stripe, and rows that are handed on together; a batch thereby stays small.
PART, ROWS = 256, 10_000
#: The neighbours of one item are spread over so many stripes, so that no stripe holds all of a frequent item's.
BLOCKS = 16
STRIPE = "field_name string, item_a string, block int, neighbours array<string>, counts array<bigint>"
PAIR = "field_name string, item_a string, item_b string, n_ab bigint"


def _pairs_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All (earlier, later) code pairs within each row, as one integer each; rows of equal length are done together."""
    sizes = np.diff(offsets)
    out = [np.empty(0, np.int64)]
    for n in np.unique(sizes[sizes > 1]):
        starts = offsets[:-1][sizes == n]
        step = max(1, ENTRIES // (n * n))
        i, j = np.triu_indices(n, 1)
        for k in range(0, len(starts), step):
            rows = codes[starts[k : k + step, None] + np.arange(n)]
            out.append(((rows[:, i] << 32) | rows[:, j]).ravel())
    return np.concatenate(out)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _stripes(field: str, keys: np.ndarray, counts: np.ndarray, names: pa.Array, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per item and block: its neighbours and how often each stood beside it; long ones in rows of PART neighbours."""
    a, b = keys >> 32, keys & 0xFFFFFFFF
    block = blocks[b]
    order = np.lexsort((b, block, a))
    a, b, block, counts = a[order], b[order], block[order], counts[order]
    starts = np.r_[True, (a[1:] != a[:-1]) | (block[1:] != block[:-1])]
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(starts, np.arange(len(a)), 0))
    new = np.flatnonzero(place % PART == 0)
    bounds = np.r_[new, len(a)]
    for k in range(0, len(new), ROWS):
        at, ends = new[k : k + ROWS], bounds[k : k + ROWS + 1]
        low, high = ends[0], ends[-1]
        cuts = pa.array(ends - low, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([field] * len(at), pa.string()),
                names.take(pa.array(a[at])),
                pa.array(block[at], pa.int32()),
                pa.ListArray.from_arrays(cuts, names.take(pa.array(b[low:high]))),
                pa.ListArray.from_arrays(cuts, pa.array(counts[low:high], pa.int64())),
            ],
            names=["field_name", "item_a", "block", "neighbours", "counts"],
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (field_name, items sorted and distinct) to the partition's stripes."""
    parts: dict[str, list] = {}

    def flush(field: str) -> Iterator[pa.RecordBatch]:
        codes, keys, counts, _ = parts.pop(field)
        keys, counts = _merge(keys, counts)
        if len(keys):
            names = pa.array(list(codes), pa.string())
            blocks = np.fromiter((zlib.crc32(x.encode()) % BLOCKS for x in codes), np.int64, len(codes))
            yield from _stripes(field, keys, counts, names, blocks)

    for batch in batches:
        fields = batch.column(0)
        for field in pc.unique(fields).to_pylist():
            rows = batch.column(1).filter(pc.equal(fields, field))
            items = rows.flatten().dictionary_encode()
            part = parts.setdefault(field, [{}, [], [], 0])
            codes = part[0]
            to = np.fromiter((codes.setdefault(x, len(codes)) for x in items.dictionary.to_pylist()), np.int64, len(items.dictionary))
            flat = to[items.indices.to_numpy()] if len(items) else np.empty(0, np.int64)
            offsets = np.r_[0, np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False))].astype(np.int64)
            keys, counts = np.unique(_pairs_of(flat, offsets), return_counts=True)
            part[1].append(keys)
            part[2].append(counts)
            part[3] += len(keys)
            if part[3] > ENTRIES:
                keys, counts = _merge(part[1], part[2])
                part[1:] = [keys], [counts], len(keys)
                if len(keys) > ENTRIES // 2:
                    yield from flush(field)
    for field in list(parts):
        yield from flush(field)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by (field, item, block): those of one key are merged as they come, and come out as pairs.

    Of a key that goes on in the next batch only its merged array is held, one entry per neighbour.
    """
    key = ["field_name", "item_a", "block"]
    kinds = pa.schema([("field_name", pa.string()), ("item_a", pa.string()), ("block", pa.int32()), ("item_b", pa.string()), ("n_ab", pa.int64())])

    def entries(batch: pa.RecordBatch) -> pa.Table:
        table = pa.Table.from_batches([batch]).rename_columns([*key, "neighbours", "counts"])
        flat = table.column("neighbours").combine_chunks()
        row = pa.array(np.repeat(np.arange(table.num_rows), pc.list_value_length(flat).to_numpy(zero_copy_only=False)))
        columns = [table.column(c).take(row) for c in key]
        return pa.table([*columns, flat.flatten(), table.column("counts").combine_chunks().flatten()], names=kinds.names).cast(kinds)

    held = kinds.empty_table()
    for batch in batches:
        if not batch.num_rows:
            continue
        merged = pa.concat_tables([held, entries(batch)]).group_by(kinds.names[:-1], use_threads=False).aggregate([("n_ab", "sum")])
        merged = merged.select([*kinds.names[:-1], "n_ab_sum"]).rename_columns(kinds.names)
        last = batch.slice(batch.num_rows - 1).to_pylist()[0]
        goes_on = pc.and_(pc.and_(pc.equal(merged.column("item_a"), last["item_a"]), pc.equal(merged.column("block"), last["block"])), pc.equal(merged.column("field_name"), last["field_name"]))
        yield from merged.filter(pc.invert(goes_on)).drop_columns(["block"]).to_batches()
        held = merged.filter(goes_on)
    yield from held.drop_columns(["block"]).to_batches()


def pair_counts(rows: DataFrame) -> DataFrame:
    """(field_name, item_a, item_b, n_ab), a < b, of rows (field_name, items).

    Each partition builds an associative array of neighbours per item, the arrays are merged by key,
    and only whole arrays are shuffled. An item's array is cut into BLOCKS by neighbour, so that none
    holds all neighbours of a frequent item.
    """
    items = rows.select("field_name", F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"))
    stripes = items.mapInArrow(_build, STRIPE)
    return stripes.repartition("field_name", "item_a", "block").sortWithinPartitions("field_name", "item_a", "block").mapInArrow(_fold, PAIR)


def item_counts(rows: DataFrame) -> DataFrame:
    """(field_name, item, n): rows with each item."""
    items = rows.select("field_name", F.explode_outer(F.array_distinct("items")).alias("item")).where("item is not null")
    return items.groupBy("field_name", "item").agg(F.count("*").alias("n"))


def log_likelihood(n: Column, n_a: Column, n_b: Column, n_ab: Column) -> Column:
    """Dunning's log-likelihood ratio of two items being independent, from the four cells of rows with both, one or none."""

    def part(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = part(n_ab) + part(n_a - n_ab) + part(n_b - n_ab) + part(n - n_a - n_b + n_ab)
    sides = part(n_a) + part(n - n_a) + part(n_b) + part(n - n_b)
    return F.greatest(2 * (cells - sides + part(n)), F.lit(0.0))


def with_expectation(pairs: DataFrame, counts: DataFrame, totals: dict[str, int], small: bool) -> DataFrame:
    """Add n, n_a, n_b, ratio (rows with both to those expected by chance) and llr.

    `small` counts are broadcast. Otherwise the pairs of items that stand in very many pairs get their
    counts by broadcast and all others by shuffle.
    """
    n = F.lit(0).cast("bigint")
    for field, total in totals.items():
        n = F.when(F.col("field_name") == field, F.lit(total).cast("bigint")).otherwise(n)
    out = pairs
    for side in ("a", "b"):
        known = counts.select(F.struct("field_name", "item").alias("key"), F.col("n").alias(f"n_{side}"))
        out = out.withColumn("key", F.struct("field_name", F.col(f"item_{side}").alias("item")))
        out = (out.join(F.broadcast(known), "key") if small else lookup(materialize(out), known, "key", "inner")).drop("key")
    out = out.withColumn("n", n)
    ratio = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.withColumns({"ratio": ratio, "llr": log_likelihood(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("n_ab"))})


def cooccurrence(rows: DataFrame, min_rows: int = 1, min_share: float = 0.0, most_items: int = 1_000_000) -> DataFrame:
    """(field_name, item_a, item_b, n_ab, n_a, n_b, n, ratio, llr) of rows (field_name, items).

    n counts the rows of a field with any item. With `min_rows` or `min_share` only pairs in at least
    so many rows, or that share of n, come out; as no pair stands in more rows than its items, rarer
    items are left out before pairs are formed. With a share s there are at most (items per row) / s
    such items. The list of items and their counts is broadcast if it has at most `most_items` entries;
    otherwise items of very many rows or pairs are looked up by broadcast and the rest by shuffle. Items repeated in a row count once; null items and empty rows don't count; repeated
    rows count each.
    """
    totals = {r[0]: r[1] for r in rows.where(F.size(F.array_compact("items")) > 0).groupBy("field_name").agg(F.count("*")).collect()}  # one row a field
    rows = rows.select("field_name", F.array_compact(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))
    counts = item_counts(rows)
    need = F.lit(min_rows).cast("double")
    for field, total in totals.items():
        need = F.when(F.col("field_name") == field, F.lit(max(float(min_rows), min_share * total))).otherwise(need)
    counts = materialize(counts.where(F.col("n") >= need))
    small = counts.count() <= most_items
    if min_rows > 1 or min_share > 0:
        if small:
            kept = {f: pa.array(sorted(r[0] for r in counts.where(F.col("field_name") == f).select("item").collect()), pa.string()) for f in totals}
            rows = rows.mapInArrow(_keep(kept), "field_name string, items array<string>")
        else:
            flat = rows.withColumn("row", F.monotonically_increasing_id()).select("field_name", "row", F.explode_outer("items").alias("item"))
            flat = flat.where("item is not null").withColumn("key", F.struct("field_name", "item"))
            flat = lookup(materialize(flat), counts.select(F.struct("field_name", "item").alias("key")), "key", "inner")
            rows = flat.groupBy("field_name", "row").agg(F.collect_list("item").alias("items")).drop("row")
    return with_expectation(pair_counts(rows), counts, totals, small).where(F.col("n_ab") >= need)


def _keep(kept: dict[str, pa.Array]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in pc.unique(batch.column(0)).to_pylist():
                rows = batch.column(1).filter(pc.equal(batch.column(0), field))
                flat = rows.flatten()
                good = pc.is_in(flat, value_set=kept[field]).to_numpy(zero_copy_only=False) if field in kept else np.zeros(len(flat), bool)
                row = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy(zero_copy_only=False))
                offsets = np.r_[0, np.cumsum(np.bincount(row[good], minlength=len(rows)))]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(good)))
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(rows), pa.string()), lists], names=["field_name", "items"])

    return run

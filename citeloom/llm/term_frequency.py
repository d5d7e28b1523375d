"""Occurrences and record frequency of every term, by record-identifier bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifiers share a container with all that have the same higher bits; beyond ARRAY entries it is a bitmap.
CHUNK, ARRAY = 1 << 16, 4096
#: Occurrences that a partition holds before it hands its containers on.
HELD = 4_000_000
CONTAINER = "term string, chunk bigint, size int, container binary, occurrences bigint"


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a container: the numbers themselves if few, else one bit each."""
    if len(low) <= ARRAY:
        return low.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[low] = 1
    return np.packbits(bits).tobytes()


def unpack(size: int, container: bytes) -> np.ndarray:
    if size <= ARRAY:
        return np.frombuffer(container, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8)))


def union(containers: list[tuple[int, bytes]]) -> tuple[int, bytes]:
    """One container with the numbers of all; its cardinality comes first."""
    if len(containers) == 1:
        return containers[0]
    bits = np.zeros(CHUNK // 8, np.uint8)
    for size, data in containers:
        if size > ARRAY:
            bits |= np.frombuffer(data, np.uint8)
        else:
            low = np.frombuffer(data, "<u2").astype(np.int64)
            np.bitwise_or.at(bits, low >> 3, (0x80 >> (low & 7)).astype(np.uint8))
    low = np.flatnonzero(np.unpackbits(bits))
    return len(low), pack(low)


def _containers(names: list[str], terms: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    term, at = np.concatenate(terms), np.concatenate(ids)
    order = np.lexsort((at, term))
    term, at = term[order], at[order]
    chunk = at >> 16
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])
    ends = np.r_[starts[1:], len(term)]
    first = np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]
    low = (at & 0xFFFF).astype(np.int64)
    for k in range(0, len(starts), 20_000):
        sizes, packed = [], []
        for s, e in zip(starts[k : k + 20_000], ends[k : k + 20_000]):
            part = low[s:e][first[s:e]]
            sizes.append(len(part))
            packed.append(pack(part))
        s, e = starts[k : k + 20_000], ends[k : k + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[t] for t in term[s]], pa.string()), pa.array(chunk[s], pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(e - s, pa.int64())],
            names=["term", "chunk", "size", "container", "occurrences"],
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, terms) to the partition's containers, one per term and chunk."""
    codes: dict[str, int] = {}
    terms: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = 0
    for batch in batches:
        lists = batch.column(1)
        items = lists.flatten().dictionary_encode()
        to = np.fromiter((codes.setdefault(x, len(codes)) for x in items.dictionary.to_pylist()), np.int64, len(items.dictionary))
        if len(items):
            terms.append(to[items.indices.to_numpy()])
            ids.append(np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)))
            held += len(items)
        if held > HELD:
            yield from _containers(list(codes), terms, ids)
            codes, terms, ids, held = {}, [], [], 0
    if terms:
        yield from _containers(list(codes), terms, ids)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (term, chunk): those of one key are united as they come; keys of one container pass as they are."""
    kinds = pa.schema([("term", pa.string()), ("chunk", pa.int64()), ("size", pa.int32()), ("container", pa.binary()), ("occurrences", pa.int64())])

    def one(rows: pa.Table) -> list:
        size, data = union(list(zip(rows.column("size").to_pylist(), rows.column("container").to_pylist())))
        return [rows.column("term")[0].as_py(), rows.column("chunk")[0].as_py(), size, data, pc.sum(rows.column("occurrences")).as_py()]

    def table(rows: list[list]) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

    held = kinds.empty_table()
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_tables([held, pa.Table.from_batches([batch]).rename_columns(kinds.names).cast(kinds)]).combine_chunks()
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        chunk = rows.column("chunk").to_numpy()
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])])
        sizes = np.diff(np.r_[starts, rows.num_rows])
        # The last key may go on in the next batch; it is held as one container.
        yield from rows.take(pa.array(starts[:-1][sizes[:-1] == 1])).to_batches()
        several = [one(rows.slice(s, n)) for s, n in zip(starts[:-1], sizes[:-1]) if n > 1]
        if several:
            yield from table(several).to_batches()
        last = rows.slice(starts[-1])
        held = table([one(last)]) if last.num_rows > 1 else last
    yield from held.to_batches()


def term_bitmaps(rows: DataFrame) -> DataFrame:
    """(term, chunk, size, container, occurrences) of rows (id BIGINT, terms ARRAY<STRING>).

    A term's records are a bitmap over their identifiers, kept in compressed containers of 65,536
    identifiers each; occurrences are counted beside it. Partitions build containers, and containers
    of one term and chunk are merged by union: a hot term is spread over its chunks and none of its
    merges is larger than one container per partition. Null terms don't count; rows with a null id
    count as one record.
    """
    clean = rows.select(F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 62))).alias("id"), F.array_compact(F.coalesce("terms", F.array().cast("array<string>"))).alias("terms"))
    parts = clean.mapInArrow(_build, CONTAINER)
    return parts.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_unite, CONTAINER)


def term_frequencies(rows: DataFrame) -> DataFrame:
    """(term, occurrences, n_rows): n_rows is the cardinality of the term's bitmap."""
    return term_bitmaps(rows).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("size").cast("bigint").alias("n_rows"))


def marked(frequencies: DataFrame, total: int, rare_rows: int = 1, common_share: float = 0.03) -> DataFrame:
    """Add mark: `rare` in at most `rare_rows` rows, else `common` in more than `common_share` of `total` rows, else null."""
    rare, common = F.col("n_rows") <= rare_rows, F.col("n_rows") > F.lit(common_share * total)
    return frequencies.withColumn("mark", F.when(rare, "rare").when(common, "common"))

"""One mix of several sources with target shares of the total size."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import pick
from citeloom.session import materialize

#: Blocks of the whole mix that sources get by quotients; more blocks mean finer shares.
BLOCKS = 10_000_000
#: A source of n texts is cut into about sqrt(n) / SHARDS_BY shards, each in blocks of TEXTS_A_BLOCK mean texts,
#: so that a shard and the texts that round a source off both are some sqrt(n) rows: the most that one task holds.
SHARDS_BY, TEXTS_A_BLOCK = 4, 8
#: The last gap of a source is closed by the best subset of so many of its smallest texts, of so many tokens in all.
RESERVE, RESERVE_TOKENS = 256, 1 << 21
#: The list of weights is held by the driver, a row per source; a longer one is refused.
MOST_SOURCES = 100_000


def apportion(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1); a party at its cap gets no more. Ties go to the earlier party.

    Seats that every divisor method step gives are found at once by halving the divisor's range; the few
    left are given one by one, with the same result as one by one from the start.
    """
    out = np.zeros(len(weights), np.int64)
    open_ = weights > 0
    if seats <= 0 or not open_.any():
        return out
    w, c = np.where(open_, weights, 0.0).astype(np.float64), np.where(open_, caps, 0)
    at = lambda x: np.minimum(c, np.floor(np.minimum(x * w, 4e18) + 0.5).astype(np.int64))
    low, high = 0.0, (2.0 * seats + 2) / w[open_].min()
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() <= seats:
            low = mid
        else:
            high = mid
        if high - low <= 1e-12 * high:
            break
    out = at(low * (1 - 1e-11))
    left = seats - int(out.sum())
    heap = [(-w[k] / (2 * out[k] + 1), k) for k in np.flatnonzero(out < c)]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < c[k]:
            heapq.heappush(heap, (-w[k] / (2 * out[k] + 1), k))
    return out


def sainte_lague(weights: Mapping[object, float], seats: int, caps: Mapping[object, int] | None = None) -> dict[object, int]:
    """`apportion` by name; ties go to the smaller name."""
    names = sorted(weights)
    given = apportion(np.array([weights[k] for k in names], float), seats, np.array([(caps or {}).get(k, seats) for k in names], np.int64)) if names else []
    return {k: int(n) for k, n in zip(names, given)}


def best_subset(sizes: list[int], target: int) -> list[int]:
    """Positions of the sizes whose sum is nearest to the target, below it rather than above; exact.

    Bit n of a number says whether some subset of the sizes so far sums to n.
    """
    most = 2 * target + 1  # a sum above twice the target is no nearer than none
    reached = [1]
    for n in sizes:
        reached.append((reached[-1] | reached[-1] << n) & ((1 << most) - 1))
    sums = reached[-1]
    below = (sums & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = sums >> (target + 1)
    best = below
    if above:
        nearest = target + 1 + (above & -above).bit_length() - 1
        best = nearest if nearest - target < target - below else below
    taken = []
    for k in range(len(sizes) - 1, -1, -1):
        if not reached[k] >> best & 1:
            taken.append(k)
            best -= sizes[k]
    return taken


def fill(sizes: np.ndarray, target: int) -> np.ndarray:
    """Which sizes, in their order, to take for a sum as near to the target as can be found: large ones that fit, then the best subset of the RESERVE smallest."""
    take = np.zeros(len(sizes), bool)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    gap = int(target)
    sums = np.cumsum(sizes[order[::-1]][:RESERVE])
    n_small = max(1, int(np.searchsorted(sums, RESERVE_TOKENS, side="right")))
    for k in order[:-n_small]:
        if sizes[k] <= gap:
            take[k] = True
            gap -= int(sizes[k])
    small = order[-n_small:]
    if gap > 0 and len(small):
        if int(sizes[small].sum()) <= gap:
            take[small] = True
        elif len(small) == 1:
            take[small] = int(sizes[small[0]]) < 2 * gap
        else:
            take[small[best_subset([int(n) for n in sizes[small]], gap)]] = True
    return take


def sized_texts(documents: DataFrame, weights: DataFrame, count_tokens) -> DataFrame:
    """(hash, doc_id, source, n_tokens): each distinct non-empty text once.

    A text in several rows stands for its least doc_id, among sources with a weight if it is in one:
    the cap on repeats counts for the text, not for its copies. Tokens are counted first, so that only
    hashes and sizes are shuffled, and copies are combined before that.
    """
    listed = F.broadcast(weights.select(F.col("source").alias("listed")).distinct())  # at most MOST_SOURCES rows
    rows = documents.where("text is not null and text <> ''").withColumn("n_tokens", count_tokens(F.col("text")))
    rows = rows.select("doc_id", "source", "n_tokens", F.unhex(F.sha2("text", 256)).alias("hash")).join(listed, F.col("source") == F.col("listed"), "left")
    first = F.min(F.struct(F.col("listed").isNull().alias("other"), "doc_id", "source", "n_tokens")).alias("first")
    return rows.groupBy("hash").agg(first).select("hash", "first.doc_id", "first.source", "first.n_tokens")


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """Each shard's part of its source's last round, in whole blocks."""
    shards = shards.sort_values("shard")
    block, rest = int(shards["block"].iloc[0]), int(shards["rest"].iloc[0])
    given = apportion(shards["size"].to_numpy(float), rest // block, -(-shards["size"].to_numpy(np.int64) // block))
    return shards[["source", "shard"]].assign(quota=given * block)


def _seeded_blocks(texts: pd.DataFrame) -> pd.DataFrame:
    """One shard: its blocks in seeded order as long as they fit into its quota; the next two may round the source off."""
    texts = texts.sort_values(["turn", "doc_id"], kind="stable")
    sizes, block, quota = texts["n_tokens"].to_numpy(np.int64), int(texts["block"].iloc[0]), int(texts["quota"].iloc[0])
    upto = np.cumsum(sizes)
    nth = (upto - sizes) // block
    # Texts stand in an order drawn by the seed, so blocks do too: a block's place is that of its first text.
    names, of = np.unique(nth, return_inverse=True)
    ends = np.cumsum(np.bincount(of, weights=sizes, minlength=len(names))).astype(np.int64)
    whole = int(np.searchsorted(ends, quota, side="right"))
    return texts[["hash", "doc_id", "source", "n_tokens"]].assign(taken=of < whole, next=(of >= whole) & (of <= whole + 1))


def _round_off(texts: pd.DataFrame) -> pd.DataFrame:
    texts = texts.sort_values(["turn", "doc_id"], kind="stable")
    take = fill(texts["n_tokens"].to_numpy(np.int64), int(texts["gap"].iloc[0]))
    return texts.loc[take, ["hash"]]


def mix(documents: DataFrame, weights: DataFrame, count_tokens, *, total_tokens: int | None = None, seed: int = 0, shards: int | None = None, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(copies, report).

    copies: (doc_id, source, n_tokens, repeats) of every distinct text, repeats 0 where it isn't in the
    mix. report: (source, target_share, reached_share, mixed_tokens, available_tokens, n_texts,
    n_used, max_repeats, most_repeats, mean_repeats).

    `documents` (doc_id, text, source), `weights` (source, target_weight, max_repeats);
    `count_tokens` makes the size column of a text column. Sources without a row, or with a null or
    non-positive weight, have target 0. Weights are scaled to sum 1.

    Without `total_tokens` the mix is the largest in which every source can have its share, so that
    shares deviate by rounding only. A larger total is filled as far as `max_repeats` permits: sources
    at their cap stay there and the others go on by their quotients.

    The total is cut into equal blocks of tokens, and Sainte-Lague's quotients give each source its
    blocks. All texts of a source are repeated as often as its tokens go round. For the last round each
    shard of the source gets its part of whole blocks by the same quotients, and its blocks are taken in
    seeded order. What is left, less than a block per shard, is closed by texts of the shards' next
    two blocks: large ones that fit, then the subset that comes nearest.

    Shards are by seeded hash, so one large source is spread over all its shards, and the same seed gives
    the same mix. No task holds more than some sqrt(n) texts of n, and the driver holds a row per source.
    Sources with a weight but no tokens, or that may not occur, get nothing; the others keep their
    proportions. Null and empty texts are never in the mix. Repeated rows count once. With no documents
    or no weights nothing is mixed and all shares are 0.
    """
    documents = pick(documents, {"doc_id": "doc_id", "text": "text", "source": "source"})
    weights = pick(weights, {"source": "source", "w": "target_weight", "r": "max_repeats"})
    rows = weights.where("source is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    share = {r["source"]: float(r["w"] or 0) for r in rows if (r["w"] or 0) > 0}
    whole = sum(share.values())
    share = {k: v / whole for k, v in share.items()}
    most = {r["source"]: max(int(r["r"] or 0), 0) for r in rows}

    spark = documents.sparkSession
    sized = materialize(sized_texts(documents, weights, count_tokens))
    listed = F.broadcast(spark.createDataFrame([(s,) for s in share], "source string"))
    totals = sized.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()  # a row per source with a weight
    size, texts = {r[0]: int(r[1]) for r in totals}, {r[0]: int(r[2]) for r in totals}
    usable = {s: w for s, w in share.items() if size.get(s, 0) > 0 and most[s] > 0}
    if total_tokens is None:
        total_tokens = int(min((most[s] * size[s] / w for s, w in usable.items()), default=0))
    unit = max(1, total_tokens // blocks)
    caps = {s: most[s] * size[s] // unit for s in usable}
    seats = sainte_lague(usable, total_tokens // unit, caps)
    plan = []
    for s, n in seats.items():
        tokens = most[s] * size[s] if n == caps[s] else n * unit  # a cap may cut a block
        parts = shards or 1 + int(texts[s] ** 0.5) // SHARDS_BY
        plan.append((s, tokens // size[s], tokens % size[s], parts, max(1, TEXTS_A_BLOCK * size[s] // texts[s])))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, rounds bigint, rest bigint, parts int, block bigint"))

    # Only sources with a last round are cut into shards.
    turn = F.xxhash64(F.lit(seed), "hash")
    open_ = sized.join(plan.where("rest > 0"), "source").withColumns({"turn": turn, "shard": F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "hash"), F.col("parts")).cast("int")})
    sizes = open_.groupBy("source", "shard", "block", "rest").agg(F.sum("n_tokens").alias("size")).where("size > 0")
    quotas = sizes.groupBy("source").applyInPandas(_shard_quotas, "source string, shard int, quota bigint")
    asked = open_.select("source", "shard", "hash", "doc_id", "n_tokens", "turn", "block").join(quotas, ["source", "shard"])
    drawn = materialize(asked.groupBy("source", "shard").applyInPandas(_seeded_blocks, "hash binary, doc_id bigint, source string, n_tokens bigint, taken boolean, next boolean"))
    gaps = drawn.groupBy("source").agg(F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0)).alias("got")).join(plan, "source").select("source", (F.col("rest") - F.col("got")).alias("gap"))
    ends = drawn.where("next").join(gaps, "source").select("hash", "doc_id", "source", "n_tokens", "gap", turn.alias("turn"))
    rounded = ends.groupBy("source").applyInPandas(_round_off, "hash binary")
    last = drawn.where("taken").select("hash").unionByName(rounded).withColumn("extra", F.lit(1))
    joined = sized.join(plan.select("source", "rounds"), "source", "left").join(last, "hash", "left")
    repeats = F.when(F.col("n_tokens") > 0, F.coalesce(F.col("rounds") + F.coalesce("extra", F.lit(0)), F.lit(0))).otherwise(0).cast("int")
    copies = joined.select("doc_id", "source", "n_tokens", repeats.alias("repeats"))

    targets = spark.createDataFrame([(r["source"], share.get(r["source"], 0.0), most[r["source"]]) for r in rows] or [], "source string, target_share double, max_repeats int")
    per = copies.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("n_texts"),
        F.count(F.when(F.col("repeats") > 0, 1)).alias("n_used"), F.max("repeats").alias("most_repeats"), F.avg("repeats").alias("mean_repeats"),
    )
    # One row per source: small whatever the corpus.
    report = per.join(targets, "source", "full")
    everything = F.sum("mixed_tokens").over(Window.partitionBy())
    n = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return copies, report.select(
        "source", n("target_share", "double"), F.coalesce(F.try_divide(F.col("mixed_tokens"), everything), F.lit(0.0)).alias("reached_share"),
        *(n(c, "bigint") for c in ("mixed_tokens", "available_tokens", "n_texts", "n_used")), n("max_repeats", "int"), n("most_repeats", "int"), n("mean_repeats", "double"),
    )

"""Filling fixed-capacity containers with items.

Method: optimal length buckets. A bucket whose longest items have length u cuts a
container into ``capacity // u`` equal slots, one item a slot. The global histogram of
item lengths decides, by dynamic programming, on the bucket boundaries that minimise
the padding of all slots; token-budget batches, of as many items as a container has
slots at least, are then formed inside each bucket. What a batch leaves open is topped
up with items of shorter buckets, which then form fewer batches of their own. An item is
never split unless it alone is larger than a container.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.arrow import stage
from marram.llm.tokenizers import Tokenizer
from marram.storage import write_through

#: Buckets, steps of the length axis in the program, and items that one task packs together.
BUCKETS, STEPS, SHARD_ITEMS = 32, 1024, 4000

_PLACED = "capacity long, shard int, container int, item long, piece int, tokens long, bucket long"


def token_lengths(texts: DataFrame, key: str, column: str, tokenizer: Tokenizer) -> DataFrame:
    """``item, tokens`` of all texts; null and empty texts have no tokens."""

    vocabulary = texts.sparkSession.sparkContext.broadcast(tokenizer.data)

    def make():
        count = tokenizer.counter(vocabulary.value)

        def run(cols):
            return {"item": cols["item"], "tokens": [count(t) if t else 0 for t in cols["text"]]}

        return run

    given = texts.select(F.col(key).cast("long").alias("item"), F.col(column).cast("string").alias("text"))
    return write_through(stage(given, "item long, tokens long", make), "token-lengths")


def slots(capacity: int, upper: int) -> int:
    """Items of a bucket with the upper end ``upper`` that fill a container, whichever they are."""
    return capacity // upper


def boundaries(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding over a histogram.

    An item of a bucket takes a slot, so its padding is ``capacity / slots`` less its
    length. Lengths are at most ``capacity``; above ``STEPS`` distinct steps they are
    rounded up to a multiple of ``capacity / STEPS``. The last boundary is the largest length.
    """
    step = max(1, -(-capacity // STEPS))
    ends = np.minimum(-(-lengths // step) * step, capacity)
    axis, at = np.unique(ends, return_inverse=True)
    n = np.bincount(at, weights=counts)
    size = np.bincount(at, weights=counts * lengths)
    cn, cs = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
    m = len(axis)
    if m <= buckets:
        return [int(x) for x in axis]
    # cost[i, j]: padding of one bucket over steps i..j
    i, j = np.arange(m)[:, None], np.arange(m)[None, :]
    slot = capacity / (capacity // axis)
    cost = np.where(i <= j, slot[None, :] * (cn[1:][None, :] - cn[:-1][:, None]) - (cs[1:][None, :] - cs[:-1][:, None]), np.inf)
    best, cut = cost[0].copy(), []
    for _ in range(buckets - 1):
        # best of one bucket more: the last one starts at k
        total = best[:-1, None] + cost[1:, :]
        k = np.argmin(total, axis=0)
        new = total[k, np.arange(m)]
        better = new < best
        cut.append(np.where(better, k, -1))
        best = np.where(better, new, best)
    out, at_, level = [m - 1], m - 1, buckets - 2
    while level >= 0:
        k = cut[level][at_]
        if k >= 0:
            out.append(int(k))
            at_ = k
        level -= 1
    return [int(axis[x]) for x in reversed(out)]


def fill(tokens: list[int], capacity: int, ends: list[int]) -> list[int]:
    """Container number of each item, items of at most ``capacity`` tokens.

    Buckets are taken from long to short. Inside a bucket batches form in the given
    order: a batch takes items while the token budget lasts, as many as the container
    has slots at least. What stays open is topped up from shorter buckets, the longest
    that fit first; so these have fewer batches, or none, when their turn comes.
    """
    inside: list[list[tuple[int, int]]] = [[] for _ in ends]
    for i in sorted(range(len(tokens)), key=lambda i: (tokens[i], -i)):
        inside[min(bisect_right(ends, tokens[i] - 1), len(ends) - 1)].append((tokens[i], -i))
    where = [0] * len(tokens)
    number = 0
    for top in range(len(ends) - 1, -1, -1):
        own = sorted(-i for _, i in inside[top])
        at = 0
        while at < len(own):
            room = capacity
            while at < len(own) and tokens[own[at]] <= room:
                where[own[at]] = number
                room -= tokens[own[at]]
                at += 1
            b = top - 1
            while b >= 0 and room > 0:
                items = inside[b]
                # the longest of this bucket that still fits
                k = bisect_right(items, (room, 1)) - 1 if items else -1
                if k < 0:
                    b -= 1
                    continue
                size, i = items.pop(k)
                where[-i] = number
                room -= size
            number += 1
    return where


def pack(lengths: DataFrame, capacities: list[int]) -> DataFrame:
    """Places every item of ``item, tokens`` for every capacity: one row per piece.

    Result: ``capacity, shard, container, item, piece, tokens, bucket``; ``bucket`` is
    the boundary above the piece's length. An item of more than ``capacity`` tokens is
    cut into full containers and a rest that is packed like an item. Items without
    tokens need no space: they have a row with a null container. Repeated items are
    packed as often as they occur. Shards of a bounded number of items, by hash, are
    packed apart, so no task sees the whole; each may leave its last containers open.
    """
    spark = lengths.sparkSession
    caps = sorted(set(capacities))
    if not caps:
        return spark.createDataFrame([], _PLACED)
    rows = lengths.count()
    sized = lengths.where("tokens > 0").select(F.explode(F.array(*(F.lit(c).cast("long") for c in caps))).alias("capacity"), "item", "tokens")
    rest = sized.withColumn("rest", F.col("tokens") % F.col("capacity"))
    # one row a length and capacity at most: bounded by the capacities
    hist = rest.where("rest > 0").groupBy("capacity", "rest").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = {}
    for c in caps:
        mine = [(r["rest"], r["n"]) for r in hist if r["capacity"] == c]
        if mine:
            x, n = map(np.array, zip(*mine))
            ends[c] = boundaries(x, n, c)
    shards = max(1, -(-rows // SHARD_ITEMS))
    shard = F.pmod(F.xxhash64("item", "tokens"), F.lit(shards)).cast("int")
    whole = (
        sized.where("tokens >= capacity")
        .select("capacity", "item", F.explode(F.sequence(F.lit(0), (F.col("tokens") / F.col("capacity")).cast("int") - 1)).alias("piece"))
        .select("capacity", F.lit(-1).alias("shard"), F.lit(None).cast("int").alias("container"), "item", "piece", F.col("capacity").alias("tokens"), F.col("capacity").alias("bucket"))
    )

    def pack_shard(pdf):
        import pandas as pd

        c = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["item", "tokens"], kind="stable")
        tokens = pdf["tokens"].tolist()
        where = fill(tokens, c, ends[c])
        bucket = [ends[c][min(bisect_right(ends[c], t - 1), len(ends[c]) - 1)] for t in tokens]
        return pd.DataFrame({"capacity": c, "shard": pdf["shard"].to_numpy(), "container": where, "item": pdf["item"].to_numpy(), "piece": pdf["piece"].to_numpy(), "tokens": tokens, "bucket": bucket})

    packed = (
        rest.where("rest > 0")
        .select("capacity", shard.alias("shard"), "item", F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("piece"), F.col("rest").alias("tokens"))
        .groupBy("capacity", "shard")
        .applyInPandas(pack_shard, _PLACED)
    )
    nothing = lengths.where("tokens <= 0 or tokens is null").select(
        F.explode(F.array(*(F.lit(c).cast("long") for c in caps))).alias("capacity"), F.lit(-2).alias("shard"), F.lit(None).cast("int").alias("container"), "item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("bucket")
    )
    return packed.unionByName(whole).unionByName(nothing)


def container_id(placed: DataFrame) -> DataFrame:
    """Adds ``container_id``: unique per capacity; null for items that need no space."""
    return placed.withColumn(
        "container_id",
        F.when(F.col("shard") >= 0, F.format_string("s%d-%d", "shard", "container")).when(F.col("shard") == -1, F.format_string("w%d-%d", "item", "piece")),
    )


def containers(placed: DataFrame) -> DataFrame:
    """One row per container: its contents and its unused space."""
    return (
        container_id(placed)
        .where("container_id is not null")
        .groupBy("capacity", "container_id")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sum("tokens").alias("used"),
            F.sort_array(F.collect_list(F.struct("item", "piece", "tokens"))).alias("contents"),
        )
        .withColumn("unused", F.col("capacity") - F.col("used"))
    )


def padding(placed: DataFrame) -> DataFrame:
    """Padding of the slots of each bucket, before topping up, and what one bucket for all would have.

    Result: ``capacity, bucket, slots, n_items, used, padding, padding_in_one``.
    """
    w = Window.partitionBy("capacity")
    of = lambda upper: F.floor(F.col("capacity") / upper)
    per = placed.where("shard >= 0").groupBy("capacity", "bucket").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("used"))
    room = lambda upper: F.round(F.col("n_items") * F.col("capacity") / of(upper) - F.col("used"), 3)
    # a handful of buckets a capacity
    return per.withColumn("longest", F.max("bucket").over(w)).select(
        "capacity", "bucket", of(F.col("bucket")).alias("slots"), "n_items", "used", room(F.col("bucket")).alias("padding"), room(F.col("longest")).alias("padding_in_one")
    )


def rules(placed: DataFrame) -> DataFrame:
    """What must hold of any packing, counted per capacity.

    Result: ``capacity, n_items, used, n_overfull`` (containers beyond their capacity),
    ``n_split`` (items in more than one piece), ``n_split_needlessly`` (of these, items
    that one container could hold).
    """
    over = containers(placed).where("used > capacity").groupBy(F.col("capacity").alias("c")).agg(F.count(F.lit(1)).alias("n_overfull"))
    items = placed.groupBy("capacity", "item").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    several = F.col("pieces") > 1
    per = items.groupBy("capacity").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("used").alias("used"), F.count(F.when(several, 1)).alias("n_split"), F.count(F.when(several & (F.col("used") <= F.col("capacity")), 1)).alias("n_split_needlessly")
    )
    return per.join(over, F.col("capacity") == F.col("c"), "left").select("capacity", "n_items", "used", F.coalesce("n_overfull", F.lit(0)).cast("long").alias("n_overfull"), "n_split", "n_split_needlessly")

"""Filling containers of a fixed number of tokens.

Conflict-constrained best fit: items come in decreasing size; the bins of a shard are kept
in order of their residual, and every bin carries one bitmap of sources and one of
duplicate clusters. The successor search starts at the least residual that takes the item
and goes on until it meets a bin without a common bit: the tightest compatible one.

A duplicate cluster (equal texts) may be in a container once, and so may a source. A group
so large that this is impossible (it may hold a third of all rows) has more than one bit, as
many as an even spread over the containers needs (``room`` times as many, if asked for), and
only items with the same bit conflict, so that conflicts never force more containers than
the tokens do. ``fill`` reports how many containers hold a source or a cluster again.

Shards are cut by hash, about ``shard`` items each, whatever source or copies they have,
and packed one by one; a shard wastes less than a few containers, so at thousands of
containers a shard the loss is far below one percent. Nothing is split but items above
the capacity: those fill whole containers, and their rest is an item like any other.

Defined cases: null and empty texts have size 0 and are in no container; a null source is a
source of its own; repeated rows of a document count once; ties are broken by key.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteglass.llm import tokens
from noteglass.session import materialise

CAPACITY, SHARD, ROOM = 2048, 20_000, 1


def slots(groups: list, bins: int, room: int = ROOM) -> list[int]:
    """A bit number for every item: items of a group share bits only as far as an even spread forbids."""
    sizes, first, seen, out, free = Counter(groups), {}, defaultdict(int), [], 0
    for g in groups:
        if g is not None and sizes[g] > 1 and g not in first:
            first[g] = (free, room * -(-sizes[g] // max(1, bins)))
            free += first[g][1]
    for g in groups:
        if g in first:
            base, n = first[g]
            out.append(base + seen[g] % n)
            seen[g] += 1
        else:
            out.append(-1)
    return out


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, room: int = ROOM) -> list[int]:
    """Bin number of every item; sizes are between 1 and the capacity."""
    bins = -(-sum(sizes) // capacity)
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    by_source, by_cluster = slots([sources[k] for k in order], bins, room), slots([clusters[k] for k in order], bins)
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual
    held, copies = [], []  # bitmaps of the bins
    some = 0  # bit r: there are bins with residual r
    out = [0] * len(sizes)
    for k, s, c in zip(order, by_source, by_cluster, strict=True):
        size, s, c = sizes[k], (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        found, rest = -1, some >> size
        residual = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            found = next((b for b in reversed(at[residual]) if not (held[b] & s or copies[b] & c)), -1)
            if found >= 0:
                at[residual].remove(found)
                if not at[residual]:
                    some &= ~(1 << residual)
                break
            rest >>= step + 1
            residual += 1
        if found < 0:
            found, residual = len(held), capacity
            held.append(0), copies.append(0)
        held[found] |= s
        copies[found] |= c
        left = residual - size
        if left:
            at[left].append(found)
            some |= 1 << left
        out[k] = found
    return out


def items(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, source, cluster): whole documents, and the parts of those above the capacity."""
    once = docs.select("doc_id", "source", "text").dropDuplicates(["doc_id"]).withColumn("cluster", F.xxhash64("text"))
    sized = tokens.count(once, "doc_id", "text", path, ("source", "cluster"))
    parts = F.sequence(F.lit(0), F.floor((F.greatest("n_tokens", F.lit(1)) - 1) / capacity).cast("int"))
    return sized.select("doc_id", F.explode(parts).alias("piece"), "n_tokens", "source", "cluster").select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"), "source", "cluster"
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, path: str | None = None, room: int = ROOM, groups: bool = False) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container) of every item; container is null for size 0.

    room: for the bits of a source; groups: keep source and cluster of each item.
    """
    sized = materialise(items(docs, capacity, path), "items")
    shards = max(1, -(-sized.count() // shard))
    more = ["source", "cluster"] if groups else []
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = sized.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        bins = best_fit(part["n_tokens"].tolist(), [s if isinstance(s, str) else "" for s in part["source"]], part["cluster"].tolist(), capacity, room)
        out = part[["doc_id", "piece", "start_token", "n_tokens", *more]].copy()
        out["container"] = [(int(part["shard"].iloc[0]) << 32) + b for b in bins]
        return out

    schema = ", ".join([f"doc_id {kind}, piece int, start_token int, n_tokens int", *(f"{c} {sized.schema[c].dataType.simpleString()}" for c in more), "container bigint"])
    empty = sized.where("n_tokens <= 0").select("doc_id", "piece", "start_token", "n_tokens", *more, F.lit(None).cast("bigint").alias("container"))
    return placed.groupBy("shard").applyInPandas(run, schema).unionByName(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the least number that the tokens need, tokens, share of room used, and containers that hold too much, a source or a cluster again. packed: with its groups."""
    n = F.count("*")
    each = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("used"), n.alias("n"), F.count_distinct(F.coalesce("source", F.lit(""))).alias("sources"), F.count_distinct("cluster").alias("clusters"))
    return each.agg(
        n.alias("n_containers"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.round(F.sum("used") / (n * capacity), 6).alias("fill"), F.count_if(F.col("used") > capacity).alias("n_over"),
        F.count_if(F.col("sources") < F.col("n")).alias("n_sources_again"), F.count_if(F.col("clusters") < F.col("n")).alias("n_clusters_again"),
    )

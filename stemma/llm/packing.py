"""Filling containers of fixed capacity with items of varying length.

Conflict-constrained best-fit, longest items first: open containers lie in order
of their residual space, with a bitmap of which residuals occur, and carry
bitmaps of the sources and duplicate clusters in them. The search for an item
goes from the tightest residual to its successors until a container is found
that holds no copy of the item's cluster; of equally tight ones, one without
the item's source is preferred.

Large inputs are dealt at random to shards of about ``shard_items`` items, each
packed by one task: a shard leaves at most a few containers partly empty.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.util import cut, ship

SHARD_ITEMS = 25_000
#: Containers a shard may open, as a share of the least possible number, before copies may share one.
SLACK = 1.02


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, slack: float = SLACK) -> tuple[list[int], list[bool]]:
    """Container number of each item (sizes descending, each from 1 to capacity), and whether it had to join a copy of its own cluster.

    sources and clusters are small numbers; cluster -1 conflicts with nothing. Items
    of one cluster only share a container once slack times the least possible number of
    containers are open and none that fits lacks the cluster.
    """
    budget = max(1, int(np.ceil(sum(sizes) / capacity * slack)))
    filled: dict[int, dict[int, list[int]]] = defaultdict(dict)  # residual -> sources' bitmap -> containers
    occurs = 0  # bit r: some open container has residual r
    held: list[int] = []  # clusters' bitmap by container
    holders: dict[int, int] = defaultdict(int)  # open containers by cluster
    members: list[list[int]] = []
    is_open = 0
    place: list[int] = []
    joined: list[bool] = []

    def take(size: int, source: int, bit: int) -> tuple[int, int, int, int] | None:
        """Tightest container with room and without the cluster: (residual, sources' bitmap, position, container)."""
        left = occurs >> size
        r = size
        while left:
            step = (left & -left).bit_length() - 1
            r += step
            groups = filled[r]
            for wanted in (False, True):
                for bitmap, stack in groups.items():
                    if bool(bitmap >> source & 1) is wanted:
                        for at in range(len(stack) - 1, -1, -1):
                            if not held[stack[at]] & bit:
                                return r, bitmap, at, stack[at]
            left >>= step + 1
            r += 1
        return None

    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        bit = 1 << cluster if cluster >= 0 else 0
        found = take(size, source, bit) if cluster < 0 or holders[cluster] < is_open else None
        clash = False
        if found is None and bit and len(held) >= budget:
            found = take(size, source, 0)
            clash = found is not None
        if found is None:
            c, r, bitmap = len(held), capacity, 0
            held.append(0)
            members.append([])
            is_open += 1
        else:
            r, bitmap, at, c = found
            stack = filled[r][bitmap]
            stack[at] = stack[-1]
            stack.pop()
            if not stack:
                del filled[r][bitmap]
                if not filled[r]:
                    occurs &= ~(1 << r)
        if bit and not held[c] & bit:
            holders[cluster] += 1
            members[c].append(cluster)
        held[c] |= bit
        r -= size
        if r:
            filled[r].setdefault(bitmap | 1 << source, []).append(c)
            occurs |= 1 << r
        else:
            is_open -= 1
            for k in members[c]:
                holders[k] -= 1
        place.append(c)
        joined.append(clash)
    return place, joined


def _codes(values: pd.Series) -> np.ndarray:
    return pd.factorize(values, use_na_sentinel=False)[0]


def _pack(group: pd.DataFrame, slack: float) -> pd.DataFrame:
    group = group.sort_values(["n_tokens", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    capacity, shard = int(group["capacity"].iloc[0]), int(group["shard"].iloc[0])
    codes = _codes(group["cluster"])
    repeated = np.bincount(codes) > 1
    dense = np.where(repeated, np.cumsum(repeated) - 1, -1)[codes]  # a cluster met once conflicts with nothing
    place, joined = best_fit(group["n_tokens"].tolist(), _codes(group["source"]).tolist(), dense.tolist(), capacity, slack)
    group["container_id"] = [f"{capacity}-{shard}-{c}" for c in place]
    group["shares_cluster"] = joined
    return group[["capacity", "container_id", "item", "piece", "start", "n_tokens", "shares_cluster"]]


def pack(items: DataFrame, capacities: DataFrame, key: str, size: str = "n_tokens", source: str = "source", cluster: str = "cluster", shard_items: int = SHARD_ITEMS, slack: float = SLACK) -> DataFrame:
    """capacity, container_id, <key>, piece, start, n_tokens, shares_cluster: where each item goes, for each distinct capacity.

    An item longer than the capacity is split: full pieces, which fill a container each, and the rest, which is
    packed as an item. No other item is split. Items of size 0 or null need no room: container_id is null for
    them. Null sources and clusters count as one source and as no cluster. Capacities below 1 raise ValueError.
    Repeated items are packed each.
    """
    ship(items.sparkSession)
    caps = [r[0] for r in capacities.select(F.col("capacity").cast("long")).filter("capacity is not null").distinct().orderBy("capacity").limit(1001).collect()]
    if len(caps) > 1000 or any(c < 1 for c in caps):
        raise ValueError("there may be up to 1000 capacities, each at least 1")
    item_kind = dict(items.dtypes)[key]
    row = F.monotonically_increasing_id()
    base = cut(items.select(row.alias("row"), F.col(key).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster")).withColumn("cluster", F.coalesce("cluster", F.concat(F.lit("row "), F.col("row").cast("string")))))
    sized = base.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in caps]) if caps else F.array().cast("array<long>")))
    empty = sized.filter("n <= 0").select("capacity", F.lit(None).cast("string").alias("container_id"), "item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("shares_cluster"))
    pieces = sized.filter("n > 0").select("capacity", "row", "item", "source", "cluster", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("capacity")).cast("int") - 1)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least("capacity", F.col("n") - F.col("start")))
    full = pieces.filter("n_tokens = capacity").select("capacity", F.concat_ws("-", "capacity", F.lit("full"), "row", "piece").alias("container_id"), "item", "piece", "start", "n_tokens", F.lit(False).alias("shares_cluster"))
    # what is left is at most one piece per item, so that shards stay near shard_items
    shards = max(1, -(-base.count() // shard_items))
    rests = pieces.filter("n_tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("row", "capacity"), F.lit(shards)).cast("int"))
    schema = f"capacity long, container_id string, item {item_kind}, piece int, start long, n_tokens long, shares_cluster boolean"
    packed = rests.select("capacity", "shard", "row", "item", "piece", "start", "n_tokens", "source", "cluster").groupBy("capacity", "shard").applyInPandas(lambda g: _pack(g, slack), schema)
    return packed.unionByName(full).unionByName(empty).withColumnRenamed("item", key)

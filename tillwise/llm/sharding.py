"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts are one group and stay together. A partial partition is
a list of ``shards`` byte sums. Differencing takes the two partial partitions
with the largest spread (largest less smallest sum) and adds them in opposite
order, largest to smallest, until one is left. It starts from one partial
partition per group.

One heap over all groups would be one task, so the groups are dealt to three
kinds of heaps of about ``BUCKET`` groups, largest groups first as in one heap:

1. the groups above a ``BUCKET``-th of all bytes, of which there are fewer than
   ``BUCKET``, leave a partial partition of some spread;
2. hashed buckets of the other groups, each with an equal share of that partial
   partition as one more item, so that together they even it out;
3. one more hashed bucket, kept back, with the sums so far as one more item:
   its small groups take up what the rounding of all others has left.

The extra item names the shards, so only ``shards`` sums pass from one step to
the next, and no level is repeated however many groups there are.

A group is one row with its byte sum before anything is combined, however many
copies it has. Slots number the rows of a shard from 0 without gaps: rows are
dealt to cells by a hash of a row number that is written once, numbered within
cells, and cells are laid end to end.

Defined results: a null text counts as the empty text (size 1) and is grouped
with it; null ids are kept; repeated rows are rows of their own in one group;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.workspace import written

SHARDS = 8
BUCKET = 4096
CELL_ROWS = 20_000


def difference(sums: np.ndarray) -> np.ndarray:
    """For each item (a row of ``shards`` sums) and part, the part it ends in."""
    count, k = sums.shape
    heap, nodes = [], []
    for i, row in enumerate(sums.tolist()):
        # A node's vector is in descending order; its parts name their own places.
        order = sorted(range(k), key=lambda j: (-row[j], j))
        vector = [row[j] for j in order]
        nodes.append((order, None, None))
        heap.append((vector[-1] - vector[0], i, vector))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, two = heapq.heappop(heap)
        total = [x + y for x, y in zip(one, reversed(two), strict=True)]
        order = sorted(range(k), key=lambda j: (-total[j], j))
        low = min(total)
        vector = [total[j] - low for j in order]
        heapq.heappush(heap, (vector[-1] - vector[0], len(nodes), vector))
        nodes.append((order, a, b))
    goes = np.empty((count, k), dtype=np.int64)
    open_ = [(len(nodes) - 1, list(range(k)))] if count else []
    while open_:
        node, final = open_.pop()
        order, a, b = nodes[node]
        place = [0] * k
        for rank, j in enumerate(order):
            place[j] = final[rank]
        if a is None:
            goes[node] = place
        else:
            open_.append((a, place))
            open_.append((b, place[::-1]))
    return goes


def _spread(groups: DataFrame, by: str, start: list[int], key_type: str = "binary") -> DataFrame:
    """``item``, ``shard`` and ``bytes``, each ``by`` differenced together with the partition ``start``."""
    k = len(start)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"])
        sums = np.zeros((len(frame) + 1, k), dtype=np.int64)
        # Equal sums are told apart by place; turning the places keeps buckets from all favouring one shard.
        turn = int(frame[by].iloc[0]) % k
        sums[0] = np.roll(start, turn)
        sums[1:, 0] = frame["bytes"]
        goes = difference(sums)
        name = np.empty(k, dtype=np.int64)
        name[goes[0]] = (np.arange(k) - turn) % k
        return pd.DataFrame({"item": frame["item"], "shard": name[goes[1:, 0]], "bytes": frame["bytes"]})

    return groups.groupBy(by).applyInPandas(one, f"item {key_type}, shard int, bytes long")


def assign_groups(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """``item`` and ``shard`` for the groups in (item binary, bytes)."""
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = F.col("bytes") * bucket > total
    # All in one heap if they fit; else the last bucket is the one kept back.
    buckets = 0 if count <= bucket else -(-count // bucket)
    dealt = groups.withColumn("bucket", F.when(large, -1).otherwise(
        F.pmod(F.xxhash64("item"), F.lit(buckets + 1))).cast("int") if buckets else F.lit(-1))

    def sums(done: DataFrame) -> list[int]:
        found = dict(done.groupBy("shard").agg(F.sum("bytes")).collect())
        return [found.get(j, 0) for j in range(shards)]

    first = written(_spread(dealt.where("bucket = -1"), "bucket", [0] * shards), "large")
    if not buckets:
        return first.select("item", "shard")
    left = sums(first)
    share = [(x - min(left)) // buckets for x in left]
    second = written(_spread(dealt.where(f"bucket >= 0 AND bucket < {buckets}"), "bucket", share), "buckets")
    so_far = [x + y for x, y in zip(left, sums(second), strict=True)]
    third = _spread(dealt.where(f"bucket = {buckets}"), "bucket", [x - min(so_far) for x in so_far])
    return first.union(second).union(third).select("item", "shard")


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with a ``slot`` from 0 within each ``by``; ``order`` is unique."""
    cells = max(1, -(-rows.count() // CELL_ROWS))
    dealt = written(rows.withColumn("_cell", F.pmod(F.xxhash64(order), F.lit(cells))), "cells")
    before = dealt.groupBy(by, "_cell").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_cell")) - F.col("_n"))
    at = F.row_number().over(Window.partitionBy(by, "_cell").orderBy(order))
    return dealt.withColumn("_at", at).join(before.drop("_n"), [by, "_cell"]).withColumn(
        "slot", F.col("_before") + F.col("_at") - 1).drop("_cell", "_at", "_before")


def shard(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("item"), F.monotonically_increasing_id().alias("_row")), "rows")
    groups = rows.groupBy("item").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards, bucket), "item").drop("item")
    return numbered(placed, "shard", "_row").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))

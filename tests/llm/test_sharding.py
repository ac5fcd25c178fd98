"""Differencing against a plain version, and the shards' laws."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillwise.llm import sharding


def plain(sizes: list[int], k: int) -> list[int]:
    """Karmarkar-Karp over sets, without names or heaps."""
    parts = [[(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0]))
    return sorted(p[0] for p in parts[0])


@pytest.mark.parametrize("seed", range(6))
def test_difference(seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 8])
    sizes = rng.sample(range(1, 10_000), 40)
    sums = np.zeros((40, k), dtype=np.int64)
    sums[:, 0] = sizes
    goes = sharding.difference(sums)
    assert (np.sort(goes, axis=1) == np.arange(k)).all()
    found = np.bincount(goes[:, 0], sizes, minlength=k)
    assert sorted(found) == plain(sizes, k)


def test_partial_partitions_combine():
    rng = np.random.default_rng(1)
    sums = rng.integers(0, 1000, (30, 4))
    goes = sharding.difference(sums)
    total = np.zeros(4, dtype=int)
    for row, to in zip(sums, goes, strict=True):
        total[to] += row
    assert total.max() - total.min() < 100


@pytest.mark.parametrize("bucket", [4096, 40])
def test_shards(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "CELL_ROWS", 40)
    rng = random.Random(bucket)
    rows = [(i, "é" * rng.randint(0, 400) + str(rng.randint(0, 80)), "x") for i in range(400)]
    rows += [(7, None, "n"), (8, "", "e"), (None, "null id", "i"), (1, rows[1][1], "r"), (1, rows[1][1], "r")]
    rows += [(1000 + i, "one text of many", "h") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    found = sharding.shard(docs, 8, bucket).collect()
    assert len(found) == len(rows)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    homes, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in found:
        homes[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) <= set(range(8)) and max(size.values()) - min(size.values()) < (20 if bucket > 400 else 200)


def test_empty_and_one(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert sharding.shard(docs.limit(0)).count() == 0
    (row,) = sharding.shard(docs).collect()
    assert (row.size, row.slot) == (2, 0) and 0 <= row.shard < 8

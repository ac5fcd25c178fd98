"""SimHash fingerprints and classes against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tillwise.llm import components, simhash


def slow_print(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints: list[tuple]) -> dict:
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups: dict = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(d)
    return {i: min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(prints))}


def test_fingerprint_of_texts():
    texts = ["", " \t\n", "One", "One two", "ÀB c D e f g", "a b c " * 70_000, "Mixed CASE words and Ünïcode here"]
    got = simhash.fingerprints([t.encode() for t in texts])
    assert [int(x) & (1 << 64) - 1 for x in got] == [slow_print(t) for t in texts]


def test_spark_hash_is_the_contracts(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert row & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(25):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains and stars of flips, copies too
            prints.append((rng.choice([None, *range(1000)]), fp))
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randrange(64)
    signed = [(i, d, p - (1 << 64) if p >> 63 else p) for i, (d, p) in enumerate(prints)]
    frame = spark.createDataFrame(signed, "i int, doc_id long, fp long")
    made = simhash.classes(frame.select("doc_id", "fp"))
    got = {r.i: r.component_id for r in frame.join(made, "fp").select("i", "component_id").collect()}
    assert got == slow_classes(prints)


def test_long_chain(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (100, 100)], "a int, b int")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {**dict.fromkeys(order, 0), 100: 100, 101: 100}


def test_documents(spark):
    a = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(3, a, "x"), (1, a, "y"), (None, a, "z"), (9, "", "e"), (8, None, "n"), (5, "something quite different in every word", "d"),
            (5, "something quite different in every word", "d"), (None, "only a null id names this one text", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = sorted(((d, f"{slow_print(t):016x}", {"x": 1, "y": 1, "z": 1, "e": 8, "n": 8, "d": 5, "q": None}[c])
                   for d, t, c in rows), key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == ["d", "n", "q", "y"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_at_any_radius(spark, radius):
    rng = random.Random(radius)
    # 10 and 11 differ in one bit; their buckets have smaller ones two bits from the other.
    prints = {0b1010, 0b1011, 0b0010, 0b0011 | 1 << 10, 0b1001, 0b1000}
    for _ in range(12):
        fp = rng.getrandbits(64)
        prints |= {fp} | {fp ^ sum(1 << b for b in rng.sample(range(12), rng.randint(1, 3))) for _ in range(6)}
    # Pairs one bit apart, with a smaller one within one bit of either and two of the other.
    for _ in range(10):
        b = rng.getrandbits(64) | 0b110 << 20
        c = b ^ 1
        prints |= {b, c, b ^ 1 << 21, c ^ 1 << 22}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius).collect()}
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert {tuple(sorted(p)) for p in got} <= near

    def classes(pairs):
        parent = {p: p for p in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        groups = {}
        for p in signed:
            groups.setdefault(root(p), set()).add(p)
        return {frozenset(g) for g in groups.values()}

    assert classes(got) == classes(near)

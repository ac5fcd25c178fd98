"""SetSketch near-duplicates against brute-force Jaccard."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import setsketch as s
from tillwise.llm.textbatch import Run


def slow_set(text: str | None) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) or (frozenset([tuple(words)]) if words else frozenset())


def slow(rows: list[tuple]) -> list[tuple]:
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[root(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame([(t, 1, d) for d, t in rows], "text string, KEY int, doc_id long")
    return sorted(map(tuple, s.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def text(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_sets_are_the_shingles():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one", "one two", "two one", "a b c a b c a b c", "É a b", "x " * 9000,
             " ".join(text(rng, 500)), "a\tb\n c", "A b C"]
    doc, hashes = s.shingle_sets(Run([t.encode() for t in texts]))
    sets = [frozenset(hashes[doc == i].tolist()) for i in range(len(texts))]
    for (a, x), (b, y) in combinations(zip(map(slow_set, texts), sets), 2):
        assert len(a & b) == len(x & y) and len(a) == len(x) and len(b) == len(y)


@pytest.mark.parametrize("j", [0.3, 0.7, 0.85, 0.95])
def test_estimate_and_merge(j):
    rng, errors = np.random.default_rng(3), []
    for _ in range(60):
        n = 400
        both = round(2 * n * j / (1 + j))
        all_ = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
        a, b = all_[:n], all_[n - both:]
        doc = lambda x: np.zeros(len(x), dtype=int)
        x, y, union = (s.registers(doc(h), h, 1) for h in (a, b, all_))
        assert (np.maximum(x, y) == union).all()
        errors.append(s.estimate(x, y, np.array([n]), np.array([n]))[0] - j)
    spread = (j * (1 - j) / len(s.FLIP)) ** 0.5
    assert abs(np.mean(errors)) < spread and np.std(errors) < 1.6 * spread


def test_merged_sketches(spark):
    rows = [(1, "a b c d", "x"), (2, "b c d e f", "x"), (3, "q r s", "y"), (4, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    groups = s.with_sketch(docs).join(docs.select("doc_id", "grp"), "doc_id")
    union = {r.grp: r.registers for r in s.merged(groups, "grp").collect()}
    doc, hashes = s.shingle_sets(Run([b"a b c d", b"b c d e f", b"q r s"]))
    table = s.registers(doc, hashes, 3)
    assert union["x"] == np.maximum(table[0], table[1]).tolist() and union["y"] == table[2].tolist()


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_against_brute_force(spark):
    """Chains, stars, a page template that most texts share, copies and odd texts."""
    rng, rows = random.Random(5), []
    for _ in range(6):
        words = text(rng, rng.randint(20, 200))
        for _ in range(rng.randint(1, 6)):
            rows.append(" ".join(words))
            words = edited(rng, words, 0.02)
    star = text(rng, 300)
    rows += [" ".join(edited(rng, star, 0.01)) for _ in range(60)]
    template = text(rng, 300)
    for _ in range(20):
        own = text(rng, rng.choice([20, 40, 75]))
        rows += [" ".join(template + own), " ".join(template + edited(rng, own, 0.05))]
    rows += ["", None, " \t", "one", "One", "one two", "ONE two", "one two three", rows[0], rows[0].upper(), rows[70]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    cases = list(zip(ids, rows)) + [(None, rows[3]), (None, "alone in the corpus with a null id"), (5, "five again but different")]
    assert got(spark, cases) == slow(cases)
    assert got(spark, []) == []


def test_members_that_the_hub_does_not_reach(spark):
    """Texts of one bucket that are not similar to its hub are linked with each other."""
    rng = random.Random(8)
    template = text(rng, 270)
    rows = []
    for i in range(40):
        own = text(rng, 70)
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:-2]))]
    want = slow(rows)
    assert {r[2] for r in want} == {2 * i for i in range(40)}
    assert got(spark, rows) == want
    distinct = s.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"))
    most = s.buckets(distinct).agg(F.max("count")).first()[0]
    assert most > 20


def test_long_text(spark):
    words = text(random.Random(2), 200_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5])), (3, " ".join(words[:100_000]))]
    assert got(spark, rows) == slow(rows)


def test_edits_of_one_page(spark):
    """A page edited at very different rates: the bounds keep pairs apart, and lose none."""
    rng, page, rows = random.Random(9), text(random.Random(10), 150), []
    for i in range(120):
        mine = edited(rng, page, rng.choice([0.005, 0.01, 0.03, 0.05, 0.08]))
        rows.append(" ".join(mine))
        if i % 4 == 0:  # near copies of an edit, the page's words restored or changed elsewhere
            rows.append(" ".join(edited(rng, mine, 0.01)))
            rows.append(" ".join(a if rng.random() < 0.2 else b for a, b in zip(page, mine, strict=True)))
    cases = list(enumerate(rows))
    assert got(spark, cases) == slow(cases)

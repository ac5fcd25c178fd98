"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tillwise.llm import lexical as x

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, most=10):
    counts = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            if not n:
                continue
            m = 10 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda r: r[:3])
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(scored[:most])]
    return sorted(out, key=str)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame([(t, 0, i) for i, t in docs], "text string, n int, doc_id long")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, Text_ int")
    return sorted(map(tuple, x.rank(d, b, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n=300, items=25):
    rng = random.Random(seed)
    words = [f"{'wW'[i % 2]}ort{i}" for i in range(400)]
    often = [int(400 * rng.random() ** 3) for _ in range(5000)]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(words[rng.choice(often)] for _ in range(k))
    docs = [(i, text(int(1 + 400 * rng.random() ** 4))) for i in range(n)]
    asked = [(i, text(rng.randint(1, 30))) for i in range(items)]
    docs += [(1000 + i, "before it " + t + " and after") for i, (_, t) in enumerate(asked[:8])]
    docs += [(5000 - i, docs[3][1]) for i in range(40)]  # one text forty times: ties beyond ten
    docs += [(None, docs[3][1]), (None, "Ünïcode wörd wort1"), (7, None), (8, ""), (9, ". , !"), (3, docs[3][1]), (11, "rare rare1 RARE")]
    asked += [(100, docs[3][1]), (101, None), (102, ""), (103, "?"), (104, "nowhere found"), (105, "rare"), (105, "rare"), (None, "wort1")]
    return docs, asked


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"bucket": 16, "block": 400}), (3, {"bucket": 7, "most": 3})])
def test_against_brute_force(spark, seed, kw):
    docs, items = corpus(seed)
    assert got(spark, docs, items, **kw) == slow(docs, items, kw.get("most", 10))


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == [] and got(spark, [(1, "a b")], []) == []


def test_long_text(spark):
    docs = [(1, "wort1 " * 300_000 + "gold"), (2, "gold and silver"), (3, "silver")]
    assert got(spark, docs, [(1, "gold wort1 silver")]) == slow(docs, [(1, "gold wort1 silver")])


def test_most_documents_are_not_scored():
    """The bounds do the work: an item with copies in the corpus scores a small part of it."""
    rng = np.random.default_rng(1)
    n, v = 2000, 3000
    own = [np.unique((v * rng.random(60) ** 2).astype(int)) for _ in range(n)]
    own[5] = own[17] = own[40]
    size = np.array([len(o) for o in own])
    member, term = np.repeat(np.arange(n, dtype=np.int32), size), np.concatenate(own)
    order = np.argsort(term, kind="stable")
    tf, m = np.ones(len(term), dtype=np.int64), np.full(len(term), 100)
    impacts = x.impact(tf, m).astype(np.int32)
    norms = np.sqrt(size * float(impacts[0]) ** 2)
    terms_, begin = np.unique(term[order], return_index=True)
    df = np.bincount(term, minlength=v)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    item = x.Item(0, own[5].astype(np.int32), weight[own[5]], 0)
    begins = np.append(begin, len(term))
    largest = np.maximum.reduceat(impacts, begin).astype(np.int64)
    args = (float(norms.max()), np.arange(n), norms, terms_, begins, member[order], impacts, largest)
    assert x.search_bucket(item, *args, 3) > n // 2  # no threshold yet
    assert set(item.docs) == {5, 17, 40}
    assert x.search_bucket(item, *args, 3) < n // 20

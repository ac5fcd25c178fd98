"""Transform, common prefixes and removed bytes against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from tillwise.llm import bwt_dedup


def test_transform_and_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        docs = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 20))).encode() for _ in range(rng.randint(1, 6))]
        symbol, lcp, doc, length = bwt_dedup.transform(docs, 1000)
        assert len(symbol) == sum(map(len, docs)) + len(docs)
        suffixes = [docs[d][len(docs[d]) - n:] for d, n in zip(doc, length, strict=True)]
        assert suffixes == sorted(suffixes)
        values = sorted(set(b"".join(docs)))
        for i, (d, n) in enumerate(zip(doc, length, strict=True)):
            before = docs[d][len(docs[d]) - n - 1] if n < len(docs[d]) else None
            assert symbol[i] == (0 if before is None else values.index(before) + 1)
            if i:
                a, b, k = suffixes[i - 1], suffixes[i], 0
                while k < min(len(a), len(b)) and a[k] == b[k]:
                    k += 1
                assert lcp[i] == k


def brute(texts: list[str | None], width: int):
    blobs = [(t or "").encode() for t in texts]
    places: dict[bytes, int] = {}
    for b in blobs:
        for i in range(len(b) - width + 1):
            places[b[i:i + width]] = places.get(b[i:i + width], 0) + 1
    for b in blobs:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if places[b[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("hot", "chunk", "block"), [(1 << 14, 1 << 20, 1 << 16), (1, 1 << 20, 1 << 16), (1 << 14, 90, 50)])
def test_against_brute_force(spark, monkeypatch, hot, chunk, block):
    monkeypatch.setattr(bwt_dedup, "CHUNK", chunk)
    rng = random.Random(hot + chunk)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(60)) for _ in range(6)]
    texts = [None, "", "ab", "short text", "x" * 300, "ab" * 80, "ab" * 80, "abc" * 90]
    for _ in range(60):
        parts = [rng.choice([rng.choice(shared), "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 50)))])
                 for _ in range(rng.randint(1, 5))]
        text = "".join(parts)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "Z" + text[at:]
        texts.append(text)
    texts += texts[-5:]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "k", i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, key string, n_bytes int").repartition(3)
    found = bwt_dedup.dedup(docs, width=20, gram=6, block=block, hot=hot).collect()
    want = sorted((i if i % 7 else -1, *w) for i, w in enumerate(brute(texts, 20)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == want
    assert sum(r.n_removed > 0 for r in found) > 10
    for r in found:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed


def test_empty_and_whole_copies(spark):
    docs = spark.createDataFrame([(1, "y" * 199), (2, "copy " * 50), (3, "copy " * 50)], "doc_id int, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in bwt_dedup.dedup(docs).collect()}
    assert got == {1: (199, 0, 0), 2: (250, 250, 1), 3: (250, 250, 1)}
    assert bwt_dedup.dedup(docs.limit(0)).count() == 0

"""Seeds and alignment against plain dynamic programming over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tillwise.llm import decontamination as d
from tillwise.llm.textbatch import Run


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)


def smith_waterman(a: list[str], b: list[str]) -> int:
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def sentence(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(n)]


def edit(rng, item, share):
    out = []
    for w in item:
        x = rng.random()
        if x < share / 3:
            out.append("changed" + w)
        elif x < 2 * share / 3:
            out += [w, "added"]
        elif x > share:
            out.append(w)
    return out


@pytest.fixture
def case():
    rng = random.Random(12)
    items = [sentence(rng, rng.randint(12, 50)) for _ in range(12)]
    docs = []
    for i in range(150):
        text = sentence(rng, rng.randint(0, 80))
        if i % 3 == 0:
            text[len(text) // 2:len(text) // 2] = edit(rng, items[i % 12], rng.choice([0, 0.1, 0.25]))
        if i % 10 == 0:
            text += items[(i + 1) % 12][:30]
        docs.append(" ".join(text).capitalize() + ("." if i % 2 else "\n"))
    return items, docs


def test_alignment_is_smith_waterman():
    rng = random.Random(2)
    texts = [sentence(rng, 30) for _ in range(8)]
    for _ in range(20):
        item = edit(rng, rng.choice(texts)[5:25], 0.3)
        found = d.items_of(pa.array([1]), [" ".join(item).encode()], 3, 96)
        run = Run([" ".join(t).encode() for t in texts])
        _, _, doc, word = d.letters(run)
        edge = np.searchsorted(doc, np.arange(len(run) + 1))
        got, a, b = d.align(found, np.zeros(8, int), edge[:-1], edge[1:], word)
        want = [smith_waterman(item, t) for t in texts]
        assert np.allclose(got * 2 * len(item), want)
        for t, lo, x, y, s in zip(texts, edge, a, b, want, strict=False):
            assert smith_waterman(item, t[x - lo:y - lo]) == s


def test_leaks_against_all_pairs(spark, case):
    items, docs = case
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, score string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(docs):
        for j, w in enumerate(items):
            score = smith_waterman(w, words(t)) / (2 * len(w))
            if score >= d.LEAST and any(
                    w[k:k + 4] == words(t)[m:m + 4] for k in range(len(w) - 3) for m in range(len(words(t)) - 3)):
                want[i, j] = score
    assert len(want) > 50
    for block in (8 << 20, 200):
        got = {(r.doc_id, r.item_id): r for r in d.leaks(frame, bench, block_bytes=block).collect()}
        assert {k: pytest.approx(v.score) for k, v in got.items()} == want
    for (i, _), r in got.items():
        assert docs[i][r.start:r.end] == r.passage
    kept = d.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(range(150)) - {i for i, _ in want}


def test_cases(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(400))
    rows = [(1, "before " + passage + " after", "a"), (2, None, "b"), (3, "", "c"), (None, passage.upper().replace(" ", ",\n"), "d"),
            (1, "before " + passage + " after", "a"), (4, long[800:1400], "e"), (5, "clean words only " * 9, "f"),
            (6, "filler " * 50_000 + passage, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([("p", passage), ("p2", passage), ("n", None), ("e", ""), ("s", "two words"), (None, long)], "item_id string, text string")
    got = sorted(((r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, "p"), (1, "p2")] * 2 + [(None, "p"), (None, "p2"), (4, None), (6, "p"), (6, "p2")], key=str)
    assert sorted(r["item_id"] for r in d.clean(docs, bench).collect()) == ["b", "c", "f"]
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0
    assert d.clean(docs, bench.limit(0)).count() == len(rows)


def test_edited_copies_with_one_ngram_left(spark):
    """All pairs with a common trigram, with the intact items among the texts too."""
    rng = random.Random(21)
    items = [[f"i{i}w{k}" for k in range(rng.choice([16, 16, 18, 24, 40]))] for i in range(40)]
    docs = [sentence(rng, 10) + [w if k % 4 != 3 else "other" for k, w in enumerate(item)] + sentence(rng, 5) for item in items]
    docs += [sentence(rng, 8) + edit(rng, item, rng.choice([0.3, 0.4, 0.5])) for item in items for _ in range(6)]
    # Stretched by words put in at one place, behind or before most of the item.
    docs += [item[:k] + [f"in{x}" for x in range(int(0.7 * len(item)))] + item[k:] for item in items[:10] for k in (4, len(item) - 4)]
    docs += items[::2]
    want, without_four = {}, 0
    for i, t in enumerate(docs):
        for j, w in enumerate(items):
            tri = {tuple(t[k:k + 3]) for k in range(len(t) - 2)} & {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
            score = smith_waterman(w, t) / (2 * len(w))
            if tri and score >= d.LEAST:
                want[i, j] = pytest.approx(score)
                without_four += not {tuple(t[k:k + 4]) for k in range(len(t) - 3)} & {tuple(w[k:k + 4]) for k in range(len(w) - 3)}
    assert without_four >= 40
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in d.leaks(frame, bench).collect()} == want


def test_ngrams_in_no_text_are_no_neighbours():
    items = d.items_of(pa.array([1]), [b"a b c d e f g h"], 3, 96)
    _, word_of = d.grams(np.zeros(8, int), items.words, 3)
    count = np.zeros(len(items.gram), dtype=np.int64)
    count[np.searchsorted(items.gram, word_of[2])] = 5
    assert items.at_offset[d.rare(items, count, 2)].tolist() == [2]

"""Repetition measures against brute force over all substrings."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwise.llm import repetition
from tillwise.llm.textbatch import Run

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text: str, least: int) -> dict:
    words = WORD.findall(text)
    n = len(words)
    longest, covered, thrice = 0, set(), set()
    for size in range(1, n):
        places: dict = {}
        for at in range(n - size + 1):
            places.setdefault(tuple(words[at:at + size]), []).append(at)
        for found in places.values():
            if len(found) > 1:
                longest = max(longest, size)
                for at in found:
                    if size >= least:
                        covered |= set(range(at, at + size))
                    if size == 3:
                        thrice |= {at, at + 1, at + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return {
        "n_words": n, "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": again,
        "n_repeat_words": len(thrice), "n_covered": len(covered), "longest_repeat": longest,
        "base_failed": n < 50 or 100 * len(thrice) > 50 * n,
    }


@pytest.fixture
def least(monkeypatch):
    monkeypatch.setattr(repetition, "MIN_REPEAT", 3)
    return 3


def test_against_all_substrings(least):
    rng = random.Random(5)
    for _ in range(150):
        texts = ["".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "ab\t"]) for _ in range(rng.randint(0, 40)))
                 for _ in range(rng.randint(1, 5))]
        found = repetition.measures(Run([t.encode() for t in texts]))
        for i, text in enumerate(texts):
            for name, value in expected(text, least).items():
                assert found[name][i] == value, (name, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té# ", max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    found = repetition.measures(Run([t.encode() for t in texts]))
    for i, text in enumerate(texts):
        for name, value in expected(text, repetition.MIN_REPEAT).items():
            assert found[name][i] == value


def test_query_cases(spark):
    plain = " ".join(f"w{i}" for i in range(80))
    loop = " ".join(["one two three four five six seven eight nine"] * 20)
    part = " ".join(f"x{i}" for i in range(60)) + " " + " ".join(["q r s t u v w x"] * 5)
    rows = [(1, plain, "a"), (2, loop, None), (3, None, "b"), (4, "", "c"), (None, plain, "d"),
            (1, plain, "a"), (5, part, "e"), (6, ("y" * 5 + " ") * 40_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(map(tuple, repetition.measure(docs).select("doc_id", "n_words", "base_failed", "kept").collect()),
                 key=str)
    assert got == sorted([(1, 80, False, True), (1, 80, False, True), (None, 80, False, True),
                          (2, 180, True, False), (3, 0, True, False), (4, 0, True, False),
                          (5, 100, False, True), (6, 40_000, True, False)], key=str)
    kept = repetition.reject(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r["kept"]) for r in kept.collect()) == [(0, "d"), (1, "a"), (1, "a"), (5, "e")]
    assert repetition.measure(docs.limit(0)).count() == 0


def test_one_long_repeat_is_rejected(spark):
    passage = " ".join(f"p{i}" for i in range(45))
    text = passage + " " + " ".join(f"m{i}" for i in range(20)) + " " + passage
    row = repetition.measure(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.longest_repeat == 45 and row.n_covered == 90 and not row.kept


def test_each_limit_decides_alone():
    fresh = iter(range(100_000))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]

    def measured(*parts):
        found = repetition.measures(Run([" ".join(sum(parts, [])).encode()]))
        return {name: value[0] for name, value in found.items()}

    # Three passages of 15 words twice: 90 of 200 words are repeated, none of them is long.
    a, b, c = new(15), new(15), new(15)
    many = measured(a, new(40), b, new(30), c, a, new(20), b, new(20), c)
    assert not many["base_failed"] and many["covered"] == 0.45 and many["longest_repeat"] <= 0.175 * 200
    assert not many["kept"]
    # One passage of 38 words twice: 76 of 200 words.
    passage = new(38)
    one = measured(passage, new(80), passage, new(44))
    assert not one["base_failed"] and one["covered"] == 0.38 and one["longest_repeat"] == 38 and not one["kept"]
    # The same share in short repeats, and one line of 10 words twice in a text of 70, stay.
    a, b, c, e = new(9), new(9), new(10), new(10)
    short = measured(a, new(40), b, new(30), c, e, a, new(20), b, new(34), c, new(1), e)
    assert short["kept"] and short["covered"] > 0.37
    line = new(10)
    assert measured(new(20), line, new(15), line, new(15))["kept"]


def test_copies_apart_against_all_substrings(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(repetition, "MAX_COVERED", 1.0)
    seen = set()
    for _ in range(300):
        n = rng.randint(50, 90)
        words = [f"{rng.randint(0, 10**9)}" for _ in range(n)]
        for _ in range(rng.randint(1, 3)):
            size, at = rng.randint(1, 18), rng.randint(0, n - 40)
            to = at + rng.randint(1, 20)
            for i in range(size):
                words[to + i] = words[at + i]
        limit = int(repetition.MAX_LONGEST * n) + 1
        places: dict = {}
        for at in range(n - limit + 1):
            places.setdefault(tuple(words[at:at + limit]), []).append(at)
        far = any(p[-1] - p[0] >= limit for p in places.values())
        found = repetition.measures(Run([b"x y", " ".join(words).encode(), b""]))
        assert found["kept"][1] == (not found["base_failed"][1] and not far)
        if not found["base_failed"][1]:
            seen.add(far)
    assert seen == {True, False}

"""Counts after edits against encoding the edited text anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tillwise.llm import token_edits

PATH = token_edits.rank_file()
ENCODING = token_edits.counter(PATH)[2]
ALPHABET = list("ab  '\n\n1é.,!st́") + ["'ll", " word", "日本", " ", "<|endoftext|>"]


def edited(text: str, start: int, stop: int, new: str) -> str:
    start = min(max(start, 0), len(text))
    return text[:start] + new + text[min(max(stop, start), len(text)):]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_edits_against_whole_encoding(monkeypatch, block):
    monkeypatch.setattr(token_edits, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(600):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 120)))
        tree = token_edits.Tree(text, PATH)
        for _ in range(4):
            at = rng.randint(-2, len(text) + 3)
            stop, new = at + rng.choice([0, 1, 3, 20, -2]), "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 60])))
            tree.edit(at, stop, new)
            text = edited(text, at, stop, new)
            assert tree.text == text
            assert tree.total == len(ENCODING.encode_ordinary(text))
            pieces = [len(p) for p in tree.pattern.findall(text)]
            assert [n for sizes, _ in tree.leaves for n in sizes] == pieces and tree.n_pieces == len(pieces)
            assert tree.chars[1] == len(text)


def test_only_the_region_is_encoded():
    text = " ".join(f"word{i}" for i in range(5000))
    tree = token_edits.Tree(text, PATH)
    tree.edit(20_000, 20_003, "xyz new")
    assert tree.reencoded < 12


def test_frame(spark):
    long = "some words " * 30_000
    rows = [(1, "plain text here", "a"), (2, None, "b"), (3, "", "c"), (None, "null id", "d"), (1, "plain text here", "a"), (4, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_edits string")
    edits = spark.createDataFrame(
        [(1, 2, 0, 5, "PLAIN"), (1, 1, 99, 120, " end"), (2, 1, 0, 0, "new"), (4, 1, 11, 16, None), (9, 1, 0, 1, "x"), (3, 1, None, None, "y")],
        "doc_id long, step int, start int, stop int, new string")
    got = token_edits.count(token_edits.attach(docs, edits))
    n = lambda t: len(ENCODING.encode_ordinary(t))
    want = {1: (n("plain text here"), n("PLAIN text here end"), 2), 2: (0, n("new"), 1), 3: (0, n("y"), 1),
            4: (n(long), n(edited(long, 11, 16, "")), 1), None: (n("null id"), n("null id"), 0)}
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.tokens_before, r.tokens_after, r.n_edits) == want[r.doc_id]
    assert token_edits.count(token_edits.attach(docs.limit(0), edits)).count() == 0


def test_query(spark):
    from tillwise.llm.queries import op9_token_edits

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    edits = docs.withColumn("e", token_edits.trial_edits(F.col("doc_id"), F.col("text"))).collect()
    want = {}
    for r in edits:
        text = r.text
        for e in r.e:
            text = edited(text, e.start, e.stop, e.new)
        want[r.doc_id] = (len(ENCODING.encode_ordinary(r.text)), len(ENCODING.encode_ordinary(text)), 4)
    got = {r.doc_id: (r.tokens_before, r.tokens_after, r.n_edits) for r in op9_token_edits(spark, sf_dir).collect()}
    assert got == want

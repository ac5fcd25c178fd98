"""The classifier's held-out accuracy and its edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tillwise.llm import quality_classifier as q
from tillwise.llm.queries import op1_quality_classifier

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op1_quality_classifier(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    test = got[got.held_out].merge(labels, on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.98
    assert (test[test.quality == 0].predicted == 0).mean() > 0.95
    # Toxic texts of good quality are good quality; being toxic is another label.
    assert (test[(test.toxic == 1) & (test.quality == 1)].predicted == 1).mean() > 0.98


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text") for i in range(60)], "doc_id int, text string")
    ok = [(i, i % 2) for i in range(60)]
    turned = [(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in ok]
    one, two = (q.train(docs, spark.createDataFrame(x, "doc_id int, quality int"), bits=10) for x in (ok, turned))
    assert (one == two).all() and one.any()


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "fit", lambda rows, bits: seen.append(len(rows)) or np.zeros((1 << bits) + 1))
    docs = spark.createDataFrame([(i, "a b c") for i in range(100)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id int, quality int")
    assert len(q.train(docs, labels, sample=7, bits=8)) == 257


def test_cases(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 5), (2, None, 6), (3, "", 7), (None, "bad ### text", 8), (1, "good words here", 5)],
        "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = q.score(docs, q.train(docs, known, bits=8)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in q.score(docs, q.train(docs, labels.limit(0), bits=8)).collect()} == {0.5}
    assert q.score(docs.limit(0), np.zeros(257, np.float32)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a a a", "é%%% ü###", "x " * 30_000])
def test_vectors_have_length_one(text):
    run = q.Run([text.encode(), b"other words"])
    doc, slot, value = q.features(run, 12)
    for d in set(doc):
        assert np.isclose((value[doc == d] ** 2).sum(), 1)
        assert len(set(slot[doc == d])) == (doc == d).sum()

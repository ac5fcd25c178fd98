"""Pieces against the tokenizer itself, and the packing rules."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillwise.llm import packing
from tillwise.llm.textbatch import Run

PATH = packing.tokenizer_file()
REAL = Tokenizer.from_file(PATH)


def ids(text: str) -> list[int]:
    return REAL.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=50) | st.text(alphabet="aB.,' 's1é́ \t<|endoftext|>ΣΑİ", max_size=30), max_size=4))
def test_encode_is_the_tokenizers(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] or [""]
    for got, text in zip(packing.encode(Run([t.encode() for t in texts]), PATH), texts, strict=True):
        assert got.tolist() == ids(text)


def test_words_of_the_corpus_and_the_vocabulary():
    import pyarrow.parquet as pq

    units = set()
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist():
        units |= set(packing.LETTERS.findall(text.lower()))
    units |= {t[:-4] for t in REAL.get_vocab() if t.endswith("</w>") and packing.LETTERS.fullmatch(t[:-4])}
    units = sorted(units)
    made = packing.ids_of(units, PATH)
    want = REAL.encode_batch_fast(units, add_special_tokens=False)
    assert len(units) > 100_000
    assert all(a == np.array(b.ids, dtype=np.uint32).tobytes() for a, b in zip(made, want, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghiéüßñ", min_size=1, max_size=30), min_size=1, max_size=20))
def test_any_letters(units):
    made = packing.ids_of(units, PATH)
    assert all(np.frombuffer(a, dtype=np.uint32).tolist() == ids(u) for a, u in zip(made, units, strict=True))


def test_special_names_and_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    for text in ["a <|endoftext|> b", "x<|ENDOFTEXT|>y", "It's. O'Neil, 'twas 12,5 a.b.c U.S.A.", "don't won't we'll. they're,"]:
        assert packing.encode(Run([text.encode()]), PATH)[0].tolist() == ids(text)


def test_place_fills_bins_and_balances():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 600, 500)
    rooms = [2048] * (int(lengths.sum()) // 2048)
    pieces, over = packing.place(lengths, rooms, 2048)
    filled = defaultdict(int)
    cost = defaultdict(float)
    for _, _, n, to in pieces:
        filled[to] += n
        cost[to] += n + n * n / 2048
    assert set(filled.values()) == {2048} and len(filled) == len(rooms)
    assert sum(n for *_, n in over) == int(lengths.sum()) % 2048
    assert max(cost.values()) < 1.1 * min(cost.values())


@pytest.mark.parametrize("block", [1 << 19, 3000])
def test_pack(spark, monkeypatch, block):
    rng = random.Random(block)
    words = ["anon", "tion", "the,", "x1.", "é", "Sand"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 200, 3000]))), "s") for i in range(60)]
    rows += [(7, rows[7][1], "again"), (None, "a null id", None), (61, None, "t"), (62, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    monkeypatch.setattr(packing, "BLOCK", block)
    pieces = packing.pack(docs, PATH).collect()
    by_doc = defaultdict(list)
    by_seq = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length and p.length > 0
    for doc_id, text, _ in {r[0]: r for r in rows}.values():
        whole = np.array([*ids(text or ""), 1], dtype="<u4")
        copies = 2 if doc_id == 7 else 1
        parts = by_doc[doc_id]
        assert sum(p.length for p in parts) == copies * len(whole)
        assert all(p.doc_tokens == len(whole) for p in parts)
        assert all(bytes(p.ids) == whole[p.start:p.start + p.length].tobytes() for p in parts)
        covered = np.zeros(len(whole), int)
        for p in parts:
            covered[p.start:p.start + p.length] += 1
        assert (covered == copies).all()
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_query_digest(spark, tmp_path):
    from tillwise.llm.queries import op2_packing

    spark.createDataFrame([(1, "some text here.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row, *_), want = sorted(op2_packing(spark, str(tmp_path)).collect(), key=lambda r: r.start), [*ids("some text here."), 1]
    assert row.doc_tokens == len(want)
    assert row.ids_crc32 == zlib.crc32(np.array(want[:row.length], dtype="<u4").tobytes())

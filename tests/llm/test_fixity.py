"""The audit against a comparison of all records, and how little it descends."""

from __future__ import annotations

import random

from tillwise.llm import fixity


def frames(spark, one, two):
    schema = "file string, offset long, payload string"
    return spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)


def layout(files: int, per_file: int, rng: random.Random):
    rows = []
    for f in range(files):
        at = 0
        for _ in range(per_file):
            body = "".join(rng.choice("abcd\n\"é") for _ in range(rng.randint(0, 60)))
            rows.append((f"f{f}", at, body))
            at += max(1, len(body.encode()))
    return rows


def test_against_all_records(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RANGE", 100)
    monkeypatch.setattr(fixity, "FANOUT", 3)
    rng = random.Random(8)
    one = layout(4, 120, rng)
    two, want = [], {}
    for file, at, body in one:
        kind = rng.choice(["ok"] * 20 + ["lost", "bad", "cut"])
        if file == "f2":
            kind = "ok"
        if kind == "lost":
            want[file, at] = "missing"
            continue
        new = {"ok": body, "bad": body + "!", "cut": body[:-1]}[kind]
        if new != body:
            want[file, at] = "changed"
        two.append((file, at, new))
    two.append(("f9", 5, "more"))
    want["f9", 5] = "extra"
    rng.shuffle(two)
    a, b = frames(spark, one, two)
    got = {(r.file, r.start): r.fault for r in fixity.audit(a, b).collect()}
    assert got == want
    first, second = fixity.trees(a, b)
    leaves = {(r.file, r.node) for r in fixity.differing_leaves(first, second).collect()}
    assert leaves == {(f, at // 100) for f, at in want}
    assert first.height == second.height >= 3
    assert fixity.audit(a, a).count() == 0


def test_cases(spark):
    one = [("a", 0, None), ("a", 0, None), (None, 0, "x"), (None, None, "y"), ("b", 0, "same"), ("b", 0, "other")]
    two = [("a", 0, ""), (None, 0, "x"), (None, None, "z"), ("b", 0, "other"), ("b", 0, "same")]
    a, b = frames(spark, one, two)
    got = {(r.file, r.start): r.fault for r in fixity.audit(a, b).collect()}
    assert got == {("a", 0): "changed", (None, None): "changed"}  # one copy less; another payload
    empty = a.limit(0)
    assert fixity.audit(empty, empty).count() == 0
    assert {r.fault for r in fixity.audit(a, empty).collect()} == {"missing"}
    assert {r.fault for r in fixity.audit(empty, a).collect()} == {"extra"}


def test_layout_is_gapless(spark):
    rows = spark.createDataFrame([((i,), f"http://{i}", "é" * i) for i in range(50)], "row struct<page_id:int>, uri string, payload string")
    laid = fixity.laid_out(rows.coalesce(1), file_bytes=1000).collect()
    at = {}
    for r in laid:
        assert r.offset == at.get(r.file, 0)
        at[r.file] = r.offset + len(r.payload.encode())
        assert r.payload.startswith("WARC/1.0\r\n") and f"Content-Length: {2 * r.row.page_id}\r\n" in r.payload
    assert len(at) > 3

"""Settling claims gives what trying them one after another gives."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from tillwise.plans import claims
from tillwise.plans.claims import TAKEN, refuse_in_turn, replay, settle, settle_singles


def serial(units: list[tuple[int, int, dict[int, int]]], stock: dict[int, int]) -> dict[int, bool]:
    stock, out = dict(stock), {}
    for _, unit, changes in sorted(units, key=lambda u: (u[0], u[1])):
        fits = all(c >= 0 or stock.get(k, 0) + c >= 0 for k, c in changes.items())
        out[unit] = fits
        if fits:
            for k, c in changes.items():
                stock[k] = stock.get(k, 0) + c
    return out


def frames(spark, units, stock):
    lines = spark.createDataFrame(
        [(u, at, k, c) for at, u, changes in units for k, c in changes.items()],
        "unit int, at int, k int, Change int")
    return lines, spark.createDataFrame(list(stock.items()), "k int, Stock int")


@pytest.mark.parametrize("seed,hot_rows", [(1, 10_000), (3, 25)])
def test_settle(spark, pieces, seed, hot_rows):
    rng = random.Random(seed)
    stock = {k: rng.randrange(0, 30) for k in range(12)}
    units = []
    for u in range(60):
        keys = {0 if rng.random() < 0.4 else rng.randrange(14) for _ in range(rng.randrange(1, 4))}
        units.append((rng.randrange(40), u, {
            k: rng.choice([-1, -2, -5, -9, -20, 4]) for k in keys}))
    lines, levels = frames(spark, units, stock)
    made = settle(lines, levels, unit="unit", key="k", order=["at"], hot_rows=hot_rows)
    got = {r.unit: r.Outcome == TAKEN for r in made.collect()}
    assert got == serial(units, stock)


@pytest.mark.parametrize("hot_rows", [10_000, 60])
def test_settle_singles(spark, pieces, hot_rows):
    rng = random.Random(5)
    stock = {k: rng.randrange(0, 30) for k in range(6)}
    units = [(rng.randrange(60), u, {0 if rng.random() < 0.5 else rng.randrange(7):
                                     rng.choice([-1, -3, -7, 2, 6])}) for u in range(150)]
    lines, levels = frames(spark, units, stock)
    made = settle_singles(lines, levels, unit="unit", key="k", order=["at"], hot_rows=hot_rows)
    got = {r.unit: r.Outcome == TAKEN for r in made.collect()}
    assert got == serial(units, stock)


def test_nothing_contended(spark):
    lines, levels = frames(spark, [(1, 1, {1: -2}), (2, 2, {1: -3})], {1: 5})
    for run in (settle, settle_singles):
        made = run(lines, levels, unit="unit", key="k", order=["at"])
        assert {r.Outcome for r in made.collect()} == {TAKEN}


def test_state_goes_over_batches():
    rows = pd.DataFrame({"u": [1, 2, 3, 4], "k": [1, 1, 1, 2], "Base": [5, 5, 5, 0],
                         "Change": [-3, -3, -2, -1]})
    out = list(refuse_in_turn([rows[:2], rows[2:]], "u", "k"))
    assert pd.concat(out)["u"].tolist() == [2, 4]


def test_replay_goes_over_batches():
    rows = pd.DataFrame({
        "_group": [1, 1, 1, 1, 2], "u": [1, 1, 2, 3, 4], "k": [1, 2, 1, 2, 1], "Base": [3, 3, 3, 3, 1],
        "Change": [-2, -2, -2, -1, -1], "Sure": [True, True, False, False, False]})
    for cut in range(6):
        out = pd.concat(list(replay([rows[:cut], rows[cut:]], "u", "k")))
        assert out["u"].tolist() == [2]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each order competes with the one before: in rounds alone 10,000 orders would take thousands."""
    calls = []
    real = claims.per_key
    monkeypatch.setattr(claims, "per_key", lambda *a, **k: calls.append(1) or real(*a, **k))
    n = 10_000
    lines = spark.range(n).selectExpr(
        "id AS unit", "id AS at", "explode(array(id, id + 1)) AS k", "-1 AS Change")
    levels = spark.range(n + 1).selectExpr("id AS k", "1 AS Stock")
    made = settle(lines, levels, unit="unit", key="k", order=["at"])
    assert {r.unit for r in made.where("Outcome = 'taken'").collect()} == set(range(0, n, 2))
    assert len(calls) == claims.ROUNDS


def test_large_groups_go_on_in_rounds(spark):
    rng = random.Random(11)
    stock = {k: rng.randrange(0, 3) for k in range(40)}
    units = [(u, u, {k: -1 for k in {u % 40, (u + 1) % 40, rng.randrange(40)}}) for u in range(60)]
    lines, levels = frames(spark, units, stock)
    for group_rows in (5, 10_000):
        made = settle(lines, levels, unit="unit", key="k", order=["at"], group_rows=group_rows)
        assert {r.unit: r.Outcome == TAKEN for r in made.collect()} == serial(units, stock)

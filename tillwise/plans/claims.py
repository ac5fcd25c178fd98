"""Competing claims on shared stock, decided as if taken one after another.

A unit is one or more lines, each moving the stock of one key by a signed
amount. Units come in a fixed order, and a unit is taken whole or not at all:
it is taken if no key it draws on would fall below zero.

Deciding them in a loop would be serial. Instead every undecided unit is held
against two bounds of the stock it will meet: the lowest, had all undecided
draws before it been taken, and the highest, had only the undecided additions
been. A unit that fits the lowest is in, one that does not fit the highest is
out. The first undecided unit meets equal bounds, so each round decides some,
and the outcome is that of the loop.

A chain of units that hang on each other would take as many rounds as it is
long. So after ``ROUNDS`` of them the undecided units are grouped with those
they share a key with, directly or through others. Groups don't affect each
other: each of up to ``GROUP_ROWS`` lines is tried unit by unit in one task, and
only the lines of larger groups go on in rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.components import components
from tillwise.plans.skew import HOT_ROWS, hot_keys, per_key
from tillwise.session import cut_lineage

TAKEN, REFUSED = "taken", "refused"
ROUNDS = 4
GROUP_ROWS = 200_000


def contended(
    lines: DataFrame, stock: DataFrame, *, unit: str, key: str, order: Sequence[str],
    hot_rows: int = HOT_ROWS, probe: DataFrame | None = None,
) -> DataFrame:
    """Lines on keys whose stock may not cover all draws, one per unit and key.

    Any other key refuses nobody, whatever happens elsewhere. Draws are added up
    line by line before any line moves. Lines that all draw may come with a
    ``probe``, their keys from where they are cheap to read again; then draws are
    added up where lines have moved to: with many keys, sums before a shuffle are
    hardly fewer than lines. Only lines on keys left over are grouped. ``Base`` is
    the key's stock, none where it is not ``Known``.
    """
    base = F.coalesce("Stock", F.lit(0)).cast("long")
    known, levels = F.col("Stock").isNotNull(), stock.select(key, "Stock")
    short = base + F.col("_draws") < 0
    if probe is None:
        sums = lines.groupBy(key).agg(F.sum(F.least("Change", F.lit(0))).cast("long").alias("_draws"))
        met = lines.join(
            sums.join(levels, key, "left").where(short)
            .select(key, base.alias("Base"), known.alias("Known")), key)
    else:
        met = (
            per_key(lines, [key], [F.col(c) for c in (*order, unit)], totals={"_draws": "Change"},
                    hot_rows=hot_rows, probe=probe)
            .join(levels, key, "left").where(short)
            .withColumns({"Base": base, "Known": known})
        )
    return met.groupBy(unit, *order, key).agg(
        F.sum("Change").cast("long").alias("Change"), F.first("Base").alias("Base"),
        F.first("Known").alias("Known"))


def _groups(undecided: DataFrame, unit: str, key: str) -> DataFrame:
    """``key`` and ``_group`` for every key with undecided units: keys of one unit are in one group."""
    named = undecided.select(unit, F.col(key).alias("b"))
    edges = named.join(named.groupBy(unit).agg(F.min("b").alias("a")), unit)
    found = components(edges).withColumnRenamed("node", key)
    return undecided.select(key).distinct().join(found, key, "left").select(
        key, F.coalesce("component", key).alias("_group"))


def replay(batches: Iterable[pd.DataFrame], unit: str, key: str) -> Iterator[pd.DataFrame]:
    """Units refused when each group's units are tried one after another.

    Rows come sorted by group, turn and unit. ``Base`` is the stock a line would
    meet without the units here; ``Sure`` ones are taken already.
    """
    now, lines, moved = None, [], {}

    def refused() -> bool:
        if any(not sure and change < 0 and base + moved.get(k, 0) + change < 0 for k, change, base, sure in lines):
            return True
        for k, change, *_ in lines:
            moved[k] = moved.get(k, 0) + change
        return False

    for rows in batches:
        gone = []
        for group, value, k, change, base, sure in zip(
                *[rows[c] for c in ("_group", unit, key, "Change", "Base", "Sure")], strict=True):
            if now != (group, value):
                if now is not None and refused():
                    gone.append(now[1])
                if now is not None and now[0] != group:
                    moved = {}
                now, lines = (group, value), []
            lines.append((k, change, base, sure))
        yield pd.DataFrame({unit: gone})
    if now is not None and refused():
        yield pd.DataFrame({unit: [now[1]]})


def _refused_in_rounds(
    lines: DataFrame, unit: str, key: str, order: Sequence[str], hot_rows: int | None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Units refused. Every round keeps the undecided lines and what was just taken.

    A line's base is its stock after all units before it that are known to be
    taken, so a taken line is needed for one more round only.
    """
    at = [F.col(c) for c in (*order, unit)]
    columns = [unit, *order, key, "Change", "Base", "Sure"]
    open_lines = cut_lineage(lines.withColumn("Sure", F.lit(False)).select(*columns))
    unit_type = lines.schema[unit].dataType.simpleString()
    # Lines only leave, so a key that fits a task now fits it in every round.
    if hot_keys(open_lines, [key], hot_rows=hot_rows) is None:
        hot_rows = None
    refused: list[DataFrame] = []
    sure, change, per_unit = F.col("Sure"), F.col("Change"), Window.partitionBy(unit)
    for turn in count(1):
        moved = open_lines.withColumns({
            "_taken": F.when(sure, change).otherwise(0),
            "_draw": F.when(sure, 0).otherwise(F.least(change, F.lit(0))),
            "_gain": F.when(sure, 0).otherwise(F.greatest(change, F.lit(0))),
        })
        bounded = (
            per_key(moved, [key], at, hot_rows=hot_rows,
                    before={"_t": "_taken", "_d": "_draw", "_g": "_gain"})
            .where(~sure)
            .withColumn("Base", (F.col("Base") + F.col("_t")).cast("long"))
        )
        draws = change < 0
        # Lines meet those of their unit in one shuffle.
        judged = cut_lineage(bounded.withColumns({
            "_fits": F.bool_and(~draws | (F.col("Base") + F.col("_d") + change >= 0)).over(per_unit),
            "_fails": F.bool_or(draws & (F.col("Base") + F.col("_g") + change < 0)).over(per_unit),
        }).select(unit, *order, key, "Change", "Base", "_fits", "_fails"))
        refused.append(judged.where("_fails").select(unit).distinct())
        undecided = judged.where("NOT _fits AND NOT _fails")
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, refused)
        open_lines = judged.where("NOT _fails").withColumn("Sure", F.col("_fits")).select(
            *columns)
        if turn % ROUNDS:
            continue
        # Lines taken for sure matter to the group of their key; other keys have no undecided units.
        grouped = cut_lineage(open_lines.join(_groups(undecided, unit, key), key))
        large = cut_lineage(grouped.groupBy("_group").count().where(F.col("count") > group_rows).select("_group"))
        tried = (
            grouped.join(large, "_group", "left_anti").repartition("_group")
            .sortWithinPartitions("_group", *order, unit)
            .mapInPandas(lambda batches: replay(batches, unit, key), f"`{unit}` {unit_type}")
        )
        refused.append(cut_lineage(tried))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, refused)
        open_lines = cut_lineage(grouped.join(large, "_group").select(*columns))


def settle(
    lines: DataFrame, stock: DataFrame, *, unit: str, key: str, order: Sequence[str],
    hot_rows: int = HOT_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Every unit with its Outcome, taken or refused.

    ``lines`` has ``unit``, ``key``, ``Change`` and the ``order`` columns, the
    same on all lines of a unit; ``stock`` has ``key`` and ``Stock``, one row
    per key. A key without stock row has none to draw on.
    """
    refused = settle_contended(
        contended(lines, stock, unit=unit, key=key, order=order), unit=unit, key=key, order=order,
        hot_rows=hot_rows, group_rows=group_rows)
    return _outcomes(lines, refused, unit)


def settle_contended(
    lines: DataFrame, *, unit: str, key: str, order: Sequence[str], hot_rows: int = HOT_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Units refused, of lines that :func:`contended` gave. Units left out by the caller draw nothing."""
    return _refused_in_rounds(lines, unit, key, order, hot_rows, group_rows)


def _outcomes(lines: DataFrame, refused: DataFrame, unit: str) -> DataFrame:
    return (
        lines.select(unit).distinct()
        .join(refused.withColumn("_refused", F.lit(True)), unit, "left")
        .select(unit, F.when(F.col("_refused"), REFUSED).otherwise(TAKEN).alias("Outcome"))
    )


def refuse_in_turn(
    batches: Iterable[pd.DataFrame], unit: str, key: str
) -> Iterator[pd.DataFrame]:
    """Units refused when each key's changes are tried one after another.

    Rows come sorted by key and turn; nothing but the stock of the present key
    is kept from row to row.
    """
    present, stock = None, 0
    for rows in batches:
        gone = []
        for value, base, change in zip(rows[key], rows["Base"], rows["Change"], strict=True):
            if value != present:
                present, stock = value, base
            short = change < 0 and stock + change < 0
            stock += 0 if short else change
            gone.append(short)
        yield rows.loc[gone, [unit]]


def settle_singles(
    lines: DataFrame, stock: DataFrame, *, unit: str, key: str, order: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """:func:`settle` for units of one line each, which only meet on their key.

    Each key is then a sequence of its own, run through where its rows are
    sorted; only keys too big for one task take rounds.
    """
    open_lines = cut_lineage(contended(lines, stock, unit=unit, key=key, order=order))
    unit_type = lines.schema[unit].dataType.simpleString()
    hot = hot_keys(open_lines, [key], hot_rows=hot_rows)
    small = open_lines if hot is None else open_lines.join(hot, key, "left_anti")
    refused = (
        small.repartition(key).sortWithinPartitions(key, *order, unit)
        .mapInPandas(lambda batches: refuse_in_turn(batches, unit, key), f"`{unit}` {unit_type}")
    )
    if hot is not None:
        big = open_lines.join(hot, key, "left_semi")
        refused = refused.unionByName(_refused_in_rounds(big, unit, key, order, hot_rows))
    return _outcomes(lines, refused, unit)

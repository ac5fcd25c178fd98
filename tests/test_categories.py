"""The category tree: depth, cycles, missing parents, sales of subtrees."""

from __future__ import annotations

from tillwise.operators import categories


def tree(spark, rows):
    frame = spark.createDataFrame(rows, "CategoryID int, ParentCategoryID int")
    return {r.CategoryID: (r.Depth, r.RootID, r.Place) for r in categories.category_tree(frame).collect()}


def test_depth_cycles_and_missing_parents(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 41)]
    rows = [*chain, (50, 51), (51, 52), (52, 50), (53, 52), (54, 53), (60, 60), (70, 999), (71, 70)]
    got = tree(spark, rows)
    assert [got[i] for i in range(1, 41)] == [(i - 1, 1, "tree") for i in range(1, 41)]
    assert all(got[i] == (None, None, "cycle") for i in (50, 51, 52, 60))
    assert all(got[i] == (None, None, "below cycle") for i in (53, 54))
    assert got[70] == (0, 70, "tree") and got[71] == (1, 70, "tree")
    assert tree(spark, []) == {}

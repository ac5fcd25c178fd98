"""Merging changes into a partitioned table, against changing all of it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tillwise.sources.merge import located, merge, save_partitioned

def place():
    return F.substring("day", 1, 7)


def stored(spark, path):
    rows = [(i, f"2024-{1 + i % 6:02d}-{1 + i % 28:02d}", "new", float(i)) for i in range(120)] + [(500, None, "new", 1.0)]
    df = spark.createDataFrame(rows, "k long, day string, status string, total double")
    save_partitioned(df, path, "month", place())
    return {r[0]: r[1:] for r in rows}


def state(spark, path):
    rows = spark.read.parquet(path).select("k", "day", "status", "total").collect()
    assert len({r.k for r in rows}) == len(rows)
    return {r.k: tuple(r)[1:] for r in rows}


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


def test_updates_touch_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    want = stored(spark, path)
    before = files(path)
    changes = spark.createDataFrame([(1, "2024-02", "paid"), (7, "2024-02", None)], "k long, month string, status string")
    assert merge(spark, path, changes, key="k", partition="month", place=place()) == ["2024-02"]
    want[1] = (want[1][0], "paid", want[1][2])
    want[7] = (want[7][0], None, want[7][2])
    assert state(spark, path) == want
    after = files(path)
    same = {f for f in before if "month=2024-02" not in f}
    assert same and all(after[f] == before[f] for f in same)
    assert not any(f in after for f in before if "month=2024-02" in f)


def test_moves_inserts_deletes_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    want = stored(spark, path)
    changes = spark.createDataFrame(
        [(2, "2024-03", "2024-05-09", "moved", 2.0, False), (900, "2025-01", "2025-01-01", "added", 9.0, False),
         (3, "2024-04", None, None, None, True), (500, None, None, "dateless", 5.0, False), (901, "2024-01", None, "lost", 1.0, True)],
        "k long, month string, day string, status string, total double, gone boolean")
    done = merge(spark, path, changes, key="k", partition="month", place=place(), deleted="gone")
    assert done == ["2024-01", "2024-03", "2024-04", "2024-05", "2025-01", None]
    want[2], want[900], want[500] = ("2024-05-09", "moved", 2.0), ("2025-01-01", "added", 9.0), (None, "dateless", 5.0)
    del want[3]
    assert state(spark, path) == want
    assert merge(spark, path, changes.limit(0), key="k", partition="month", place=place()) == []
    # Again: the same table, but for the moved row, which is now looked for where it is.
    found = located(spark.read.parquet(path), changes.where("k = 2").drop("month"), "k", "month")
    merge(spark, path, found, key="k", partition="month", place=place())
    assert state(spark, path) == want


def test_empty_partition_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    want = stored(spark, path)
    gone = spark.read.parquet(path).where("month = '2024-06'").select("k", "month", F.lit(True).alias("gone"))
    merge(spark, path, gone, key="k", partition="month", place=place(), deleted="gone")
    assert state(spark, path) == {k: v for k, v in want.items() if (v[0] or "")[:7] != "2024-06"}
    assert not (tmp_path / "t" / "month=2024-06").exists()


def test_plan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    stored(spark, path)
    from tillwise.sources.merge import _in

    plan = spark.read.parquet(path).where(_in("month", ["2024-02"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-02" in plan.split("PartitionFilters")[1][:120]

"""Streams over many small files end where one batch over all rows ends."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tillwise.operators.audit import order_audit_trail
from tillwise.streaming import jobs

AS_OF = datetime(2024, 1, 31)


def files(df, path, parts):
    df.repartition(parts).write.parquet(path)
    return path


def test_sales_metrics(spark, tmp_path):
    orders = spark.createDataFrame(
        [(i, datetime(2024, 1, 1 + i % 9, i % 24), ["Shipped", "Pending"][i % 2], Decimal(i))
         for i in range(200)],
        "OrderID int, OrderDate timestamp_ntz, OrderStatus string, TotalAmount decimal(12,4)")
    folder, target = files(orders, str(tmp_path / "in"), 4), str(tmp_path / "out")
    stream = jobs.file_stream(spark, folder, orders.schema, files_per_batch=1)
    jobs.stream_sales_metrics(stream, target, lateness="30 days").awaitTermination()
    want = orders.groupBy(
        F.date_trunc("day", "OrderDate").alias("Day"), "OrderStatus").agg(
        F.count("*").alias("Orders"), F.sum("TotalAmount").alias("Revenue"))
    got = jobs.sales_metrics(spark, target)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stock_ledger_over_batches(spark, tmp_path):
    products = spark.createDataFrame(
        [(p, Decimal(1), 100, 30, AS_OF) for p in range(5)],
        "ProductID int, Price decimal(12,4), StockQuantity int, ReorderLevel int,"
        " ModifiedDate timestamp_ntz")
    moves = spark.createDataFrame(
        [(i % 5 if i % 3 else 0, -(i % 4)) for i in range(120)], "ProductID int, Quantity int")
    folder, target = files(moves, str(tmp_path / "in"), 5), str(tmp_path / "out")
    stream = jobs.file_stream(spark, folder, moves.schema, files_per_batch=1)
    jobs.stream_stock_ledger(stream, products, target, as_of=AS_OF).awaitTermination()
    want = {p: 100 + sum(-(i % 4) for i in range(120) if (i % 5 if i % 3 else 0) == p)
            for p in range(5)}
    got = {r.ProductID: r.StockQuantity
           for r in jobs.stock_levels(spark, products, target).collect()}
    assert got == want
    alerts = [r.PrimaryKeyValue for r in jobs.stock_alert_log(spark, target).collect()]
    low = [str(p) for p, s in want.items() if s <= 30]
    assert sorted(alerts) == low


def test_stock_state_outlives_the_query(spark, tmp_path):
    """Stopped and started again over more files, with products that nobody knows."""
    products = spark.createDataFrame(
        [(p, 100, 30) for p in range(3)], "ProductID int, StockQuantity int, ReorderLevel int")
    target, folder, total = str(tmp_path / "out"), str(tmp_path / "in"), {}
    for part in range(3):
        rows = [((i * 7 + part) % 5 if i % 4 else None, -(i % 3) - part) for i in range(40)]
        for p, q in rows:
            total[p] = total.get(p, 0) + q
        moves = spark.createDataFrame(rows, "ProductID int, Quantity int")
        moves.repartition(2).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, moves.schema, files_per_batch=1)
        jobs.stream_stock_ledger(stream, products, target, as_of=AS_OF).awaitTermination()
    levels = {r.ProductID: r.StockQuantity for r in jobs.stock_levels(spark, products, target).collect()}
    assert levels == {p: 100 + total[p] for p in range(3)}
    rejected = jobs.stock_rejects(spark, target).groupBy("ProductID").agg(
        F.sum("Quantity").alias("q"), F.max("RejectedBefore").alias("first")).collect()
    assert {r.ProductID: r.q for r in rejected} == {p: total[p] for p in (3, 4, None)}
    assert {r.first for r in rejected} == {0}
    ledger = jobs.stock_ledger(spark, target).orderBy(F.desc("PreviousStock"), F.desc("NewStock")).collect()
    for p in range(3):
        own = [r for r in ledger if r.ProductID == p]
        assert own[0].PreviousStock == 100 and own[-1].NewStock == levels[p]
        assert all(a.NewStock == b.PreviousStock for a, b in zip(own, own[1:]))


def test_order_audit_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SNAPSHOT_EVERY", 2)
    columns = "OrderID int, CustomerID int, TotalAmount decimal(12,4), OrderStatus string"
    before = spark.createDataFrame(
        [(i, i, Decimal(i), "Pending") for i in range(1, 6)], columns)
    steps = [
        [(1, 1, Decimal(1), "Shipped", False), (9, 9, Decimal(9), "Pending", False)],
        [(1, 1, Decimal(2), "Shipped", False), (2, 2, Decimal(2), "Pending", True)],
        [(2, 2, Decimal(2), "Pending", False), (9, 9, Decimal(9), "Pending", True)],
        [(1, 1, Decimal(2), "Shipped", False), (2, 2, Decimal(3), "Pending", False)],
    ]
    target, folder = str(tmp_path / "out"), str(tmp_path / "in")
    want, state = [], before
    for rows in steps:
        change = spark.createDataFrame(rows, f"{columns}, Deleted boolean").withColumn("At", F.lit(1))
        change.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, change.schema)
        jobs.stream_order_audit(
            stream, before, target, as_of=AS_OF, sequence="At").awaitTermination()
        kept = state.join(change, "OrderID", "left_anti").unionByName(
            change.where("NOT Deleted").drop("Deleted", "At"))
        want += order_audit_trail(state, kept, as_of=AS_OF).collect()
        state = spark.createDataFrame(kept.collect(), kept.schema)
    got = jobs.order_audit_log(spark, target).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_several_changes_of_an_order_in_a_batch(spark, tmp_path):
    columns = "OrderID int, CustomerID int, TotalAmount decimal(12,4), OrderStatus string"
    before = spark.createDataFrame([(1, 1, Decimal(1), "Pending")], columns)
    rows = [(1, 1, Decimal(1), "Shipped", False, 3), (1, 1, Decimal(1), "Processing", False, 2),
            (1, 1, Decimal(1), "Shipped", True, 4), (1, 1, Decimal(2), "Pending", False, 5),
            (7, 7, Decimal(7), "Pending", False, 1), (7, 7, Decimal(7), "Pending", True, 2),
            (8, 8, Decimal(8), "Pending", True, 1)]
    change = spark.createDataFrame(rows, f"{columns}, Deleted boolean, At int")
    folder, target = files(change, str(tmp_path / "in"), 3), str(tmp_path / "out")
    stream = jobs.file_stream(spark, folder, change.schema)
    jobs.stream_order_audit(stream, before, target, as_of=AS_OF, sequence="At").awaitTermination()
    got = sorted((r.PrimaryKeyValue, r.Operation, str(r.OldValues)[:24], str(r.NewValues)[:24])
                 for r in jobs.order_audit_log(spark, target).collect())
    assert [g[:2] for g in got] == [("1", "DELETE"), ("1", "INSERT"), ("1", "UPDATE"), ("1", "UPDATE"),
                                    ("7", "DELETE"), ("7", "INSERT")]
    moves = {(g[2].split(",")[0], g[3].split(",")[0]) for g in got if g[1] == "UPDATE"}
    assert moves == {("OrderStatus=Pending", "OrderStatus=Processing"), ("OrderStatus=Processing", "OrderStatus=Shipped")}


def test_alert_below_zero_and_ledger(spark, tmp_path):
    products = spark.createDataFrame([(1, 100, 30), (2, 100, 30)], "ProductID int, StockQuantity int, ReorderLevel int")
    moves = spark.createDataFrame([(1, -150), (2, -10)], "ProductID int, Quantity int")
    folder, target = files(moves, str(tmp_path / "in"), 1), str(tmp_path / "out")
    stream = jobs.file_stream(spark, folder, moves.schema)
    jobs.stream_stock_ledger(stream, products, target, as_of=AS_OF).awaitTermination()
    assert [r.PrimaryKeyValue for r in jobs.stock_alert_log(spark, target).collect()] == ["1"]
    assert {tuple(r) for r in jobs.stock_ledger(spark, target).collect()} == {(1, -150, 100, -50), (2, -10, 100, 90)}


def test_sales_day_in_another_zone_and_late_rows(spark, tmp_path):
    rows = [[(1, datetime(2024, 3, 10, 23), "Shipped", Decimal(1)), (2, datetime(2024, 3, 11, 0), "Shipped", Decimal(2))],
            [(3, datetime(2024, 3, 1), "Shipped", Decimal(4))], [(4, datetime(2024, 3, 1), "Shipped", Decimal(8))]]
    schema = "OrderID int, OrderDate timestamp_ntz, OrderStatus string, TotalAmount decimal(12,4)"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    late = 0
    try:
        for part in rows:
            frame = spark.createDataFrame(part, schema)
            frame.coalesce(1).write.mode("append").parquet(folder)
            query = jobs.stream_sales_metrics(
                jobs.file_stream(spark, folder, frame.schema), target, lateness="2 days")
            query.awaitTermination()
            late += sum(jobs.late_rows(query).values())
        got = {(r.Day, r.Orders) for r in jobs.sales_metrics(spark, target).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {(datetime(2024, 3, 10), 1), (datetime(2024, 3, 11), 1)}
    assert late == 2


def test_stock_state_is_kept_without_python(spark, tmp_path):
    """No call of Python per product; products without a known quantity are touched, too, and read as zero."""
    products = spark.createDataFrame([(1, 100, 30), (2, 100, 30)], "ProductID int, StockQuantity int, ReorderLevel int")
    target, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for rows in ([(1, None), (2, 5), (2, -5), (None, 3)], [(1, -80), (None, None), (9, -1)], [(1, 2), (None, 4)]):
        moves = spark.createDataFrame(rows, "ProductID int, Quantity int")
        moves.coalesce(1).write.mode("append").parquet(folder)
        query = jobs.stream_stock_ledger(
            jobs.file_stream(spark, folder, moves.schema), products, target, as_of=AS_OF)
        query.awaitTermination()
        assert "Python" not in query._jsq.explainInternal(False) and "Pandas" not in query._jsq.explainInternal(False)
    assert sorted(map(tuple, jobs.stock_ledger(spark, target).collect())) == [
        (1, -80, 100, 20), (1, 0, 100, 100), (1, 2, 20, 22), (2, 0, 100, 100)]
    rejects = jobs.stock_rejects(spark, target).select("ProductID", "Quantity", "RejectedBefore")
    assert {tuple(r) for r in rejects.collect()} == {(None, 3, 0), (None, 0, 3), (9, -1, 0), (None, 4, 3)}
    assert {tuple(r) for r in jobs.stock_levels(spark, products, target).collect()} == {(1, 22, 30), (2, 100, 30)}

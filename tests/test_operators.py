"""Edge rows of the operators, and recommendations against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.seed import AS_OF, opening_store, request_frame
from tillwise import model
from tillwise.operators import audit, orders, prep, privacy, quality, recommend, reports, views
from tillwise.sources.star import split_columns
from tillwise.store import Store


@pytest.fixture(scope="module")
def empty(spark):
    return Store(spark, {n: spark.createDataFrame([], model.schema(n)) for n in model.TABLES})


def test_report_dispatch(empty):
    kinds = {k: set(reports.sales_report(empty, k, as_of=AS_OF)) for k in
             ("Summary", "Category", "Product", "Detailed", "Other")}
    assert kinds == {"Summary": {"summary"}, "Category": {"category"}, "Product": {"product"},
                     "Detailed": {"category", "product", "monthly"}, "Other": set()}
    with pytest.raises(ValueError, match="Start date"):
        reports.sales_report(empty, as_of=AS_OF, start=AS_OF, end=AS_OF - timedelta(days=1))


def test_empty_tables(empty):
    row = reports.sales_report_summary(empty, as_of=AS_OF).first()
    assert (row.TotalOrders, row.TotalRevenue, row.AverageOrderValue) == (0, None, None)
    row = views.sales_performance_dashboard(empty, as_of=AS_OF).first()
    assert (row.OrdersToday, row.RevenueToday, row.OrderGrowthRate) == (0, None, 0.0)
    for made in (views.customer_analytics(empty, as_of=AS_OF),
                 views.product_performance(empty, as_of=AS_OF),
                 views.inventory_dashboard(empty, as_of=AS_OF),
                 views.customer_order_history(empty),
                 quality.check_data_integrity(empty)):
        assert made.count() == 0


def order_rows(spark, rows):
    return spark.createDataFrame(
        [(o, c, d, s, Decimal(t)) for o, c, d, s, t in rows],
        "OrderID string, CustomerID string, OrderDate timestamp_ntz, OrderStatus string,"
        " TotalAmount decimal(12,4)")


def test_dashboard_with_old_orders_only(empty, spark):
    old = order_rows(spark, [("A", "C1", datetime(2020, 1, 1), "Delivered", "10")])
    row = views.sales_performance_dashboard(empty.replacing(sales_order=old), as_of=AS_OF).first()
    assert (row.OrdersToday, row.RevenueToday, row.RevenueThisYear) == (0, 0, 0)
    assert row.AOVLast30Days is None
    cancelled = order_rows(spark, [("A", "C1", datetime(2020, 1, 1), "Cancelled", "10")])
    row = views.sales_performance_dashboard(
        empty.replacing(sales_order=cancelled), as_of=AS_OF).first()
    assert row.RevenueToday is None


def test_rejects_in_order_of_the_checks(spark):
    store = opening_store(spark)
    good = request_frame(spark).where("OrderID = 'O1'")
    off = {
        "customer": {"CustomerID": F.lit("C99")},
        "malformed": {"OrderItems": F.lit("[{")},
        "number": {"OrderItems": F.lit(
            '[{"ProductID":"MCT-001","Quantity":"some","UnitPrice":1}]')},
        "none": {"OrderItems": F.lit("[]")},
        "negative": {"OrderItems": F.lit(
            '[{"ProductID":"MCT-001","Quantity":-1,"UnitPrice":1}]')},
        "product": {"OrderItems": F.lit('[{"ProductID":"NO","Quantity":1,"UnitPrice":1}]')},
        "twice": {"OrderItems": F.lit(
            '[{"ProductID":"DXPS13-001","Quantity":20,"UnitPrice":1},'
            '{"ProductID":"DXPS13-001","Quantity":11,"UnitPrice":1}]')},
        "shipping": {"ShippingAddressID": F.lit(3)},
        "billing": {"BillingAddressID": F.lit(2)},
        "no_address": {"ShippingAddressID": F.lit(None).cast("int")},
    }
    requests = None
    for name, edit in off.items():
        one = good.withColumns({"OrderID": F.lit(name), **edit})
        requests = one if requests is None else requests.unionByName(one)
    want = {
        "customer": "Customer not found or inactive.",
        "malformed": model.MALFORMED_ITEMS, "number": model.MALFORMED_ITEMS,
        "negative": model.MALFORMED_ITEMS, "none": model.NO_ITEMS,
        "product": "One or more products are invalid or inactive.",
        "twice": "Insufficient inventory for one or more products.",
        "shipping": "Invalid shipping address.", "billing": "Invalid billing address.",
        "no_address": None,
    }
    got = {r.OrderID: r.ErrorMessage for r in orders.validate_orders(store, requests).collect()}
    assert got == want
    made = orders.process_orders(store, requests, as_of=AS_OF)
    rejects = {r.OrderID: r.ErrorMessage for r in made["rejects"].collect()}
    assert rejects == {k: v for k, v in want.items() if v}
    assert [r.OrderID for r in made["orders"].collect()] == ["no_address"]


def test_zero_tax_rate_and_totals_after_changes(empty, spark):
    orders_ = order_rows(spark, [("A", "C1", AS_OF, "Pending", "0"),
                                 ("B", "C1", AS_OF, "Pending", "0"),
                                 ("C", "C1", AS_OF, "Pending", "7")])
    money = "CAST({} AS DECIMAL(12,4))"
    orders_ = orders_.selectExpr(
        "*", f"{money.format(1)} AS SubTotal",
        "CAST(CASE OrderID WHEN 'A' THEN 0 ELSE 2 END AS DECIMAL(12,4)) AS TaxAmount",
        f"{money.format(3)} AS ShippingAmount", f"{money.format(1)} AS DiscountAmount",
        "OrderDate AS ModifiedDate")
    lines = spark.createDataFrame(
        [("A", Decimal("100"))], "OrderID string, LineTotal decimal(18,4)")
    store = empty.replacing(sales_order=orders_, order_detail=lines)
    gone = spark.createDataFrame([("B",)], "OrderID string")
    made = quality.recompute_order_totals(store, lines.select("OrderID"), gone, as_of=AS_OF)
    rows = {r.OrderID: (r.SubTotal, r.TaxAmount, r.TotalAmount) for r in made.collect()}
    assert rows == {"A": (100, Decimal("8.75"), Decimal("110.75")), "B": (0, 2, 4)}


def test_two_new_defaults(spark):
    everyone = spark.createDataFrame(
        [(1, "C1", True), (2, "C1", True), (3, "C1", True), (4, "C2", True), (5, "C2", False)],
        "ID int, CustomerID string, IsDefault boolean")
    changed = everyone.where("ID IN (2, 3, 5)")
    plain = quality.enforce_default_address(everyone, changed, "ID")
    assert {r.ID for r in plain.where("IsDefault").collect()} == {4}
    kept = quality.enforce_default_address(everyone, changed, "ID", corrected=True)
    assert {r.ID for r in kept.where("IsDefault").collect()} == {3, 4}


def test_unknown_passes_checks(empty, spark):
    rows = spark.createDataFrame(
        [(1, "A", None, None), (1, "A", None, None)],
        "CategoryID int, CategoryName string, CategoryDescription string, ParentCategoryID int")
    table = prep.apply_defaults(rows, "category", as_of=AS_OF)
    made = quality.constraint_violations(empty.replacing(category=table), ["category"])
    found = {r.ConstraintName: r.ViolatingRows for r in made.collect() if r.ViolatingRows}
    assert found == {"primary_key": 2, "category_name": 2}


def test_keys_must_be_known(empty, spark):
    rows = spark.createDataFrame([(None, "A"), (None, "B"), (3, None)], "CategoryID int, CategoryName string")
    table = prep.apply_defaults(rows.withColumn("ParentCategoryID", F.lit(None).cast("int")), "category", as_of=AS_OF)
    made = quality.constraint_violations(empty.replacing(category=table), ["category"])
    found = {r.ConstraintName: r.ViolatingRows for r in made.collect() if r.ViolatingRows}
    assert found == {"primary_key": 2, "CategoryID_required": 2, "CategoryName_required": 1}


def test_defaults_do_not_hide_unknown_values(spark):
    rows = spark.createDataFrame([("A", None)], "CategoryName string, IsActive boolean")
    assert prep.apply_defaults(rows, "category", as_of=AS_OF).first().IsActive is None
    assert prep.apply_defaults(rows, "category", as_of=AS_OF, fill_unknown=True).first().IsActive is True


def test_hash_keys_differ(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", "", None), ("a", "|b", None), (None, "a", "b")],
                                 "x string, y string, z string")
    assert prep.with_hash_key(rows, "k", "x", "y", "z").select("k").distinct().count() == 5


def test_key_is_not_in_the_plan(spark, capsys):
    key = "0123456789abcdef"
    people = spark.createDataFrame([(1, "a@b.c", "555")], "CustomerID int, Email string, PhoneNumber string").repartition(2)
    shown = privacy.reveal_customer_pii(privacy.protect_customer_pii(people, key), key)
    assert shown.first().Email == "a@b.c"
    shown.explain(True)
    shown.explain("formatted")
    assert key not in capsys.readouterr().out


def test_order_audit_kinds(spark):
    before = order_rows(spark, [("A", "C1", AS_OF, "Pending", "1"), ("B", "C1", AS_OF, "Pending", "2"),
                                ("C", "C1", AS_OF, "Pending", "3")])
    after = order_rows(spark, [("A", "C1", AS_OF, "Shipped", "1"), ("B", "C1", AS_OF, "Pending", "2"),
                               ("D", "C2", AS_OF, "Pending", "4.5")])
    rows = {r.PrimaryKeyValue: (r.Operation, r.OldValues, r.NewValues)
            for r in audit.order_audit_trail(before, after, as_of=AS_OF).collect()}
    assert rows == {
        "A": ("UPDATE", "OrderStatus=Pending, TotalAmount=1.0000",
              "OrderStatus=Shipped, TotalAmount=1.0000"),
        "C": ("DELETE", "CustomerID=C1, TotalAmount=3.0000, OrderStatus=Pending", None),
        "D": ("INSERT", None, "CustomerID=C2, TotalAmount=4.5000, OrderStatus=Pending")}


def test_encryption_is_random_and_reversible(spark):
    key = "0123456789abcdef0123456789abcdef"
    people = opening_store(spark).scan("customer").limit(2)
    runs = [privacy.protect_customer_pii(people, key).collect() for _ in range(2)]
    assert len({bytes(r.Email) for rows in runs for r in rows}) == 4
    assert [r.EmailHash for r in runs[0]] == [r.EmailHash for r in runs[1]]
    shown = privacy.reveal_customer_pii(privacy.protect_customer_pii(people, key), key)
    assert {r.Email for r in shown.collect()} == {r.Email for r in people.collect()}


def test_many_returns_do_not_overflow(empty, spark):
    store = opening_store(spark)
    back = spark.createDataFrame(
        [(f"R{i}", "O", "MCT-001", 3, Decimal("1"), "Processed") for i in range(7)],
        "ReturnID string, OrderID string, ProductID string, ReturnQuantity int,"
        " RefundAmount decimal(12,4), ReturnStatus string")
    made = views.product_performance(store.replacing(product_return=back), as_of=AS_OF)
    row = made.where("ProductID = 'MCT-001'").first()
    assert (row.TotalReturnQuantity, row.ReturnRate) == (21, 0.0)


def brute_force(purchases, products, sold, wanted):
    out = {}
    sizes: dict[int, int] = {}
    for _, (category, _, _) in products.items():
        sizes[category] = sizes.get(category, 0) + 1
    for customer, mine in purchases.items():
        counts: dict[int, int] = {}
        for p in mine:
            counts[products[p][0]] = counts.get(products[p][0], 0) + 1
        ranked = sorted(
            (-counts[c] * sizes[c], -sold.get(p, 0), p)
            for p, (c, stock, active) in products.items()
            if c in counts and stock > 0 and active and p not in mine)
        out[customer] = [(p, i + 1) for i, (_, _, p) in enumerate(ranked[:wanted])]
    return {c: v for c, v in out.items() if v}


@pytest.mark.parametrize("seed,hot_rows", [(1, 10_000), (2, 25)])
def test_recommendations_against_brute_force(empty, spark, pieces, seed, hot_rows):
    rng = random.Random(seed)
    products = {f"P{i:02}": (rng.randrange(1, 6), rng.randrange(0, 4), rng.random() < 0.85)
                for i in range(40)}
    lines, orders_, sold = [], [], {}
    purchases: dict[str, set[str]] = {}
    for o in range(60):
        customer, cancelled = f"C{rng.randrange(8)}", rng.random() < 0.2
        orders_.append((f"O{o}", customer, AS_OF, "Cancelled" if cancelled else "Shipped", "1"))
        for _ in range(rng.randrange(0, 6)):
            p, q = rng.choice(sorted(products)), rng.randrange(1, 5)
            lines.append((f"L{len(lines)}", f"O{o}", p, q, Decimal("1"), Decimal("1")))
            sold[p] = sold.get(p, 0) + q
            if not cancelled:
                purchases.setdefault(customer, set()).add(p)
    store = empty.replacing(
        category=spark.createDataFrame(
            [(c, f"K{c}") for c in range(1, 6)], "CategoryID int, CategoryName string"),
        product=spark.createDataFrame(
            [(p, p, p, c, Decimal("2"), s, a) for p, (c, s, a) in products.items()],
            "ProductID string, ProductName string, ProductSKU string, CategoryID int,"
            " Price decimal(12,4), StockQuantity int, IsActive boolean"),
        sales_order=order_rows(spark, orders_),
        order_detail=spark.createDataFrame(
            lines, "OrderDetailID string, OrderID string, ProductID string, Quantity int,"
                   " UnitPrice decimal(12,4), LineTotal decimal(18,4)"))
    made = recommend.product_recommendations(
        store, as_of=AS_OF, max_recommendations=4, hot_rows=hot_rows)
    got: dict[str, list] = {}
    for r in made.orderBy("CustomerID", "RecommendationRank").collect():
        got.setdefault(r.CustomerID, []).append((r.ProductID, r.RecommendationRank))
    assert got == brute_force(purchases, products, sold, 4)


def test_range_folders_are_pruned(spark, tmp_path):
    rows = order_rows(spark, [(f"O{i}", "C", datetime(2020 + i % 5, 1, 1), "Shipped", "1")
                              for i in range(50)])
    bounds = [datetime(2021, 1, 1), datetime(2023, 1, 1)]
    read = prep.partitioned_orders(rows, bounds, str(tmp_path / "o"))
    assert {r.OrderRange: r["count"] for r in read.groupBy("OrderRange").count().collect()} == {
        1: 10, 2: 20, 3: 20}
    plan = read.where("OrderRange = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(OrderRange" in plan


def test_split_columns():
    assert split_columns("a, f(b, c) AS d,\n e") == ["a", "f(b, c) AS d", "e"]


def test_publish_switches_all_frames_at_once(spark, tmp_path):
    from tillwise.sources.publish import publish, published

    target = str(tmp_path / "out")
    publish({"a": spark.range(3), "b": spark.range(5)}, target)
    first = published(spark, target, "a")
    broken = spark.range(1).selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception, match="no"):
        publish({"a": spark.range(7), "b": broken}, target)
    assert published(spark, target, "a").count() == 3 and published(spark, target, "b").count() == 5
    publish({"a": spark.range(7), "b": spark.range(8)}, target)
    assert published(spark, target, "a").count() == 7 and published(spark, target, "b").count() == 8
    assert first.count() == 3


def test_constraints_read_a_table_once_and_count_keys_not_hashes(empty, spark, monkeypatch):
    rows = [(1, "a", None), (2, "a", None), (2, "b", 1), (None, "c", 9), (None, "c", 9), (3, None, 3)]
    table = spark.createDataFrame([
        (i, name, None, parent, 0, True, AS_OF, AS_OF) for i, name, parent in rows], model.schema("category"))
    read = []

    def build(_wanted):
        read.append(1)
        return table

    store = empty.replacing(category=build)

    def counted():
        read.clear()
        made = quality.constraint_violations(store, ["category"])
        return {r.ConstraintName: r.ViolatingRows for r in made.collect() if r.ViolatingRows}, len(read)

    want = {"CategoryID_required": 2, "CategoryName_required": 1, "not_own_parent": 1, "primary_key": 4,
            "category_name": 4, "parent_category": 2}
    # Once for all rules, once more for each of the two whose keys came twice.
    assert counted() == (want, 3)
    monkeypatch.setattr(quality, "_hash", lambda columns: F.lit(7).cast("long"))
    assert counted() == (want, 3)
    table = table.where("CategoryID = 1")
    monkeypatch.undo()
    assert counted() == ({}, 1)

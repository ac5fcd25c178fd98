"""The worked-out results of the small shop."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tests.seed import AS_OF, run_shop
from tillwise.functions.pricing import customer_tiers
from tillwise.operators import quality, reports, summaries, views
from tillwise.session import shared_dir


@pytest.fixture(scope="module")
def shop(spark):
    shared_dir(spark)
    return run_shop(spark)


def test_orders(shop):
    store, _ = shop
    got = {r.OrderID: (r.SubTotal, r.TaxAmount, r.TotalAmount, r.OrderStatus)
           for r in store.scan("sales_order").collect()}
    want = {
        "O1": ("1249.98", "109.3733", "1369.3433", "Processing"),
        "O2": ("139.96", "12.2465", "158.1965", "Shipped"),
        "O3": ("479.98", "41.9983", "534.9683", "Delivered"),
        "O4": ("61.96", "5.4215", "68.3715", "Processing"),
        "O5": ("234.96", "20.5590", "249.5090", "Shipped"),
        "H1": ("1299.98", "113.7483", "1376.7183", "Delivered"),
    }
    assert got == {o: (Decimal(a), Decimal(b), Decimal(c), d)
                   for o, (a, b, c, d) in want.items()}


def test_stock_and_ledger(shop):
    store, _ = shop
    stock = {r.ProductSKU.rsplit("-", 1)[0]: r.StockQuantity
             for r in store.scan("product").collect()}
    touched = {"IPH15PRO": 74, "SGS24": 44, "MBP14": 3, "DXPS13": 0, "SXMN5": 8, "APPRO": 99,
               "MCT": 192, "MJ": 149, "WB": 119, "KASM": 40, "IPD": 84, "TGG": 148, "SAP": 99,
               "AH": 179, "YM": 118, "DS": 59}
    assert {k: stock[k] for k in touched} == touched
    moves = store.scan("inventory_transaction").collect()
    kinds = [r.TransactionType for r in moves]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "Sale": 14, "Return": 1, "Restock": 1, "Damage": 1}
    assert all(r.PreviousStock + r.Quantity == r.NewStock for r in moves)


def test_audit_count(shop):
    store, _ = shop
    rows = [(r.TableName, r.Operation) for r in store.scan("audit_log").collect()]
    assert len(rows) == 35
    assert rows.count(("Order", "INSERT")) == 6
    assert rows.count(("Order", "UPDATE")) == 6
    assert rows.count(("Product", "UPDATE")) == 20
    assert rows.count(("Product", "STOCK_ALERT")) == 3


def test_summary(shop):
    store, _ = shop
    row = reports.sales_report_summary(store, as_of=AS_OF).first()
    assert (row.TotalOrders, row.UniqueCustomers, row.TotalItemsSold) == (5, 5, 16)
    assert row.TotalRevenue == Decimal("5078.6577")
    assert row.TotalSubTotal == Decimal("4630.60")
    assert row.TotalTax == Decimal("405.1777")
    assert row.TotalShipping == Decimal("122.88")
    assert row.TotalDiscounts == Decimal("80")
    assert round(row.AverageOrderValue, 4) == 423.2215
    row = reports.sales_report_summary(store, as_of=AS_OF, corrected=True).first()
    assert row.TotalRevenue == Decimal("2380.3886")
    assert round(row.AverageOrderValue, 4) == 476.0777


def test_category_report(shop):
    store, _ = shop
    rows = reports.sales_report_category(store, as_of=AS_OF).collect()
    assert [(r.CategoryName, r.TotalRevenue) for r in rows] == [
        (n, Decimal(v)) for n, v in [
            ("Smartphones", "999.99"), ("Kitchen", "479.98"), ("Audio", "249.99"),
            ("Fitness", "209.97"), ("Men's Clothing", "139.96"), ("Non-Fiction", "35.98"),
            ("Fiction", "25.98"), ("Women's Clothing", "24.99")]]


def test_status_counts(shop):
    store, _ = shop
    rows = {r.OrderStatus: (r.OrderCount, r.TotalValue)
            for r in summaries.orders_by_status(store).collect()}
    assert rows == {"Processing": (2, Decimal("1437.7148")), "Shipped": (2, Decimal("407.7055")),
                    "Delivered": (2, Decimal("1911.6866"))}


def test_tiers(shop):
    store, _ = shop
    tiers = {r.CustomerID: (r.CustomerTier, r.TotalSpent) for r in customer_tiers(store).collect()}
    assert tiers["C01"] == ("Gold", Decimal("2746.0616"))
    assert tiers["C03"][0] == "Silver"
    assert {tiers[f"C{i:02}"][0] for i in (2, 4, 5, 6, 7, 8, 9, 10)} == {"Bronze"}


def test_low_stock(shop):
    store, _ = shop
    rows = summaries.low_stock_list(store).collect()
    assert [(r.ProductSKU, r.StockQuantity, r.ReorderLevel, r.Status) for r in rows] == [
        ("DXPS13-001", 0, 8, "OUT OF STOCK"), ("MBP14-001", 3, 5, "LOW STOCK"),
        ("SXMN5-001", 8, 15, "LOW STOCK")]
    rows = reports.low_stock_products(store, as_of=AS_OF).collect()
    assert [r.ProductSKU for r in rows] == ["DXPS13-001", "MBP14-001", "SXMN5-001"]
    assert {r.DaysOfInventoryRemaining for r in rows} == {999.0}
    rows = reports.low_stock_products(store, as_of=AS_OF, include_out_of_stock=False).collect()
    assert [r.ProductSKU for r in rows] == ["MBP14-001", "SXMN5-001"]


def test_integrity(shop):
    store, _ = shop
    rows = quality.check_data_integrity(store).collect()
    assert [tuple(r) for r in rows] == [
        ("Info", "Customer", "Active customers without shipping addresses", 5, "No")]
    broken = quality.constraint_violations(store).where("ViolatingRows > 0").collect()
    assert broken == []


def test_history(shop):
    store, _ = shop
    rows = views.customer_order_history(store).collect()
    assert len(rows) == 14
    first = [r for r in rows if r.CustomerID == "C01"]
    assert len(first) == 4
    assert {r.CustomerTotalOrders for r in first} == {4}
    assert {r.CustomerTotalSpent for r in first} == {Decimal("5492.1232")}
    assert sorted(r.OrderRank for r in first) == [1, 2, 3, 4]


def test_products_by_category(shop):
    store, _ = shop
    rows = {r.CategoryName: (r.ProductCount, round(r.AvgPrice, 4), r.TotalStock)
            for r in summaries.products_by_category(store).collect()}
    assert rows == {
        "Smartphones": (2, 949.99, 118), "Laptops": (2, 1649.99, 3), "Audio": (3, 326.6567, 167),
        "Men's Clothing": (3, 49.99, 441), "Women's Clothing": (3, 53.3233, 379),
        "Kitchen": (3, 209.99, 189), "Furniture": (3, 219.99, 135), "Fiction": (3, 13.99, 468),
        "Non-Fiction": (3, 17.3233, 368), "Fitness": (5, 70.99, 777)}


def test_counts(shop):
    store, _ = shop
    rows = {r.DataType: r.RecordCount for r in summaries.table_counts(store).collect()}
    assert rows == {"Categories": 15, "Products": 30, "Customers": 10, "Orders": 6,
                    "Order Details": 14, "Inventory Transactions": 17, "Product Returns": 1,
                    "Shipping Addresses": 6, "Billing Addresses": 5, "Audit Log Entries": 35}


def test_save_and_open(shop, spark, tmp_path):
    store, _ = shop
    store.save(str(tmp_path / "shop"))
    again = type(store).open(spark, str(tmp_path / "shop"))
    assert again.scan("sales_order").count() == 6
    assert summaries.orders_by_status(again).count() == 3

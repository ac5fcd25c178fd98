"""The registered queries: every operator over the driver's tables."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillwise import sql
from tillwise.functions.delivery import with_delivery_estimate
from tillwise.functions.pricing import customer_tiers, with_product_discount, with_shipping_cost
from tillwise.operators import (
    audit,
    categories,
    inventory,
    orders,
    prep,
    privacy,
    quality,
    recommend,
    reports,
    returns,
    summaries,
    views,
)
from tillwise.session import scratch_path, tune
from tillwise.sources import feeds
from tillwise.sources.merge import save_partitioned
from tillwise.sources.star import (
    AS_OF,
    HISTORY_START,
    line_columns,
    order_columns,
    star_store,
)
from tillwise.store import Store
from tillwise.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
ALL = {"as_of": AS_OF, "start": HISTORY_START, "end": AS_OF}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so engines with other decimal widths compare equal."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def zone_of(order_id: Column) -> Column:
    names = ["LOCAL", "REGIONAL", "NATIONAL", "INTERNATIONAL", "MOON"]
    made = None
    for at, name in enumerate(names):
        hit = order_id % 6 == at
        made = F.when(hit, name) if made is None else made.when(hit, name)
    return made


def method_of(order_id: Column) -> Column:
    names = ["Standard", "Express", "Overnight", "Economy"]
    made = None
    for at, name in enumerate(names):
        hit = order_id % 5 == at
        made = F.when(hit, name) if made is None else made.when(hit, name)
    return made


def _parcels(store: Store) -> DataFrame:
    return store.scan("order_detail", "OrderDetailID", "OrderID", "Quantity").select(
        "OrderDetailID",
        F.expr("CAST(Quantity * CAST(0.35 AS DECIMAL(3,2)) AS DECIMAL(8,2))").alias("Weight"),
        zone_of(F.col("OrderID")).alias("Zone"),
        method_of(F.col("OrderID")).alias("ShippingMethod"),
    )


def _shipping_cost(store: Store) -> DataFrame:
    return with_shipping_cost(_parcels(store))


def _product_discount(store: Store) -> DataFrame:
    lines = store.scan("order_detail", "OrderDetailID", "OrderID", "ProductID", "Quantity",
                       "UnitPrice")
    bought = lines.join(store.scan("sales_order", "OrderID", "CustomerID"), "OrderID").select(
        "OrderDetailID", "CustomerID", "ProductID", "Quantity", "UnitPrice")
    return with_product_discount(store, bought, promo_categories=(6, 7, 8))


def _placed(store: Store) -> DataFrame:
    return store.scan("sales_order", "OrderID", "OrderDate", "ShippingMethod").select(
        "OrderID",
        (F.col("OrderDate") + F.make_dt_interval(F.lit(0), (F.col("OrderID") % 24).cast("int")))
        .alias("OrderDate"),
        "ShippingMethod",
        zone_of(F.col("OrderID")).alias("Zone"),
    )


def _delivery_estimate(store: Store) -> DataFrame:
    return with_delivery_estimate(_placed(store))


def _by_sql(statement: str) -> Callable[[Store], DataFrame]:
    """A statement with the SQL functions, over the store's tables and what the functions are tested on."""
    def run(store: Store) -> DataFrame:
        sql.register_functions(store)
        _parcels(store).createOrReplaceTempView("parcels")
        _placed(store).createOrReplaceTempView("placed_orders")
        return store.spark.sql(statement)

    return run


BOUNDARIES = [datetime(1996, 1, 1), datetime(1997, 1, 1), datetime(1998, 7, 1),
              datetime(2000, 1, 1), datetime(2001, 1, 1)]
NAME = "Customer#000000007"


def _table_counts(store: Store) -> DataFrame:
    log = audit.order_audit_trail(
        store.scan("sales_order"), feeds.orders_after(store), as_of=AS_OF)
    return summaries.table_counts(store.replacing(audit_log=log))


def _order_ranges(store: Store) -> DataFrame:
    """Orders per date range, counted on the written table."""
    orders = store.scan("sales_order", "OrderID", "OrderDate", "TotalAmount")
    written = prep.partitioned_orders(
        orders, BOUNDARIES, scratch_path(store.spark, "orders"))
    return written.groupBy("OrderRange").agg(
        F.count("*").alias("Orders"), F.sum("TotalAmount").alias("Total"),
        F.min("OrderDate").alias("FirstDate"), F.max("OrderDate").alias("LastDate"),
    )


def _order_range_pruned(store: Store) -> DataFrame:
    """Orders of one range, read from its folder only."""
    orders = store.scan("sales_order", "OrderID", "OrderDate", "TotalAmount")
    written = prep.partitioned_orders(
        orders, BOUNDARIES, scratch_path(store.spark, "orders"))
    return written.where(F.col("OrderRange") == 3).select("OrderID", "OrderDate", "TotalAmount")


def _month() -> Column:
    return F.date_format("OrderDate", "yyyy-MM")


def _monthly_orders(store: Store) -> str:
    """The orders as a table by month."""
    path = scratch_path(store.spark, "orders")
    save_partitioned(store.scan("sales_order"), path, "OrderMonth", _month())
    return path


def _returns_merged(store: Store) -> DataFrame:
    """Returns close orders in the stored table."""
    path = _monthly_orders(store)
    checked = returns.validate_returns(store, feeds.return_requests(store))
    returns.merge_closed_orders(store.spark, path, checked, as_of=AS_OF, partition="OrderMonth", place=_month())
    return store.spark.read.parquet(path).select("OrderID", "OrderStatus", "ModifiedDate")


def _updates_merged(store: Store) -> DataFrame:
    path = _monthly_orders(store)
    prep.merge_order_updates(
        store.spark, path, feeds.order_updates(store), partition="OrderMonth", place=_month())
    return store.spark.read.parquet(path).select(
        "OrderID", "OrderStatus", "PaymentStatus", "TrackingNumber", "ActualDeliveryDate")


def _defaults(store: Store, fill_unknown: bool = False) -> DataFrame:
    bare = store.scan("sales_order", "OrderID", "CustomerID", "PaymentStatus").withColumn(
        "PaymentStatus",
        F.when(F.col("PaymentStatus") != "Failed", F.col("PaymentStatus")))
    filled = prep.apply_defaults(bare, "sales_order", as_of=AS_OF, fill_unknown=fill_unknown)
    return prep.with_hash_key(filled, "RowKey", "OrderID", "CustomerID")


def _sequence(store: Store) -> DataFrame:
    orders = store.scan("sales_order", "OrderID", "OrderDate")
    return prep.with_sequence_key(
        orders, "SequenceID", [F.col("OrderDate"), F.col("OrderID")], after=1000)


def _recomputed(store: Store) -> DataFrame:
    after = feeds.details_after(store)
    changed = store.replacing(order_detail=after, sales_order=feeds.untaxed_orders(store))
    keys = store.scan("order_detail", "OrderID")
    return quality.recompute_order_totals(changed, after, keys, as_of=AS_OF).select(
        "OrderID", "SubTotal", "TaxAmount", "ShippingAmount", "DiscountAmount", "TotalAmount",
        "ModifiedDate")


def _ledger_check(store: Store) -> DataFrame:
    """The faulty ledger against products holding their latest stock."""
    moves = feeds.with_faults(store).scan("inventory_transaction")
    closing = moves.groupBy("ProductID").agg(
        F.max_by("NewStock", F.struct("TransactionDate", "TransactionID")).alias("StockQuantity"))
    return audit.validate_inventory_ledger(moves, closing)


def _defaults_kept(table: str, key: str, corrected: bool) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        everyone, new = feeds.addresses_after(store, table, key)
        return quality.enforce_default_address(everyone, new, key, corrected=corrected).select(
            key, "CustomerID", "IsDefault")

    return run


def _protected(store: Store) -> DataFrame:
    """Customers encrypted and read back; the key lives for one run."""
    key = secrets.token_hex(16)
    stored = privacy.protect_customer_pii(store.scan("customer"), key)
    return privacy.reveal_customer_pii(stored, key).select(
        "CustomerID", "Email", "PhoneNumber", "EmailHash")


def _upserted(store: Store) -> DataFrame:
    key = secrets.token_hex(16)
    stored = privacy.protect_customer_pii(store.scan("customer"), key)
    after = privacy.upsert_customers(stored, feeds.customer_changes(store), key, as_of=AS_OF)
    return privacy.reveal_customer_pii(after, key).select(
        "CustomerID", "CustomerName", "Email", "PhoneNumber", "EmailHash", "IsActive",
        "ModifiedDate")


def _alerts(part: str) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        made = audit.stock_alerts(
            store.scan("product"), feeds.products_after(store), as_of=AS_OF)[part]
        return made.select("ProductID", "StockQuantity", "Price", "ModifiedDate") if (
            part == "products") else made

    return run


def _repaired(part: str, *columns: str) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        made = quality.fix_data_integrity(feeds.with_faults(store), as_of=AS_OF)[part]
        return made.select(*columns) if columns else made

    return run


def _validated_orders(store: Store) -> DataFrame:
    return orders.validate_orders(feeds.roomy(store), feeds.order_requests(store))


def _priced(store: Store) -> DataFrame:
    requests = feeds.order_requests(store)
    items = orders.parse_order_items(requests, product_type="bigint")
    return orders.price_orders(requests, items)


def _allocated(part: str) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        lines = store.scan("order_detail", "OrderID", "ProductID", "Quantity").join(
            store.scan("sales_order", "OrderID", "OrderDate"), "OrderID")
        return orders.allocate_orders(feeds.roomy(store), lines)[part]

    return run


def _process(store: Store) -> dict[str, DataFrame]:
    return orders.process_orders(feeds.roomy(store, 30), feeds.order_requests(store), as_of=AS_OF)


def _processed(store: Store) -> DataFrame:
    """Every request with its total or what was wrong with it."""
    made = _process(store)
    taken = made["orders"].select(
        "OrderID", "OrderStatus", "TotalAmount", F.lit(None).cast("string").alias("ErrorMessage"))
    return taken.unionByName(made["rejects"].select(
        "OrderID", F.lit("Rejected").alias("OrderStatus"),
        F.lit(None).cast("decimal(12,4)").alias("TotalAmount"), "ErrorMessage"))


def _trail(made: dict[str, DataFrame]) -> DataFrame:
    """Audit rows and alerts of a job."""
    return made["audit"].unionByName(made["alerts"])


def _adjusted(part: str, *columns: str) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        made = inventory.apply_inventory_adjustments(
            feeds.roomy(store), feeds.stock_adjustments(store), as_of=AS_OF)[part]
        return made.select(*columns) if columns else made

    return run


def _adjusted_amply(store: Store) -> DataFrame:
    """With stock for everything, so that no adjustment is refused."""
    return inventory.apply_inventory_adjustments(
        feeds.roomy(store, 1, 10_000_000), feeds.stock_adjustments(store), as_of=AS_OF)["ledger"]


def _returned(part: str, *columns: str, corrected: bool = False) -> Callable[[Store], DataFrame]:
    def run(store: Store) -> DataFrame:
        made = returns.process_returns(
            store, feeds.return_requests(store), as_of=AS_OF, corrected=corrected)[part]
        return made.select(*columns) if columns else made

    return run


def _detailed_report(store: Store) -> DataFrame:
    """All result sets of the detailed report under one another: what each row is about, and its revenue."""
    label = {"category": "CategoryID", "product": "ProductID", "monthly": "Period"}
    revenue = {"category": "TotalRevenue", "product": "TotalRevenue", "monthly": "MonthlyRevenue"}
    made = reports.sales_report(store, "Detailed", **ALL)
    return reduce(DataFrame.unionByName, [
        frame.select(F.lit(name).alias("ResultSet"), F.col(label[name]).cast("string").alias("Label"),
                     F.col(revenue[name]).cast("double").alias("Revenue"))
        for name, frame in made.items()])


OPERATORS: dict[str, Callable[[Store], DataFrame]] = {
    "sales_report_detailed": _detailed_report,
    "sql_shipping_cost": _by_sql(
        "SELECT OrderDetailID, shipping_cost(Weight, Zone, ShippingMethod) AS ShippingCost FROM parcels"),
    "sql_delivery_estimate": _by_sql(
        "SELECT OrderID, delivery_estimate(OrderDate, ShippingMethod, Zone) AS EstimatedDelivery"
        " FROM placed_orders"),
    "sql_customer_tier": _by_sql(
        "SELECT CustomerID, customer_tier(CustomerID) AS CustomerTier FROM customer"),
    "sales_report_product_filtered":
        lambda s: reports.sales_report_product(s, category_id=7, **ALL),
    "sales_report_category_filtered":
        lambda s: reports.sales_report_category(s, category_id=7, **ALL),
    "low_stock_products_available":
        lambda s: reports.low_stock_products(s, as_of=AS_OF, include_out_of_stock=False),
    "customer_order_history_split": lambda s: views.customer_order_history(s, hot_rows=120),
    "sales_report_summary": lambda s: reports.sales_report_summary(s, **ALL),
    "sales_report_summary_last_30_days": lambda s: reports.sales_report_summary(s, as_of=AS_OF),
    "sales_report_summary_corrected":
        lambda s: reports.sales_report_summary(s, corrected=True, **ALL),
    "sales_report_category": lambda s: reports.sales_report_category(s, **ALL),
    "category_tree": lambda s: categories.category_tree(
        feeds.nested_categories(s).scan("category", "CategoryID", "ParentCategoryID")),
    "sales_report_subtree":
        lambda s: categories.sales_report_subtree(feeds.nested_categories(s), **ALL),
    "sales_report_product": lambda s: reports.sales_report_product(s, **ALL),
    "sales_report_monthly": lambda s: reports.sales_report_monthly(s, **ALL),
    "low_stock_products": lambda s: reports.low_stock_products(s, as_of=AS_OF),
    "customer_order_history": lambda s: views.customer_order_history(s),
    "product_performance": lambda s: views.product_performance(s, as_of=AS_OF),
    "product_performance_corrected":
        lambda s: views.product_performance(s, as_of=AS_OF, corrected=True),
    "inventory_dashboard": lambda s: views.inventory_dashboard(s, as_of=AS_OF),
    "inventory_dashboard_corrected":
        lambda s: views.inventory_dashboard(s, as_of=AS_OF, corrected=True),
    "customer_analytics": lambda s: views.customer_analytics(s, as_of=AS_OF),
    "sales_performance_dashboard": lambda s: views.sales_performance_dashboard(s, as_of=AS_OF),
    "shipping_cost": _shipping_cost,
    "customer_tier": customer_tiers,
    "product_discount": _product_discount,
    "delivery_estimate": _delivery_estimate,
    "product_recommendations": lambda s: recommend.product_recommendations(s, as_of=AS_OF),
    "table_counts": _table_counts,
    "orders_by_status": summaries.orders_by_status,
    "products_by_category": summaries.products_by_category,
    "low_stock_list": summaries.low_stock_list,
    "update_last_login": lambda s: summaries.update_last_login(s, as_of=AS_OF).select(
        "CustomerID", "CustomerName", "LastLoginDate"),
    "apply_order_updates": lambda s: prep.apply_order_updates(
        s.scan("sales_order"), feeds.order_updates(s)).select(
        "OrderID", "OrderStatus", "PaymentStatus", "TrackingNumber", "ActualDeliveryDate"),
    "history_by_customer_name": lambda s: summaries.history_by_customer_name(s, NAME),
    "products_with_status":
        lambda s: summaries.products_with_status(s, "Low Stock", as_of=AS_OF),
    "recommendations_by_customer_name":
        lambda s: summaries.recommendations_by_customer_name(s, NAME, as_of=AS_OF),
    "computed_columns_category": lambda s: prep.with_category_level(
        s.scan("category", "CategoryID", "ParentCategoryID")),
    "computed_columns_product": lambda s: prep.with_low_stock_flag(
        s.scan("product", "ProductID", "StockQuantity", "ReorderLevel")),
    "computed_columns_order_detail": lambda s: prep.with_line_total(
        s.scan("order_detail", "OrderDetailID", "Quantity", "UnitPrice", "DiscountAmount")),
    "computed_columns_customer": lambda s: prep.with_email_hash(
        s.scan("customer", "CustomerID", "Email")),
    "partitioned_orders": _order_ranges,
    "partitioned_orders_pruned": _order_range_pruned,
    "apply_defaults": _defaults,
    "apply_defaults_filled": lambda s: _defaults(s, fill_unknown=True),
    "sequence_keys": _sequence,
    "order_audit_trail": lambda s: audit.order_audit_trail(
        s.scan("sales_order"), feeds.orders_after(s), as_of=AS_OF),
    "product_audit_trail": lambda s: audit.product_audit_trail(
        s.scan("product"), feeds.products_after(s), as_of=AS_OF),
    "stock_alerts": _alerts("alerts"),
    "stock_alerts_products": _alerts("products"),
    "stock_alerts_rejects": _alerts("rejects"),
    "validate_inventory_ledger": _ledger_check,
    "recompute_order_totals": _recomputed,
    "enforce_default_address_shipping":
        _defaults_kept("shipping_address", "ShippingAddressID", False),
    "enforce_default_address_billing":
        _defaults_kept("billing_address", "BillingAddressID", False),
    "enforce_default_address_corrected":
        _defaults_kept("shipping_address", "ShippingAddressID", True),
    "protect_customer_pii": _protected,
    "upsert_customers": _upserted,
    "check_data_integrity": lambda s: quality.check_data_integrity(feeds.with_faults(s)),
    "fix_data_integrity_orders": _repaired(
        "orders", "OrderID", "SubTotal", "TotalAmount", "ModifiedDate"),
    "fix_data_integrity_products": _repaired(
        "products", "ProductID", "StockQuantity", "ModifiedDate"),
    "fix_data_integrity_audit": _repaired("audit"),
    "constraint_violations": lambda s: quality.constraint_violations(feeds.with_faults(s)),
    "parse_order_items": lambda s: orders.parse_order_items(
        feeds.order_requests(s), product_type="bigint"),
    "validate_orders": _validated_orders,
    "price_orders": _priced,
    "allocate_orders": _allocated("outcomes"),
    "allocate_orders_products": _allocated("products"),
    "process_orders": _processed,
    "process_orders_ledger": lambda s: _process(s)["ledger"].drop("TransactionID"),
    "process_orders_details": lambda s: _process(s)["details"],
    "process_orders_products":
        lambda s: _process(s)["products"].select("ProductID", "StockQuantity", "ModifiedDate"),
    "process_orders_audit": lambda s: _trail(_process(s)),
    "apply_inventory_adjustments_audit": lambda s: _trail(inventory.apply_inventory_adjustments(
        feeds.roomy(s), feeds.stock_adjustments(s), as_of=AS_OF)),
    "process_returns_audit": lambda s: _trail(returns.process_returns(
        s, feeds.return_requests(s), as_of=AS_OF)),
    "apply_inventory_adjustments": _adjusted("ledger"),
    "apply_inventory_adjustments_products":
        _adjusted("products", "ProductID", "StockQuantity", "ModifiedDate"),
    "apply_inventory_adjustments_rejects": _adjusted("rejects"),
    "apply_inventory_adjustments_ample": _adjusted_amply,
    "validate_returns": lambda s: returns.validate_returns(s, feeds.return_requests(s)).select(
        "ReturnID", "CustomerID", "RefundAmount", "ErrorMessage", "ClosesOrder"),
    "process_returns": _returned("returns"),
    "process_returns_ledger": _returned(
        "ledger", "ProductID", "TransactionType", "Quantity", "PreviousStock", "NewStock",
        "ReferenceID", "Notes"),
    "process_returns_products":
        _returned("products", "ProductID", "StockQuantity", "ModifiedDate"),
    "process_returns_orders": _returned("orders", "OrderID", "OrderStatus", "ModifiedDate"),
    "process_returns_merged": _returns_merged,
    "apply_order_updates_merged": _updates_merged,
    "process_returns_corrected":
        _returned("returns", "ReturnID", "ReturnQuantity", "RefundAmount", corrected=True),
    "process_returns_corrected_orders":
        _returned("orders", "OrderID", "OrderStatus", "ModifiedDate", corrected=True),
}


def _raw_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files. As a glob the path may be one file, too."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return jobs.file_stream(spark, f"{sf_dir}/{table}.parque[t]", schema)


def _streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order table as a stream; files come in no order of dates, so the
    lateness spans all of them."""
    target = scratch_path(spark, "metrics")
    orders = order_columns(_raw_stream(spark, sf_dir, "orders"))
    jobs.stream_sales_metrics(orders, target, lateness="3650 days").awaitTermination()
    return jobs.sales_metrics(spark, target)


def _sales_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_columns(_raw_stream(spark, sf_dir, "lineitem")).select(
        "ProductID", (-F.col("Quantity")).alias("Quantity"))


def _streamed_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, target = star_store(spark, sf_dir), scratch_path(spark, "stock")
    goods = feeds.roomy(store).scan("product")
    jobs.stream_stock_ledger(
        _sales_stream(spark, sf_dir), goods, target, as_of=AS_OF).awaitTermination()
    return jobs.stock_levels(spark, goods, target)


def _streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product, as the batches of the stream may be cut in any way."""
    store, target = star_store(spark, sf_dir), scratch_path(spark, "stock")
    goods = feeds.roomy(store).scan("product")
    jobs.stream_stock_ledger(
        _sales_stream(spark, sf_dir), goods, target, as_of=AS_OF).awaitTermination()
    return jobs.stock_ledger(spark, target).groupBy("ProductID").agg(
        F.max("PreviousStock").alias("FirstStock"), F.sum("Quantity").alias("Quantity"),
        F.min("NewStock").alias("LastStock"))


def _streamed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of products that the table lacks: every twentieth is left out of it."""
    store, target = star_store(spark, sf_dir), scratch_path(spark, "stock")
    goods = store.scan("product").where("ProductID % 20 != 0")
    jobs.stream_stock_ledger(
        _sales_stream(spark, sf_dir), goods, target, as_of=AS_OF).awaitTermination()
    return jobs.stock_rejects(spark, target).groupBy("ProductID", "ErrorMessage").agg(
        F.sum("Quantity").alias("Quantity"), F.max("RejectedBefore").alias("FirstBefore"))


def _streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, target = star_store(spark, sf_dir), scratch_path(spark, "stock")
    goods = feeds.roomy(store).scan("product")
    jobs.stream_stock_ledger(
        _sales_stream(spark, sf_dir), goods, target, as_of=AS_OF).awaitTermination()
    return jobs.stock_alert_log(spark, target)


def _streamed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed orders against the order table: re-priced, moved on, deleted, new, or changed twice."""
    store, target = star_store(spark, sf_dir), scratch_path(spark, "audit")
    changes = feeds.order_steps(order_columns(_raw_stream(spark, sf_dir, "orders")))
    jobs.stream_order_audit(
        changes, store.scan("sales_order"), target, as_of=AS_OF, sequence="Step").awaitTermination()
    return jobs.order_audit_log(spark, target)


STREAMS: dict[str, Query] = {
    "stream_sales_metrics": _streamed_metrics,
    "stream_stock_ledger": _streamed_stock,
    "stream_stock_movements": _streamed_ledger,
    "stream_stock_alerts": _streamed_alerts,
    "stream_stock_rejects": _streamed_rejects,
    "stream_order_audit": _streamed_audit,
}


def _stream_query(run: Query) -> Query:
    return lambda spark, sf_dir: plain(run(tune(spark), sf_dir))


def _query(operator: Callable[[Store], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(operator(star_store(tune(spark), sf_dir)))

    return run


def queries() -> dict[str, Query]:
    made = {name: _query(operator) for name, operator in OPERATORS.items()}
    made.update({name: _stream_query(run) for name, run in STREAMS.items()})
    return made

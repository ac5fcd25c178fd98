"""Integrity checks, repairs, constraint counts, totals and default addresses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise import model
from tillwise.functions.clock import ts
from tillwise.functions.values import money, not_cancelled, or_zero, text
from tillwise.operators.audit import audit_columns
from tillwise.session import cut_lineage
from tillwise.store import Store

# The checks by name, with severity, table and text.
INTEGRITY_CHECKS = {
    "orphans": ("Critical", "OrderDetail", "Order details without corresponding orders"),
    "empty": ("Warning", "Order", "Orders without order details"),
    "negative": ("Critical", "Product", "Products with negative inventory"),
    "uncategorised": ("Critical", "Product", "Products without valid categories"),
    "totals": ("Warning", "Order", "Orders with incorrect total calculations"),
    "unaddressed": ("Info", "Customer", "Active customers without shipping addresses"),
    "ledger": ("Warning", "InventoryTransaction",
               "Inventory transactions with calculation errors"),
}
FIXED_CHECKS = ("totals", "negative")
SEVERITY_ORDER = {"Critical": 1, "Warning": 2, "Info": 3}


def _line_sums(store: Store) -> DataFrame:
    return store.scan("order_detail", "OrderID", "LineTotal").groupBy("OrderID").agg(
        F.count("*").alias("Lines"), F.sum("LineTotal").alias("LineSum"))


def _off(subtotal: Column, lines: Column) -> Column:
    return F.abs(subtotal - lines) > model.TOTAL_TOLERANCE


def _count(flag: Column, rows: Column | None = None) -> Column:
    """Rows, or units of ``rows``, for which ``flag`` holds; 0 if none."""
    one = F.lit(1).cast("long") if rows is None else rows
    return F.coalesce(F.sum(F.when(flag, one)), F.lit(0)).cast("long")


def check_data_integrity(store: Store, *, fix: bool = False) -> DataFrame:
    """The checks that found something, worst first.

    Orders and lines meet once, on sums per order, for three of the checks.
    """
    orders = store.scan("sales_order", "OrderID", "OrderStatus", "SubTotal")
    both = orders.withColumn("InOrders", F.lit(True)).join(_line_sums(store), "OrderID", "full")
    of_orders = both.agg(
        _count(F.col("InOrders").isNull(), F.col("Lines")).alias("orphans"),
        _count(F.col("Lines").isNull() & not_cancelled(F.col("OrderStatus"))).alias("empty"),
        _count(_off(F.col("SubTotal"), F.col("LineSum"))).alias("totals"),
    )
    known = store.scan("category", "CategoryID").distinct().withColumn("Known", F.lit(True))
    of_products = (
        store.scan("product", "CategoryID", "StockQuantity")
        .groupBy("CategoryID")
        .agg(F.count("*").alias("Rows"), F.count_if(F.col("StockQuantity") < 0).alias("Negative"))
        .join(known, "CategoryID", "left")
        .agg(
            F.coalesce(F.sum("Negative"), F.lit(0)).cast("long").alias("negative"),
            _count(F.col("Known").isNull(), F.col("Rows")).alias("uncategorised"),
        )
    )
    housed = store.scan("shipping_address", "CustomerID", "IsActive").where("IsActive").select(
        "CustomerID").distinct()
    of_customers = (
        store.scan("customer", "CustomerID", "IsActive").where("IsActive")
        .join(housed, "CustomerID", "left_anti")
        .agg(F.count("*").alias("unaddressed"))
    )
    of_moves = store.scan("inventory_transaction", "PreviousStock", "Quantity", "NewStock").agg(
        F.count_if(F.col("PreviousStock") + F.col("Quantity") != F.col("NewStock"))
        .alias("ledger"))

    def listed(counts: DataFrame) -> DataFrame:
        rows = [
            F.struct(
                *[F.lit(v).alias(n) for n, v in zip(
                    ("Severity", "TableName", "IssueDescription"), INTEGRITY_CHECKS[name],
                    strict=True)],
                F.col(name).alias("RecordCount"),
                F.lit("Yes" if fix and name in FIXED_CHECKS else "No").alias("FixApplied"),
            )
            for name in counts.columns
        ]
        return counts.select(F.inline(F.array(*rows)))

    parts = [listed(c) for c in (of_orders, of_products, of_customers, of_moves)]
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY_ORDER.items() for x in pair])
    return (
        reduce(DataFrame.unionByName, parts)
        .where(F.col("RecordCount") > 0)
        .orderBy(rank[F.col("Severity")], "TableName", "IssueDescription")
    )


def fix_data_integrity(
    store: Store, *, as_of: datetime, application: str = "tillwise"
) -> dict[str, DataFrame]:
    """Repaired ``orders`` and ``products``, and the ``audit`` rows of the repairs.

    The audit rows tell the stock found before the repair.
    """
    orders = store.scan("sales_order")
    off = _off(F.col("SubTotal"), F.col("LineSum"))
    owed = F.col("LineSum") + F.col("TaxAmount") + F.col("ShippingAmount") - F.col(
        "DiscountAmount")
    fixed = (
        orders.join(_line_sums(store).drop("Lines"), "OrderID", "left")
        .withColumn("Off", F.coalesce(off, F.lit(False)))
        .withColumns({
            "TotalAmount": F.when(F.col("Off"), money(owed)).otherwise(F.col("TotalAmount")),
            "ModifiedDate": F.when(F.col("Off"), ts(as_of)).otherwise(F.col("ModifiedDate")),
            "SubTotal": F.when(F.col("Off"), money(F.col("LineSum")))
            .otherwise(F.col("SubTotal")),
        })
        .select(*orders.columns)
    )
    products = store.scan("product")
    negative = F.col("StockQuantity") < 0
    repaired = products.withColumns({
        "ModifiedDate": F.when(negative, ts(as_of)).otherwise(F.col("ModifiedDate")),
        "StockQuantity": F.when(negative, 0).otherwise(F.col("StockQuantity")),
    })
    audit = products.where(negative).select(*audit_columns(
        "Product", "FIX", F.col("ProductID"),
        F.concat(F.lit("NegativeStock="), text(F.col("StockQuantity"))),
        F.lit("CorrectedStock=0"),
        as_of=as_of, actor="INTEGRITY_CHECK", application=application,
    ))
    return {"orders": fixed, "products": repaired, "audit": audit}


def _exact(columns: Sequence[str]) -> Column:
    """The values as one text that no other values have."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def _hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def constraint_violations(store: Store, tables: Iterable[str] | None = None) -> DataFrame:
    """Rows breaking each rule of the model: required, check, unique and reference.

    Keys and required columns must be known. One pass per table lists, for each
    of its rows, the numbers of the rules it breaks, and the keys its unique
    rules and references speak of; equal entries are counted before they meet,
    so many equal keys cost one row. A unique key goes as its hash: only where
    a hash came twice are the keys themselves read again, and counted whole.
    References and their targets go as themselves, and meet in one join.
    """
    chosen = [t for t in (model.TABLES if tables is None else tables) if t in store]
    references = {
        t: {n: r for n, r in model.REFERENCES.get(t, {}).items() if r[1] in store} for t in chosen}
    targets = sorted({(r[1], r[2]) for named in references.values() for r in named.values()})
    target_of = {target: -n for n, target in enumerate(targets, 1)}
    rules: list[tuple[str, str]] = []
    unique: dict[int, tuple[str, Sequence[str]]] = {}
    refers: dict[int, int] = {}

    def numbered(table: str, name: str) -> int:
        rules.append((table, name))
        return len(rules) - 1

    parts = []
    for table in sorted({*chosen, *(t for t, _ in targets)}):
        breaks: dict[int, Column] = {}
        entries: list[Column] = []
        hashed: dict[int, Sequence[str]] = {}
        whole: dict[int, Sequence[str]] = {}
        if table in chosen:
            for column in dict.fromkeys((*model.PRIMARY_KEYS[table], *model.REQUIRED[table])):
                breaks[numbered(table, f"{column}_required")] = F.col(column).isNull()
            for name, rule in model.CHECKS.get(table, {}).items():
                breaks[numbered(table, name)] = ~F.coalesce(F.expr(rule), F.lit(True))
            for name, columns in {"primary_key": model.PRIMARY_KEYS[table],
                                  **model.UNIQUE_KEYS.get(table, {})}.items():
                number = numbered(table, name)
                hashed[number], unique[number] = columns, (table, columns)
                entries.append(F.lit(number))
            for name, (own, other, theirs) in references[table].items():
                number = numbered(table, name)
                whole[number], refers[number] = own, target_of[other, theirs]
                known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in own])
                entries.append(F.when(known, number))
        for (other, theirs), number in target_of.items():
            if other == table:
                whole[number] = theirs
                entries.append(F.lit(number))

        def of_rule(made: dict[int, Column], otherwise: Column) -> Column:
            return reduce(lambda rest, n: F.when(F.col("Rule") == n, made[n]).otherwise(rest), made, otherwise)

        told = F.array(*entries)
        if breaks:
            told = F.when(reduce(lambda a, b: a | b, breaks.values()), F.array(
                *[F.when(b, number) for number, b in breaks.items()], *entries)).otherwise(told)
        parts.append(
            store.scan(table).withColumn("Rule", F.explode(told)).where("Rule IS NOT NULL").select(
                "Rule",
                of_rule({n: _hash(c) for n, c in hashed.items()}, F.lit(0).cast("long")).alias("Hash"),
                of_rule({n: _exact(c) for n, c in whole.items()}, F.lit("")).alias("Key")))
    # A hash that came once is of a key that came once: nothing to keep.
    once = F.col("Rule").isin(list(unique)) & (F.col("n") == 1)
    found = cut_lineage(
        reduce(DataFrame.union, parts).groupBy("Rule", "Hash", "Key").agg(F.count("*").alias("n")).where(~once))
    of_target = F.create_map(*[F.lit(x) for pair in refers.items() for x in pair]) if refers else None
    broken = [found.where(~F.col("Rule").isin([*unique, *refers, *target_of.values()])).select("Rule", "n")]
    if refers:
        target = found.where("Rule < 0").select(F.col("Rule").alias("_of"), F.col("Key").alias("_key"))
        used = found.where(F.col("Rule").isin(list(refers))).withColumn("Of", of_target[F.col("Rule")])
        broken.append(used.join(
            target, (F.col("Of") == F.col("_of")) & (F.col("Key") == F.col("_key")), "left_anti").select("Rule", "n"))
    twice = found.where(F.col("Rule").isin(list(unique)))
    for number in sorted(r.Rule for r in twice.select("Rule").distinct().collect()):
        table, columns = unique[number]
        hashes = twice.where(F.col("Rule") == number).select("Hash")
        keys = store.scan(table, *columns).select(_hash(columns).alias("Hash"), _exact(columns).alias("Key"))
        broken.append(
            keys.join(hashes, "Hash", "left_semi").groupBy("Key").agg(F.count("*").alias("n")).where("n > 1")
            .select(F.lit(number).alias("Rule"), "n"))
    sums = reduce(DataFrame.union, broken).groupBy("Rule").agg(F.sum("n").alias("Broken"))
    all_rules = store.spark.createDataFrame(
        [(n, *rule) for n, rule in enumerate(rules)], "Rule int, TableName string, ConstraintName string")
    return all_rules.join(sums, "Rule", "left").select(
        "TableName", "ConstraintName", F.coalesce("Broken", F.lit(0)).cast("long").alias("ViolatingRows"))


def recompute_order_totals(
    store: Store, inserted: DataFrame, deleted: DataFrame, *, as_of: datetime
) -> DataFrame:
    """Orders touched by changed lines, with totals from their present lines.

    An order without tax gets the default rate, even if none was meant.
    """
    touched = inserted.select("OrderID").union(deleted.select("OrderID")).distinct()
    sums = (
        store.scan("order_detail", "OrderID", "LineTotal")
        .join(touched, "OrderID", "left_semi")
        .groupBy("OrderID").agg(F.sum("LineTotal").alias("LineSum"))
    )
    orders = store.scan("sales_order")
    subtotal, tax = F.col("SubTotal"), F.col("TaxAmount")
    rest = F.col("ShippingAmount") - F.col("DiscountAmount")
    untaxed = tax.isNull() | (tax == 0)
    full_tax = subtotal * F.lit(model.DEFAULT_TAX_RATE)
    return (
        orders.join(touched, "OrderID", "left_semi")
        .join(sums, "OrderID", "left")
        .withColumn("SubTotal", money(or_zero(F.col("LineSum"))))
        .withColumns({
            "TotalAmount": money(F.when(untaxed, subtotal + full_tax + rest)
                                 .otherwise(subtotal + tax + rest)),
            "TaxAmount": money(F.when(untaxed, full_tax).otherwise(tax)),
            "ModifiedDate": ts(as_of),
        })
        .select(*orders.columns)
    )


def enforce_default_address(
    addresses: DataFrame, changed: DataFrame, key: str, *, corrected: bool = False
) -> DataFrame:
    """Addresses after a batch of ``changed`` rows that may set new defaults.

    A new default resets the customer's others. Two new defaults in one batch
    reset each other; ``corrected`` lets the highest key stay.
    """
    new = changed.where("IsDefault").groupBy("CustomerID").agg(
        F.min(key).alias("LowNew"), F.max(key).alias("HighNew"))
    own = F.col(key)
    beaten = own != F.col("HighNew")
    if not corrected:
        beaten = beaten | (own != F.col("LowNew"))
    return (
        addresses.join(new, "CustomerID", "left")
        .withColumn("IsDefault", F.col("IsDefault") & ~F.coalesce(beaten, F.lit(False)))
        .select(*addresses.columns)
    )

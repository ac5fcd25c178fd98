"""Tables, defaults, rules and fixed values of the retail data model."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql.types import StructType

MONEY = "decimal(12,4)"

# ---------------------------------------------------------------- fixed values
# Texts and numbers below are part of the results, so they are kept as given.
ORDER_STATUSES = ("Pending", "Processing", "Shipped", "Delivered", "Cancelled", "Returned")
PAYMENT_STATUSES = ("Pending", "Authorized", "Captured", "Failed", "Refunded")
TRANSACTION_TYPES = ("Sale", "Return", "Adjustment", "Restock", "Damage", "Transfer")
AUDIT_OPERATIONS = ("INSERT", "UPDATE", "DELETE", "FIX", "MAINTENANCE", "STOCK_ALERT")
RETURN_STATUSES = ("Pending", "Approved", "Rejected", "Processed")
ADDRESS_TYPES = ("Shipping", "Billing", "Both")

DEFAULT_TAX_RATE = Decimal("0.0875")
TOTAL_TOLERANCE = Decimal("0.01")

BASE_RATES = {"Economy": "3.99", "Standard": "5.99", "Express": "12.99", "Overnight": "24.99"}
OTHER_BASE_RATE = "5.99"
POUND_RATES = {"Economy": "0.89", "Standard": "1.25", "Express": "2.50", "Overnight": "4.99"}
OTHER_POUND_RATE = "1.25"
ZONE_FACTORS = {"LOCAL": "0.8", "REGIONAL": "1.0", "NATIONAL": "1.3", "INTERNATIONAL": "2.5"}
OTHER_ZONE_FACTOR = "1.0"
UNCAPPED_ZONE = "INTERNATIONAL"
SHIPPING_FLOOR = "1.99"
SHIPPING_CAP = "99.99"

METHOD_DAYS = {"Overnight": 1, "Express": 2, "Standard": 5, "Economy": 7}
OTHER_METHOD_DAYS = 5
ZONE_DAYS = {"LOCAL": 0, "REGIONAL": 1, "NATIONAL": 2, "INTERNATIONAL": 5}
OTHER_ZONE_DAYS = 1

# tier: (spent alone, or spent with at least so many orders)
TIER_RULES = {
    "Platinum": ("10000", "5000", 50),
    "Gold": ("2500", "1000", 20),
    "Silver": ("500", "250", 5),
}
LOWEST_TIER = "Bronze"
TIER_DISCOUNTS = {"Platinum": "0.15", "Gold": "0.10", "Silver": "0.05"}
QUANTITY_DISCOUNTS = ((10, "0.05"), (5, "0.02"))
PROMO_CATEGORIES = (1, 2, 3)
PROMO_DISCOUNT = "0.03"
DISCOUNT_CAP = "0.25"

ORDER_REJECTS = {
    "customer": "Customer not found or inactive.",
    "product": "One or more products are invalid or inactive.",
    "stock": "Insufficient inventory for one or more products.",
    "shipping": "Invalid shipping address.",
    "billing": "Invalid billing address.",
}
RETURN_REJECTS = {
    "line": "Order or product not found.",
    "status": "Returns are only allowed for delivered or shipped orders.",
    "quantity": "Invalid return quantity.",
}
ADJUSTMENT_REJECTS = {
    "product": "Product not found or inactive.",
    "stock": "Insufficient inventory. Current stock: ",
}
# Rejects of our own, for input the source system would have failed on.
MALFORMED_ITEMS = "Malformed order items."
NO_ITEMS = "Order has no items."
# ------------------------------------------------------------ end fixed values

# Keys are strings or whole numbers, whichever the source holds.
TABLES = {
    "category": """CategoryID INT, CategoryName STRING, CategoryDescription STRING,
        ParentCategoryID INT, CategoryLevel INT, IsActive BOOLEAN,
        CreatedDate TIMESTAMP_NTZ, ModifiedDate TIMESTAMP_NTZ""",
    "product": """ProductID STRING, ProductName STRING, CategoryID INT, Price DECIMAL(12,4),
        StockQuantity INT, ReorderLevel INT, ProductDescription STRING, ProductImage BINARY,
        ProductSKU STRING, IsActive BOOLEAN, CreatedDate TIMESTAMP_NTZ,
        ModifiedDate TIMESTAMP_NTZ, IsLowStock INT""",
    "customer": """CustomerID STRING, CustomerName STRING, Email STRING, PhoneNumber STRING,
        Address STRING, ShippingAddress STRING, BillingAddress STRING, IsActive BOOLEAN,
        CreatedDate TIMESTAMP_NTZ, ModifiedDate TIMESTAMP_NTZ, LastLoginDate TIMESTAMP_NTZ""",
    "shipping_address": """ShippingAddressID INT, CustomerID STRING, AddressLine1 STRING,
        AddressLine2 STRING, City STRING, StateProvince STRING, PostalCode STRING,
        Country STRING, AddressType STRING, IsDefault BOOLEAN, IsActive BOOLEAN,
        CreatedDate TIMESTAMP_NTZ""",
    "billing_address": """BillingAddressID INT, CustomerID STRING, AddressLine1 STRING,
        AddressLine2 STRING, City STRING, StateProvince STRING, PostalCode STRING,
        Country STRING, IsDefault BOOLEAN, IsActive BOOLEAN, CreatedDate TIMESTAMP_NTZ""",
    "sales_order": """OrderID STRING, CustomerID STRING, OrderDate TIMESTAMP_NTZ,
        OrderStatus STRING, ShippingAddressID INT, BillingAddressID INT,
        SubTotal DECIMAL(12,4), TaxAmount DECIMAL(12,4), ShippingAmount DECIMAL(12,4),
        DiscountAmount DECIMAL(12,4), TotalAmount DECIMAL(12,4), PaymentStatus STRING,
        ShippingMethod STRING, TrackingNumber STRING, ExpectedDeliveryDate TIMESTAMP_NTZ,
        ActualDeliveryDate TIMESTAMP_NTZ, Notes STRING, CreatedDate TIMESTAMP_NTZ,
        ModifiedDate TIMESTAMP_NTZ""",
    "order_detail": """OrderDetailID STRING, OrderID STRING, ProductID STRING, Quantity INT,
        UnitPrice DECIMAL(12,4), DiscountAmount DECIMAL(12,4), LineTotal DECIMAL(18,4),
        CreatedDate TIMESTAMP_NTZ""",
    "inventory_transaction": """TransactionID STRING, ProductID STRING, TransactionType STRING,
        Quantity INT, PreviousStock BIGINT, NewStock BIGINT, ReferenceID STRING,
        ReferenceType STRING, TransactionDate TIMESTAMP_NTZ, UserId STRING, Notes STRING""",
    "audit_log": """AuditID STRING, TableName STRING, Operation STRING, PrimaryKeyValue STRING,
        OldValues STRING, NewValues STRING, ChangedBy STRING, ChangedDate TIMESTAMP_NTZ,
        Application STRING""",
    "product_return": """ReturnID STRING, OrderID STRING, OrderDate TIMESTAMP_NTZ,
        ProductID STRING, CustomerID STRING, ReturnQuantity INT, RefundAmount DECIMAL(12,4),
        ReturnReason STRING, ReturnStatus STRING, RestockProduct BOOLEAN,
        ProcessedDate TIMESTAMP_NTZ, CreatedDate TIMESTAMP_NTZ, CreatedBy STRING""",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


PRIMARY_KEYS = {
    "category": ("CategoryID",),
    "product": ("ProductID",),
    "customer": ("CustomerID",),
    "shipping_address": ("ShippingAddressID",),
    "billing_address": ("BillingAddressID",),
    "sales_order": ("OrderID", "OrderDate"),
    "order_detail": ("OrderDetailID",),
    "inventory_transaction": ("TransactionID",),
    "audit_log": ("AuditID",),
    "product_return": ("ReturnID",),
}

UNIQUE_KEYS = {
    "category": {"category_name": ("CategoryName", "ParentCategoryID")},
    "product": {"product_sku": ("ProductSKU",)},
    "customer": {"customer_email": ("Email",)},
}

REQUIRED = {
    "category": ("CategoryName", "IsActive", "CreatedDate", "ModifiedDate"),
    "product": ("ProductName", "CategoryID", "Price", "StockQuantity", "ReorderLevel",
                "ProductSKU", "IsActive", "CreatedDate", "ModifiedDate"),
    "customer": ("CustomerName", "Email", "IsActive", "CreatedDate", "ModifiedDate"),
    "shipping_address": ("CustomerID", "AddressLine1", "City", "StateProvince", "PostalCode",
                         "Country", "AddressType", "IsDefault", "IsActive", "CreatedDate"),
    "billing_address": ("CustomerID", "AddressLine1", "City", "StateProvince", "PostalCode",
                        "Country", "IsDefault", "IsActive", "CreatedDate"),
    "sales_order": ("CustomerID", "OrderStatus", "SubTotal", "TaxAmount", "ShippingAmount",
                    "DiscountAmount", "TotalAmount", "PaymentStatus", "CreatedDate",
                    "ModifiedDate"),
    "order_detail": ("OrderID", "ProductID", "Quantity", "UnitPrice", "DiscountAmount",
                     "CreatedDate"),
    "inventory_transaction": ("ProductID", "TransactionType", "Quantity", "PreviousStock",
                              "NewStock", "TransactionDate", "UserId"),
    "audit_log": ("TableName", "Operation", "PrimaryKeyValue", "ChangedBy", "ChangedDate"),
    "product_return": ("OrderID", "OrderDate", "ProductID", "CustomerID", "ReturnQuantity",
                       "RefundAmount", "ReturnStatus", "RestockProduct", "CreatedDate",
                       "CreatedBy"),
}


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# A row breaks a check only where the predicate is false; unknown passes.
CHECKS = {
    "category": {"not_own_parent": "CategoryID <> ParentCategoryID"},
    "product": {
        "price_positive": "Price > 0",
        "stock_not_negative": "StockQuantity >= 0",
        "reorder_level_not_negative": "ReorderLevel >= 0",
    },
    "shipping_address": {"address_type_known": _one_of("AddressType", ADDRESS_TYPES)},
    "sales_order": {
        "order_status_known": _one_of("OrderStatus", ORDER_STATUSES),
        "payment_status_known": _one_of("PaymentStatus", PAYMENT_STATUSES),
        "amounts_not_negative": "least(SubTotal, TaxAmount, ShippingAmount, DiscountAmount,"
                                " TotalAmount) >= 0",
        "expected_after_order": "ExpectedDeliveryDate > OrderDate",
        "delivered_not_before_order": "ActualDeliveryDate >= OrderDate",
    },
    "order_detail": {
        "quantity_positive": "Quantity > 0",
        "unit_price_positive": "UnitPrice > 0",
        "discount_within_line": "DiscountAmount BETWEEN 0 AND Quantity * UnitPrice",
    },
    "inventory_transaction": {
        "transaction_type_known": _one_of("TransactionType", TRANSACTION_TYPES)
    },
    "audit_log": {"operation_known": _one_of("Operation", AUDIT_OPERATIONS)},
    "product_return": {
        "return_quantity_positive": "ReturnQuantity > 0",
        "refund_not_negative": "RefundAmount >= 0",
        "return_status_known": _one_of("ReturnStatus", RETURN_STATUSES),
    },
}

# table -> rule -> (own columns, other table, its columns)
REFERENCES = {
    "category": {"parent_category": (("ParentCategoryID",), "category", ("CategoryID",))},
    "product": {"product_category": (("CategoryID",), "category", ("CategoryID",))},
    "shipping_address": {"address_customer": (("CustomerID",), "customer", ("CustomerID",))},
    "billing_address": {"address_customer": (("CustomerID",), "customer", ("CustomerID",))},
    "sales_order": {
        "order_customer": (("CustomerID",), "customer", ("CustomerID",)),
        "order_shipping_address": (
            ("ShippingAddressID",), "shipping_address", ("ShippingAddressID",)),
        "order_billing_address": (
            ("BillingAddressID",), "billing_address", ("BillingAddressID",)),
    },
    "order_detail": {"detail_product": (("ProductID",), "product", ("ProductID",))},
    "inventory_transaction": {"transaction_product": (("ProductID",), "product", ("ProductID",))},
    "product_return": {
        "return_order": (("OrderID", "OrderDate"), "sales_order", ("OrderID", "OrderDate")),
        "return_product": (("ProductID",), "product", ("ProductID",)),
        "return_customer": (("CustomerID",), "customer", ("CustomerID",)),
    },
}

# Column defaults on ingest; the marks stand for arguments of apply_defaults.
AS_OF, ACTOR, APPLICATION = object(), object(), object()
DEFAULTS = {
    "category": {"IsActive": True, "CreatedDate": AS_OF, "ModifiedDate": AS_OF},
    "product": {"StockQuantity": 0, "ReorderLevel": 10, "IsActive": True,
                "CreatedDate": AS_OF, "ModifiedDate": AS_OF},
    "customer": {"IsActive": True, "CreatedDate": AS_OF, "ModifiedDate": AS_OF},
    "shipping_address": {"Country": "USA", "AddressType": "Shipping", "IsDefault": False,
                         "IsActive": True, "CreatedDate": AS_OF},
    "billing_address": {"Country": "USA", "IsDefault": False, "IsActive": True,
                        "CreatedDate": AS_OF},
    "sales_order": {"OrderDate": AS_OF, "OrderStatus": "Pending", "SubTotal": 0,
                    "TaxAmount": 0, "ShippingAmount": 0, "DiscountAmount": 0,
                    "TotalAmount": 0, "PaymentStatus": "Pending", "CreatedDate": AS_OF,
                    "ModifiedDate": AS_OF},
    "order_detail": {"DiscountAmount": 0, "CreatedDate": AS_OF},
    "inventory_transaction": {"TransactionDate": AS_OF, "UserId": ACTOR},
    "audit_log": {"ChangedBy": ACTOR, "ChangedDate": AS_OF, "Application": APPLICATION},
    "product_return": {"ReturnStatus": "Pending", "RestockProduct": True,
                       "CreatedDate": AS_OF, "CreatedBy": ACTOR},
}

"""Keeping customers' addresses and numbers unreadable at rest."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.clock import ts
from tillwise.operators.prep import email_hash

SECRET_COLUMNS = ("Email", "PhoneNumber")


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per value; unknown stays unknown."""
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM")).cast("string")


def secret(frame: DataFrame, key: str) -> Column:
    """``key`` as a value that plans, and the logs that hold plans, name but don't show."""
    return frame.sparkSession.createDataFrame([(key,)], "secret string").scalar()


def protect_customer_pii(customers: DataFrame, key: str) -> DataFrame:
    """Readable customers as stored ones, with a digest to find equal emails by.

    ``key`` has 16, 24 or 32 bytes and comes from the caller's secret store.
    """
    return customers.withColumns({
        "EmailHash": email_hash(F.col("Email")),
        **{c: encrypt(F.col(c), secret(customers, key)) for c in SECRET_COLUMNS},
    })


def reveal_customer_pii(stored: DataFrame, key: str) -> DataFrame:
    return stored.withColumns({c: decrypt(F.col(c), secret(stored, key)) for c in SECRET_COLUMNS})


def upsert_customers(
    stored: DataFrame, changes: DataFrame, key: str, *, as_of: datetime
) -> DataFrame:
    """Stored customers after readable ``changes``, one row per CustomerID.

    Unknown values in a change keep what is stored. Only readable input is
    encrypted; values already stored are carried over as they are.
    """
    new = protect_customer_pii(changes, key)
    kept = ["Email", "EmailHash", "PhoneNumber", "Address", "ShippingAddress",
            "BillingAddress", "IsActive"]
    is_new, is_old = F.col("s.CustomerID").isNull(), F.col("c.CustomerID").isNull()
    values: dict[str, Column] = {
        "CustomerID": F.coalesce("c.CustomerID", "s.CustomerID"),
        "CustomerName": F.when(is_old, F.col("s.CustomerName")).otherwise(
            F.col("c.CustomerName")),
        "CreatedDate": F.coalesce("s.CreatedDate", "c.CreatedDate", ts(as_of)),
        "ModifiedDate": F.when(is_old, F.col("s.ModifiedDate")).otherwise(ts(as_of)),
        "LastLoginDate": F.coalesce("s.LastLoginDate", "c.LastLoginDate"),
        **{c: F.coalesce(f"c.{c}", f"s.{c}") for c in kept},
    }
    values["IsActive"] = F.when(is_new, F.coalesce("c.IsActive", F.lit(True))).otherwise(
        values["IsActive"])
    return (
        stored.alias("s")
        .join(new.alias("c"), F.col("s.CustomerID") == F.col("c.CustomerID"), "full")
        .select(*[values[c].alias(c) for c in stored.columns])
    )

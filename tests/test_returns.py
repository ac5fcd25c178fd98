"""Returns of one line together, and where rows of an order meet."""

from __future__ import annotations

import contextlib
import io
from decimal import Decimal

import pytest

from tests.seed import AS_OF
from tillwise import model
from tillwise.operators import returns
from tillwise.session import cut_lineage
from tillwise.store import Store


@pytest.fixture(scope="module")
def asked(spark):
    """Two orders, and requests for more than one of their lines holds."""
    lines = spark.createDataFrame(
        [("a", 1, 7, 5, Decimal(2)), ("b", 1, 8, 1, Decimal(3)), ("c", 2, 7, 4, Decimal(2))],
        "OrderDetailID string, OrderID long, ProductID long, Quantity int, UnitPrice decimal(12,4)")
    placed = spark.createDataFrame(
        [(1, 1, AS_OF, "Delivered"), (2, 1, AS_OF, "Shipped")],
        "OrderID long, CustomerID long, OrderDate timestamp_ntz, OrderStatus string")
    earlier = spark.createDataFrame(
        [(1, 7, 1, "Processed")], "OrderID long, ProductID long, ReturnQuantity int, ReturnStatus string")
    store = Store(spark, {"order_detail": lines, "sales_order": placed, "product_return": earlier})
    wanted = [("r1", 1, 7, 3), ("r2", 1, 7, 2), ("r3", 1, 7, 1), ("r4", 1, 8, 1), ("r5", 2, 7, 4), ("r6", 2, 9, 1)]
    return store, spark.createDataFrame(
        [(r, AS_OF, o, p, n, None, None, True) for r, o, p, n in wanted],
        "ReturnID string, RequestedAt timestamp_ntz, OrderID long, ProductID long, ReturnQuantity int,"
        " ReturnReason string, RefundAmount decimal(12,4), RestockProduct boolean")


@pytest.mark.parametrize("in_row", [returns.IN_ROW, 2, 0])
def test_requests_for_a_line_in_turn(asked, in_row):
    made = returns.validate_returns(*asked, corrected=True, in_row=in_row)
    short = model.RETURN_REJECTS["quantity"]
    assert {r.ReturnID: (r.ErrorMessage, r.ClosesOrder) for r in made.collect()} == {
        "r1": (None, False), "r2": (short, False), "r3": (None, False), "r4": (None, True),
        "r5": (None, True), "r6": (model.RETURN_REJECTS["line"], False)}


@pytest.mark.parametrize("corrected", [False, True])
def test_rows_of_an_order_meet_once(spark, asked, monkeypatch, corrected):
    """All shuffles are by OrderID: requests move once, and are written once."""
    plans = []

    def kept(df):
        with contextlib.redirect_stdout(io.StringIO()) as told:
            df.explain()
        plans.append(told.getvalue())
        return cut_lineage(df)

    monkeypatch.setattr(returns, "cut_lineage", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        returns.validate_returns(*asked, corrected=corrected)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 1
    shuffles = [s for s in plans[0].splitlines() if "Exchange hashpartitioning" in s]
    assert shuffles and not [s for s in shuffles if "ProductID" in s]

"""The category tree at its true depth, and sales added up along it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.reports import revenue_by_category
from tillwise.session import cut_lineage
from tillwise.store import Store


def ancestors(categories: DataFrame) -> DataFrame:
    """CategoryID, AncestorID and Distance for every category and all that are above it.

    Steps double: what is known reaches as far again above each ancestor, so a
    tree of depth d takes log d rounds. A category in a cycle is above itself;
    pairs are kept once with their least distance, so cycles end too. A parent
    that is not there counts as none.
    """
    own = categories.select("CategoryID", F.col("ParentCategoryID").alias("AncestorID"))
    known = cut_lineage(
        own.where("AncestorID IS NOT NULL")
        .join(own.select(F.col("CategoryID").alias("AncestorID")), "AncestorID", "left_semi")
        .select("CategoryID", "AncestorID", F.lit(1).alias("Distance")).distinct())
    pairs = known.count()
    while True:
        higher = known.select(
            F.col("CategoryID").alias("AncestorID"), F.col("AncestorID").alias("Higher"), F.col("Distance").alias("More"))
        known = cut_lineage(
            known.unionByName(known.join(higher, "AncestorID").select(
                "CategoryID", F.col("Higher").alias("AncestorID"), (F.col("Distance") + F.col("More")).alias("Distance")))
            .groupBy("CategoryID", "AncestorID").agg(F.min("Distance").alias("Distance")))
        pairs, before = known.count(), pairs
        if pairs == before:
            return known


def category_tree(categories: DataFrame) -> DataFrame:
    """Depth, root and place of each category.

    ``Place`` is ``tree``, ``cycle`` for a category above itself, or ``below
    cycle``; depth and root are known in the tree only.
    """
    known = ancestors(categories)
    looped = known.where("CategoryID = AncestorID").select(F.col("CategoryID").alias("AncestorID"), F.lit(True).alias("Looped"))
    above = known.join(looped, "AncestorID", "left").groupBy("CategoryID").agg(
        F.max("Distance").alias("Depth"), F.max_by("AncestorID", "Distance").alias("RootID"),
        F.bool_or(F.col("Looped").isNotNull()).alias("UnderLoop"),
        F.bool_or(F.col("CategoryID") == F.col("AncestorID")).alias("InLoop"))
    lost = F.coalesce("UnderLoop", F.lit(False))
    return categories.select("CategoryID").join(above, "CategoryID", "left").select(
        "CategoryID",
        F.when(~lost, F.coalesce("Depth", F.lit(0))).alias("Depth"),
        F.when(~lost, F.coalesce("RootID", "CategoryID")).alias("RootID"),
        F.when(F.coalesce("InLoop", F.lit(False)), "cycle").when(lost, "below cycle").otherwise("tree").alias("Place"))


def sales_report_subtree(
    store: Store, *, as_of: datetime, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Sales of each category with all categories below it, highest revenue first.

    Lines are added up per category before they meet the tree, so what is
    repeated for every ancestor is a row per category. Members of a cycle have
    the sum of all its members, each counted once.
    """
    categories = store.scan("category", "CategoryID", "CategoryName", "ParentCategoryID")
    sales = revenue_by_category(store, as_of=as_of, start=start, end=end)
    each = categories.select("CategoryID", F.col("CategoryID").alias("AncestorID"))
    below = each.union(ancestors(categories).where("CategoryID != AncestorID").select("CategoryID", "AncestorID"))
    return (
        below.join(sales, "CategoryID", "left")
        .groupBy(F.col("AncestorID").alias("CategoryID"))
        .agg(F.count("*").alias("Categories"), F.sum("QuantitySold").alias("QuantitySold"),
             F.sum("TotalRevenue").alias("TotalRevenue"))
        .join(categories.select("CategoryID", "CategoryName"), "CategoryID")
        .select("CategoryID", "CategoryName", "Categories",
                F.coalesce("QuantitySold", F.lit(0)).cast("long").alias("QuantitySold"),
                F.coalesce("TotalRevenue", F.lit(0)).alias("TotalRevenue"))
        .orderBy(F.desc("TotalRevenue"), "CategoryID")
    )

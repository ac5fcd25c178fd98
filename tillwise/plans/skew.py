"""Ordered work per key that stays spread out when one key holds most rows.

A plain window sends all rows of a key to one task. Here keys with few rows
take that plain window; keys too big for one task are range-sorted into pieces
of bounded size, numbered piece by piece, and the pieces are shifted by what
lies before them. Both ways give the same result, on every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import cut_lineage

# Rows of one key that a task may take, whatever the size of the table.
HOT_ROWS = 1_000_000
# Keys are counted in so many buckets first.
BUCKETS = 4096


def hot_keys(
    df: DataFrame, keys: Sequence[str], *, bound: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame | None:
    """Keys of ``df`` holding more than ``hot_rows`` rows with their ``_rows``, or None.

    ``bound`` is a table with at least as many rows that is cheaper to count,
    such as a file scan. The keys stay a table: there can be one for every
    ``hot_rows`` rows.
    """
    if (df if bound is None else bound).count() <= hot_rows:
        return None
    # A hot key fills its bucket: of all other buckets no key has to be counted.
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    full = [r[0] for r in df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
            .where(F.col("_rows") > hot_rows).collect()]
    if not full:
        return None
    found = cut_lineage(
        df.where(bucket.isin(full)).groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows))
    return None if found.isEmpty() else found


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    """Key equality that also matches unknown to unknown, as grouping does."""
    test = F.lit(True)
    for key in keys:
        test = test & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return test


def _in_order(hot: DataFrame, keys: Sequence[str], order: Sequence[Column], tasks: int) -> DataFrame:
    """Rows range-sorted over ``tasks`` tasks, with ``_piece`` and ``_at``; written once.

    The split is by the full, unique order, so no key is too big for it.
    Pieces and rows must see the same split.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    return cut_lineage(
        hot.repartitionByRange(max(2, tasks), *by).sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright("_at", 33)))


def _piecewise(
    hot: DataFrame,
    tasks: int,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str | None,
    before: dict[str, str],
    count: str | None,
    totals: dict[str, str],
) -> DataFrame:
    columns = hot.columns
    placed = _in_order(hot, keys, order, tasks)
    sums = {f"_s_{v}": F.sum(v) for v in {*before.values(), *totals.values()}}
    # One row per hot key and sort partition it touches.
    pieces = placed.groupBy(*keys, "_piece").agg(
        F.count("*").alias("_n"), *[s.alias(n) for n, s in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    shifts = pieces.select(
        *keys, "_piece",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o_rank"),
        F.sum("_n").over(whole).alias("_t_rank"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o{n}") for n in sums],
        *[F.sum(n).over(whole).alias(f"_t{n}") for n in sums],
    )
    local = Window.partitionBy(*keys, "_piece").orderBy("_at")
    so_far = local.rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        placed.withColumn("_rank", F.row_number().over(local))
        .withColumns({
            f"_b_{name}": F.coalesce(F.sum(value).over(so_far), F.lit(0))
            for name, value in before.items()
        })
        .alias("l")
        .join(
            shifts.alias("r"),
            _same([*keys, "_piece"], "l", "r"),
        )
    )
    out = [F.col(f"l.{c}") for c in columns]
    if rank:
        out.append((F.col("_rank") + F.col("_o_rank")).cast("long").alias(rank))
    for name, value in before.items():
        out.append((F.col(f"_b_{name}") + F.col(f"_o_s_{value}")).alias(name))
    if count:
        out.append(F.col("_t_rank").alias(count))
    for name, value in totals.items():
        out.append(F.col(f"_t_s_{value}").alias(name))
    return joined.select(*out)


def per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    rank: str | None = None,
    before: dict[str, str] | None = None,
    count: str | None = None,
    totals: dict[str, str] | None = None,
    probe: DataFrame | None = None,
    bound: DataFrame | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add columns worked out along each key's rows in ``order``.

    ``rank`` numbers the rows from 1; ``before`` maps a new column to the value
    column summed over all earlier rows; ``count`` and ``totals`` cover the
    whole key. ``order`` must be total. ``probe`` is a cheaper frame with the
    same keys and at least as many rows of each, used to look for hot keys;
    ``bound`` is one still cheaper to count, with at least its number of rows.
    ``hot_rows`` None tells that no key is hot.
    """
    before, totals = before or {}, totals or {}
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def plain(rows: DataFrame) -> DataFrame:
        out = [F.col(c) for c in rows.columns]
        if rank:
            out.append(F.row_number().over(ordered).cast("long").alias(rank))
        for name, value in before.items():
            out.append(F.coalesce(F.sum(value).over(so_far), F.lit(0)).alias(name))
        if count:
            out.append(F.count("*").over(by_key).alias(count))
        for name, value in totals.items():
            out.append(F.sum(value).over(by_key).alias(name))
        return rows.select(*out)

    hot = None
    if hot_rows is not None:
        hot = hot_keys(df if probe is None else probe, keys, bound=bound, hot_rows=hot_rows)
    if hot is None:
        return plain(df)
    # What led to the rows runs once; both halves read the written copy.
    marked = cut_lineage(
        df.alias("l").join(hot.alias("h"), _same(keys, "l", "h"), "left")
        .select("l.*", F.col("h._rows").isNotNull().alias("_hot")))
    wide = plain(marked.where("NOT _hot").drop("_hot"))
    rows = hot.agg(F.sum("_rows")).first()[0]
    split = _piecewise(marked.where("_hot").drop("_hot"), -(-2 * rows // hot_rows), keys, order,
                       rank, before, count, totals)
    return wide.unionByName(split.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in wide.schema.fields]
    ))


def numbered(df: DataFrame, order: Sequence[Column], name: str, *, piece_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``name`` from 1 over all rows in ``order``, which must be total.

    Rows are range-sorted into pieces of about ``piece_rows``; a piece is
    numbered by its own task and shifted by the rows before it.
    """
    placed = _in_order(df, [], order, -(-df.count() // piece_rows))
    sizes = placed.groupBy("_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row per piece, which is few: all of them in one task.
    before = sizes.select("_piece", "_first", F.coalesce(F.sum("_n").over(
        Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_piece").withColumn(
        name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)

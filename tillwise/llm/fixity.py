"""Merkle fixity audit of replicated WARC files.

A record is hashed whole. A leaf of a file's tree is a range of ``RANGE`` bytes
of offsets and hashes the records that start there, in order of offset; an
inner node hashes its up to ``FANOUT`` children in order. The ranges are fixed
by offset, so a record that is missing or damaged on one side leaves all other
leaves alike. The audit compares the roots of two replicas, and from there the
children of nodes that differ, level by level, so that it reads as many nodes
as there are damaged branches; records are compared only in leaves that
differ.

Leaves hold as many records as start within their range, inner nodes
``FANOUT`` children: no group grows with the data, and a file with a third of
all records is many leaves. Equal records at one offset are counted before
they are gathered.

Defined results: a null payload counts as empty, a null file or offset as a
value of its own; repeated records are one record with a count; a file on one
side only differs at its root and all its records are reported; empty replicas
are alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.workspace import written

RANGE = 64 << 10
FANOUT = 16
FILE_BYTES = 256 << 20


def record(uri: Column, payload: Column) -> Column:
    """A response record: header, empty line, payload, and the two line ends after it."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _joined(*parts: Column) -> Column:
    """Text of a tuple in which no two different tuples meet."""
    return F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})


def records(replica: DataFrame) -> DataFrame:
    """file, start, length, digest, copies and leaf of (file, offset, payload)."""
    body = F.coalesce(F.col("payload"), F.lit(""))
    return replica.select(
        F.col("file"), F.col("offset").cast("long").alias("start"), F.octet_length(body).cast("long").alias("length"),
        F.sha2(body, 256).alias("digest"),
    ).groupBy("file", "start", "length", "digest").agg(F.count("*").alias("copies")).withColumn(
        "leaf", F.floor(F.coalesce(F.col("start"), F.lit(0)) / RANGE).cast("long"))


@dataclass
class Tree:
    """``nodes``: level (0 for leaves), file, node, hash, n_records; ``height``: the roots' level."""

    records: DataFrame
    nodes: DataFrame
    height: int


def _tree(found: DataFrame, height: int) -> Tree:
    line = F.struct(F.col("start").alias("at"), _joined(F.col("start"), F.col("length"), F.col("digest"), F.col("copies")).alias("line"))
    level = found.groupBy("file", F.col("leaf").alias("node")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("hash"),
        F.sum("copies").alias("n_records"))
    levels = [written(level.select(F.lit(0).alias("level"), "file", "node", "hash", "n_records"), "fixity")]
    for at in range(1, height + 1):
        child = F.struct(F.col("node").alias("at"), F.concat_ws(":", F.col("node").cast("string"), "hash").alias("line"))
        level = levels[-1].groupBy("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["line"]), "\n"), 256).alias("hash"),
            F.sum("n_records").alias("n_records"))
        levels.append(written(level.select(F.lit(at).alias("level"), "file", F.col("up").alias("node"), "hash", "n_records"), "fixity"))
    return Tree(found, reduce(DataFrame.unionByName, levels), height)


def trees(one: DataFrame, two: DataFrame) -> tuple[Tree, Tree]:
    """Trees of two replicas, of equal height."""
    found = [written(records(r), "records") for r in (one, two)]
    most = max((f.agg(F.max("leaf")).first()[0] or 0) for f in found)
    height = 0
    while most >= FANOUT ** height:
        height += 1
    return _tree(found[0], height), _tree(found[1], height)


def _differing(one: DataFrame, two: DataFrame, on: list[str]) -> DataFrame:
    """Keys whose hash is not the same on both sides, or is on one side only."""
    sides = one.select(*on, F.lit(1).alias("side"), "hash").union(two.select(*on, F.lit(2).alias("side"), "hash"))
    return sides.groupBy(*on).agg(
        F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")
    ).where("n < 2 OR low != high").select(*on)


def differing_leaves(one: Tree, two: Tree) -> DataFrame:
    """``file`` and ``node`` of the leaves that differ, found from the roots down."""

    def at(tree: Tree, level: int) -> DataFrame:
        return tree.nodes.where(F.col("level") == level)

    open_ = _differing(at(one, one.height), at(two, two.height), ["file", "node"])
    for level in range(one.height - 1, -1, -1):
        above = written(open_.select(F.col("file").alias("_file"), F.col("node").alias("_node")), "branches")

        def below(tree: Tree, level=level, above=above) -> DataFrame:
            nodes = at(tree, level)
            return nodes.join(above, nodes["file"].eqNullSafe(above["_file"]) & (
                F.floor(nodes["node"] / FANOUT) == above["_node"]), "left_semi")

        open_ = _differing(below(one), below(two), ["file", "node"])
    return open_


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records that differ between two replicas given as (file, offset, payload).

    file, start, fault (``missing``: only in the first; ``extra``: only in the
    second; ``changed``), and length and digest on both sides. Several
    different records at one offset are compared as a set.
    """
    first, second = trees(one, two)
    bad = written(differing_leaves(first, second), "leaves")

    def within(tree: Tree, side: int) -> DataFrame:
        found = tree.records
        return found.join(bad, found["file"].eqNullSafe(bad["file"]) & (found["leaf"] == bad["node"]), "left_semi").select(
            "file", "start", F.lit(side).alias("side"), "length", "digest", "copies")

    both = within(first, 1).union(within(second, 2))

    def of(side: int, column: str) -> Column:
        return F.min(F.when(F.col("side") == side, F.col(column)))

    def everything(side: int) -> Column:
        line = _joined(F.col("length"), F.col("digest"), F.col("copies"))
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == side, line))), "\n")

    return both.groupBy("file", "start").agg(
        everything(1).alias("_one"), everything(2).alias("_two"),
        of(1, "length").alias("length_1"), of(1, "digest").alias("digest_1"),
        of(2, "length").alias("length_2"), of(2, "digest").alias("digest_2"),
    ).where("_one != _two").select(
        "file", "start",
        F.when(F.col("_two") == "", "missing").when(F.col("_one") == "", "extra").otherwise("changed").alias("fault"),
        "length_1", "digest_1", "length_2", "digest_2")


def laid_out(rows: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(row, uri, payload) as records with ``file`` and ``offset``.

    Each input split writes files of its own, one record after the other, as
    parallel writers do; a file ends with the record that passes ``file_bytes``.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    frame = rows.select("row", record(F.col("uri"), F.col("payload")).alias("payload"))

    def of(batches):
        writer, file, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names, offsets = [], []
            for size in pc.binary_length(batch.column(1)).to_pylist():
                names.append(f"{writer:05d}-{file:05d}.warc")
                offsets.append(at)
                at += size
                if at >= file_bytes:
                    file, at = file + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "file", "offset"])

    return frame.mapInArrow(of, StructType([
        *frame.schema.fields, StructField("file", StringType()), StructField("offset", LongType())]))

"""SimHash near-duplicates by ball hashing that meets in the middle.

A fingerprint has a bit set if it is set in over half of the hashes of the
text's three-word shingles. Two fingerprints at most ``radius`` bits apart have
a value between them at most half of that from each. So every distinct
fingerprint emits all values within half the radius; a shuffle brings equal
values together; a bucket is kept as the set of bits that lead to it, in one row; each bucket links its fingerprints to one of them, which
keeps all that share a bucket connected without forming their pairs; links are
deduplicated, and verified by counting the differing bits. Distinct
fingerprints that share a value differ from it in different bits, so with half
radius 1 a bucket has 65 at most, however many copies a text has.

Components of the links get the smallest document id in reach. Links go by the
bits alone: no word similarity is checked beside them.

Defined results: null, empty and blank texts have the fingerprint zero and are
linked like any other; with fewer than three words the whole sequence is the
one shingle; repeated rows are copies of each other; a null id never names a
component unless the component has no other, then the name is null; an empty
table stays empty. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillwise.llm.components import components
from tillwise.llm.textbatch import blobs_of
from tillwise.llm.workspace import plain_names, written

WORDS = 3
RADIUS = 2
SEED = 42


def fingerprints(blobs: list[bytes], words: int = WORDS) -> np.ndarray:
    """One signed 64-bit fingerprint per text."""
    h = xxhash.xxh64_intdigest
    out = np.zeros(len(blobs), dtype=np.uint64)
    for i, blob in enumerate(blobs):
        # bytes.lower and bytes.split know ASCII only: A-Z and the white space meant here.
        found = blob.lower().split()
        if not found:
            continue
        n = max(len(found) - words + 1, 1)
        shingles = map(b" ".join, zip(*[found[k:] for k in range(words)])) if len(found) >= words else [b" ".join(found)]
        hashed = np.fromiter((h(s, SEED) for s in shingles), dtype=np.uint64, count=n)
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65536):
            bits = np.unpackbits(hashed[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long; no shuffle."""
    at_text = docs.columns.index("text")

    def of(batches):
        for batch in batches:
            made = fingerprints(blobs_of(batch.column(at_text)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made)], names=[*batch.schema.names, name])

    return docs.mapInArrow(of, StructType([*docs.schema.fields, StructField(name, LongType())]))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fp`` within ``radius`` bits.

    Any two within the radius are linked directly or through one fingerprint of
    a shared bucket, to which both are linked: the smallest of those within half
    the radius, rounded down, of the bucket's value. The others are within half
    of it, rounded up, so at an odd radius too no such link is beyond it, and of
    any two within the radius one is that near to some value both emit.
    """
    flips = [0]
    for _ in range((radius + 1) // 2):
        flips = sorted({f ^ (1 << bit) for f in flips for bit in range(64)} | set(flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    # A row is a value and the number of the flip that led to it, which names the fingerprint
    # in a byte or two; a bucket is the set of its flips, as bits.
    balls = prints.select("fp", F.posexplode(F.array(*[F.lit(f) for f in signed])).alias("flip", "by")).select(
        F.col("fp").bitwiseXOR(F.col("by")).alias("variant"), F.col("flip").cast("short").alias("flip"))
    words = [lo for lo in range(0, len(flips), 63)]
    buckets = balls.groupBy("variant").agg(*[
        F.bit_or(F.expr(f"CASE WHEN flip BETWEEN {lo} AND {lo + 62} THEN shiftleft(1L, flip - {lo}) ELSE 0L END")).alias(f"set{lo}")
        for lo in words])
    number = sum((F.bit_count(f"set{lo}") for lo in words[1:]), F.bit_count(f"set{words[0]}"))

    def members(most: int) -> Column:
        """The fingerprints of a bucket that are at most ``most`` bits from its value."""
        return F.concat(*[
            F.filter(
                F.array(*[F.when(F.col(f"set{lo}").bitwiseAND(F.lit(1 << i)) != 0, F.col("variant").bitwiseXOR(F.lit(f)))
                          for i, f in enumerate(signed[lo:lo + 63]) if flips[lo + i].bit_count() <= most]),
                lambda x: x.isNotNull())
            for lo in words if any(f.bit_count() <= most for f in flips[lo:lo + 63])])

    inner = "fps"
    buckets = buckets.where(number > 1)
    if radius % 2:
        buckets, inner = buckets.withColumn("inner", members(radius // 2)), "inner"
    found = buckets.withColumn("fps", members(64)).select(
        F.array_min(inner).alias("a"), F.explode("fps").alias("b")).where("a != b").distinct()
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp``, ``component`` (a fingerprint) and ``component_id`` of each fingerprint in (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    found = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return written(named.join(least, "component").select("fp", "component", "component_id"), "classes")


def grouped(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row of ``docs`` (doc_id, text), and the classes."""
    rows = with_fingerprint(docs.select("doc_id", "text"), "fp")
    prints = written(rows.select("doc_id", "fp"), "prints")
    return prints, classes(prints, radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints, made = grouped(docs, radius)
    return prints.select("doc_id", "fp").join(made, "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each component, with its own columns."""
    plain = plain_names(docs)
    _, made = grouped(plain, radius)
    rows = with_fingerprint(plain, "fp")
    first = rows.join(made, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeated ids leave more than one such row: the one with the smallest print and text stays.
    row = F.struct(*plain.columns)
    order = F.struct("fp", F.xxhash64("text"), F.sha2(F.to_json(row), 256))
    return first.groupBy("component").agg(F.min_by(row, order).alias("row")).select("row.*").toDF(*docs.columns)

"""Ranked lexical search: impact vectors in buckets of falling length.

A document's impact vector has, for each term, the integer
``10**9 * tf div (1000 * tf + 8 * m)`` with ``m`` from its number of terms; an
item's vector has the weights of its terms. The score is their product, and an
item asks for the ``TOP`` largest.

1. One pass over the texts counts terms. Only terms of the items matter from
   here on; the counts are a table.
2. Impact vectors are range-sorted by length (Euclidean norm) and put into
   buckets of ``BUCKET`` documents, or ``ENTRIES`` entries, one row each, by terms.
3. The longest buckets are searched first; the tenth best score of each item
   there is a threshold for all others. A bucket is passed over for an item if,
   by Cauchy-Schwarz, not even its longest vector reaches the threshold.
4. Inside, an item's terms are taken in falling weight until the rest can't
   reach the threshold alone, by Cauchy-Schwarz or by the largest impact of each
   coordinate in the bucket. Only documents with one of the terms taken are
   looked at, and only if what these give plus the bound of the rest (with the
   document's own remaining length) reaches the threshold.
5. Survivors are scored over all terms in 64-bit integers. A bound equal to the
   threshold survives, so ties are whole.

Items are taken in blocks of ``BLOCK`` bytes of text; a block's terms and
thresholds are all that is sent to tasks. No result is approximate.

Defined results: documents and items without a term (null and empty too) are in
no result; repeated documents are ranked each, repeated items answered each; a
null document id comes after all others among equals; empty tables give no
rows; other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tillwise.llm.textbatch import blobs_of
from tillwise.llm.workspace import written

TOP = 10
BUCKET = 2048
ENTRIES = 1 << 19
HEAD = 8
BLOCK = 4 << 20
RUN = 1 << 20
NO_ID = np.iinfo(np.int64).max

# Letters of ASCII as lower case, digits and all beyond ASCII as they are, anything else as a space.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(blob: bytes) -> list[bytes]:
    return blob.translate(TERM).split()


class Numbers(dict):
    """Numbers of known terms, -1 for others."""

    def __missing__(self, key: bytes) -> int:
        return -1


def count_terms(blobs: list[bytes], number: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms per text; text, term and times of each known term, ordered by text and term."""
    found = [terms_of(b) for b in blobs]
    n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(n.sum()))
    doc = np.repeat(np.arange(len(found)), n)
    known = ids >= 0
    key, tf = np.unique(doc[known] * max(len(number), 1) + ids[known], return_counts=True)
    return n, key // max(len(number), 1), key % max(len(number), 1), tf


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def mean_ratio(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    return 100 - 90 + 90 * n * documents // length


def counted(docs: DataFrame, number: Numbers) -> DataFrame:
    """doc_id, n, terms and times of each document, for the terms in ``number``."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def of(batches):
        for batch in batches:
            blobs, at = blobs_of(batch.column(1)), 0
            while at < len(blobs):
                to, size = at, 0
                while to < len(blobs) and (to == at or size + len(blobs[to]) <= RUN):
                    size, to = size + len(blobs[to]), to + 1
                n, doc, term, tf = count_terms(blobs[at:to], shared.value)
                cut = pa.array(np.searchsorted(doc, np.arange(to - at + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, to - at), pa.array(n),
                    pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "times"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        of, "doc_id long, n long, terms array<int>, times array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return np.diff(ends), values


def with_length(counts: DataFrame, documents: int, length: int) -> DataFrame:
    """doc_id, m, norm, terms and times of the documents with a known term."""

    def of(batches):
        for batch in batches:
            m = mean_ratio(batch.column(1).to_numpy(), documents, length)
            size, tf = _lists(batch.column(3))
            x = impact(tf.astype(np.int64), np.repeat(m, size)).astype(float)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(m)), size), x * x, minlength=len(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m), pa.array(norm), batch.column(2), batch.column(3)],
                names=["doc_id", "m", "norm", "terms", "times"])

    return counts.where(F.size("terms") > 0).mapInArrow(
        of, "doc_id long, m long, norm double, terms array<int>, times array<int>")


BUCKETS = "top double, docs binary, norms binary, terms binary, begins binary, members binary, impacts binary"


def bucketed(vectors: DataFrame, bucket: int) -> DataFrame:
    """Buckets of up to ``bucket`` documents in falling order of length, each one row, by terms.

    ``top`` is the greatest length; ``docs`` and ``norms`` are one value per
    document, ``members`` and ``impacts`` the entries of each of ``terms``.
    """

    def of(batches):
        waiting: list[tuple] = []

        def packed(rows):
            docs = np.concatenate([r[0] for r in rows])
            m, norm = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
            size = np.concatenate([r[3] for r in rows])
            term, tf = np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows]).astype(np.int64)
            member = np.repeat(np.arange(len(docs), dtype=np.int32), size)
            order = np.argsort(term, kind="stable")
            term, member = term[order], member[order]
            x = impact(tf[order], m[member]).astype(np.int32)
            own, begin = np.unique(term, return_index=True)
            parts = [docs, norm, own.astype(np.int32), np.append(begin, len(term)), member, x]
            return pa.RecordBatch.from_arrays(
                [pa.array([float(norm.max())]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                names=[c.split()[0] for c in BUCKETS.split(", ")])

        have, entries = 0, 0
        for batch in batches:
            docs = batch.column(0).fill_null(NO_ID).to_numpy()
            m, norm = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            size, term = _lists(batch.column(3))
            _, tf = _lists(batch.column(4))
            at, edge = 0, np.concatenate(([0], np.cumsum(size)))
            while at < len(docs):
                to = int(np.searchsorted(edge, edge[at] + ENTRIES - entries, side="right")) - 1
                to = min(len(docs), at + bucket - have, max(to, at + 1))
                lo, hi = edge[at], edge[to]
                waiting.append((docs[at:to], m[at:to], norm[at:to], size[at:to], term[lo:hi], tf[lo:hi]))
                have, entries, at = have + to - at, entries + int(hi - lo), to
                if have == bucket or entries >= ENTRIES or to < len(docs):
                    yield packed(waiting)
                    waiting, have, entries = [], 0, 0
        if waiting:
            yield packed(waiting)

    # Equal lengths are dealt out by a hash: copies don't meet in one range.
    order = [F.desc("norm"), F.xxhash64("doc_id", "terms")]
    return vectors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(of, BUCKETS)


class Item:
    """An item's terms in falling weight, what is known of its best documents, and its threshold."""

    def __init__(self, number: int, terms: np.ndarray, weights: np.ndarray, threshold: int):
        order = np.argsort(-weights, kind="stable")
        self.number, self.terms, self.weights = number, terms[order], weights[order]
        # Norm of the weights from each place on, and none after the last.
        self.rest = np.sqrt(np.append(np.cumsum((self.weights[::-1] ** 2).astype(float))[::-1], 0.0))
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.threshold = threshold

    def add(self, docs: np.ndarray, scores: np.ndarray, most: int) -> None:
        docs, scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, scores])
        best = np.lexsort((docs, -scores))[:most]
        self.docs, self.scores = docs[best], scores[best]
        if len(best) == most:
            self.threshold = max(self.threshold, int(self.scores[-1]))


SLACK = 1 + 1e-9  # bounds are doubles; what they let through is scored in integers


def search_bucket(item: Item, top: float, docs, norms, terms, begins, members, impacts, largest, most: int) -> int:
    """Add the bucket's best documents to ``item``; how many were scored."""
    need = max(item.threshold, 1)
    if item.rest[0] * top * SLACK < need:
        return 0
    at = np.searchsorted(terms, item.terms)
    there = at < len(terms)
    there[there] = terms[at[there]] == item.terms[there]
    at, weights = at[there], item.weights[there]
    if not len(at):
        return 0
    rest = np.sqrt(np.append(np.cumsum((weights[::-1] ** 2).astype(float))[::-1], 0.0))
    by_coordinate = np.append(np.cumsum((weights * largest[at])[::-1].astype(float))[::-1], 0.0)
    bound = np.minimum(rest * top, by_coordinate) * SLACK
    taken = int(np.argmax(bound < need))  # the first place whose rest can't reach the threshold
    if not taken:
        return 0
    lo, hi = begins[at], begins[at + 1]
    size = hi - lo
    place = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    member, x = members[place], impacts[place].astype(np.int64)
    focus = int(size[:taken].sum())
    part = np.bincount(member[:focus], np.repeat(weights[:taken], size[:taken]) * x[:focus], minlength=len(docs))
    if taken < len(at):
        used = np.bincount(member[:focus], x[:focus].astype(float) ** 2, minlength=len(docs))
        own = np.sqrt(np.maximum(norms * norms - used, 0.0)) * rest[taken]
        alive = (part > 0) & ((part + np.minimum(own, by_coordinate[taken])) * SLACK >= need)
    else:
        alive = part >= need
    if not alive.any():
        return 0
    real = alive[member]
    score = np.zeros(len(docs), dtype=np.int64)
    np.add.at(score, member[real], np.repeat(weights, size)[real] * x[real])
    found = np.flatnonzero(score >= need)
    item.add(docs[found], score[found], most)
    return int(alive.sum())


def search(buckets: DataFrame, asked, thresholds: dict[int, int], most: int) -> DataFrame:
    """number, doc_id, score: the best documents of each task for each item in the broadcast ``asked``."""

    def of(batches):
        items = [Item(number, terms, weights, thresholds.get(number, 0)) for number, terms, weights in asked.value]
        for batch in batches:
            for i in range(len(batch)):
                top = batch.column(0)[i].as_py()
                docs, norms, terms, begins, members, impacts = (
                    np.frombuffer(batch.column(k)[i].as_buffer(), dtype=kind)
                    for k, kind in enumerate((np.int64, np.float64, np.int32, np.int64, np.int32, np.int32), start=1))
                largest = np.maximum.reduceat(impacts, begins[:-1]).astype(np.int64)
                for item in items:
                    search_bucket(item, top, docs, norms, terms, begins, members, impacts, largest, most)
        numbers = np.repeat([i.number for i in items], [len(i.docs) for i in items]).astype(np.int32)
        docs = np.concatenate([i.docs for i in items]) if items else np.zeros(0, np.int64)
        scores = np.concatenate([i.scores for i in items]) if items else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(docs, mask=docs == NO_ID), pa.array(scores)], names=["number", "doc_id", "score"])

    return buckets.mapInArrow(of, "number int, doc_id long, score long")


def best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows of each item with their ``rank``."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items (id, terms) that have terms, in lists of at most ``most`` bytes of text or one item."""
    rows, size = [], 0
    for row in items.select("item_id", F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        text = bytes(row.text or b"")
        terms = sorted(set(terms_of(text)))
        if not terms:
            continue
        if rows and size + len(text) > most:
            yield rows
            rows, size = [], 0
        rows.append((row.item_id, terms))
        size += len(text)
    if rows:
        yield rows


def _ranked(docs: DataFrame, rows: list[tuple], id_field: StructField, most: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    number = Numbers((t, i) for i, t in enumerate(sorted({t for _, terms in rows for t in terms})))
    counts = written(counted(docs, number), "counts")
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total.documents, total.length or 0
    df = np.zeros(len(number), dtype=np.int64)
    # No more rows than the block has terms.
    for term, holding in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = holding
    weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * df + 1))).astype(np.int64)
    asked = []
    for i, (_, terms) in enumerate(rows):
        ids = np.array([number[t] for t in terms], dtype=np.int64)
        ids = ids[(df[ids] > 0) & (weight[ids] > 0)]
        if len(ids):
            asked.append((i, ids.astype(np.int32), weight[ids]))
    shared = spark.sparkContext.broadcast(asked)
    buckets = written(bucketed(with_length(counts, documents, max(length, 1)), bucket), "impacts")
    head = buckets.orderBy(F.desc("top")).limit(HEAD)
    thresholds = {r.number: r.score for r in best(search(head, shared, {}, most), most).where(F.col("rank") == most).collect()}
    found = written(search(buckets, shared, thresholds, most), "found")
    names = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(rows)], StructType([StructField("number", IntegerType()), id_field]))
    made = written(best(found, most).join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"), "ranked")
    shared.unpersist()
    return made


def rank(docs: DataFrame, items: DataFrame, *, most: int = TOP, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``most`` best documents with a score above 0."""
    id_field = StructField("item_id", items.schema["item_id"].dataType)
    made = [_ranked(docs, rows, id_field, most, bucket) for rows in blocks(items, block)]
    if not made:
        return docs.sparkSession.createDataFrame([], StructType([id_field])).selectExpr(
            "item_id", "CAST(NULL AS INT) AS rank", "CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS LONG) AS score")
    return reduce(DataFrame.union, made)

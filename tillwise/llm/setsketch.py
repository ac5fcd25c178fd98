"""Near-duplicates by SetSketch registers: banded, estimated by likelihood, verified.

A text's set holds its distinct three-word shingles (A-Z lower-cased), as
64-bit hashes. Register ``i`` of its sketch is ``floor(1 - log_b(x))`` for the
least ``x`` of the set's hashes, each mapped to an exponential variable of rate
``RATE``, and held between 0 and 255: minima on an exponential scale, truncated
to a byte. The sketch of a union has the larger of both registers (``merged``).
Registers of two sets are equal with a probability of at least their
similarity J, and that grows with J.

1. Equal sets become one row: a digest of the set is its key.
2. ``BANDS`` times ``ROWS`` registers are a key each. Two sets at J = 0.85 share
   no key with a probability of about 1e-7.
3. Each bucket has a hub that meets all other members: the one whose buckets
   hold the most, so of edits of one page the page, or who is next to it. A pair
   goes on if the sizes allow the similarity and the likelihood of all
   registers, given both sizes, is greatest at ``PLAUSIBLE`` or above (seven
   standard deviations below 0.85). What is left is measured on the full sets;
   confirmed links give components. A large group of near copies is connected
   by now, and a bucket whose members are all of one component is done.
4. In other buckets members of different components meet. Where more than
   ``FEW`` are left, counts keep those apart that can't be similar: the sizes;
   the shingles of each that no other such text has; its other shingles that
   the hub lacks; and the hub's shingles that it lacks, counted in ``PARTS``
   parts by hash. The first, and the differences of the others, add up to no
   more than the distance of two texts. A text with more shingles of its own
   than any partner bears leaves at once.
   Pairs that are left go the way of step 3. So texts that edit one page in
   different places cost a comparison of numbers, which stays in the join.

Defined results: texts without words (null and empty too) have the empty set,
are linked with nothing and name their component themselves; with one or two
words the sequence is the one shingle; repeated rows are copies of each other;
a null id names a component only if it has no other, and is then kept; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.components import components
from tillwise.llm.textbatch import Run, U, blobs_of, mix, runs
from tillwise.llm.workspace import written

WORDS = 3
LEAST = 85  # per cent
BANDS, ROWS = 30, 6
BASE, RATE, TOP = 1.2, 20.0, 255
PLAUSIBLE = 0.65
FEW = 16
PARTS = 32

_random = np.random.default_rng(12)
FLIP = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | U(1)


def shingle_sets(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct shingles, ordered by both."""
    start, end = run.words()
    word = run.hasher(lower=True)(start, end)
    doc = run.doc_of(start)
    count = np.bincount(doc, minlength=len(run))
    whole = doc[WORDS - 1:] == doc[:len(doc) - WORDS + 1]
    chain = word[WORDS - 1:]
    for k in range(WORDS - 1, 0, -1):
        chain = mix(word[k - 1:k - 1 + len(chain)] * U(2 * k + 1) + chain)
    few = np.flatnonzero((count > 0) & (count < WORDS))
    first = np.searchsorted(doc, few)
    short = np.array([reduce(lambda h, w: int(mix(np.array([h ^ int(w)], dtype=U))[0]), word[f:f + n], n)
                      for f, n in zip(first.tolist(), count[few].tolist(), strict=True)], dtype=U)
    doc, made = np.concatenate([doc[WORDS - 1:][whole], few]), np.concatenate([chain[whole], short])
    order = np.lexsort((made, doc))
    doc, made = doc[order], made[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (made[1:] != made[:-1])
    return doc[fresh], made[fresh]


def registers(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The sketch of each of ``n`` texts, a row of bytes; empty sets stay 0."""
    made = np.zeros((n, len(FLIP)), dtype=np.uint8)
    if len(doc):
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        least = np.empty((len(cut), len(FLIP)))
        for i, (flip, times) in enumerate(zip(FLIP, TIMES, strict=True)):
            value = hashes ^ flip
            value *= times
            least[:, i] = np.minimum.reduceat(value, cut)
        # A uniform value in (0, 1) as an exponential one.
        x = -np.log1p(-(least + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
        made[doc[cut]] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return made


def likelihood_slope(j: np.ndarray, more: np.ndarray, less: np.ndarray, m: int, u: np.ndarray) -> np.ndarray:
    """The derivative by J of the log-likelihood of ``more`` larger and ``less`` smaller registers of ``m``.

    ``u`` is the first set's share of both sizes. The log-likelihood is concave.
    """
    v, c = 1 - u, (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-x * c) / np.log(BASE), c / (np.log(BASE) * (1 - x * c))

    (p, dp), (q, dq) = chance(np.maximum(u - v * j, 1e-12)), chance(np.maximum(v - u * j, 1e-12))
    same = np.maximum(1 - p - q, 1e-12)
    return (m - more - less) * (v * dp + u * dq) / same - more * v * dp / p - less * u * dq / q


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of pairs of sets that makes their registers likeliest, given their sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(40):
        j = (low + high) / 2
        up = likelihood_slope(j, more, less, a.shape[1], u) > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


def with_sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, text_hash and sketch of each row; key and sketch are null for empty sets."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    frame = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def of(batches):
        for batch in batches:
            keys, size, sketch = [], [], []
            for _, run in runs(blobs_of(batch.column(1))):
                doc, hashes = shingle_sets(run)
                cut = np.searchsorted(doc, np.arange(len(run) + 1))
                size.append(np.diff(cut))
                table = registers(doc, hashes, len(run))
                for d, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    keys.append(_digest(hashes[lo:hi]) if hi > lo else None)
                    sketch.append(table[d].tobytes() if hi > lo else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(keys, pa.binary()), pa.array(np.concatenate(size) if size else [], pa.int64()),
                batch.column(2), pa.array(sketch, pa.binary())],
                names=["doc_id", "key", "n_shingles", "text_hash", "sketch"])

    return frame.mapInArrow(of, f"doc_id {id_type}, key binary, n_shingles long, text_hash long, sketch binary")


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def merged(sketches: DataFrame, by: str) -> DataFrame:
    """``by``, ``registers``: the sketch of the union of each group's sets."""
    byte = F.expr("transform(sequence(1, length(sketch)), i -> cast(conv(hex(substring(sketch, i, 1)), 16, 10) as int))")
    each = sketches.where("sketch IS NOT NULL").select(by, F.posexplode(byte).alias("at", "value"))
    return each.groupBy(by, "at").agg(F.max("value").alias("value")).groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda r: r["value"]).alias("registers"))


def buckets(distinct: DataFrame) -> DataFrame:
    """bucket, key, n_shingles and count for every key of a band that ``count`` sets share, two or more."""
    bands = F.array(*[F.expr(f"substring(sketch, {i * ROWS + 1}, {ROWS})") for i in range(BANDS)])
    each = distinct.select("key", "n_shingles", F.posexplode(bands).alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "key", "n_shingles")
    shared = each.groupBy("bucket").count().where("count > 1")
    return each.join(shared, "bucket")


def _sizes_allow(a: Column, b: Column, least: int) -> Column:
    return 100 * F.least(a, b) >= least * F.greatest(a, b)


def _plausible(pairs: DataFrame, distinct: DataFrame, plausible: float) -> DataFrame:
    """The pairs whose estimate reaches ``plausible``."""
    one, two = (distinct.select(F.col("key").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def of(batches):
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
                        for c in (batch.column(4), batch.column(5)))
                found = estimate(a, b, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                yield batch.filter(pa.array(found >= plausible)).select([0, 1, 2, 3])

    return both.mapInArrow(of, "a binary, b binary, n_a long, n_b long")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and hashes of the wanted (key, at), each from one text."""
    places = wanted.select(F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"), F.col("key").alias("_key"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_of")).join(
        places, F.col("_of").eqNullSafe(F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "_key")

    def of(batches):
        for batch in batches:
            for at, run in runs(blobs_of(batch.column(0))):
                doc, hashes = shingle_sets(run)
                cut = np.searchsorted(doc, np.arange(len(run) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(run)), pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes.view(np.int64)))],
                    names=["key", "hashes"])

    return rows.mapInArrow(of, "key binary, hashes array<long>").groupBy("key").agg(F.first("hashes").alias("hashes"))


def _measured(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """The pairs with the number of shingles they have in common, and of those only ``a`` has, by part."""
    one, two = (sets.select(F.col("key").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    # Members first: the hub's set joins last and is not shuffled with each of them.
    both = pairs.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    if not parts:
        return both.select("a", "b", "n_a", "n_b", common.alias("common"))
    part = F.expr(f"transform(array_except(set_a, set_b), h -> cast(h & {parts - 1} AS int))")
    lost = F.expr(f"transform(sequence(0, {parts - 1}), p -> size(filter(part, q -> q = p)))")
    return both.withColumn("part", part).select("a", "b", "n_a", "n_b", common.alias("common"), lost.alias("lost"))


class _Sets:
    """Full sets, fetched once each."""

    def __init__(self, docs: DataFrame, distinct: DataFrame):
        self.docs, self.places, self.rows = docs, distinct.select("key", "at"), None

    def of(self, keys: DataFrame) -> DataFrame:
        """A table that has the sets of ``keys`` among others."""
        wanted = keys.distinct()
        if self.rows is not None:
            wanted = wanted.join(self.rows.select("key"), "key", "left_anti")
        fresh = written(_full_sets(self.docs, self.places.join(wanted, "key")), "sets")
        self.rows = fresh if self.rows is None else self.rows.union(fresh)
        return self.rows


def _similar(least: int) -> Column:
    common = F.col("common")
    return 100 * common >= least * (F.col("n_a") + F.col("n_b") - common)


def _looked_at(pairs: DataFrame, distinct: DataFrame, sets: _Sets, plausible: float, parts: int = 0) -> DataFrame:
    pairs = written(_plausible(written(pairs, "pairs"), distinct, plausible), "plausible")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key")))
    return written(_measured(pairs, sets.of(ends), parts), "measured")


def _alone(left: DataFrame, hubs: DataFrame, sets: _Sets, few: int) -> DataFrame:
    """key, alone: shingles that no other member of the larger buckets and none of their hubs has."""
    large = left.groupBy("bucket").count().where(F.col("count") > few).select("bucket")
    keys = written(left.join(large, "bucket").select("key").union(
        hubs.join(large, "bucket").select("hub_key")).distinct(), "large")
    each = sets.of(keys).join(keys, "key").select("key", F.explode("hashes").alias("hash"))
    once = each.groupBy("hash").agg(F.count("*").alias("holders"), F.first("key").alias("key")).where("holders = 1")
    counted = once.groupBy("key").agg(F.count("*").alias("alone"))
    return keys.join(counted, "key", "left").select("key", F.coalesce("alone", F.lit(0)).cast("long").alias("alone"))


def links(
    docs: DataFrame, distinct: DataFrame, least: int = LEAST, plausible: float = PLAUSIBLE, few: int = FEW
) -> DataFrame:
    """Confirmed links ``a``, ``b`` that connect all similar sets of ``distinct`` (key, n_shingles, sketch, at)."""
    alive = written(buckets(distinct), "buckets")
    sets = _Sets(docs, distinct)
    # Few rows in a bucket's turn: Spark keeps the first of each task before the shuffle.
    first = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("met"), "key"))
    degree = alive.groupBy("key").agg(F.sum("count").alias("met"))
    alive = alive.drop("count")
    hubs = written(alive.join(degree, "key").withColumn("turn", first).where("turn = 1").select(
        "bucket", F.col("key").alias("hub_key"), F.col("n_shingles").alias("hub_n")), "hubs")
    met = written(alive.join(hubs, "bucket").where("key != hub_key"), "met")
    stars = met.where(_sizes_allow(F.col("n_shingles"), F.col("hub_n"), least)).select(
        F.col("hub_key").alias("a"), F.col("key").alias("b"), F.col("hub_n").alias("n_a"),
        F.col("n_shingles").alias("n_b")).distinct()
    measured = _looked_at(stars, distinct, sets, plausible, PARTS)
    found = measured.where(_similar(least)).select("a", "b")
    label = written(components(found).select(F.col("node").alias("key"), F.col("component").alias("to")), "labels")

    # The hub has met everyone. What is left of a bucket matters if it has several components.
    named = met.join(label, "key", "left").withColumn("component", F.coalesce("to", "key")).drop("to")
    several = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    away = measured.select(F.col("a").alias("hub_key"), F.col("b").alias("key"),
                           (F.col("n_b") - F.col("common")).alias("own"), "lost")
    left = written(named.join(several, "bucket").join(away, ["hub_key", "key"], "left"), "left")
    if left.isEmpty():
        return found
    alone = written(_alone(left, hubs, sets, few), "alone")
    # Distance and sizes: similar if (100 + least) * distance <= (100 - least) * both sizes.
    widest = (100 - least) * (F.col("n_shingles") + F.floor(100 * F.col("n_shingles") / least))
    rest = left.join(alone, "key", "left").select(
        "bucket", "key", "n_shingles", "component", "own", "lost", F.coalesce("alone", F.lit(0)).alias("alone")).where(
        (100 + least) * F.col("alone") <= widest)
    rest = written(rest, "rest")
    one, two = rest.alias("x"), rest.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    apart = x("alone") + y("alone") + F.coalesce(
        F.abs((x("own") - x("alone")) - (y("own") - y("alone"))), F.lit(0))
    lost = F.coalesce(F.aggregate(
        F.zip_with(x("lost"), y("lost"), lambda p, q: F.abs(p - q)), F.lit(0), lambda total, d: total + d), F.lit(0))
    bears = (100 - least) * (x("n_shingles") + y("n_shingles"))
    pairs = one.join(two, F.col("x.bucket") == F.col("y.bucket")).where(
        (x("key") < y("key")) & (x("component") != y("component"))
        & _sizes_allow(x("n_shingles"), y("n_shingles"), least)
        & ((100 + least) * apart <= bears) & ((100 + least) * (apart + lost) <= bears))
    pairs = pairs.select(x("key").alias("a"), y("key").alias("b"), x("n_shingles").alias("n_a"),
                         y("n_shingles").alias("n_b")).distinct()
    return found.union(_looked_at(pairs, distinct, sets, plausible).where(_similar(least)).select("a", "b"))


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    prints = written(with_sketch(docs), "sketches")
    full = prints.where("key IS NOT NULL")
    distinct = written(full.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("at"),
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "distinct")
    label = components(links(docs, distinct, least)).select(F.col("node").alias("key"), F.col("component").alias("to"))
    named = distinct.select("key", "first_id").join(label, "key", "left").select(
        "key", "first_id", F.coalesce("to", "key").alias("component"))
    named = written(named, "named")
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = written(named.join(least_id, "component").select("key", "component_id"), "classes")
    rows = full.select("doc_id", "n_shingles", "key").join(classes, "key").select("doc_id", "n_shingles", "component_id")
    alone = prints.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

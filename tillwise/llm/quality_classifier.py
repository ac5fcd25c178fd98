"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

A text becomes a sparse vector over ``2 ** bits`` slots. Its tokens are the
runs of letters and digits, and the runs of other characters, of its words;
slots count single tokens and pairs of neighbours. A pair of equal tokens goes
to one slot of its own whatever the token, and so does each three-token string
seen earlier in the text: a token that says nothing about other texts still
tells that a text repeats itself. Vectors have length one.

``train`` fits a bounded sample of labelled rows (``sample`` rows, those with
the smallest hash of their id), one after the other, by follow-the-regularised-
leader updates with a learning rate for each slot. ``score`` is a dot product
per text in a pass over the table without a shuffle.

Defined results: null and empty texts have no slots and score by the intercept
alone; a null id or label is not learned from; several labels of one id count
as their smallest; of several texts of one id the one with the smallest hash
is learned from; with no label at all, or none of a kind, every score is the
share of label 1 (0.5 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.textbatch import LOWER, SPACE, Run, U, blobs_of, mix, runs

BITS = 18
SAMPLE = 16384
THRESHOLD = 0.7
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 2

# Space, letters and digits (with all of UTF-8 beyond ASCII), other characters.
KIND = np.full(256, 2, dtype=np.int8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[SPACE] = 0


def tokens(run: Run) -> tuple[np.ndarray, np.ndarray]:
    kind = KIND[run.buf]
    edge = np.flatnonzero(np.diff(kind, prepend=0))
    end = np.append(edge[1:], len(kind))
    real = kind[edge] > 0
    return edge[real], end[real]


def features(run: Run, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and value of all vectors' non-zero entries, ordered by text."""
    start, end = tokens(run)
    one = run.hasher(lower=True)(start, end)
    doc = run.doc_of(start)
    beside = doc[1:] == doc[:-1]
    two = mix(one[:-1] * U(3) + mix(one[1:]))
    two[one[:-1] == one[1:]] = U(0x5EED)
    three = mix(two[:-1] * U(5) + mix(one[2:]))
    whole = doc[2:] == doc[:-2]
    key = mix(three[whole] + doc[2:][whole].astype(U))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    seen = doc[2:][whole][again]
    slot = np.concatenate([one, two[beside], np.full(len(seen), U(0xA6A1))])
    slot = mix(slot) >> U(64 - bits)
    where = np.concatenate([doc, doc[:-1][beside], seen]).astype(U)
    key, count = np.unique((where << U(bits)) | slot, return_counts=True)
    doc, slot = (key >> U(bits)).astype(np.int64), (key & U((1 << bits) - 1)).astype(np.int64)
    norm = np.sqrt(np.bincount(doc, count.astype(float) ** 2, minlength=len(run)))
    return doc, slot, count / norm[doc]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int) -> np.ndarray:
    """Weights of all slots and, last, the intercept; follow the regularised leader."""
    labels = np.array([y for *_, y in rows], dtype=float)
    share = labels.mean() if len(labels) else 0.5
    weights = np.zeros((1 << bits) + 1)
    if share in (0.0, 1.0):
        weights[-1] = 0.0 if not len(labels) else (20.0 if share else -20.0)
        return weights
    n = np.zeros(1 << bits)
    z = np.zeros(1 << bits)
    bias, bias_n = np.log(share / (1 - share)), 1.0
    for _ in range(EPOCHS):
        for slot, x, y in rows:
            zi, ni = z[slot], n[slot]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            more = ni + g * g
            z[slot] = zi + g - (np.sqrt(more) - root) / ALPHA * w
            n[slot] = more
            bias_n += (p - y) ** 2
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * (p - y)
    weights[:-1] = np.where(
        np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    weights[-1] = bias
    return weights


def held_out(doc_id: Column) -> Column:
    """The rows kept for testing: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE,
    bits: int = BITS,
) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows that are not held out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("_y"))
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(sample)
    )
    texts = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"]).select(
        "_order", "_id", "_y", "text", F.xxhash64("text").alias("_text"))

    def vectors(batches):
        for batch in batches:
            for at, run in runs(blobs_of(batch.column(3))):
                doc, slot, value = features(run, bits)
                cut = np.searchsorted(doc, np.arange(len(run) + 1))
                part = batch.slice(at, len(run))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), part.column(4),
                    pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(slot.astype(np.int32))),
                    pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(value)),
                ], names=["_order", "_id", "_y", "_text", "slot", "value"])

    def learn(frames):
        rows = pd.concat([pd.DataFrame(columns=["_order", "_id", "_y", "_text", "slot", "value"]), *frames])
        rows = rows.sort_values(["_order", "_id", "_text"]).drop_duplicates("_id")
        weights = fit(list(zip(rows["slot"], rows["value"], rows["_y"], strict=True)), bits)
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    id_type = labels.schema["doc_id"].dataType.simpleString()
    sparse = texts.mapInArrow(
        vectors, f"_order long, _id {id_type}, _y int, _text long, slot array<int>, value array<double>")
    made = sparse.repartition(1).mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(made[0][0], dtype=np.float32) if made else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (with a ``text``) with a ``score`` from 0 to 1 added or replaced."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c.lower() != "score"]
    at_text = kept.index("text")

    def dots(batches):
        w = shared.value
        for batch in batches:
            out = []
            for _, run in runs(blobs_of(batch.column(at_text))):
                doc, slot, value = features(run, bits)
                dot = np.bincount(doc, w[slot] * value, minlength=len(run)) + w[-1]
                out.append(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))
            made = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made)], names=[*batch.schema.names, "score"])

    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    from pyspark.sql.types import DoubleType, StructField, StructType

    return frame.mapInArrow(dots, StructType([*frame.schema.fields, StructField("score", DoubleType())]))

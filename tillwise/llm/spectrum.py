"""Embedding whitening: leading components by spectrum slicing.

Entries are taken as ``x = floor(64 * c) + 1000000``. Spark adds up counts,
sums (exact) and, after centring, products of entries: one partial matrix per
task, added by row. The covariance, as large as the dimension squared whatever
the number of vectors, comes to the driver, which finds its leading
eigenvectors:

1. ``above`` counts the eigenvalues over a shift: the positive pivots of an
   LDL' factorisation (Bunch-Kaufman pivots) of the shifted covariance.
2. Shifts are halved until each leading eigenvalue is alone between two.
3. Rayleigh quotient iteration, begun by inverse iteration at the middle of
   the slice, converges cubically to it; should it leave the slice, the slice
   is halved and it begins anew. Vectors are kept orthogonal to those found.
4. Counts between neighbouring eigenvalues certify that the k-th found is the
   k-th. Eigenvalues too close to part get a common orthonormal basis.

Whitening is a pass over the vectors; the whitened vectors' covariance is added
up in the same way and its distance from the identity is a column.

Defined results: vectors that are null, empty or hold null or non-finite
entries go; so do those of another length than most have (the longer of equally
frequent ones stays); entries beyond 2 ** 40 are held there; a deviation beyond
a long is null; repeated rows count each and null ids are kept; components with
less than ``FLAT`` of the variance are none (so equal vectors, one vector or an
empty table give no rows); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 32
FLAT = 1e-11
SCALE, SHIFT, HELD = 64.0, 1_000_000, 1 << 40
ALPHA = (1 + 17**0.5) / 8
ROUNDS = 60


# --- the spectrum, on the driver -------------------------------------------------------------

def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` are over ``shift``."""
    a = v - shift * np.eye(len(v))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        own, two = abs(a[k, k]), False
        if k + 1 < n:
            r = k + 1 + int(np.abs(a[k + 1:, k]).argmax())
            largest = abs(a[r, k])
            if own < ALPHA * largest:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if own * row.max() < ALPHA * largest * largest:
                    if abs(a[r, r]) >= ALPHA * row.max():
                        swap(k, r)
                    else:
                        two = True
                        swap(k + 1, r)
        if two:
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            positive += 1 if det < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot, rest = a[k, k], a[k + 1:, k].copy()
            positive += pivot > 0
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(rest, rest / pivot)
            k += 1
    return int(positive)


class Slices:
    """Shifts with the number of eigenvalues over them."""

    def __init__(self, v: np.ndarray):
        self.v, self.norm = v, float(np.abs(v).sum(axis=1).max(initial=0.0))
        self.known = {-1.01 * self.norm: len(v), 1.01 * self.norm: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = above(self.v, shift)
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The nearest known shifts below and above the k-th largest eigenvalue."""
        return (max(s for s, c in self.known.items() if c >= k), min(s for s, c in self.known.items() if c < k))

    def isolate(self, k: int) -> tuple[float, float, int]:
        """A slice with the k-th eigenvalue and how many it holds: 1, unless they can't be told apart."""
        close = 4 * len(self.v) * np.finfo(float).eps * self.norm
        while True:
            low, high = self.around(k)
            held = self.known[low] - self.known[high]
            if held == 1 or high - low <= close:
                return low, high, held
            self.count((low + high) / 2)


def _solve(v: np.ndarray, shift: float, block: np.ndarray, norm: float) -> np.ndarray:
    """``block`` by inverse iteration; a shift that is an eigenvalue is moved by a rounding error."""
    for off in (0.0, 1.0, -3.0):
        try:
            made = np.linalg.solve(v - (shift + off * np.finfo(float).eps * norm) * np.eye(len(v)), block)
            if np.isfinite(made).all():
                return made
        except np.linalg.LinAlgError:
            pass
    return block


def _apart(block: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``block`` orthonormal, and orthogonal to the columns ``found``."""
    for _ in range(2):
        block = np.linalg.qr(block - found @ (found.T @ block))[0]
    return block


def quotient_iteration(v: np.ndarray, low: float, high: float, found: np.ndarray, norm: float, seed: int) -> tuple[float, np.ndarray, list[float]] | None:
    """Eigenvalue and vector in (low, high), with the residuals on the way; None if it leaves the slice."""
    x = _apart(np.random.default_rng(seed).standard_normal((len(v), 1)), found)
    for _ in range(2):
        x = _apart(_solve(v, (low + high) / 2, x, norm), found)
    residuals: list[float] = []
    while True:
        value = float((x.T @ v @ x).item())
        residuals.append(float(np.linalg.norm(v @ x - value * x)))
        if residuals[-1] <= 4 * len(v) * np.finfo(float).eps * norm:
            return (value, x[:, 0], residuals) if low <= value <= high else None
        if len(residuals) > 12:
            return None
        x = _apart(_solve(v, value, x, norm), found)


def leading(v: np.ndarray, most: int = MOST, flat: float = FLAT) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their vectors as columns."""
    d, total = len(v), float(np.trace(v))
    values: list[float] = []
    found = np.zeros((d, 0))
    slices = Slices(v)
    while total > 0 and len(values) < min(most, d):
        k = len(values) + 1
        if slices.count(flat * total) < k:
            break
        for attempt in range(ROUNDS):
            low, high, held = slices.isolate(k)
            got = quotient_iteration(v, low, high, found, slices.norm, k + attempt) if held == 1 else None
            if got or held > 1 or high - low <= np.finfo(float).eps * slices.norm:
                break
            slices.count((low + high) / 2)
        if got:
            values.append(got[0])
            found = np.column_stack([found, got[1]])
            continue
        # Beyond telling apart: any orthonormal basis of the space they share.
        block = _apart(np.random.default_rng(k).standard_normal((d, held)), found)
        for _ in range(4):
            block = _apart(_solve(v, (low + high) / 2, block, slices.norm), found)
        each = np.einsum("ij,ij->j", block, v @ block)
        order = np.argsort(-each)
        values.extend(each[order].tolist())
        found = np.column_stack([found, block[:, order]])
    values, found = np.array(values[:most]), found[:, :most]
    apart = 16 * d * np.finfo(float).eps * slices.norm
    for k in range(1, len(values)):
        if values[k - 1] - values[k] > apart and slices.count((values[k - 1] + values[k]) / 2) != k:
            raise ArithmeticError(f"eigenvalue {k} is not the {k}-th largest")
    return values, found


# --- sums over all vectors, on Spark ---------------------------------------------------------

def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that remain, and their entries as longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fits)).flatten()
    bad = np.repeat(False, len(flat)) if not flat.null_count else flat.is_null().to_numpy(zero_copy_only=False)
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    ok = (np.isfinite(c) & ~bad.reshape(-1, d)).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(c[ok] * SCALE), -float(HELD), float(HELD)).astype(np.int64) + SHIFT
    return fits[ok], x


def dimension(rows: DataFrame, column: str) -> int:
    """The length most vectors have; 0 if there is none."""
    whole = F.col(column).isNotNull() & F.forall(
        column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    first = rows.where(whole & (F.size(column) > 0)).groupBy(F.size(column).alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).limit(1).collect()
    return first[0].d if first else 0


Entries = Callable[[pa.Array], np.ndarray]


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each entry."""

    def of(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            _, x = matrix(batch.column(1), d)
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([str(v) for v in (n, *sums)]), pa.array(range(d + 1), pa.int32())], names=["value", "at"])

    parts = vectors.mapInArrow(of, "value string, at int")
    got = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {r["at"]: int(r["value"]) for r in got}
    return by.get(0, 0), [by.get(i + 1, 0) for i in range(d)]


def _added(vectors: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int) -> np.ndarray:
    """The sum over tasks of ``part``'s matrix of so many rows; each row is added in one place, by task."""

    def of(batches):
        made = part(batches)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(rows), pa.int32()), pa.array([TaskContext.get().partitionId()] * rows, pa.int32()),
            pa.array([r.tobytes() for r in made], pa.binary())], names=["at", "task", "part"])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                row = np.frombuffer(data, dtype=np.float64)
                if i == at:
                    total = total + row
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "sum"])
                at, total = i, row
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "sum"])

    sums = vectors.mapInArrow(of, "at int, task int, part binary").repartition("at").sortWithinPartitions(
        "at", "task").mapInArrow(add, "at int, sum binary").collect()
    return np.array([np.frombuffer(r["sum"], dtype=np.float64) for r in sorted(sums, key=lambda r: r["at"])])


def covariance(vectors: DataFrame, n: int, mean: np.ndarray, entries: Entries) -> np.ndarray:
    """Covariance of ``entries`` of all vectors, centred first."""
    k = len(mean)

    def part(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = entries(batch.column(1)) - mean
            total += y.T @ y
        return total

    made = _added(vectors, part, k) / n
    return (made + made.T) / 2


def mean_of(vectors: DataFrame, n: int, entries: Entries, k: int) -> np.ndarray:

    def part(batches):
        total = np.zeros((1, k))
        for batch in batches:
            total[0] += entries(batch.column(1)).sum(axis=0)
        return total

    return _added(vectors, part, 1)[0] / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over entries of (n * x - S) ** 2 of each row, exact."""
    if not len(x):
        return []
    s = np.array(sums, dtype=object)
    widest = max(abs(n * int(x.max())) + max(map(abs, sums)), abs(n * int(x.min())) + max(map(abs, sums)))
    if widest < 1 << 62 and len(sums) * widest**2 < 1 << 63:
        return ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    # Entries in a row may be far smaller than that bound: only longer integers tell.
    far = n * x.astype(object) - s
    return [v if v < 1 << 63 else None for v in map(int, (far * far).sum(axis=1))]


def whiten(rows: DataFrame, *, key: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """Per remaining row and component: key, component, n, deviation, whitened, explained, identity_error."""
    id_type = rows.schema[key].dataType.simpleString()
    vectors = rows.select(key, column)
    d = dimension(vectors, column)
    n, sums = exact_sums(vectors, d) if d else (0, [])
    values, directions = np.zeros(0), np.zeros((d, 0))
    if n:
        mean = np.array([s / n for s in sums])
        v = covariance(vectors, n, mean, lambda c: matrix(c, d)[1])
        values, directions = leading(v, most)
    k = len(values)
    whole = np.array(sums, dtype=object)

    def centred(x: np.ndarray) -> np.ndarray:
        """x - S / n with the difference taken before the division where it fits."""
        if n * (abs(int(x.max(initial=0))) + abs(int(x.min(initial=0)))) < 1 << 62:
            return (n * x - whole.astype(np.int64)) / n
        return x - mean

    def white(column: pa.Array) -> np.ndarray:
        return centred(matrix(column, d)[1]) @ directions / np.sqrt(values)

    error = 0.0
    if k:
        off = covariance(vectors, n, mean_of(vectors, n, white, k), white) - np.eye(k)
        error = float(np.abs(off).max())

    def of(batches):
        for batch in batches:
            kept, x = matrix(batch.column(1), d) if k else (np.zeros(0, np.int64), np.zeros((0, d), np.int64))
            z = centred(x) @ directions / np.sqrt(values) if k else np.zeros((0, 0))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(kept)), pa.array(deviations(x, n, sums), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(z).ravel(), pa.float64()))],
                names=[key, "deviation", "whitened"])

    total = float(np.trace(v)) if k else 1.0
    share = F.array(*[F.lit(float(e / total)) for e in values]) if k else F.array(F.lit(0.0))
    return vectors.mapInArrow(of, f"`{key}` {id_type}, deviation long, whitened array<double>").select(
        key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))

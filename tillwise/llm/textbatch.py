"""Whole texts as numpy arrays of bytes: words, lines and hashes of spans.

Python tasks get Arrow batches; the helpers cut them into runs of at most
``BYTES`` bytes (or one longer text), so memory is bounded by the longest text
and not by the batch. Every array operation covers all texts of a run at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))

# The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[U, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base ** 0..n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, BYTES) * 5 // 4 + 1, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have if len(have) < 1 << 23 else have[: 1 << 23]
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Run:
    """Some texts side by side, each followed by one line break."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs
        self.buf = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
        self.length = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs))
        self.end = np.cumsum(self.length + 1) - 1
        self.start = self.end - self.length
        self._sums: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.blobs)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="left")

    def sums(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Per text, the number (or the weights' sum) of the positions ``at``."""
        return np.bincount(self.doc_of(at), weights, minlength=len(self))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word; no word crosses a text."""
        inside = np.zeros(len(self.buf) + 1, dtype=np.int8)
        inside[1:] = ~SPACE[self.buf]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each line, the texts' own ends included."""
        end = np.flatnonzero(self.buf == 10)
        return np.concatenate(([0], end[:-1] + 1)), end

    def _prefix(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums of bytes times powers, and the powers that undo the place of a span."""
        if lower not in self._sums:
            data = (LOWER[self.buf] if lower else self.buf).astype(U)
            n = len(data)
            data += U(1)
            data *= powers(BASE, n)[:n]
            prefix = np.zeros(n + 1, dtype=U)
            np.cumsum(data, out=prefix[1:])
            self._sums[lower] = prefix, powers(INVERSE, n)
        return self._sums[lower]

    def hasher(self, lower: bool = False):
        """A function of span starts and ends that gives equal spans equal hashes."""
        prefix, back = self._prefix(lower)

        def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(U))

        return of

    def rolling(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes at each place, as ``hasher`` gives it."""
        prefix, back = self._prefix(False)
        made = prefix[width:] - prefix[:-width]
        made *= back[:len(made)]
        made += U(width)
        return mix(made)


def blobs_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def runs(blobs: list[bytes], most: int = BYTES) -> Iterator[tuple[int, Run]]:
    """The texts in runs of at most ``most`` bytes, each with its first index."""
    at = 0
    while at < len(blobs):
        size, to = 0, at
        while to < len(blobs) and (to == at or size + len(blobs[to]) <= most):
            size += len(blobs[to]) + 1
            to += 1
        yield at, Run(blobs[at:to])
        at = to

"""Exact substring dedup by a collection's Burrows-Wheeler transform and LCP array.

Every byte of a ``WIDTH``-byte string that also starts elsewhere is removed.

**Construction.** ``transform`` builds the transform and the common prefixes of
a collection column by column: round ``j`` inserts, for each document of the
collection at once, the suffix of length ``j``. Where it goes follows from the
transform so far: the places of a symbol in it are, in
order, the suffixes that start with that symbol. The same order gives the
common prefix with both neighbours as one more than the least on the way from
one place of the symbol to the next. Here the rounds don't read front to back:
a block is small enough to keep the transform as arrays in the task's memory,
and places are found by binary search in them.

**What goes into a collection.** All strings of ``WIDTH`` bytes with the same
content share their least ``GRAM``-byte hash (leftmost of equals). A text is cut
into pieces of neighbouring strings with one such minimiser; equal strings are
always in different pieces under the same minimiser. A piece under a minimiser
found once in all texts holds no repeat and goes no further. Equal pieces are
counted and kept once. The pieces under one minimiser are in one collection;
a task fills its collections from whole minimisers up to ``BLOCK`` bytes. A
minimiser with more than ``HOT`` different pieces isn't gathered: its pieces are
cut once more, into single strings, that are counted by a shuffle.

Texts are keyed by a 64-bit hash and every piece is checked against its text by
a second one, so equal texts share their work and a collision has no effect.

Defined results: null and empty texts have nothing to remove and keep the empty
string's hash; texts shorter than ``WIDTH`` stay whole; repeated rows, equal
texts included, cover each other wholly; null ids are carried; an empty table
gives no rows; other columns are not read.

Equal pieces, and minimisers above ``HOT``, are decided by counting hashes, not
by the transform.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.textbatch import Run, U, blobs_of, runs
from tillwise.llm.workspace import written

WIDTH = 200
GRAM = 64
BLOCK = 160 << 10
HOT = 1 << 14
CHUNK = 1 << 20
PLACE = U((1 << 21) - 1)


def transform(pieces: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, common prefixes (up to ``most``) with the suffix before, document and suffix length.

    Symbols are numbered from 1 by byte value; 0 ends a document, before all others.
    """
    m = len(pieces)
    length = np.array([len(p) for p in pieces])
    rounds = int(length.max(initial=0))
    # Column j holds the symbol before the suffix of length j, column by column in memory.
    before = np.zeros((rounds + 1, m), dtype=np.uint8)
    values = np.unique(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    number = np.zeros(256, dtype=np.uint8)
    number[values] = np.arange(1, len(values) + 1)
    for d, piece in enumerate(pieces):
        before[:len(piece), d] = number[np.frombuffer(piece, dtype=np.uint8)[::-1]]
    small = np.uint8 if most < 256 else np.int32
    symbol, lcp = before[0].copy(), np.zeros(m, dtype=small)
    entry = np.arange(m, dtype=np.int32)
    newest = np.arange(m)
    # Of each suffix but the empty ones, by their order: the place of its first symbol in the transform.
    source = np.zeros(0, dtype=np.int64)
    begun = np.zeros(257, dtype=np.int64)  # suffixes by first symbol, counted one symbol up
    for j in range(1, rounds + 1):
        who = np.flatnonzero(length >= j)
        first, at = before[j - 1, who], newest[who]
        order = np.argsort(first.astype(np.int64) << 32 | at)
        who, first, at = who[order], first[order], at[order]
        # Suffixes with one first symbol stand in the order of their symbol's places: how many of them
        # come before is where the place belongs among those.
        begin = m + np.cumsum(begun)
        block, end = begin[first], begin[first] + begun[first.astype(np.int64) + 1]
        low = block.copy()
        cut = np.append(np.flatnonzero(np.diff(first, prepend=first[0] + 1)), len(first)).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            low[a:b] += source[block[a] - m:end[a] - m].searchsorted(at[a:b])
        place = low + np.arange(len(who))
        beside = first[1:] == first[:-1]
        left = np.where(low > block, source[low - 1 - m] if len(source) else -1, -1)
        left[1:] = np.maximum(left[1:], np.where(beside, at[:-1], -1))
        right = np.where(low < end, source[np.minimum(low - m, len(source) - 1)] if len(source) else -1, -1)
        # Common prefixes: of the suffix with the one before, and of an old one that comes right after it.
        after = right >= 0
        after[:-1] &= ~(beside & (at[1:] < right[:-1]))
        lows, highs = np.concatenate([left[left >= 0], at[after]]), np.concatenate([at[left >= 0], right[after]])
        shared = _least(lcp, lows, highs, most, small)
        own = np.zeros(len(who), dtype=small)
        own[left >= 0] = shared[:np.count_nonzero(left >= 0)]
        lcp[low[after]] = shared[np.count_nonzero(left >= 0):]
        kept = np.ones(len(symbol) + len(who), bool)
        kept[place] = False
        symbol = _merged(kept, place, symbol, before[j, who])
        lcp = _merged(kept, place, lcp, own)
        entry = _merged(kept, place, entry, j * m + who)
        moved = np.flatnonzero(kept)
        source = _merged(kept[m:], place - m, moved.take(source, mode="clip"), moved[at])
        newest[who] = place
        begun[1:] += np.bincount(first, minlength=256)
    return symbol, lcp, entry % m if m else entry, entry // m if m else entry


def _merged(kept: np.ndarray, place: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    made = np.empty(len(kept), dtype=old.dtype)
    made[kept] = old
    made[place] = new
    return made


def _least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, small: type) -> np.ndarray:
    """One more than the least common prefix in low + 1..high, at most ``most``."""
    made = np.zeros(len(low), dtype=small)
    if len(low):
        order = np.argsort(low, kind="stable")
        ends = np.empty(2 * len(low), dtype=np.int64)
        ends[0::2], ends[1::2] = low[order] + 1, high[order] + 1
        least = np.minimum.reduceat(np.append(lcp, small(0)), ends)[0::2]
        made[order] = np.minimum(least, most - 1) + small(1)
    return made


def repeated(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece and start of each ``width``-byte string that starts at two or more places."""
    _, lcp, piece, suffix = transform(pieces, width)
    full = lcp >= width
    at = np.flatnonzero(full | np.append(full[1:], False))
    start = np.array([len(p) for p in pieces])[piece[at]] - suffix[at]
    order = np.lexsort((start, piece[at]))
    return piece[at][order], start[order]


def pieces_of(blobs: list[bytes], width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, start, number of strings, minimiser and content hash of each piece, part by part."""
    parts = [(i, at, blob[at:at + CHUNK + width - 1]) for i, blob in enumerate(blobs)
             for at in range(0, max(len(blob) - width + 1, 0), CHUNK)]
    for first, run in runs([p[2] for p in parts], CHUNK):
        hashed = run.hasher()
        key = run.rolling(gram)
        # Least hash first, leftmost of equals: the place is in the low bits.
        least = key & ~PLACE
        least |= np.arange(len(key), dtype=U)
        span, wide = width - gram + 1, 1
        while wide * 2 <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < span:
            least = np.minimum(least[:len(least) - (span - wide)], least[span - wide:])
        place = (least & PLACE).view(np.int64)
        # Strings start at run.start up to end - width, in each text of the run.
        count = run.length - width + 1
        doc = np.repeat(np.arange(len(run)), count)
        start = np.repeat(run.start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        by_string = place[start]
        cut = np.flatnonzero(np.concatenate(
            ([True], (by_string[1:] != by_string[:-1]) | (doc[1:] != doc[:-1])))) if len(start) else start
        number = np.diff(np.append(cut, len(start)))
        origin = start[cut]
        base = np.array([p[1] for p in parts[first:first + len(run)]])
        text = np.array([p[0] for p in parts[first:first + len(run)]])
        yield (text[doc[cut]], origin - run.start[doc[cut]] + base[doc[cut]], number,
               key[place[origin]].view(np.int64), hashed(origin, origin + number + width - 1).view(np.int64))


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _pieces(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """minimiser, content, key, at (start and number of strings in one long) of (key, text)."""

    def of(batches):
        for batch in batches:
            keys = batch.column(0)
            for text, start, number, minimiser, content in pieces_of(blobs_of(batch.column(1)), width, gram):
                yield pa.RecordBatch.from_arrays([
                    pa.array(minimiser), pa.array(content), keys.take(pa.array(text)), pa.array(start << 16 | number)],
                    names=["minimiser", "content", "key", "at"])

    return texts.mapInArrow(of, "minimiser long, content long, key long, at long")


def _checked(run: Run, doc: int, at: int, content: int, width: int, hashed) -> tuple[int, int] | None:
    """Start and number of a piece, if the text has that piece there."""
    start, number = at >> 16, at & 0xFFFF
    size = number + width - 1
    if start + size > run.length[doc]:
        return None
    lo = np.array([run.start[doc] + start])
    return (start, number) if hashed(lo, lo + size).view(np.int64)[0] == content else None


def _extract(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """minimiser, content, hot and bytes of the wanted (key, at, minimiser, content, hot)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "minimiser", "content", "hot")).alias("wanted"))

    def of(batches):
        last = None
        for batch in batches:
            # The join leaves equal keys side by side: of a text with many copies one is enough.
            keys = batch.column(2).to_numpy()
            fresh = np.append(keys[:1] != last, keys[1:] != keys[:-1]) if len(keys) else keys.astype(bool)
            last = keys[-1] if len(keys) else last
            batch = batch.filter(pa.array(fresh))
            blobs, seen = blobs_of(batch.column(0)), set()
            lists = batch.column(1).to_pylist()
            for base, run in runs(blobs):
                hashed = run.hasher()
                rows = []
                for d in range(len(run)):
                    for w in lists[base + d]:
                        if (w["minimiser"], w["content"]) in seen:
                            continue
                        got = _checked(run, d, w["at"], w["content"], width, hashed)
                        if got:
                            seen.add((w["minimiser"], w["content"]))
                            rows.append((w["minimiser"], w["content"], w["hot"], run.blobs[d][got[0]:got[0] + got[1] + width - 1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
                        names=["minimiser", "content", "hot", "bytes"])

    return texts.join(lists, "key").select("text", "wanted", "key").mapInArrow(
        of, "minimiser long, content long, hot boolean, bytes binary")


def _ranges(start: np.ndarray) -> list[int]:
    """Sorted places as from, to, from, to, ..."""
    edge = np.flatnonzero(np.diff(start, prepend=-2) != 1)
    last = np.append(edge[1:], len(start)) - 1
    return np.column_stack([start[edge], start[last] + 1]).ravel().tolist()


RANGES = "minimiser long, content long, ranges array<int>"


def _by_collection(pieces: DataFrame, width: int, block: int) -> DataFrame:
    """The repeated strings of each piece, from collections of whole minimisers."""

    def of(batches):
        waiting: list[tuple[int, int, bytes]] = []

        def solved():
            piece, start = repeated([w[2] for w in waiting], width)
            cut = np.searchsorted(piece, np.arange(len(waiting) + 1))
            rows = [(*w[:2], _ranges(start[a:b])) for w, a, b in zip(waiting, cut[:-1], cut[1:], strict=True) if b > a]
            return pa.RecordBatch.from_arrays([
                pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                names=["minimiser", "content", "ranges"])

        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is not None and row[:2] == last[:2]:
                    continue
                if size >= block and row[0] != last[0]:
                    yield solved()
                    waiting, size = [], 0
                waiting.append(row)
                size, last = size + len(row[2]), row
        if waiting:
            yield solved()

    return pieces.select("minimiser", "content", "bytes").repartition("minimiser").sortWithinPartitions(
        "minimiser", "content").mapInArrow(of, RANGES)


def _by_string(pieces: DataFrame, width: int) -> DataFrame:
    """The same for minimisers with too many pieces for one task: single strings, counted."""

    def of(batches):
        for batch in batches:
            for first, run in runs([b for b in batch.column(2).to_pylist()]):
                number = run.length - width + 1
                doc = np.repeat(np.arange(len(run)), number)
                start = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                origin = run.start[doc] + start
                two = mixed(run, origin, width)
                part = batch.slice(first, len(run))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(two)],
                    names=["minimiser", "content", "start", "string"])

    strings = written(pieces.select("minimiser", "content", "bytes").dropDuplicates(["minimiser", "content"]).mapInArrow(
        of, "minimiser long, content long, start int, string long"), "strings")
    often = strings.groupBy("minimiser", "string").count().where("count > 1").drop("count")
    found = strings.join(often, ["minimiser", "string"]).groupBy("minimiser", "content").agg(
        F.array_sort(F.collect_list("start")).alias("starts"))
    return found.select("minimiser", "content", F.flatten(F.transform("starts", lambda s: F.array(s, s + 1))).alias("ranges"))


def mixed(run: Run, start: np.ndarray, width: int) -> np.ndarray:
    return run.hasher()(start, start + width).view(np.int64)


def _flat(found: pa.Array) -> tuple[np.ndarray, ...]:
    """A column of pieces as arrays: whose, at, content, and where the ranges of each lie in the last (-1: none)."""
    rows = pc.list_parent_indices(found).to_numpy()
    pieces = found.flatten()
    ranges = pieces.field("ranges")
    size = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy().astype(np.int64)
    none = pc.is_null(ranges).to_numpy(zero_copy_only=False)
    last = np.cumsum(size)
    first = np.where(none, -1, last - size)
    return (rows, pieces.field("at").to_numpy(), pieces.field("content").to_numpy(), first,
            np.where(none, -1, last), ranges.flatten().to_numpy().astype(np.int64))


def repeats(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``key`` and ``found``: the pieces of (key, text) with repeated strings, each with its start and
    number, content hash and ranges of repeated strings (null: all of them)."""
    pieces = _pieces(texts, width, gram)
    # Written, so that the join deals out both sides itself and can split a common minimiser.
    shared = written(pieces.groupBy("minimiser").count().where("count > 1").select("minimiser"), "shared")
    places = written(pieces.join(shared, "minimiser"), "places")
    each = written(places.groupBy("minimiser", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "at")).alias("one")), "pieces")
    several = each.groupBy("minimiser").agg(F.count("*").alias("different")).where("different > 1")
    wanted = each.join(several, "minimiser").select(
        "one.*", "minimiser", "content", (F.col("different") > hot).alias("hot"))
    extracted = written(_extract(texts, wanted, width), "extracted")
    ranges = _by_collection(extracted.where("NOT hot"), width, block).union(_by_string(extracted.where("hot"), width))
    # A piece found twice is repeated as a whole, whatever its collection says.
    marked = each.where("copies > 1").select("minimiser", "content", F.lit(None).cast("array<int>").alias("ranges")).union(
        ranges.join(each.where("copies = 1").select("minimiser", "content"), ["minimiser", "content"]))
    return places.join(marked, ["minimiser", "content"]).groupBy("key").agg(
        F.collect_set(F.struct("at", "content", "ranges")).alias("found"))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (from, to, ... in bytes) per document."""
    texts = docs.select(_key(F.col("text")).alias("key"), "text")
    found = repeats(texts, width, gram, block, hot)
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"), "text").join(found, "key", "left").select(
        "doc_id", "text", "found")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def of(batches):
        for batch in batches:
            out, whose, at, content, first, last, bounds = [], *_flat(batch.column(2))
            for base, run in runs(blobs_of(batch.column(1))):
                lo, hi = np.searchsorted(whose, [base, base + len(run)])
                doc, start, number = whose[lo:hi] - base, at[lo:hi] >> 16, at[lo:hi] & 0xFFFF
                origin, size = run.start[doc] + start, number + width - 1
                real = np.flatnonzero(origin + size <= run.end[doc])
                if len(real):
                    same = run.hasher()(origin[real], (origin + size)[real]).view(np.int64) == content[lo:hi][real]
                    real = real[same]
                step = np.zeros(len(run.buf) + 1, dtype=np.int64)
                whole = real[first[lo:hi][real] < 0]
                part = real[first[lo:hi][real] >= 0]
                np.add.at(step, origin[whole], 1)
                np.add.at(step, (origin + size)[whole], -1)
                n = (last - first)[lo:hi][part] // 2
                index = np.repeat(first[lo:hi][part] - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
                np.add.at(step, np.repeat(origin[part], n) + bounds[index], 1)
                np.add.at(step, np.repeat(origin[part], n) + bounds[index + 1] + width - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0))
                cut = np.searchsorted(edge, np.append(run.start, len(run.buf)))
                for d, blob in enumerate(run.blobs):
                    own = edge[cut[d]:cut[d + 1]] - run.start[d]
                    removed = int((own[1::2] - own[::2]).sum())
                    kept = np.frombuffer(blob, dtype=np.uint8)[~gone[run.start[d]:run.end[d]]].tobytes() if removed else blob
                    out.append((len(blob), removed, len(own) // 2, hashlib.sha256(kept).hexdigest(), own))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.mapInArrow(
        of, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")

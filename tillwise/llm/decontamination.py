"""Benchmark decontamination: n-gram seeds, Smith-Waterman alignment.

Test items are cut into segments of at most ``SEGMENT`` tokens (runs of
letters and digits, A-Z in lower case), half overlapping. Every text's n-grams
are looked up among the items' n-grams; each that is found joins the text to the
segment at a diagonal, so a copy is found if one n-gram of it is left whole. Seeds
on near diagonals share one window of the text, which reaches as far as an
alignment through them can with the score of a leak. A window that holds too few
of the segment's words for that score is left out, so common phrases cost a count
of words and no alignment. (At a ``spread`` above 1 only the rarest of as many
neighbouring n-grams found in any text is a seed; that is cheaper and loses copies
whose own n-grams are less rare than their neighbours in other texts.) The window
and the segment are aligned word by word
(match 2, mismatch -1, gap -1). A score of ``LEAST`` of the best possible one,
or more, is a leak: edits, dropped and inserted words lower the score a little
and no longer.

The items are the stated set of queries and are sent to all tasks in blocks of
at most ``BLOCK_BYTES`` of text, each in a pass over all texts; texts are never
shuffled and windows are bounded by the segments, not by the texts.

Defined results: null and empty texts and items match nothing, nor do items of
fewer than ``WORDS`` tokens; repeated rows and items each give their own rows;
null ids are carried; empty tables give no rows; other columns are not read
by ``leaks`` and are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tillwise.llm.quality_classifier import KIND, tokens
from tillwise.llm.textbatch import Run, U, blobs_of, mix, runs

WORDS = 3
SPREAD = 1
SEGMENT = 96
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
SIEVE_BITS = 22


@dataclass
class Items:
    """A block of test items as arrays; sent to every task."""

    ids: pa.Array
    item: np.ndarray  # of each segment
    bounds: np.ndarray  # tokens of segment s: words[bounds[s]:bounds[s + 1]]
    words: np.ndarray
    gram: np.ndarray  # distinct n-grams, sorted
    at_gram: np.ndarray  # of each place with an n-gram: which one
    at_segment: np.ndarray
    at_offset: np.ndarray
    sieve: np.ndarray


def letters(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of each token."""
    start, end = tokens(run)
    real = KIND[run.buf[start]] == 1
    start, end = start[real], end[real]
    return start, end, run.doc_of(start), run.hasher(lower=True)(start, end)


def grams(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each n-gram within a text."""
    at = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
    made = word[at]
    for k in range(1, n):
        made = mix(made * U(3) + word[at + k])
    return at, made


def items_of(ids: pa.Array, blobs: list[bytes], words: int, segment: int) -> Items:
    run = Run(blobs)
    _, _, doc, word = letters(run)
    at = np.searchsorted(doc, np.arange(len(blobs) + 1)) if blobs else np.zeros(1, np.int64)
    pieces, owner = [], []
    for i in range(len(blobs)):
        lo, hi = at[i], at[i + 1]
        while hi - lo >= words:
            to = min(lo + segment, hi)
            pieces.append(word[lo:to])
            owner.append(i)
            if to == hi:
                break
            lo += segment // 2
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
    flat = np.concatenate(pieces) if pieces else np.zeros(0, U)
    of = np.repeat(np.arange(len(pieces)), np.diff(bounds))
    place, made = grams(of, flat, words)
    gram, at_gram = np.unique(made, return_inverse=True)
    return Items(ids, np.array(owner, dtype=np.int64), bounds, flat, gram, at_gram, of[place],
                 place - bounds[of[place]], sieve_of(gram))


def sieve_of(keys: np.ndarray) -> np.ndarray:
    made = np.zeros(1 << SIEVE_BITS, bool)
    made[(keys >> U(64 - SIEVE_BITS)).astype(np.int64)] = True
    return made


def found(keys: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ``known`` ones, and where there."""
    may = np.flatnonzero(sieve[(keys >> U(64 - SIEVE_BITS)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, keys[may]), max(len(known) - 1, 0))
    real = known[place] == keys[may] if len(known) else np.zeros(len(may), bool)
    return may[real], place[real]


def rare(items: Items, count: np.ndarray, spread: int) -> np.ndarray:
    """Places whose n-gram is the rarest of some ``spread`` neighbours (the first of equals).

    N-grams found in no text (count 0) can seed nothing and are no neighbours.
    """
    chosen = np.zeros(len(items.at_gram), bool)
    often = count[items.at_gram]
    often = np.where(often > 0, often, np.iinfo(np.int64).max)
    edge = np.searchsorted(items.at_segment, np.arange(len(items.item) + 1))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        own = often[lo:hi]
        if hi - lo <= spread:
            chosen[lo + int(own.argmin())] = True
            continue
        view = np.lib.stride_tricks.sliding_window_view(own, spread)
        chosen[lo + np.arange(len(view)) + view.argmin(axis=1)] = True
    return np.flatnonzero(chosen & (often < np.iinfo(np.int64).max))


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of spans, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def shared(items: Items, segment: np.ndarray, start: np.ndarray, stop: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How many words of each segment stand anywhere in the tokens start:stop."""
    number = np.zeros(len(segment), dtype=np.int64)
    length = items.bounds[segment + 1] - items.bounds[segment]
    size = np.cumsum(length + stop - start)
    at = 0
    while at < len(segment):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 17))))
        which = np.arange(at, to)
        salt = mix(which.astype(U) * U(0x9E3779B97F4A7C15))
        text = word[spans(start[at:to], (stop - start)[at:to])] ^ np.repeat(salt, (stop - start)[at:to])
        own = items.words[spans(items.bounds[segment[at:to]], length[at:to])] ^ np.repeat(salt, length[at:to])
        number[at:to] = np.bincount(np.repeat(which - at, length[at:to])[np.isin(own, text)], minlength=to - at)
        at = to
    return number


def align(items: Items, segment: np.ndarray, start: np.ndarray, stop: np.ndarray, word: np.ndarray):
    """Best local score of each segment with the tokens start:stop, and where it ends and begins."""
    length = items.bounds[segment + 1] - items.bounds[segment]
    width = int((stop - start).max())
    across = np.arange(width)
    inside = start[:, None] + across < stop[:, None]
    text = np.where(inside, word[np.minimum(start[:, None] + across, len(word) - 1)], U(0))
    score = np.zeros((len(segment), width + 1), dtype=np.int32)
    begin = np.tile(np.arange(width + 1, dtype=np.int32), (len(segment), 1))
    best = np.zeros(len(segment), dtype=np.int32)
    best_end, best_begin = np.zeros(len(segment), np.int64), np.zeros(len(segment), np.int64)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    row = np.arange(len(segment))
    for i in range(int(length.max())):
        live = i < length
        token = items.words[np.minimum(items.bounds[segment] + i, len(items.words) - 1)]
        same = (text == token[:, None]) & inside & live[:, None]
        cross = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        up = score[:, 1:] + GAP
        now = np.zeros_like(score)
        now[:, 1:] = np.maximum(np.maximum(cross, up), 0)
        origin = np.tile(np.arange(width + 1, dtype=np.int32), (len(segment), 1))
        np.copyto(origin[:, 1:], begin[:, 1:], where=(up > 0) & (up >= cross))
        np.copyto(origin[:, 1:], begin[:, :-1], where=(cross > 0) & (cross >= up))
        # A gap in the segment carries the best score to the left on at one GAP a word.
        carried = np.maximum.accumulate(now + ramp, axis=1)
        source = np.maximum.accumulate(np.where(now + ramp >= carried, np.arange(width + 1), 0), axis=1)
        score = np.maximum(carried - ramp, 0)
        begin = np.take_along_axis(origin, source, axis=1)
        score[~live] = 0
        top = score.argmax(axis=1)
        better = score[row, top] > best
        best[better] = score[row, top][better]
        best_end[better] = top[better]
        best_begin[better] = begin[row, top][better]
    return best / (MATCH * length), start + best_begin, start + best_end


def leaks_in(run: Run, items: Items, gram: np.ndarray, first: np.ndarray, places: np.ndarray, sieve: np.ndarray,
             words: int, least: float) -> list[tuple[int, int, float, int, int]]:
    """Text, item, score, and start and end (bytes) of the best alignment per text and item."""
    start, end, doc, word = letters(run)
    at, key = grams(doc, word, words)
    hit, which = found(key, gram, sieve)
    if not len(hit):
        return []
    n = first[which + 1] - first[which]
    place, token = places[spans(first[which], n)], np.repeat(at[hit], n)
    segment, diagonal = items.at_segment[place], token - items.at_offset[place]
    length = items.bounds[segment + 1] - items.bounds[segment]
    whose = doc[token]
    order = np.lexsort((diagonal, segment, whose))
    whose, segment, diagonal, length = whose[order], segment[order], diagonal[order], length[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ((whose[1:] != whose[:-1]) | (segment[1:] != segment[:-1])
                 | (diagonal[1:] - diagonal[:-1] > length[1:] // 2))
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(order)) - 1
    edge = np.searchsorted(doc, np.arange(len(run) + 1))
    # A leak's score leaves room for this many gaps.
    whose, segment, pad = whose[head], segment[head], np.ceil((1 - least) * -MATCH / GAP * length[head]).astype(np.int64) + 1
    lo = np.maximum(diagonal[head] - pad, edge[whose])
    hi = np.minimum(diagonal[tail] + length[head] + pad, edge[whose + 1])
    # Each word of the segment adds MATCH at most, and only if the window has it.
    may = shared(items, segment, lo, hi, word) >= least * (items.bounds[segment + 1] - items.bounds[segment])
    whose, segment, lo, hi = whose[may], segment[may], lo[may], hi[may]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    by_width = np.argsort(hi - lo, kind="stable")
    at_ = 0
    while at_ < len(by_width):
        to = at_ + 1
        while to < len(by_width) and (to - at_) * (hi - lo)[by_width[to]] < 1 << 17:
            to += 1
        some = by_width[at_:to]
        got, a, b = align(items, segment[some], lo[some], hi[some], word)
        for j in np.flatnonzero(got >= least):
            pair = (int(whose[some[j]]), int(items.item[segment[some[j]]]))
            if got[j] > best.get(pair, (0.0,))[0]:
                best[pair] = (float(got[j]), int(a[j]), int(b[j]))
        at_ = to
    return [(d, i, s, int(start[a]), int(end[b - 1])) for (d, i), (s, a, b) in best.items()]


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The items in blocks of about ``block_bytes`` of text."""
    frame = benchmark.select(F.col("item_id"), F.col("text"))
    total = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        part = frame.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else frame
        # The order decides nothing but which of two equal items is named first.
        table = part.toArrow().combine_chunks().sort_by([("item_id", "ascending"), ("text", "ascending")])
        ids = table.column(0).combine_chunks()
        yield ids, blobs_of(table.column(1))


def prepared(docs: DataFrame, benchmark: DataFrame, words: int, spread: int, segment: int, block_bytes: int):
    """Each block of items with the places of its seeds; rarity, where it matters, is counted over all texts."""
    spark = docs.sparkSession
    for ids, blobs in blocks(benchmark, block_bytes):
        items = items_of(ids, blobs, words, segment)
        if not len(items.gram):
            continue
        known = spark.sparkContext.broadcast((items.gram, items.sieve))

        def held(batches, known=known):
            gram, sieve = known.value
            for batch in batches:
                for _, run in runs(blobs_of(batch.column(0))):
                    _, _, doc, word = letters(run)
                    at, key = grams(doc, word, words)
                    hit, which = found(key, gram, sieve)
                    pair = np.unique(doc[at[hit]] * len(gram) + which)
                    yield pa.RecordBatch.from_arrays([pa.array((pair % len(gram)).astype(np.int32))], names=["gram"])

        count = np.ones(len(items.gram), dtype=np.int64)
        if spread > 1:
            count[:] = 0
            for g, n in docs.select("text").mapInArrow(held, "gram int").groupBy("gram").count().collect():
                count[g] = n
        place = rare(items, count, spread)
        place = place[np.argsort(items.at_gram[place], kind="stable")]
        used, first = np.unique(items.at_gram[place], return_index=True)
        gram = items.gram[used]
        yield spark.sparkContext.broadcast((items, gram, np.append(first, len(place)), place, sieve_of(gram)))


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS, spread: int = SPREAD, segment: int = SEGMENT,
    least: float = LEAST, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, score, start and end (code points of the text) and the passage, for each leak."""
    frame = docs.select("doc_id", "text")
    schema = StructType([
        frame.schema["doc_id"], benchmark.schema["item_id"], StructField("score", DoubleType()),
        StructField("start", LongType()), StructField("end", LongType()), StructField("passage", StringType())])
    made = docs.sparkSession.createDataFrame([], schema)
    for sent in prepared(docs, benchmark, words, spread, segment, block_bytes):

        def of(batches, sent=sent):
            items, gram, first, places, sieve = sent.value
            for batch in batches:
                for base, run in runs(blobs_of(batch.column(1))):
                    rows = leaks_in(run, items, gram, first, places, sieve, words, least)
                    if not rows:
                        continue
                    doc, item, score, a, b = zip(*rows, strict=True)
                    texts = [run.blobs[d] for d in doc]
                    a = [x - int(run.start[d]) for x, d in zip(a, doc, strict=True)]
                    b = [x - int(run.start[d]) for x, d in zip(b, doc, strict=True)]
                    before = [len(t[:x].decode()) for t, x in zip(texts, a, strict=True)]
                    passage = [t[x:y].decode() for t, x, y in zip(texts, a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([base + d for d in doc])), items.ids.take(pa.array(item)),
                        pa.array(score), pa.array(before), pa.array([x + len(p) for x, p in zip(before, passage, strict=True)]),
                        pa.array(passage)], names=schema.names)

        made = made.union(frame.mapInArrow(of, schema))
    return made


def clean(
    docs: DataFrame, benchmark: DataFrame, *, words: int = WORDS, spread: int = SPREAD, segment: int = SEGMENT,
    least: float = LEAST, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` without a leak; texts stay where they are."""
    kept, at_text = docs, docs.columns.index("text")
    for sent in prepared(docs, benchmark, words, spread, segment, block_bytes):

        def of(batches, sent=sent):
            items, gram, first, places, sieve = sent.value
            for batch in batches:
                ok = np.ones(batch.num_rows, bool)
                for base, run in runs(blobs_of(batch.column(at_text))):
                    for d, *_ in leaks_in(run, items, gram, first, places, sieve, words, least):
                        ok[base + d] = False
                yield batch.filter(pa.array(ok))

        kept = kept.mapInArrow(of, docs.schema)
    return kept

"""Quality rules on repetition: suffix arrays over each text's words.

The words of a text (``[^\\x20\\x09-\\x0D]+``) are its symbols. Prefix doubling
sorts the suffixes; the ranks kept from each doubling give the common prefix
of neighbours, so the LCP array needs no pass of its own. An LCP interval of
depth ``d`` is a substring of ``d`` words found at two or more places; the
deepest interval around a suffix is the longest repeat that starts there, and
all others are covered by it. The union of the repeats of at least
``MIN_REPEAT`` words is the repeated part of a text. A text is rejected if
that part is more than ``MAX_COVERED`` of its words, or if one substring of more
than ``MAX_LONGEST`` of them stands at two places apart. (``longest_repeat``
counts places that overlap as well; a repeat of L words in that sense has two
copies apart of L / 2 or more.) Words in such repeats are in repeated windows of
three, so a share over 0.5, or two copies of over 0.25, fails the base rule
already; both limits are below that and decide on their own.

Suffixes of different texts differ in their first symbol, so many texts are
sorted in one go and repeats never cross texts. The rules read each text once,
without a shuffle, whole, in memory bounded by the longest text.

Defined results: null and empty texts have zero measures and fail the base
rule; texts of one word are never repeated; repeated rows get equal results;
an empty table stays empty; other columns, whatever their names, are kept
except those named like a measure, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tillwise.llm.textbatch import SPACE, Run, U, blobs_of, mix, runs
from tillwise.llm.workspace import plain_names

MIN_REPEAT = 8
# Above what texts of good quality with one line twice have (README).
MAX_COVERED = 0.4
MAX_LONGEST = 0.175
MIN_WORDS = 50
# The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MEASURES = StructType([
    StructField("n_words", LongType()), StructField("word_chars", LongType()),
    StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
    StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
    StructField("n_covered", LongType()), StructField("longest_repeat", LongType()),
    StructField("n_repeats", LongType()), StructField("covered", DoubleType()),
    StructField("kept", BooleanType()),
])


def twice(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flag = np.zeros(len(key), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def union(start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a span."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def suffix_array(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (of each suffix with the one before it).

    Each round sorts by twice as many symbols as the round before, and only
    suffixes that still share their rank with another.
    """
    n = len(symbol)
    _, rank = np.unique(symbol, return_inverse=True)
    first = np.sort(rank, kind="stable")
    # A rank is the number of smaller suffixes, so ranks of settled ones stay.
    rank = np.searchsorted(first, rank).astype(np.int64)
    levels, width = [rank], 1
    shared = np.bincount(rank, minlength=n)
    while True:
        open_ = np.flatnonzero(shared[rank] > 1)
        if not len(open_):
            break
        after = open_ + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        group = sorted_key // (n + 1)
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        block = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(order))
        block_at = np.maximum.accumulate(np.where(block, place, 0))
        new_at = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[open_[order]] = group + new_at - block_at
        levels.append(rank)
        shared = np.bincount(rank, minlength=n)
        width *= 2
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.zeros(n, dtype=np.int64)
    left, right = suffix[:-1].copy(), suffix[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        r, step = levels[level], 1 << level
        inside = np.maximum(left, right) < n
        same = np.zeros(n - 1 if n else 0, bool)
        same[inside] = r[left[inside]] == r[right[inside]]
        lcp[1:][same] += step
        left[same] += step
        right[same] += step
    return suffix, lcp


def apart(suffix: np.ndarray, lcp: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first suffix of each group with equal ``least`` words, two copies of which don't overlap.

    ``least`` is at least 1 and equal for suffixes with a common word.
    """
    inside = lcp >= least[suffix]
    first = np.flatnonzero(~inside)
    spread = np.maximum.reduceat(suffix, first) - np.minimum.reduceat(suffix, first)
    head = suffix[first]
    return head[spread >= least[head]]


def measures(run: Run) -> dict[str, np.ndarray]:
    """The measures of each text of a run."""
    k = len(run)
    start, end = run.words()
    doc = run.doc_of(start)
    n_words = np.bincount(doc, minlength=k)
    hashed = run.hasher()
    of_word = hashed(start, end)

    # Continuation bytes of UTF-8 are not characters of their own.
    plain = ~SPACE[run.buf] & ((run.buf & 0xC0) != 0x80)
    ends = np.concatenate(([0], np.cumsum(plain)))
    word_chars = ends[run.end] - ends[run.start]
    n_symbols = run.sums(np.flatnonzero(SYMBOLS[run.buf]))

    line_start, line_end = run.lines()
    words_to = np.searchsorted(start, line_end)
    filled = words_to > np.searchsorted(start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    line_doc = run.doc_of(line_start)
    line = mix(hashed(line_start, line_end) + line_doc.astype(U))
    order = np.argsort(line, kind="stable")
    later = order[1:][line[order][1:] == line[order][:-1]]
    n_dup_lines = np.bincount(line_doc[later], minlength=k)

    within = np.flatnonzero(doc[2:] == doc[:-2])
    window = mix(mix(of_word[within] * U(3) + of_word[within + 1]) * U(5) + of_word[within + 2])
    often = within[twice(mix(window + doc[within].astype(U)))]
    n_repeat_words = np.bincount(
        doc[union(often, np.full(len(often), 3), len(start))], minlength=k)

    n = len(start)
    longest = np.zeros(n, dtype=np.int64)
    n_repeats = np.zeros(k, dtype=np.int64)
    long_repeat = np.zeros(k, bool)
    if n:
        suffix, lcp = suffix_array(mix(of_word + doc.astype(U) * U(0x9E3779B97F4A7C15)))
        deep = np.maximum(lcp, np.append(lcp[1:], 0))
        longest[suffix] = deep
        # Each run of neighbours at least MIN_REPEAT deep is one such interval.
        opens = (lcp >= MIN_REPEAT) & (np.concatenate(([0], lcp[:-1])) < MIN_REPEAT)
        n_repeats = np.bincount(doc[suffix[opens]], minlength=k)
        limit = np.floor(MAX_LONGEST * n_words).astype(np.int64) + 1
        long_repeat[doc[apart(suffix, lcp, limit[doc])]] = True
    at = np.flatnonzero(longest >= MIN_REPEAT)
    n_covered = np.bincount(doc[union(at, longest[at], n)], minlength=k)
    longest_repeat = np.zeros(k, dtype=np.int64)
    np.maximum.at(longest_repeat, doc, longest)

    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)
    covered = n_covered / np.maximum(n_words, 1)
    kept = ~base_failed & (covered <= MAX_COVERED) & ~long_repeat
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "base_failed": base_failed,
        "n_covered": n_covered, "longest_repeat": longest_repeat, "n_repeats": n_repeats,
        "covered": covered, "kept": kept,
    }


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures and the verdict ``kept`` of each text."""
    added = {f.name.lower() for f in MEASURES}
    kept = [c for c in docs.columns if c.lower() not in added]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at_text = [c.lower() for c in kept].index("text")

    def of(batches):
        for batch in batches:
            parts = [measures(run) for _, run in runs(blobs_of(batch.column(at_text)))]
            made = [
                pa.array(np.concatenate([p[f.name] for p in parts]) if parts else []).cast(
                    pa.bool_() if isinstance(f.dataType, BooleanType)
                    else pa.float64() if isinstance(f.dataType, DoubleType) else pa.int64())
                for f in MEASURES
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, *MEASURES.names])

    return frame.mapInArrow(of, StructType([*frame.schema.fields, *MEASURES.fields]))


def reject(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, with their own columns."""
    inner = plain_names(docs)
    return measure(inner).where("kept").select(*inner.columns).toDF(*docs.columns)

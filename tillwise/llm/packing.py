"""Cost-balanced packing of token sequences.

A document's tokens cost ``length + length ** 2 / size`` (the linear layers and
attention within the document). Each task packs its own documents, a block of
at least ``BLOCK`` tokens at a time: a document of ``size`` tokens or more
fills sequences of its own first; what remains is taken in descending length
and put into the sequence of lowest cost that still has room. When none has
room the document is cut at the room of the cheapest sequence that is open.
Sequences are filled to the last token; what is left over (less than one
sequence) goes on to the task's next block. At the end of a task the rest goes
to sequences whose lengths are powers of two, which need no padding.

There is no shuffle, and memory is bounded by a block and the longest text. A
task that is run again packs the same rows the same way.

Ids are those of the whole text: units between white space (and before most
signs after an ASCII letter or digit) can't be merged with anything beyond, so
each distinct unit of a batch is encoded once.

Defined results: null and empty texts have the end token only; a null doc_id
is kept; repeated rows are documents of their own; an empty table gives no
pieces; further columns are not read.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tillwise.llm.textbatch import LOWER, Run, blobs_of, runs

SIZE = 2048
END = 1
BLOCK = 1 << 19
# Units whose ids a worker remembers, twice: some 15 MB.
CACHED = 40_000
RUN_BYTES = 4 << 20
# Between an ASCII letter or digit and one of these the tokenizer always cuts.
# Not so before an apostrophe, which may begin a piece with letters.
WORD, STOP = np.zeros(256, bool), np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
STOP[list(b'!"#$%&()*+,-./:;=>?@[\\]^_`{|}~<')] = True


@cache
def encoder(path: str):
    """The tokenizer, a function for words of plain letters, and the ids known so far.

    Merging the pair of lowest rank first needs nothing but the ranks, so
    ``tiktoken`` gives such words (one piece each, lower case, composed) the
    tokenizer's own ids in a fraction of its time. A zero byte stands for the
    end of a word. Ids seen lately move from the old half of the cache to the
    new one; when that is full it becomes the old one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(shown))
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    vocabulary = {k: v for k, v in tokenizer.get_vocab().items() if k not in special}
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ranks = {}
    for token, number in vocabulary.items():
        last = token.endswith("</w>")
        ends[number] = last
        ranks[bytes(byte[c] for c in (token[:-4] if last else token)) + b"\0" * last] = number
    words = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def plain(texts: list[str]) -> list[np.ndarray]:
        ids = np.array(words.encode_ordinary("\0".join(texts) + "\0"), dtype=np.uint32)
        return np.split(ids, np.flatnonzero(ends[ids])[:-1] + 1)

    return tokenizer, plain, [name.lower().encode() for name in special], [{}, {}]


LETTERS = re.compile("[a-zß-öø-ÿ]+")


def ids_of(units: list[str], path: str) -> list[bytes]:
    """Each unit's ids as bytes."""
    tokenizer, plain, *_ = encoder(path)
    easy = [LETTERS.fullmatch(u) is not None for u in units]
    quick = iter(plain([u for u, e in zip(units, easy, strict=True) if e]) if any(easy) else ())
    slow = iter(tokenizer.encode_batch_fast([u for u, e in zip(units, easy, strict=True) if not e], add_special_tokens=False))
    return [(next(quick) if e else np.array(next(slow).ids, dtype=np.uint32)).tobytes() for e in easy]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(run: Run, path: str) -> list[np.ndarray]:
    """The ids of each text of a run, without special tokens."""
    _, _, special, caches = encoder(path)
    buf, raw = run.buf, run.buf.tobytes()
    start, end = run.words()
    # Lower case is the tokenizer's own first step; a special token's name is neither to arise from it nor to be cut.
    plain = not any(name in raw.lower() for name in special)
    inner = np.zeros(0, dtype=np.int64)
    if plain:
        buf = LOWER[buf]
        inner = np.flatnonzero(WORD[buf[:-1]] & STOP[buf[1:]]) + 1
    start = np.sort(np.concatenate([start, inner]), kind="stable")
    end = np.sort(np.concatenate([end, inner]), kind="stable")
    hashed = run.hasher(lower=plain)(start, end)
    unit, first, at = np.unique(hashed, return_index=True, return_inverse=True)
    young, old = caches
    keys = unit.tolist()
    parts = [young.get(key) or old.get(key) for key in keys]
    new = [i for i, part in enumerate(parts) if part is None]
    raw = buf.tobytes()
    lo, hi = start[first].tolist(), end[first].tolist()
    made = ids_of([raw[lo[i]:hi[i]].decode("utf-8", "replace") for i in new], path)
    for i, part in zip(new, made, strict=True):
        parts[i] = part
    if len(young) + len(keys) > CACHED:
        old, young = young, {}
        caches[:] = young, old
    young.update(zip(keys, parts, strict=True))
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), dtype=np.uint32)
    each = size[at]
    to = np.cumsum(each)
    origin = np.repeat((np.cumsum(size) - size)[at] - (to - each), each)
    ids = flat[origin + np.arange(len(origin))]
    cut = np.searchsorted(start, np.append(run.start, len(buf)))
    bounds = np.concatenate(([0], to))[cut]
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def place(lengths: np.ndarray, rooms: list[int], size: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (item, start, length, bin) that fill the bins, and what is left over."""
    room = np.array(rooms, dtype=np.int64)
    cost = np.zeros(len(room))
    pieces, over = [], []
    for item in np.argsort(-lengths, kind="stable").tolist():
        at, left = 0, int(lengths[item])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    over.append((item, at, left))
                    break
            to = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, int(room[to]))
            pieces.append((item, at, n, to))
            room[to] -= n
            cost[to] += n + n * n / size
            at, left = at + n, left - n
    return pieces, over


def pack(docs: DataFrame, tokenizer: str | None = None, *, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (unsigned 32-bit, little-endian),
    doc_tokens, sequence_id, offset. ``size`` is a power of two."""
    path = tokenizer or tokenizer_file()
    frame = docs.select("doc_id", "text")
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def of(batches):
        first = TaskContext.get().partitionId() << 33
        made = 0
        # Open documents: id as an array of one, ids, start of the open part within them.
        waiting: list[tuple[pa.Array, np.ndarray, int]] = []

        def flush(last: bool):
            nonlocal waiting, made
            rows, rest, rest_doc = [], [], []
            for d, (_, ids, at) in enumerate(waiting):
                while len(ids) - at >= size:
                    rows.append((d, at, size, made, 0))
                    at, made = at + size, made + 1
                if at < len(ids):
                    rest.append(len(ids) - at)
                    rest_doc.append((d, at))
            total = sum(rest)
            rooms = [size] * (total // size)
            if last:
                rooms += [1 << b for b in range(size.bit_length() - 2, -1, -1) if (total % size) >> b & 1]
            pieces, over = place(np.array(rest, dtype=np.int64), rooms, size)
            filled = [0] * len(rooms)
            for item, at, n, to in pieces:
                d, base = rest_doc[item]
                rows.append((d, base + at, n, made + to, filled[to]))
                filled[to] += n
            made += len(rooms)
            batch = None
            if rows:
                doc, at, n, seq, offset = map(np.array, zip(*rows, strict=True))
                ids = [waiting[d][1][a:a + k].tobytes() for d, a, k in zip(doc, at, n, strict=True)]
                batch = pa.RecordBatch.from_arrays([
                    pa.concat_arrays([waiting[d][0] for d in doc]), pa.array(at), pa.array(n),
                    pa.array(ids, pa.binary()), pa.array([len(waiting[d][1]) for d in doc], pa.int64()),
                    pa.array(seq + first), pa.array(offset),
                ], names=["doc_id", *names])
            waiting = [(*waiting[rest_doc[i][0]][:2], rest_doc[i][1] + at) for i, at, _ in over]
            return batch

        held = 0
        for batch in batches:
            who = batch.column(0)
            for at, run in runs(blobs_of(batch.column(1)), RUN_BYTES):
                for i, ids in enumerate(encode(run, path)):
                    whole = np.append(ids, np.uint32(end)).astype("<u4")
                    waiting.append((who.slice(at + i, 1), whole, 0))
                    held += len(whole)
                    if held >= BLOCK:
                        out = flush(last=False)
                        if out is not None:
                            yield out
                        held = sum(len(w[1]) - w[2] for w in waiting)
        out = flush(last=True)
        if out is not None:
            yield out

    kinds = [LongType(), LongType(), BinaryType(), LongType(), LongType(), LongType()]
    return frame.mapInArrow(of, StructType([
        frame.schema["doc_id"], *[StructField(n, t) for n, t in zip(names, kinds, strict=True)]]))

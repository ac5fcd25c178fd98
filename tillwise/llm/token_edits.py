"""Edit-aware token counts: a segment tree of pre-token counts per document.

A document's leaves are blocks of about ``BLOCK`` pre-tokens (the pieces the
tokenizer's own pattern cuts a text into; tokens never span two). A leaf holds
its pre-tokens' lengths and token counts, a node the sums of characters and
tokens below it. An edit (replace the characters ``start`` to ``stop`` of the
text as it is at that time) finds its leaf from the root by the sums of
characters, cuts the text again from a pre-token before the edit until a cut
falls where one was before, counts the tokens of the new pre-tokens only, and
updates the sums above the leaves it touched. The pattern looks one character
ahead and starts afresh at each cut, which is why two pre-tokens of context
before the edit and the first common cut after it are enough.

Texts and edits of a document travel in one row, so there is no shuffle and
memory is bounded by the longest text and a bounded cache of counts.

Defined results: a null text is empty; a null list of edits is none; edit
positions beyond the text's end are moved to it, negative ones to 0 and a stop
before the start to the start; a null position is 0 (a null stop the start), a
null replacement empty; an empty table stays empty; repeated rows are counted
each; columns named like the results are replaced and all others kept.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLOCK = 64
CACHED = 200_000
COUNTS = ["n_pretokens", "tokens_before", "tokens_after", "n_edits", "n_reencoded"]


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def counter(path: str):
    """The pre-token pattern, and a function that counts a pre-token's tokens."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            n = len(encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(known) >= CACHED:
                    known.clear()
                known[piece] = n
        return n

    return regex.compile(public_tokenizers.PATTERN), count, encoding


class Tree:
    """Leaves of pre-tokens and, above them, sums of characters and tokens."""

    def __init__(self, text: str, path: str):
        self.pattern, self.count, _ = counter(path)
        self.text = text
        pieces = self.pattern.findall(text)
        self.n_pieces = len(pieces)
        self.reencoded = 0
        self.leaves = [
            ([len(p) for p in pieces[at:at + BLOCK]], [self.count(p) for p in pieces[at:at + BLOCK]])
            for at in range(0, len(pieces), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.width = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (sizes, counts) in enumerate(self.leaves):
            self.chars[n + i], self.tokens[n + i] = sum(sizes), sum(counts)
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last for the end) and its first character."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (sizes, counts)
        node = leaf + self.width
        more = sum(sizes) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        # Two pre-tokens before the one the edit starts in, from the leaf before if need be.
        leaf, base = self.find(max(start - 1, 0))
        while leaf and self._pieces_before(leaf, base, start) < 3:
            leaf -= 1
            base -= self.chars[leaf + self.width]
        sizes, _ = self.leaves[leaf]
        skip, at = 0, base
        while skip < len(sizes) and at + sizes[skip] < start:
            at += sizes[skip]
            skip += 1
        for _ in range(2):
            if skip:
                skip -= 1
                at -= sizes[skip]
        self.text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        # Cuts of the old text behind the edit, leaf by leaf, as they are needed.
        last, index, old_at = leaf, skip, at
        made_sizes, made_counts, here, settled = [], [], at, False
        for match in self.pattern.finditer(self.text, at):
            if here >= start + len(new):
                while old_at + shift < here and last < len(self.leaves):
                    if index < len(self.leaves[last][0]):
                        old_at += self.leaves[last][0][index]
                        index += 1
                    else:
                        last, index = last + 1, 0
                if old_at >= stop and old_at + shift == here:
                    settled = True
                    break
            piece = match.group()
            made_sizes.append(len(piece))
            made_counts.append(self.count(piece))
            self.reencoded += 1
            here = match.end()
        if settled and last < len(self.leaves):
            rest = self.leaves[last][0][index:], self.leaves[last][1][index:]
        else:
            last, rest = len(self.leaves) - 1, ([], [])
        head = self.leaves[leaf]
        was = sum(len(self.leaves[i][0]) for i in range(leaf, last + 1))
        all_sizes = head[0][:skip] + made_sizes + rest[0]
        all_counts = head[1][:skip] + made_counts + rest[1]
        self.n_pieces += len(all_sizes) - was
        # The touched leaves share what they now hold; one much too large splits the leaves anew.
        spread = last - leaf + 1
        each = max(1, -(-len(all_sizes) // spread))
        for i in range(spread):
            self._set(leaf + i, all_sizes[i * each:(i + 1) * each], all_counts[i * each:(i + 1) * each])
        if each > 4 * BLOCK:
            sizes = [x for s, _ in self.leaves for x in s]
            counts = [x for _, c in self.leaves for x in c]
            self.leaves = [(sizes[k:k + BLOCK], counts[k:k + BLOCK]) for k in range(0, len(sizes), BLOCK)] or [([], [])]
            self._build()

    def _pieces_before(self, leaf: int, base: int, start: int) -> int:
        n, at = 0, base
        for size in self.leaves[leaf][0]:
            if at >= start:
                break
            at, n = at + size, n + 1
        return n


def attach(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with ``edits``: a list of a document's (doc_id, step, start, stop, new), by step.

    Edits are gathered per document, which bounds the list by one document's
    edits; documents without any get a null list.
    """
    listed = edits.groupBy(F.col("doc_id").alias("_doc")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step", "start", "stop", "new"))),
        lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["new"].alias("new"))).alias("edits"))
    return docs.join(listed, docs["doc_id"] == listed["_doc"], "left").drop("_doc")


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (with ``text`` and ``edits``, a list of start, stop, new) with the columns of ``COUNTS``."""
    path = path or rank_file()
    kept = [c for c in docs.columns if c.lower() not in COUNTS]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    at_text, at_edits = kept.index("text"), kept.index("edits")

    def of(batches):
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(at_text), batch.column(at_edits), strict=True):
                tree = Tree(text.as_py() or "", path)
                n, before = tree.n_pieces, tree.total
                known = edits.as_py() or []
                for e in known:
                    e = e or {"start": None, "stop": None, "new": None}
                    at = e["start"] or 0
                    tree.edit(at, at if e["stop"] is None else e["stop"], e["new"] or "")
                rows.append((n, before, tree.total, len(known), tree.reencoded))
            made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *COUNTS])

    return frame.mapInArrow(of, StructType([*frame.schema.fields, *[StructField(c, LongType()) for c in COUNTS]]))


def trial_edits(doc_id: Column, text: Column, n: int = 4) -> Column:
    """Edits that follow from the id and the text's length: an insertion, a deletion, two replacements."""
    size = F.length(F.coalesce(text, F.lit("")))
    news = ["new words, 12 of them", "", "'s", " x"]
    cuts = [0, 40, 7, 1]
    made = []
    for step in range(n):
        at = F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(step)), (size + 1).cast("long"))
        made.append(F.struct(at.alias("start"), (at + cuts[step % 4]).alias("stop"), F.lit(news[step % 4]).alias("new")))
    return F.array(*made)

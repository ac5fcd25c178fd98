"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain: runs of characters that can be listed become
alternatives of strings, and each string the conjunction of its trigrams. The
index has a posting (trigram, text) for every trigram that some rule asks for
and every text that contains it, over lower-cased text; postings are keyed by
a hash of the text, so copies share them. A text's postings are intersected as
bits, the queries are evaluated on the bits, and only candidates are verified
with the expression itself. Rules without a mandatory trigram scan every text.
A false key match only adds a candidate, which is then verified.

All work on texts is DataFrame functions. Splitting a text at the matches and
extracting them gives the lengths from which positions follow, in code points,
end exclusive; a kind's spans are leftmost and do not overlap.

Defined results: null and empty texts have no spans; null ids and repeated
rows are kept as they are; an empty table stays empty; other columns, whatever
their names, are carried along by ``redact`` and not read by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.workspace import written


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds. Runs of hex digits and of access keys are
# matched whole either way, so their least length stands in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# The method's own kinds: token formats that name themselves.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
LISTED = 64
CLASS = 8
MASK = "[SECRET]"

Query = frozenset  # of alternatives, each a frozenset of trigrams
ANY: Query = frozenset([frozenset()])


def _shortest(query: Query) -> Query:
    """An alternative that asks for more than another adds nothing."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(one: Query, two: Query) -> Query:
    return _shortest(frozenset(a | b for a in one for b in two))


def _of_strings(strings: set[str]) -> Query:
    return _shortest(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _characters(op, value) -> set[str] | None:
    """The characters a single-character element can be, if they are few."""
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.IN:
        found: set[str] = set()
        for kind, item in value:
            if kind is ops.LITERAL:
                found.add(chr(item).lower())
            elif kind is ops.RANGE and item[1] - item[0] < CLASS:
                found |= {chr(c).lower() for c in range(item[0], item[1] + 1)}
            else:
                return None
        return found if len(found) <= CLASS else None
    return None


def _walk(items) -> tuple[set[str] | None, Query]:
    """All strings an expression matches, if they can be listed, else its query."""
    open_, query, whole = {""}, ANY, True

    def close():
        nonlocal open_, query, whole
        query, open_, whole = _and(query, _of_strings(open_)), {""}, False

    for op, value in items:
        inner_query = ANY
        strings = _characters(op, value)
        if op is ops.SUBPATTERN:
            strings, inner_query = _walk(value[-1])
        elif op is ops.BRANCH:
            each = [_walk(x) for x in value[1]]
            strings = set().union(*[s for s, _ in each]) if all(s is not None for s, _ in each) else None
            inner_query = _shortest(frozenset().union(*[q if s is None else _of_strings(s) for s, q in each]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = value
            inner, repeated = _walk(body)
            strings = {""} | inner if inner is not None and (least, most) == (0, 1) else None
            if strings is None and least:
                inner_query = repeated if inner is None else _of_strings(inner)
        elif op is ops.AT:
            continue
        if strings is None:
            close()
            query = _and(query, inner_query)
        elif len(open_) * len(strings) > LISTED:
            close()
            open_ = set(strings)
        else:
            open_ = {a + b for a in open_ for b in strings}
    if whole:
        return open_, _of_strings(open_)
    close()
    return None, query


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, one of which is in the lower-cased text of any match."""
    return _walk(_parser.parse(pattern))[1]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: ``posting`` (the trigram's place in ``trigrams``) and ``key``."""
    low = texts.select("key", F.lower("text").alias("low"))
    listed = F.array(*[F.struct(F.lit(i).alias("posting"), F.lit(t).alias("trigram")) for i, t in enumerate(trigrams)])
    found = F.filter(listed, lambda x: F.contains(F.col("low"), x["trigram"]))
    return low.select("key", F.explode(F.transform(found, lambda x: x["posting"])).alias("posting"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and, per indexed rule, whether its query holds; only keys where one does."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules if trigram_query(r.pattern) != ANY}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    at = {t: i for i, t in enumerate(trigrams)}
    lists = range(0, len(trigrams), 63)
    bits = postings(texts, trigrams).groupBy("key").agg(*[
        F.bit_or(F.when(F.col("posting").between(lo, lo + 62), F.expr(f"shiftleft(1L, posting - {lo})")).otherwise(F.lit(0).cast("long"))).alias(f"bits{lo}")
        for lo in lists])

    def holds(alternative) -> Column:
        made = F.lit(True)
        for lo in lists:
            mask = sum(1 << (at[t] - lo) for t in alternative if lo <= at[t] < lo + 63)
            if mask:
                made = made & (F.col(f"bits{lo}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return made

    def either(query) -> Column:
        made = F.lit(False)
        for alternative in sorted(query, key=sorted):
            made = made | holds(alternative)
        return made

    flags = bits.select("key", *[either(q).alias(f"may_{k}") for k, q in queries.items()])
    some = F.lit(False)
    for kind in queries:
        some = some | F.col(f"may_{kind}")
    return flags.where(some)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind number, end) of a rule in one text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    told = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))),
        told, lambda x, t: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), F.length(t).alias("told")))
    span = "struct<start:int,kind:int,end:int>"
    placed = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["own"]).alias("at"),
            F.when(x["told"] >= rule.least, F.array_append(s["spans"], F.struct(
                (s["at"] + x["gap"]).alias("start"), F.lit(order).alias("kind"),
                (s["at"] + x["gap"] + x["own"]).alias("end")))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return F.when(F.regexp_like(text, pattern), placed).otherwise(F.array().cast(f"array<{span}>"))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``row`` (all of the document's columns), ``text`` and ``spans`` by start, then kind."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    keyed = rows.withColumn("key", text_key(F.col("text")))
    # Written, so that the join deals out both sides itself and can split a text with many copies.
    found = written(candidates(docs.select(text_key(F.col("text")).alias("key"), "text"), rules), "candidates")
    joined = keyed.join(found, "key", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for order, rule in enumerate(rules):
        made = matches(F.col("text"), rule, order)
        if f"may_{rule.kind}" in found.columns:
            made = F.when(F.col(f"may_{rule.kind}"), made).otherwise(empty)
        each.append(F.coalesce(made, empty))
    return joined.select("row", "text", F.array_sort(F.concat(*each)).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans."""
    found = with_spans(docs.select("doc_id", "text"), rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[number(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(as_text(base, rules), 256).alias("base_sha256"), as_text(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (one for spans that overlap) and ``n_chars`` to match."""
    rebuilt = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask)))
            .otherwise(s["out"]).alias("out")),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    clean = F.when(F.size("spans") > 0, rebuilt).otherwise(F.col("text"))
    found = with_spans(docs, rules).select("row", clean.alias("clean"))
    return found.select(*[
        F.col("clean").alias(c) if c == "text"
        else F.coalesce(F.length("clean"), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("row").getField(c).alias(c) for c in docs.columns])

"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from tillwise.llm.secrets import BASE, MORE

# Damage as in queries.replicas, compared page by page without any tree.
FIXITY = r"""
WITH made AS (
    SELECT page_id, coalesce(page_id % 97, 0) AS fault,
        'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
        || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
        || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
        || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS one
    FROM pages
), two AS (
    SELECT *, CASE fault WHEN 41 THEN NULL WHEN 13 THEN substr(one, 1, 200) || '?' || substr(one, 202)
        WHEN 29 THEN substr(one, 1, length(one) - 9) ELSE one END AS two
    FROM made WHERE fault IN (13, 29, 41)
)
SELECT page_id, CASE WHEN two IS NULL THEN 'missing' ELSE 'changed' END AS fault,
    octet_length(encode(one)) AS length_1, sha256(one) AS digest_1,
    octet_length(encode(two)) AS length_2, sha256(two) AS digest_2
FROM two WHERE two IS DISTINCT FROM one
"""


def secrets() -> str:
    """Every rule over every text, without an index."""
    each = []
    for number, rule in enumerate(BASE + MORE):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        told = f"regexp_extract_all(body, {pattern}, {rule.group})" if rule.group else "found"
        each.append(f"""
    SELECT row_no, {number} AS kind_no, '{rule.kind}' AS kind,
        unnest(list_transform(range(1, len(found) + 1), lambda i: {{
            'at': list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0),
            'size': length(found[i]), 'told': length(told[i])}})) AS span
    FROM (SELECT row_no, found, gaps, {told} AS told FROM (
        SELECT row_no, body, regexp_extract_all(body, {pattern}, 0) AS found,
            regexp_split_to_array(body, {pattern}) AS gaps
        FROM texts WHERE regexp_matches(body, {pattern})))""")
    least = " ".join(f"WHEN {n} THEN {r.least}" for n, r in enumerate(BASE + MORE))
    counts = ", ".join(
        f"coalesce(count(*) FILTER (kind_no = {n}), 0) AS n_{r.kind}" for n, r in enumerate(BASE))
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
), spans AS ({" UNION ALL ".join(each)}
), kept AS (
    SELECT row_no, kind_no, CAST(span.at AS BIGINT) AS begin_,
        kind || ':' || CAST(span.at AS BIGINT) || ':' || CAST(span.at + span.size AS BIGINT) AS told
    FROM spans WHERE span.told >= CASE kind_no {least} END
)
SELECT any_value(doc_id) AS doc_id, {counts},
    sha256(coalesce(string_agg(told, ',' ORDER BY begin_, kind_no) FILTER (kind_no < {len(BASE)}), '')) AS base_sha256,
    coalesce(string_agg(told, ',' ORDER BY begin_, kind_no), '') AS spans
FROM texts LEFT JOIN kept USING (row_no) GROUP BY row_no
"""


# Near-duplicates: every pair of texts that shares a shingle, and its components by repeated look-up.
NEAR = r"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), listed AS (
    SELECT row_no, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1),
            lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
    FROM texts
), sets AS (
    SELECT min(row_no) AS set_no, min(doc_id) AS first_id, len(any_value(shingles)) AS n, any_value(shingles) AS shingles,
        list(row_no) AS copies
    FROM (SELECT *, md5(array_to_string(list_sort(shingles), chr(10))) AS digest FROM listed WHERE len(shingles) > 0)
    GROUP BY digest
), each AS (SELECT set_no, n, unnest(shingles) AS shingle FROM sets
), links AS (
    SELECT a.set_no AS a, b.set_no AS b
    FROM each a JOIN each b ON a.shingle = b.shingle AND a.set_no < b.set_no
        AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.set_no, b.set_no, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT set_no AS a, set_no AS b FROM sets
    UNION
    SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a
), least AS (
    SELECT reach.a AS set_no, min(first_id) AS component_id
    FROM reach JOIN sets ON reach.b = sets.set_no GROUP BY reach.a
), named AS (SELECT unnest(copies) AS row_no, component_id FROM sets JOIN least USING (set_no))
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles,
    CASE WHEN len(shingles) = 0 THEN doc_id ELSE component_id END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN len(shingles) = 0 THEN doc_id ELSE component_id END AS kept
FROM listed LEFT JOIN named USING (row_no)
"""


# Ranked search: every document scored for every item.
RANKED = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), items AS (
    SELECT item_no, item_id, unnest(list_distinct(terms)) AS term FROM (
        SELECT row_number() OVER () AS item_no, item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM benchmark)
), total AS (
    SELECT count(*) FILTER (len(terms) > 0) AS documents, CAST(sum(len(terms)) AS BIGINT) AS length FROM texts
), counts AS (
    SELECT row_no, doc_id, any_value(n) AS n, term, count(*) AS tf
    FROM (SELECT row_no, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM texts) GROUP BY row_no, doc_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(documents) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total GROUP BY term
), scored AS (
    SELECT item_no, item_id, row_no, doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // length)))) AS BIGINT) AS score
    FROM items JOIN counts USING (term) JOIN weights USING (term), total GROUP BY item_no, item_id, row_no, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

"""DuckDB SQL for those numbered queries whose rows SQL can give over whole tables.

The SQL follows the contracts of the results, not the methods: all windows or shingles are compared.
"""

from __future__ import annotations

from salesloom.llm.text import LOWER, UPPER

_TEXT_WORD = r"[^\x20\x09-\x0D]+"
_ALPHANUMERIC_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, fold: bool) -> str:
    text = "coalesce(text, '')"
    if fold:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"regexp_extract_all({text}, '{pattern}')"


OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_TEXT_WORD, True)} AS w FROM documents),
g AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
    FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM g AS x JOIN g AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d JOIN least_id USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_words(_ALPHANUMERIC_WORD, True)} AS w FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 13) AS k
    FROM (SELECT item_id, {_words(_ALPHANUMERIC_WORD, True)} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
    SELECT DISTINCT item_id, k, unnest(
        [array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g
    FROM b),
sizes AS (SELECT DISTINCT k FROM b),
windows AS (
    SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(
        [array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS g
    FROM d CROSS JOIN sizes WHERE len(w) >= k),
hits AS (SELECT doc_id, item_id, k, i FROM windows JOIN item_windows USING (k, g)),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_words(_TEXT_WORD, False)} AS w FROM documents),
windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(
        [array_to_string(w[i:i + 19], ' ') FOR i IN range(1, len(w) - 18)]) AS g
    FROM d WHERE len(w) >= 20),
numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM numbered WHERE nth > 1),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept
    FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def _coded(n: int) -> str:
    """Parts with the nearest entry of codebook ``n``: the least of distance * 64 + index."""
    return f"""
a{n} AS (
    SELECT r, p.part, min(64 * list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) + b.entry) AS m
    FROM p JOIN b{n} AS b ON p.part = b.part GROUP BY r, p.part)"""


def _trained(n: int) -> str:
    """Codebook ``n`` from the one before: floors of means, unused entries as they were."""
    return f"""
m{n} AS (
    SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS e
    FROM (SELECT p.part, CAST(m % 64 AS BIGINT) AS entry, i, sum(x[i]) AS s, count(*) AS c
          FROM p JOIN a{n - 1} AS a ON p.r = a.r AND p.part = a.part, range(1, 1000) AS t(i) WHERE i <= len(x)
          GROUP BY p.part, entry, i) GROUP BY part, entry),
b{n} AS (
    SELECT b.part, b.entry, coalesce(m.e, b.e) AS e
    FROM b{n - 1} AS b LEFT JOIN m{n} AS m ON m.part = b.part AND m.entry = b.entry)"""


OP11 = f"""
WITH v AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT r, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS x
    FROM v, range(16) AS t(part)),
b0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= 64),{_coded(0)},{_trained(1)},{_coded(1)},{_trained(2)},{_coded(2)},
coded AS (
    SELECT r, string_agg(format('{{:02x}}', CAST(m % 64 AS BIGINT)), '' ORDER BY part) AS code, sum(m // 64) AS error
    FROM a2 GROUP BY r),
digest AS (
    SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded ON v.r = coded.r, digest
"""

OP12 = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
named AS (
    SELECT conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) AS k,
           len(regexp_extract_all(text, '{_TEXT_WORD}')) AS words
    FROM t),
own AS (
    SELECT conv_id, k, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS n FROM named),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
        lambda c, o: list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d, k, words
    FROM (
        SELECT c.conv_id, 1 AS part, o.n, o.k, o.words FROM convs AS c JOIN own AS o ON o.conv_id = c.donor AND o.n <= c.h
        UNION ALL
        SELECT c.conv_id, 2, o.n, o.k, o.words FROM convs AS c JOIN own AS o ON o.conv_id = c.conv_id AND o.n > c.h)),
steps AS (
    SELECT conv_id, 0 AS d, '' AS path, 0 AS words FROM convs
    UNION ALL
    SELECT conv_id, d, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING), words FROM rebuilt),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM steps GROUP BY path, d),
below AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own_values AS (
    SELECT nodes.path, d, (nodes.n - 1) * words AS saved, CASE WHEN below.n IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes LEFT JOIN below ON below.path = nodes.path),
sums AS (
    SELECT left(path, 32 * k) AS path, sum(saved) AS saved, sum(leaf) AS leaves
    FROM (SELECT path, saved, leaf, unnest(range(d + 1)) AS k FROM own_values) GROUP BY 1),
last AS (SELECT conv_id, max(path) AS path FROM steps GROUP BY conv_id),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY path)
SELECT nodes.conv_id, nodes.d AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs,
       coalesce(below.n, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM nodes JOIN sums ON sums.path = nodes.path
LEFT JOIN nodes AS above ON above.d = nodes.d - 1 AND above.path = left(nodes.path, 32 * (nodes.d - 1))
LEFT JOIN below ON below.path = nodes.path LEFT JOIN ends ON ends.path = nodes.path
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op4_winnowing": OP4, "op9_substring_dedup": OP9, "op11_ball_codes": OP11,
              "op12_prefix_trie": OP12, "op13_byte_trie": OP13}

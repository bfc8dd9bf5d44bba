"""DuckDB SQL for the rows of the queries that SQL can express."""

from geoweave.llm.licenses import _MARKS, TEMPLATES, window_words

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 80 * (na + nb - i)
), reach(d, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = s.doc_id
"""

OP3 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM g),
m AS (SELECT gram, min(doc_id) AS least FROM h GROUP BY gram HAVING min(doc_id) < max(doc_id)),
r AS (SELECT h.doc_id, h.i FROM h JOIN m ON h.gram = m.gram WHERE h.doc_id > m.least),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 13)) AS j)),
l AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, p: gone IS NULL OR NOT list_contains(gone, p)), ' ')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""

OP8 = f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
k AS (SELECT row_number() OVER () AS r, * FROM w),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM k WHERE len(ws) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM h, (SELECT unnest(range(0, 5)) AS j) WHERE n > 1 GROUP BY r),
m AS (
  SELECT k.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(text, '[!?]')) AS n_marks, len(regexp_extract_all(text, '[A-Z]')) AS n_upper
  FROM k LEFT JOIN c ON k.r = c.r
), f AS (
  SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), s AS (
  SELECT *, CAST(n_symbols * 10 > n_words AS INT) + CAST(n_dup_lines * 10 > len(ls) * 3 AS INT) + CAST(word_chars < 3 * n_words OR word_chars > 12 * n_words AS INT)
    + CAST(n_marks * 10 > n_words * 3 AS INT) + CAST(n_upper * 10 > word_chars * 3 AS INT) AS n_failed,
    n_symbols * 20 > n_words OR n_dup_lines * 20 > len(ls) * 3 OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR n_marks * 20 > n_words * 3 OR n_upper * 20 > word_chars * 3 AS near FROM f
), hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR n_failed > 0) AS b FROM s GROUP BY source),
o AS (SELECT sum(b) / sum(n) AS mean, coalesce(var_samp(b / n), 0) AS var, avg(1 / n) AS inverse FROM hosts),
q AS (SELECT mean, greatest(var - mean * (1 - mean) * inverse, mean * (1 - mean) * 1e-4, 1e-12) AS between_hosts FROM o),
p AS (SELECT mean, sqrt(between_hosts) AS sd, greatest(mean * (1 - mean) / between_hosts - 1, 1.0) AS strength FROM q),
v AS (SELECT source, (b + mean * strength) / (n + strength) - mean AS away, sd FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN away < -sd THEN n_failed < 2 WHEN away > sd THEN NOT near ELSE n_failed < 1 END AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_FROM = "'" + (UPPER + _MARKS.replace("\t\n\x0b\x0c\r", "")).replace("'", "''") + "' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TO = "'" + LOWER + " " * len(_MARKS) + "'"


def _plain(text: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), {_FROM}, {_TO}), ' +'), lambda w: w <> '')"


def _grams(words: str) -> str:
    return f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))"


_ROWS = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in sorted(TEMPLATES.items()))
OP7 = f"""
WITH l AS (SELECT license, {_plain('notice')} AS w FROM (VALUES {_ROWS}) x(license, notice)),
t AS (
  SELECT license, CAST(CASE {' '.join(f'WHEN len(w) <= {n} THEN {window_words(n)}' for n in (4, 8, 16, 32, 64, 128, 256))} END AS BIGINT) AS span,
    len(list_distinct({_grams('w')})) AS n_shingles, unnest(list_distinct({_grams('w')})) AS g FROM l WHERE len(w) >= 5
), d AS (SELECT doc_id, {_plain('text')} AS w FROM documents),
s AS (SELECT doc_id, unnest({_grams('w')}) AS g, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
m AS (SELECT doc_id, license, span, n_shingles, s.g, p FROM s JOIN t ON s.g = t.g),
x AS (SELECT *, unnest(range(greatest(0, (p - (span - 4) + span // 2) // (span // 2)), p // (span // 2) + 1)) AS k FROM m),
c AS (SELECT doc_id, license, n_shingles, k * (span // 2) AS place, count(DISTINCT g) AS n_shared FROM x WHERE k * (span // 2) + span - 4 > p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n_shared DESC, place) AS o FROM c WHERE 100 * n_shared >= 80 * n_shingles)
SELECT doc_id, license, n_shared, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(place AS BIGINT) AS first_word FROM r WHERE o = 1
"""


def _rounds(n: int) -> str:
    """A table of assignments aK and one of entries cK for each round, and the last assignments."""
    out = []
    for k in range(n + 1):
        out.append(f"""
b{k} AS (SELECT part, list(c ORDER BY e) AS cs FROM c{k} GROUP BY part),
a{k} AS (
  SELECT r, p.part, x, list_min(list_transform(range(len(cs)), lambda e: len(cs) * coalesce(list_sum(list_transform(range(len(x)), lambda j: (x[j + 1] - cs[e + 1][j + 1]) * (x[j + 1] - cs[e + 1][j + 1]))), 0) + e)) AS best, len(cs) AS n
  FROM p JOIN b{k} ON p.part = b{k}.part
)""")
        if k < n:
            out.append(f"""
u{k} AS (SELECT part, best % n AS e, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{k}),
s{k} AS (SELECT part, e, j, CAST(sum(y) AS BIGINT) AS t, count(*) AS m FROM u{k} GROUP BY ALL),
m{k} AS (SELECT part, e, list((t - ((t % m) + m) % m) // m ORDER BY j) AS c FROM s{k} GROUP BY part, e),
c{k + 1} AS (SELECT c{k}.part, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.part = m{k}.part AND c{k}.e = m{k}.e)""")
    return ",".join(out)


OP12 = f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT r, vec_id, v, part, v[len(v) * part // 16 + 1:len(v) * (part + 1) // 16] AS x FROM k, range(16) q(part)),
o AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k),
c0 AS (SELECT part, e, x AS c FROM p JOIN o ON p.r = o.r WHERE e < 64),{_rounds(2)},
f AS (SELECT r, string_agg(printf('%02x', best % n), '' ORDER BY part) AS code, CAST(sum(best // n) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2 WHERE len(c) > 0),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k ON f.r = k.r GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM k JOIN f ON k.r = f.r JOIN l ON k.label IS NOT DISTINCT FROM l.label, h
"""

#: The polynomial of CRC-32, lowest bit first: a fixed value.
CRC = 0xEDB88320
_CRC_BITS = "flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii({0}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
OP13 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_BITS.format('CAST(conv_id AS VARCHAR)')}),
    lambda a, b: xor(xor(a, b) >> 1, {CRC} * (xor(a, b) & 1)))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = c.base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h
), p AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY own, place) AS path FROM r GROUP BY conv_id),
s AS (SELECT c.conv_id, coalesce(path, []) AS path FROM c LEFT JOIN p ON c.conv_id = p.conv_id),
m AS (SELECT conv_id, len(path) AS n, unnest(range(len(path) + 1)) AS depth, path FROM s),
n AS (
  SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = depth) AS ends FROM m GROUP BY ALL
), k AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.node[n.depth].t) ELSE 0 END AS saves
  FROM n LEFT JOIN k ON n.depth = k.depth AND n.node = k.node
), u AS (SELECT unnest(range(depth + 1)) AS depth, node, n_children, saves FROM v),
b AS (SELECT depth, node[1:depth] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved FROM u GROUP BY ALL)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN b ON v.depth = b.depth AND v.node = b.node LEFT JOIN n q ON q.depth = v.depth - 1 AND q.node = v.node[1:v.depth - 1]
"""

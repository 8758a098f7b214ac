"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_JSD = """sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x:
      (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0.0 END
       + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0.0 END) / 2)), 0.0))"""

_CLASS = ("[\\p{Ll}\\p{Lo}]+", "[\\t\\n\\v\\f\\r ]+", "\\p{Lu}+", "[.,;:!?''\"()\\-]+", "\\p{Nd}+")
_COUNTS = ", ".join(f"(length(t) - length(regexp_replace(t, '{c}', '', 'g')))::DOUBLE"
                    for c in _CLASS)

OP6_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang AS g, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
numbered AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, * FROM base),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM numbered, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT r, i FROM grams
          QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n
            FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY r),
dup_lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM numbered, unnest(string_split(t, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
freq AS (SELECT g, word, count(*) AS n FROM numbered, unnest(w) AS u(word) GROUP BY g, word),
common AS (SELECT g, list(word ORDER BY word) AS words FROM (
  SELECT g, word FROM freq
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, word) <= 16) GROUP BY g),
counted AS (
  SELECT b.r, b.doc_id, b.g, len(w) AS n_words, length(t) AS chars,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         [{_COUNTS}] AS c5,
         list_transform(coalesce(words, []), lambda x: len(list_filter(w, lambda y: y = x))::DOUBLE) AS o0
  FROM numbered b LEFT JOIN common ON common.g IS NOT DISTINCT FROM b.g),
full_counts AS (
  SELECT *, list_append(c5, chars - list_sum(c5)) AS c,
         list_append(o0, n_words - coalesce(list_sum(o0), 0.0)) AS o FROM counted),
totals AS (SELECT g, sum(n_words) AS n, sum(chars) AS ch FROM full_counts GROUP BY g),
class_ref AS (
  SELECT g, list(s / ch ORDER BY i) AS q FROM (
    SELECT f.g, i, sum(c[i]) AS s, any_value(ch) AS ch
    FROM full_counts f JOIN totals ON totals.g IS NOT DISTINCT FROM f.g,
         unnest(range(1, len(c) + 1)) AS u(i) GROUP BY f.g, i) GROUP BY g),
word_ref AS (
  SELECT g, list(s / n ORDER BY i) AS q FROM (
    SELECT f.g, i, sum(o[i]) AS s, any_value(n) AS n
    FROM full_counts f JOIN totals ON totals.g IS NOT DISTINCT FROM f.g,
         unnest(range(1, len(o) + 1)) AS u(i) GROUP BY f.g, i) GROUP BY g),
judged AS (
  SELECT f.*, coalesce(v.n, 0) AS n_repeat_words, coalesce(d.n, 0) AS n_dup_lines,
         f.n_words < 10 OR 100 * coalesce(v.n, 0) > 20 * f.n_words AS base_failed,
         CASE WHEN chars >= 200 THEN {_JSD.format(
             p="list_transform(c, lambda x: x / chars)", q="cr.q")} END AS cd,
         CASE WHEN f.n_words >= 50 THEN {_JSD.format(
             p="list_transform(o, lambda x: x / f.n_words)", q="wr.q")} END AS wd,
         o[len(o)] = f.n_words AND pow(wr.q[len(wr.q)], f.n_words) < 1e-9 AS no_common
  FROM full_counts f LEFT JOIN covered v USING (r) LEFT JOIN dup_lines d USING (r)
  JOIN class_ref cr ON cr.g IS NOT DISTINCT FROM f.g
  JOIN word_ref wr ON wr.g IS NOT DISTINCT FROM f.g),
bins AS (
  SELECT g, s, b, count(*) AS n FROM (
    SELECT g, length(bin(n_words // 50)) - 1 AS s, floor(wd * 10000)::BIGINT AS b
    FROM judged WHERE wd IS NOT NULL
    UNION ALL
    SELECT g, NULL, floor(wd * sqrt(n_words) * 1000)::BIGINT FROM judged WHERE wd IS NOT NULL)
  GROUP BY ALL),
below AS (SELECT *, sum(n) OVER (PARTITION BY g, s ORDER BY b) AS c,
                 sum(n) OVER (PARTITION BY g, s) AS m FROM bins),
quantiles AS (
  SELECT g, s, max(m)::DOUBLE AS m, min(b) FILTER (2 * c >= m) AS mid,
         min(b) FILTER (100 * c >= 16 * m) AS low FROM below GROUP BY g, s),
raws AS (SELECT g, s, m, (mid + 4.0::DOUBLE * (mid - low)) AS raw FROM quantiles),
limits AS (
  SELECT c.g, c.s, min((c.m * least(0.45::DOUBLE, greatest(0.25::DOUBLE, c.raw / 10000))
      + 30 * ((a.m * least(0.45::DOUBLE, greatest(0.25::DOUBLE, a.raw / 1000 / sqrt(50 * pow(2, c.s))))
               + 30 * 0.45::DOUBLE) / (a.m + 30))) / (c.m + 30))
    OVER (PARTITION BY c.g ORDER BY c.s) AS most
  FROM raws c JOIN raws a ON a.g IS NOT DISTINCT FROM c.g AND a.s IS NULL
  WHERE c.s IS NOT NULL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > 0.25, false)
       AND NOT coalesce(wd > most OR (wd IS NOT NULL AND no_common), false) AS kept
FROM judged j LEFT JOIN limits l
  ON l.g IS NOT DISTINCT FROM j.g AND l.s = length(bin(j.n_words // 50)) - 1 AND j.n_words >= 50
"""

OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram
          FROM w, unnest(range(1, greatest(len(ws) - 18, 1))) AS u(i) WHERE len(ws) >= 20),
later AS (SELECT doc_id, i FROM grams
          QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, unnest(range(0, 20)) AS u(k)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(low.b, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
             list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE a.id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5
"""

# CRC-32 of a string of ASCII digits: eight shifts per byte with the reversed polynomial.
_CRC32 = """xor(4294967295, list_reduce(
    list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
    4294967295::BIGINT))"""

OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': r, 't': t}} ORDER BY p) AS s,
               {_CRC32.format(s="CAST(c AS VARCHAR)")} % 4 AS h FROM turns GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s
  FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, d, s[1:d] AS k, d = len(s) AS ends
             FROM rebuilt, unnest(range(0, len(s) + 1)) AS u(d)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(kids.n, 0) AS n_children, (kids.n IS NULL)::BIGINT AS leaf,
         CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(
           k[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN kids USING (d, k)),
totals AS (SELECT a AS d, k[1:a] AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
           FROM valued, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN totals USING (d, k)
LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.k[1:v.d - 1]
"""

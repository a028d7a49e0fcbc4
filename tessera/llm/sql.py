"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS s FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS x FROM p),
g AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS first FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos FROM g WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(coalesce(gone, []), x[2])], ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = rf"""
WITH b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, s, p.n FROM p JOIN win ON p.x = win.x AND p.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
p AS (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
k AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, x) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS pos FROM k WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len([x FOR x IN w IF regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_letter_words,
    len([x FOR x IN lines IF regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)')]) AS n_bullets,
    len([x FOR x IN lines IF regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')]) AS n_ellipses
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= 3 * n_words AND 2 * n_dup_lines <= n_lines AND word_chars BETWEEN 2 * n_words AND 20 * n_words
  AND 10 * n_letter_words >= 8 * n_words AND (n_bullets <= 1 OR 10 * n_bullets <= 9 * n_lines) AND (n_ellipses <= 1 OR 10 * n_ellipses <= 3 * n_lines) AS kept
FROM b
"""

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, m, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, (VALUES (1), (2), (3), (4), (5)) AS sizes(m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
s AS (
  SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN b z ON z.lang = b.lang AND z.m > b.m AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b ANTI JOIN held USING (lang, phrase)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL = {"op13_phrases": OP13, "op3_minhash_near_dedup": OP3, "op4_chat_format": OP4, "op6_substring_dedup": OP6, "op8_decontaminate": OP8, "op10_quality_rules": OP10}

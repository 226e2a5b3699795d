"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import repetition

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), least AS (
  SELECT key, min(doc_id) AS keeper FROM keys WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> l.keeper, false) AS gone
  FROM keys k LEFT JOIN least l ON k.key = l.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), k AS (
  SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0
), ds AS (
  SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM d, k WHERE len(w) >= k
), bs AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM b WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
), c AS (
  SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM bs JOIN ds ON bs.s = ds.s AND bs.k = ds.k GROUP BY ALL
)
SELECT doc_id, c.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM c JOIN n ON c.item_id = n.item_id WHERE 5 * n_shared >= 4 * n_shingles
"""

OP5 = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), p AS (
  SELECT doc_id, o, substring(t, 2 * o + 1, 1398) AS part FROM (SELECT doc_id, t, unnest(range(0, n - 199, 500)) AS o FROM b WHERE n >= 200)
), w AS (
  SELECT doc_id, o + i AS i, md5(substring(part, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, o, part, unnest(range(0, length(part) // 2 - 199)) AS i FROM p)
), again AS (
  SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS fresh FROM again
), numbered AS (
  SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT s.doc_id, a, z, substring(t, 2 * lag(z, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) + 1, 2 * (a - lag(z, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a))) AS gap
  FROM spans s JOIN b ON s.doc_id = b.doc_id
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS z, string_agg(gap, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id
)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN t ELSE kept || substring(t, 2 * z + 1) END)) AS kept_sha256
FROM b LEFT JOIN cut c ON b.doc_id = c.doc_id
"""

_OVER = " OR ".join(f"d{k} > least({most!r}e0, {repetition.USUAL[k]!r}e0 + {repetition.ONE_LINE}e0 / greatest(n_words, 1)) * word_chars" for k, most in repetition.NGRAMS.items())
_COVERED = "\n".join(
    f""", g{k} AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again FROM (
    SELECT doc_id, i, concat_ws(' ', x{"".join(f", lead(x, {j}) OVER along" for j in range(1, k))}) AS gram, lead(x, {k - 1}) OVER along AS last
    FROM ws WINDOW along AS (PARTITION BY doc_id ORDER BY i)) WHERE last IS NOT NULL
), c{k} AS (
  SELECT doc_id, sum(length(x)) AS d{k} FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM g{k} WHERE again) JOIN ws USING (doc_id, i) GROUP BY doc_id
)"""
    for k in repetition.NGRAMS
)

OP7 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), lines AS (
  SELECT doc_id, line, count(*) - 1 AS more, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
), said AS (
  SELECT doc_id, sum(more)::BIGINT AS n_dup_lines, sum(more + 1)::BIGINT AS n_lines, sum(more * chars)::BIGINT AS dup_line_chars FROM lines GROUP BY doc_id
), ws AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), three AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) > 1 AS twice FROM (
    SELECT doc_id, i, x, lead(x) OVER along AS y, lead(x, 2) OVER along AS z FROM ws WINDOW along AS (PARTITION BY doc_id ORDER BY i)) WHERE z IS NOT NULL
), repeated AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS j FROM three WHERE twice) GROUP BY doc_id
){_COVERED}, j AS (
  SELECT base.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(d{k}, 0) AS d{k}" for k in repetition.NGRAMS)}
  FROM base LEFT JOIN said USING (doc_id) LEFT JOIN repeated USING (doc_id) {" ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in repetition.NGRAMS)}
), v AS (
  SELECT *, n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {repetition.MOST_REPEATED} * n_words AS base_failed FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_dup_lines > {repetition.LINES}e0 * n_lines OR dup_line_chars > {repetition.LINE_CHARS}e0 * word_chars OR {_OVER}) AS kept
FROM v
"""

ORACLES: dict[str, str] = {
    "op5_repeated_substrings": OP5,
    "op7_repetition": OP7,
    "op9_decontamination": OP9,
    "op10_line_dedup": OP10,
}

"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from boxlake.llm.quality import BOILERPLATE

WORD = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), ranked AS (
  SELECT h.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS nth
  FROM hosts h LEFT JOIN rules r
    ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host))
   AND starts_with(h.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
"""

_PHRASES = "|".join(BOILERPLATE)

OP5 = rf"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT k, regexp_extract_all(text, '{WORD}') AS ws FROM doc)
), grams AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n
  FROM (SELECT k, i,
               CASE WHEN lead(w, 4) OVER (PARTITION BY k ORDER BY i) IS NOT NULL THEN
                 concat_ws(' ', w, lead(w, 1) OVER (PARTITION BY k ORDER BY i),
                   lead(w, 2) OVER (PARTITION BY k ORDER BY i),
                   lead(w, 3) OVER (PARTITION BY k ORDER BY i),
                   lead(w, 4) OVER (PARTITION BY k ORDER BY i)) END AS g
        FROM words) WHERE g IS NOT NULL
), repeated AS (
  SELECT k, count(*) AS n FROM (
    SELECT DISTINCT k, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS i FROM grams WHERE n > 1)
  GROUP BY k
), lines AS (
  SELECT k, line, n, row_number() OVER (PARTITION BY k, line ORDER BY n) AS nth,
         regexp_extract_all(line, '{WORD}') AS ws
  FROM (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
        FROM (SELECT k, string_split(text, chr(10)) AS ls FROM doc))
), judged AS (
  SELECT k, nth, len(ws) AS n, len(list_aggregate(ws, 'string_agg', '')) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^|>]', '', 'g')) AS separators,
         len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS shouts,
         regexp_matches(ws[len(ws)], '[.!?:;"'')\]…”»]$') AS closed,
         regexp_matches(lower(line), '{_PHRASES}') AS phrase
  FROM lines WHERE len(ws) > 0
), failed AS (
  SELECT *, 100 * symbols > 20 * n OR 100 * shouts > 30 * n OR (n < 4 AND NOT closed)
            OR (separators >= 3 AND 100 * separators > 12 * n) OR phrase AS fails
  FROM judged
), per_doc AS (
  SELECT k, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars,
         (count(*) FILTER (WHERE nth > 1))::BIGINT AS n_dup_lines,
         (count(*) FILTER (WHERE fails))::BIGINT AS n_failed_lines,
         coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost_chars
  FROM failed GROUP BY k
), counted AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM doc LEFT JOIN per_doc USING (k) LEFT JOIN repeated r USING (k)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * lost_chars <= 50 * word_chars AS kept
FROM counted
"""

OP1 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM doc
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles AS x JOIN shingles AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) AS p
  JOIN sizes AS m ON m.doc_id = a JOIN sizes AS n ON n.doc_id = b
  WHERE 100 * shared >= 75 * (m.n + n.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
), lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)
"""

OP10 = rf"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)
), windows AS (
  SELECT doc_id, i, w,
         CASE WHEN count(*) OVER next = 20 THEN string_agg(w, ' ') OVER next END AS g
  FROM words WINDOW next AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT doc_id, i, w, CASE WHEN g IS NOT NULL
    THEN row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 ELSE false END AS again FROM windows
), covered AS (
  SELECT doc_id, i, w, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) AS d LEFT JOIN kept AS k USING (doc_id)
"""

OP4 = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b,
         CASE WHEN 2 * i + 100 <= length(h) THEN substr(h, 2 * i + 1, 100) END AS g
  FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM doc)
), judged AS (
  SELECT doc_id, i, b, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM bytes
), covered AS (
  SELECT doc_id, i, b, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged
), edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens
  FROM covered
), kept AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed,
         count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS h
  FROM edged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM (SELECT doc_id FROM documents) AS d LEFT JOIN kept AS k USING (doc_id)
"""

def _centroid_sql(clusters: int = 16, rounds: int = 3, size: int = 64) -> str:
    def nearest(means: str) -> str:
        return f"""
  SELECT v, d, c FROM (
    SELECT v, c, sum((x - m) ** 2)::BIGINT AS d,
           row_number() OVER (PARTITION BY v ORDER BY sum((x - m) ** 2), c) AS nth
    FROM parts JOIN {means} USING (i) GROUP BY v, c) WHERE nth = 1"""

    steps = ""
    for n in range(rounds):
        steps += f""", near{n} AS ({nearest(f"mean{n}")}
), mean{n + 1} AS (
  SELECT c, i, coalesce(s, m) AS m FROM mean{n} LEFT JOIN (
    SELECT c, i, CASE WHEN sum(x) % count(*) < 0 THEN (sum(x) - sum(x) % count(*)) // count(*) - 1
                      ELSE (sum(x) - sum(x) % count(*)) // count(*) END::BIGINT AS s
    FROM near{n} JOIN parts USING (v) GROUP BY c, i) USING (c, i)
)"""
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS v, vec_id, [x::DOUBLE FOR x IN embedding] AS e
  FROM embeddings WHERE len(embedding) = {size}
), whole AS (
  SELECT v, vec_id, [floor({size} * x)::BIGINT FOR x IN e] AS e FROM vectors
  WHERE len([x FOR x IN e IF x IS NOT NULL AND isfinite(x)]) = {size}
), parts AS (SELECT v, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM whole),
mean0 AS (
  SELECT c, i, x AS m FROM parts JOIN (
    SELECT v, row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || vec_id::VARCHAR), e) - 1 AS c
    FROM whole) USING (v) WHERE c < {clusters}
){steps}, last AS ({nearest(f"mean{rounds}")}
), named AS (
  SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM mean{rounds} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, d AS distance,
       (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM last JOIN whole USING (v) JOIN named USING (c)
"""


ORACLES = {
    "op1_minhash_groups": OP1, "op3_url_rules": OP3, "op4_suffix_repeats": OP4,
    "op5_line_quality": OP5,
    "op10_seed_extend": OP10, "op12_table_centroids": _centroid_sql(),
}

"""DuckDB SQL for the queries that SQL can express on whole tables."""

WORDS = r"""words AS (
  SELECT doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
)"""

OP6 = (
    "WITH RECURSIVE "
    + WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s
  FROM words
),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
tokens AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 90 * (nx + ny - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x, x AS y FROM edges
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
),
least_of AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id
FROM sized LEFT JOIN least_of ON doc_id = x
"""
)

OP9 = r"""
WITH lines AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents
),
rows_ AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM lines),
pairs AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM rows_),
starts AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS k FROM pairs WHERE b IS NOT NULL
),
gone AS (SELECT doc_id, i FROM starts WHERE k > 1 UNION SELECT doc_id, i + 1 FROM starts WHERE k > 1),
cuts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT r.doc_id, string_agg(line, chr(10) ORDER BY r.i) AS text
  FROM rows_ r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i WHERE g.i IS NULL GROUP BY r.doc_id
)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN c.n IS NULL THEN coalesce(d.text, '') ELSE coalesce(k.text, '') END) AS kept_sha256
FROM lines l JOIN documents d USING (doc_id) LEFT JOIN cuts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP10 = (
    "WITH "
    + WORDS.format(text="coalesce(text, '')")
    + """,
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50)
),
first AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
later AS (SELECT doc_id, i FROM windows JOIN first USING (h) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, (SELECT unnest(range(0, 50)) AS k)),
cuts AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]), ' ') END) AS kept_sha256
FROM words LEFT JOIN cuts USING (doc_id)
"""
)

SQL = {"op6_ngram_jaccard": OP6, "op9_line_dedup": OP9, "op10_substring_dedup": OP10}

"""DuckDB SQL for the queries that SQL can express."""

LINES = """
rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
wins AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w
  FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM rows WHERE len(ls) >= 3)
),
firsts AS (
  SELECT w, doc_id AS fdoc, pos AS fpos FROM wins
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) = 1
),
later AS (
  SELECT doc_id, pos FROM wins JOIN firsts USING (w)
  WHERE NOT (doc_id = fdoc AND pos < fpos + 3)
),
gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM later, (VALUES (0), (1), (2)) v(k)),
kept AS (
  SELECT l.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS removed_lines,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept_text
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM rows) l
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
  GROUP BY l.doc_id
)
"""

OP3 = f"""
WITH {LINES.format(docs="documents")}
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL WHEN k.removed_lines > 0 THEN k.kept_text ELSE r.text END AS text,
       CAST(CASE WHEN r.text IS NULL THEN 0 ELSE len(r.ls) END AS INTEGER) AS n_lines,
       CAST(coalesce(k.removed_lines, 0) AS INTEGER) AS removed_lines
FROM rows r LEFT JOIN kept k USING (doc_id)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

RECORD_BYTES = """strlen('WARC/1.0') + strlen('WARC-Type: resource') + strlen('WARC-Record-ID: <urn:page:>') + strlen('WARC-Target-URI: ')
  + strlen('Content-Length: ') + 16 + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(html) + strlen(CAST(strlen(html) AS VARCHAR))"""

OP10 = f"""
WITH n AS (SELECT greatest(1, ceil(count(*) / 4096.0)) AS volumes FROM pages),
archive AS (
  SELECT CAST(page_id AS VARCHAR) AS id, url AS uri, page_id, html, {RECORD_BYTES} AS length,
         CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || chr(10) || url), 1, 8) AS BIGINT) % CAST(volumes AS BIGINT) AS volume
  FROM pages, n
),
placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY volume ORDER BY id, uri) - length AS BIGINT) AS start FROM archive
)
SELECT id, uri, volume, start, CAST(length AS BIGINT) AS length, CASE WHEN page_id % 89 = 3 THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE page_id % 89 = 3 OR (page_id % 97 = 5 AND html <> '#' || substr(html, 2))
UNION ALL
SELECT CAST(page_id AS VARCHAR), url,
       CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || chr(10) || url), 1, 8) AS BIGINT) % CAST(volumes AS BIGINT),
       -1, CAST({RECORD_BYTES} AS BIGINT), 'extra'
FROM (SELECT -page_id - 1 AS page_id, url, html FROM pages WHERE page_id % 83 = 7), n
"""

ORACLE = {"op3_window_dedup": OP3, "op6_histogram_topk": OP6, "op10_merkle_warc": OP10}

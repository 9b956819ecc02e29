"""DuckDB twins of those training-data queries whose results SQL can tell plainly.

op4 finds neighbours by a graph; its twin looks at all pairs, so they agree where the graph's recall is 1, as it is on
small tables.  op6 ranks few positions; its twin compares every string of 400 bytes.
"""

ORACLE: dict[str, str] = {
    "op4_nn_descent": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
  u AS (SELECT vec_id, e, list_reduce([x * x for x in e], lambda s, x: s + x) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  o AS (SELECT * FROM u WHERE n > 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce([z[1] * z[2] for z in list_zip(q.e, c.e)], lambda s, x: s + x) / (sqrt(c.n) * sqrt(q.n)) AS score FROM o q JOIN o c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_suffix_array_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
  p AS (SELECT r, i, md5_number(h[i + 1:i + 400]) AS w FROM (SELECT r, h, unnest(range(0, greatest(0, octet_length(h) - 399))) AS i FROM d)),
  s AS (SELECT r, i FROM p WHERE w IN (SELECT w FROM p GROUP BY w HAVING count(*) > 1)),
  g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s)),
  c AS (SELECT r, n, min(i) AS b, max(i) + 400 AS e FROM g GROUP BY r, n),
  k AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS was, lead(b) OVER (PARTITION BY r ORDER BY b) AS nxt FROM c),
  x AS (SELECT d.r, count(*) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed, string_agg(hex(h[was + 1:b]), '' ORDER BY b) || coalesce(max(hex(h[e + 1:])) FILTER (nxt IS NULL), '') AS kept FROM k JOIN d USING (r) GROUP BY d.r)
  SELECT doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hex(h)))) AS kept_sha256 FROM d LEFT JOIN x USING (r)""",
}

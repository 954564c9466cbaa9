"""DuckDB SQL of the queries that SQL can express on whole tables."""

from lodestar.llm.quality_rules import OP1_SQL

OP4_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, ws, size, unnest(range(1, (len(ws) - size + 2)::BIGINT)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g),
cover AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item)::BIGINT AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid),
dp AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
bp AS (SELECT bid, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM (SELECT row_number() OVER () AS bid, ws FROM b)),
eq AS (SELECT rid, bid, i - j AS diagonal, i, i - row_number() OVER (PARTITION BY rid, bid, i - j ORDER BY i) AS island FROM dp JOIN bp USING (w)),
runs AS (SELECT rid, count(*)::BIGINT AS size, min(i)::BIGINT AS place FROM eq GROUP BY rid, bid, diagonal, island),
longest AS (SELECT rid, max(size) AS size, arg_max(-place, [size, -place]) AS back FROM runs GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated,
  coalesce(longest.size, 0) AS longest_match, coalesce(-longest.back, -1) AS longest_at
FROM d LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid) LEFT JOIN longest USING (rid)
"""

OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, (len(ws) - 33)::BIGINT)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r),
lists AS (SELECT rid, list(p) AS ps, count(*)::BIGINT AS n FROM gone GROUP BY rid),
stay AS (
  SELECT rid, array_to_string(list(wd ORDER BY p), ' ') AS kept
  FROM (SELECT rid, unnest(ws) AS wd, unnest(range(1, len(ws) + 1)) AS p FROM d) t ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(lists.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid) LEFT JOIN stay USING (rid)
"""

ORACLES = {"op1_quality_rules": OP1_SQL, "op4_decontaminate": OP4_SQL, "op8_substring_dedup": OP8_SQL}

"""DuckDB SQL with the same results as those queries that SQL can express."""

from __future__ import annotations

from quarrylens.llm.mixing import MOST, SHARE, WEIGHTS
from quarrylens.llm.urlfilter import RULES

_RULES = ", ".join(f"('{v}', '{r}')" for v, r in RULES)

OP2 = rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules AS (SELECT v, r, split_part(r, '/', 1) AS h, substr(r, strpos(r, '/')) AS p FROM (VALUES {_RULES}) t(v, r)),
fits AS (
  SELECT page_id, host, path, (SELECT max_by({{'v': v, 'r': r}}, length(r)) FROM rules
    WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM fits
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, list_extract({list(map(float, WEIGHTS))}, (place % {len(WEIGHTS)} + 1)::INT) AS weight, source_size * {float(MOST)}::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE AS budget FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 WHERE level < ratio ORDER BY ratio, place LIMIT 1) AS fill FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN fill IS NULL THEN cap ELSE least(cap, fill * weight) END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM s6),
s8 AS (SELECT *, target - base * source_size AS rest FROM s7),
g1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
g2 AS (SELECT g1.*, s8.source_size, s8.target, s8.base + CASE WHEN s8.rest > 0 AND g1.before + g1.size / 2 <= s8.rest THEN 1 ELSE 0 END AS n
  FROM g1 JOIN s8 ON g1.source IS NOT DISTINCT FROM s8.source)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken, source, n::INT AS copies FROM g2
"""


_WORDS = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
near AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
c(x, least_id) USING KEY (x) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT near.y, min(c.least_id) FROM c JOIN near ON c.x = near.x JOIN recurring.c AS o ON o.x = near.y WHERE c.least_id < o.least_id GROUP BY near.y)
SELECT x AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least_id AS component_id FROM c LEFT JOIN n ON n.doc_id = x
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
v AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM t),
later AS (SELECT doc_id, i FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
runs AS (SELECT doc_id, count(*) AS n FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.i = g.i - 1) GROUP BY 1),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(runs.n, 0)::BIGINT AS n_repeats
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN runs USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2, "op3_jaccard_join": OP3, "op6_mixing": OP6, "op8_substring_dedup": OP8}

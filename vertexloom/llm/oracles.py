"""DuckDB SQL for those queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Smallest id reachable over link(a, b), a < b, for node(id): label(id, component), by rounds until nothing changes.
_LABEL = """ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(id, label, act, it) AS (SELECT id, id, true, 0 FROM node UNION ALL
SELECT * FROM (SELECT r.id, least(label, coalesce(m, label)), coalesce(m < label, false), it + 1
  FROM r LEFT JOIN (SELECT ways.b AS id, min(x.label) AS m FROM r x JOIN ways ON x.id = ways.a GROUP BY ways.b) y ON r.id = y.id)
WHERE EXISTS (SELECT 1 FROM r z WHERE z.act)),
label AS (SELECT id, label AS component FROM r WHERE it = (SELECT max(it) FROM r))"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
link AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))),
node AS (SELECT doc_id AS id FROM s), {_LABEL}
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component AS component_id FROM s LEFT JOIN label ON doc_id = id"""

NEAR = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fine AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.95),
node AS (SELECT vec_id AS id FROM v), {_LABEL},
n AS (SELECT a AS id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept
FROM v JOIN label ON vec_id = label.id LEFT JOIN n ON vec_id = n.id"""

_U = "('0x' || substr(md5('mix' || coalesce('+' || source, '-')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"
_DIGITS = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT"

MIX = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, source_size * 2.0::DOUBLE AS top FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
  coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS stopped,
  sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1),
s3 AS (SELECT *, (total - stopped) / open AS level FROM s2),
s4 AS (SELECT *, first_value(CASE WHEN level * weight <= top THEN level END IGNORE NULLS) OVER (ORDER BY top / weight, source NULLS LAST
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fixed FROM s3),
s AS (SELECT source, n, source_size, coalesce(least(top, fixed * weight), top) AS target FROM s4),
c AS (SELECT d.*, n, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  floor(log2(size + 1.0::DOUBLE) * 8)::INTEGER AS class, {_DIGITS} % ceil(n / 4096.0)::BIGINT AS chunk FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, chunk, size DESC, doc_id NULLS FIRST) - 1 AS pos, {_U} AS u FROM c)
SELECT doc_id, size, source_size, target, (size * (floor(rate * (pos + 1) + u) - floor(rate * pos + u)))::BIGINT AS taken FROM k"""

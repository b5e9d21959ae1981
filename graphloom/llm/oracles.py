"""DuckDB SQL for those operators that SQL can express, over the whole tables."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
  SELECT DISTINCT a AS id, a AS to_id FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.to_id
), least AS (SELECT id, min(to_id) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id)::BIGINT AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
"""

WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END::BIGINT AS refers_to
FROM payloads
"""


#: The operator goes on until nothing fits; here as many passes are written out, of which the last ones change nothing (a test counts).
_PASSES = 24


def _pass(rows: str, out: str) -> str:
    """One pass of taking documents in order that still fit, as CTEs named after `out`."""
    return f"""
room_{out} AS MATERIALIZED (SELECT k, any_value(target) - sum(copies * size) AS room FROM {rows} GROUP BY k),
open_{out} AS MATERIALIZED (SELECT r.*, room, rank IS NOT NULL AND size <= room AND copies < 2 AS fits FROM {rows} r JOIN room_{out} USING (k)),
{out} AS MATERIALIZED (SELECT doc_id, k, size, source_size, target, copies + taken::INT AS copies, CASE WHEN NOT taken THEN rank END AS rank FROM (
  SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY k ORDER BY NOT fits, rank, doc_id, size ROWS UNBOUNDED PRECEDING) <= room AS taken FROM open_{out}))"""


MIXING = rf"""
WITH docs AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS size FROM documents),
sizes AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM docs GROUP BY k, source),
weighed AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS top FROM sizes),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM sizes) - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY top / weight, source NULLS LAST) AS nth FROM weighed),
common AS (SELECT arg_min(level, nth) AS c FROM levels WHERE level * weight <= top),
targets AS (SELECT k, source_size, coalesce(least(top, (SELECT c FROM common) * weight), top) AS target FROM levels),
odds AS (SELECT doc_id, k, size, source_size, target, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target * 1.0::DOUBLE / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS expected,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM docs JOIN targets USING (k)),
start AS (SELECT doc_id, k, size, source_size, target, floor(expected)::INT AS copies, CASE WHEN expected > floor(expected) THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rank FROM odds),
{", ".join(_pass(f"p{i}" if i else "start", f"p{i + 1}") for i in range(_PASSES))}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM p{_PASSES}
"""

URL_FILTERS = r"""
WITH base AS (
  SELECT page_id, make_timestamp((1704067200 + page_id * 104729 % 31536000) * 1000000) AS fetched_at,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]*)', 1), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) AS raw FROM pages
), captures AS (SELECT page_id, fetched_at, coalesce(host, '') AS host, CASE WHEN coalesce(raw, '') = '' THEN '/' ELSE raw END AS path FROM base),
hosts AS (SELECT DISTINCT host, (length(host) + ascii(substr(host, 3, 1))) % 4 AS k, (ascii(substr(host, 2, 1)) * 7 + length(host)) % 200 AS s, regexp_replace(host, '^[^.]+\.', '') AS parent FROM captures WHERE host <> ''),
changes AS (
  SELECT 'host' AS kind, host AS pattern, 'block' AS action, s AS day FROM hosts WHERE k IN (0, 1)
  UNION SELECT 'host', host, 'remove', s + 60 FROM hosts WHERE k = 0
  UNION SELECT 'host', host, 'allow', s + 45 FROM hosts WHERE k = 1
  UNION SELECT 'host', host, 'block', s + 120 FROM hosts WHERE k = 1
  UNION SELECT 'domain', parent, 'block', 100 FROM hosts WHERE k = 2
  UNION SELECT 'prefix', host || '/en', 'block', s + 10 FROM hosts WHERE k = 3
), spans AS (
  SELECT kind, pattern, action, make_timestamp((1704067200 + 86400 * day) * 1000000) AS valid_from,
    coalesce(make_timestamp((1704067200 + 86400 * lead(day) OVER (PARTITION BY kind, pattern ORDER BY day)) * 1000000), TIMESTAMP '9999-12-31') AS valid_to FROM changes
), parts AS (SELECT *, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN [host] ELSE string_split(host, '.') END AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM captures WHERE host <> ''),
keys AS (
  SELECT page_id, fetched_at, 2 AS o, i AS depth, 'prefix' AS kind, host || '/' || array_to_string(p[1:i], '/') AS pattern FROM (SELECT *, unnest(range(0, len(p) + 1)) AS i FROM parts)
  UNION ALL SELECT page_id, fetched_at, 1, 0, 'host', host FROM parts
  UNION ALL SELECT page_id, fetched_at, 0, i, 'domain', array_to_string(l[len(l) - i + 1 :], '.') FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts)
), met AS (SELECT k.*, s.action FROM keys k JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern AND s.action <> 'remove' AND fetched_at >= valid_from AND fetched_at < valid_to),
best AS (SELECT page_id, count(*) AS matches, max({'o': o, 'depth': depth, 'kind': kind, 'pattern': pattern, 'action': action}) AS b FROM met GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(matches, 0)::BIGINT AS matches, b.kind AS kind, b.pattern AS pattern, coalesce(b.action, 'none') AS verdict FROM captures c LEFT JOIN best USING (page_id)
"""

"""DuckDB SQL for the operators that SQL can express."""

LINE_WINDOWS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, pos, md5(lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3]) AS h
  FROM (SELECT doc_id, lines, unnest(range(greatest(len(lines) - 2, 0))) AS pos FROM d)
  WHERE regexp_matches(lines[pos + 1] || lines[pos + 2] || lines[pos + 3], '[^ \\t\\r]')),
f AS (SELECT h, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM w GROUP BY h HAVING count(*) > 1),
c AS (
  SELECT DISTINCT w.doc_id, unnest(range(pos, pos + 3)) AS pos FROM w JOIN f USING (h)
  WHERE w.doc_id <> f.first.doc_id OR w.pos - f.first.pos >= 3),
drops AS (SELECT doc_id, list(pos) AS covered FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(covered), 0) AS n_removed,
  md5(CASE WHEN covered IS NULL THEN d.text ELSE
    coalesce(array_to_string([x FOR x, i IN lines IF NOT list_contains(covered, i - 1)], chr(10)), '') END) AS kept_md5
FROM d LEFT JOIN drops USING (doc_id)
"""

HOST_REPUTATION = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h0),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
stats AS (
  SELECT lvl, count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE * n) AS nn, sum(k::DOUBLE * k / n) AS kkn
  FROM (SELECT 'h' AS lvl, n, k FROM h UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 's', n, k FROM s) WHERE n > 0 GROUP BY lvl),
parts AS (
  SELECT lvl, g, n, k / n AS p, (kkn - k * k / n) / nullif(g - 1, 0) AS b, (k - kkn) / nullif(n - g, 0) AS w,
    (n - nn / n) / nullif(g - 1, 0) AS n0 FROM stats),
fit AS (
  SELECT lvl, coalesce(p, 0.5) AS mean,
    1 / coalesce(CASE WHEN g > 1 AND n > g AND b + (n0 - 1) * w > 0 THEN least(greatest((b - w) / (b + (n0 - 1) * w), 0.001), 0.999) END, 0.001) - 1 AS strength
  FROM parts),
fs AS (SELECT (SELECT mean FROM fit WHERE lvl = 's') AS mean, (SELECT strength FROM fit WHERE lvl = 's') AS st),
sm AS (SELECT suffix, (k + st * mean) / (n + st) AS suffix_mean FROM s, fs),
dm AS (SELECT domain, (k + st * suffix_mean) / (n + st) AS domain_mean FROM d JOIN sm USING (suffix), (SELECT strength AS st FROM fit WHERE lvl = 'd')),
hm AS (SELECT host, n, (k + st * domain_mean) / (n + st) AS m, st FROM h JOIN dm USING (domain), (SELECT strength AS st FROM fit WHERE lvl = 'h')),
bound AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (n + st + 1)) AS low FROM hm),
rules(verdict, rule, name, prefix) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
hits AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN low > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN bound USING (host) LEFT JOIN hits ON p.host = hits.host AND p.path = hits.path
"""

WORD_WINDOWS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (
  SELECT r, doc_id, pos, md5(array_to_string(ws[pos:pos + 19], ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS pos FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING count(*) > 1),
c AS (
  SELECT DISTINCT r, unnest(range(pos, pos + 20)) AS i
  FROM (SELECT r, doc_id, h, pos, min(pos) OVER (PARTITION BY h, r) AS p0 FROM w SEMI JOIN f USING (h)) JOIN f USING (h)
  WHERE pos > p0 OR doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)),
k AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN c USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The codebooks' rounds, one after the other, over one row per component."""
    ctes = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c AS MATERIALIZED (
  SELECT r, (i - 1) // (len(q) // {parts}) AS part, (i - 1) % (len(q) // {parts}) AS place, q[i] AS x
  FROM (SELECT r, q, unnest(range(1, len(q) + 1)) AS i FROM v))""",
        f"""b0 AS MATERIALIZED (
  SELECT e AS entry, part, place, x FROM c JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM v QUALIFY e < {entries}) USING (r))""",
    ]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT r, part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY r, part)""")
        if k < rounds:
            ctes.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT entry, part, place, coalesce((s - ((s % n) + n) % n) // n, b.x)::BIGINT AS x
  FROM b{k} b LEFT JOIN (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM c JOIN a{k} USING (r, part) GROUP BY ALL) USING (part, entry, place))""")
    return f"""
WITH {", ".join(ctes)},
o AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (r), s
"""


PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS l,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'name': name, 'l': l} ORDER BY turn NULLS FIRST, role, name) AS s,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
      lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384)))) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, CASE WHEN b.s IS NULL THEN c.s[c.h + 1:] ELSE list_concat(b.s[1:c.h], c.s[c.h + 1:]) END AS s
  FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
k AS MATERIALIZED (
  SELECT conv_id, len(s) AS m, d, md5(array_to_string([x.name FOR x IN s[1:d]], ',')) AS node,
    CASE WHEN d > 0 THEN md5(array_to_string([x.name FOR x IN s[1:d - 1]], ',')) END AS up, CASE WHEN d > 0 THEN s[d].l ELSE 0 END AS l
  FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(l) AS l,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE m = d), '')) AS ends_sha256
  FROM k GROUP BY node),
kids AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.node, b.node AS under FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT below.node, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves, sum((n_convs - 1) * l)::BIGINT AS saved_tokens
  FROM below JOIN n ON n.node = under LEFT JOIN kids ON kids.node = under GROUP BY below.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS p ON p.node = n.up LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node
"""

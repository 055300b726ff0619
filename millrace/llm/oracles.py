"""DuckDB statements of the queries that SQL can express; written apart from the operators' own plans."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('20260:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (
  SELECT source, source_size, rk, (rk - 1) % 3 + 1 AS weight, 3 * source_size::DOUBLE AS cap, 3 * source_size::DOUBLE / ((rk - 1) % 3 + 1) AS ratio
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source)),
l AS (
  SELECT max((total - c) / (w - cw)) AS level
  FROM (SELECT (SELECT sum(source_size) FROM s)::DOUBLE AS total, (SELECT sum(weight) FROM s)::DOUBLE AS w,
               coalesce(sum(cap) OVER b, 0) AS c, coalesce(sum(weight) OVER b, 0)::DOUBLE AS cw
        FROM s WINDOW b AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (
  SELECT s.*, least(cap, level * weight) AS target, greatest(ceil(source_size / 4194304), 1)::BIGINT AS shards,
         (SELECT sum(source_size) // 16 FROM s)::BIGINT AS all_seats, (SELECT sum(source_size) FROM s)::DOUBLE AS total
  FROM s, l),
q AS (
  SELECT rk, target / (2 * k + 1) AS quotient, all_seats
  FROM t, unnest(range(0, CASE WHEN total > 0 THEN (2 * all_seats * target / total)::BIGINT + 2 ELSE 0 END)) AS u(k)
  WHERE target > 0),
won AS (
  SELECT rk, count(*) AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, rk) AS place FROM q) WHERE place <= all_seats GROUP BY rk),
p AS (
  SELECT d.*, t.rk, t.source_size, t.target, coalesce(won.seats, 0) AS seats, ('0x' || substr(d.k, 1, 8))::BIGINT % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.rk = t.rk),
c AS (SELECT rk, shard, seats, sum(size)::BIGINT AS cell_size, count(*) AS docs FROM p GROUP BY rk, shard, seats),
cq AS (
  SELECT rk, shard, cell_size / (2 * k + 1) AS quotient, seats
  FROM c, unnest(range(0, CASE WHEN cell_size > 0 THEN seats + 1 ELSE 0 END)) AS u(k)),
cw AS (
  SELECT rk, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY quotient DESC, shard) AS place FROM cq) WHERE place <= seats GROUP BY rk, shard),
cell AS (
  SELECT c.rk, c.shard, cell_size, least(coalesce(quota, 0) * 16, cell_size * 3)::BIGINT AS words,
         (('0x' || substr(md5('20261:' || c.rk || ':' || c.shard), 1, 8))::BIGINT % greatest(ceil(cell_size / 16), 1)::BIGINT) * 16 AS first
  FROM c LEFT JOIN cw ON c.rk = cw.rk AND c.shard = cw.shard),
o AS (
  SELECT p.*, cell_size, words, first, CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY p.rk, p.shard ORDER BY k, size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
  FROM p JOIN cell ON p.rk = cell.rk AND p.shard = cell.shard),
e AS (SELECT *, fin - size AS beg, first + words - whole * cell_size AS til FROM o)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(least(fin, til) - greatest(beg, first), 0)
        + greatest(least(fin + cell_size, til) - greatest(beg + cell_size, first), 0))::BIGINT AS taken
FROM e
"""

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def codes(rounds: int = 4) -> str:
    """Plain Lloyd rounds: every part against every entry."""
    steps = [
        """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, k AS part, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] AS x FROM e, range(4) AS r(k))),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT vec_id, part, entry, (xx + list_inner_product(c, c) - 2 * list_inner_product(x, c))::BIGINT AS d FROM p JOIN b{k} USING (part)),
a{k} AS (SELECT vec_id, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM d{k} GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT part, entry, place, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM p JOIN a{k} USING (vec_id, part)) GROUP BY ALL),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place)::DOUBLE[] AS m FROM s{k} GROUP BY ALL),
b{k + 1} AS (SELECT part, entry, coalesce(m, c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    last = f"""
h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS place FROM b{rounds})),
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN e USING (vec_id), h"""
    return "WITH " + ",".join(steps) + "," + last


TRIE = """
WITH t AS (
  SELECT conv_id, octet_length(encode(text)) AS bytes, sha256(length(role) || ':' || role || text)[1:32] AS step,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, sha256(length(role) || ':' || role || text)[1:32]) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
i AS (
  SELECT conv_id, conv_id - conv_id % 5 AS donor,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, bytes, step, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth
  FROM (SELECT i.conv_id, 1 AS part, place, bytes, step FROM i JOIN t ON t.conv_id = i.donor AND place <= h
        UNION ALL SELECT i.conv_id, 2, place, bytes, step FROM i JOIN t ON t.conv_id = i.conv_id AND place > h)),
m AS (
  SELECT conv_id, depth, bytes, string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (
  SELECT node, depth, node[1 : 32 * (depth - 1)] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved
  FROM m GROUP BY node, depth),
e AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node),
k AS (SELECT parent AS node, count(*) AS kids FROM n WHERE depth > 0 GROUP BY parent),
s AS (
  SELECT node[1 : 32 * up] AS node, sum(saved) AS saved, sum((kids IS NULL)::INT) AS leaves
  FROM (SELECT n.node, saved, kids, unnest(range(0, depth + 1)) AS up FROM n LEFT JOIN k USING (node)) GROUP BY ALL)
SELECT n.conv_id, n.depth, CASE WHEN n.depth > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs, coalesce(kids, 0) AS n_children, leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN e ON e.node = n.node LEFT JOIN n p ON p.node = n.parent AND p.depth = n.depth - 1
"""

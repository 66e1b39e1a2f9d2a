"""op11: prefix trie of all conversations, rebuilt so that groups of twenty share first turns."""

from pyspark.sql import functions as F

from tidewatch.llm import prefixtrie
from tidewatch.llm.base import query, table

# crc32 has no SQL function: bytes and bits are folded in, with the polynomial's fixed value
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)))"""
SQL = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM r),
s AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS t FROM k GROUP BY 1),
h AS (SELECT conv_id, t, {_CRC} % 4 AS h FROM s),
b AS (SELECT h.conv_id, list_concat(coalesce(s.t[:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN s ON s.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, [x.k FOR x IN t[:d]] AS node, CAST(d AS BIGINT) AS depth, CASE WHEN d > 0 THEN t[d].w ELSE 0 END AS w, len(t) = d AS ends
 FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM b)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT u.node, u.depth, min(v.conv_id) AS parent_conv_id FROM n u JOIN n v ON u.depth = v.depth + 1 AND u.node[:v.depth] = v.node GROUP BY 1, 2),
m AS (SELECT node[:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
q AS (SELECT n.*, c.parent_conv_id, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN c USING (node, depth) LEFT JOIN m USING (node, depth)),
t AS (SELECT a.node, a.depth, sum((z.n_convs - 1) * z.w) AS saved_tokens, count(*) FILTER (z.n_children = 0) AS n_leaves
 FROM q a JOIN q z ON z.depth >= a.depth AND z.node[:a.depth] = a.node GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM q JOIN t USING (node, depth)"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, sf):
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    turns = prefixtrie.with_shared_heads(prefixtrie.keyed(table(spark, sf, "conversations")), 20, h, 3)
    return prefixtrie.trie(turns).drop("node")

"""op7: exact integer inner products of every hundredth embedding with all others."""

from tidewatch.llm import topk
from tidewatch.llm.base import query, table

SQL = """WITH ok AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
dim AS (SELECT len(v) AS n FROM ok GROUP BY 1 ORDER BY count(*) DESC, n DESC LIMIT 1),
g AS (SELECT vec_id, v FROM ok, dim WHERE len(v) = n),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS score
 FROM g a JOIN g b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""


@query("op7_topk", SQL)
def op7_topk(spark, sf):
    return topk.top(table(spark, sf, "embeddings"), k=10, every=100)

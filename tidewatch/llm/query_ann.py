"""op6: nearest neighbours of every hundredth embedding. The found ones have no SQL form; the query is
tested for recall against brute force, and for exact scores."""

from tidewatch.llm import ann
from tidewatch.llm.base import query, table


@query("op6_ann")
def op6_ann(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), k=10, every=100)

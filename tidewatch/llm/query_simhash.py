"""op1: SimHash near-duplicate groups of all documents. XXH64 has no SQL counterpart in the oracle's
engine, so it is tested against brute force."""

from tidewatch.llm import simhash
from tidewatch.llm.base import query, table


@query("op1_simhash")
def op1_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"), words=3, budget=3)

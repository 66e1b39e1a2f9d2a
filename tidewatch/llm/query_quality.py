"""op8: quality of all documents; trained views have no SQL form, so it is tested by held-out accuracy."""

from tidewatch.llm import quality
from tidewatch.llm.base import fold, query, table


@query("op8_quality")
def op8_quality(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels").where(fold("doc_id", 5) != 0))
    out = quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "text_score", "meta_score")

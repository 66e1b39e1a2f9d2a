"""op4: toxicity scores of all documents; a trained model has no SQL form, so it is tested by held-out accuracy."""

from pyspark.sql import functions as F

from tidewatch.llm import toxicity
from tidewatch.llm.base import fold, query, table


def model(docs, labels):
    """Fitted on labels of documents outside the held-out fold."""
    return toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    out = toxicity.score(docs.select("doc_id", "text", "lang"), model(docs, table(spark, sf, "labels")))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "flagged")

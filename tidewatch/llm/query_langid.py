"""op9: language of all documents; suffix automata have no SQL form, so it is tested against a
brute-force parse and by held-out accuracy."""

from tidewatch.llm import langid
from tidewatch.llm.base import fold, query, table


def model(docs):
    """Fitted on documents outside the held-out fold."""
    return langid.train(docs.where(fold("doc_id", 4) != 2))


@query("op9_langid")
def op9_langid(spark, sf):
    docs = table(spark, sf, "documents")
    out = langid.identify(docs.select("doc_id", "text"), model(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

"""op3: BPE ids of all documents and their decoded texts, tested against the library."""

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import bpe
from tidewatch.llm.base import query, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query("op3_bpe")
def op3_bpe(spark, sf):
    out = bpe.encode(table(spark, sf, "documents"), TOKENIZER)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

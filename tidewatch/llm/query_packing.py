"""op5: best-fit packing of all documents. Tokenizing has no SQL form, so it is tested against the
library and exact lower bounds."""

import public_tokenizers

from tidewatch.llm import packing
from tidewatch.llm.base import query, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op5_packing")
def op5_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), TOKENIZER, capacity=1024, end_id=2)

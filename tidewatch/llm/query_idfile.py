"""op12: token ids of all documents, written to Huffman-coded files and read back; tested against the library."""

import public_tokenizers

from tidewatch.llm import idfile
from tidewatch.llm.base import query, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op12_idfile")
def op12_idfile(spark, sf):
    path = idfile.new_path(spark)
    idfile.write_ids(table(spark, sf, "documents"), TOKENIZER, path, end_id=0)
    return idfile.read_documents(spark, path)

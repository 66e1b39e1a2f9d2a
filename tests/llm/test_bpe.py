import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " \n\t", "Hello, World!", "don't WE'LL it's '", "a b c   d", "x<|endoftext|>y <|startoftext|> z", "ÉÉ é İ ΑΣ ΣΑΣ ΑΣ!", "1 22 333", "日本語 🎉🎉",
         "a\x1cb \x85 c", "same same same", "́ ́a", "word " * 3000]


def brute(text, lib):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.asarray(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [1, 200, 10**7])
def test_encode_equals_the_library(spark, block):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(df, PATH, block=block).collect()), key=str)
    assert got == sorted(((i, *brute(t, lib)) for i, t, _ in rows), key=str)


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_decode_joins_pieces(spark):
    lib = Tokenizer.from_file(PATH)
    ids = [lib.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "k long, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df, PATH, "k").collect()} == {i: lib.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_query_against_the_library(spark):
    from tidewatch.llm.queries import QUERIES
    sf, lib = "/root/testdata/sf0.01", Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, ids, text = brute(r.text, lib)
        want[r.doc_id] = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, sf).collect()} == want

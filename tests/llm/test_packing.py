import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " a", "a ", "  ", "a  b", "a   b", "a \n b", "a\n \nb", "\n\n a", "a <|endoftext|> b", "x <|endoftext|>", "tab\tx \t y", "é ü  ß 日本語 🎉",
         "don't we'll  it's '", "a   b", "a  b", "1 22 333  4", "x " * 500, "\x1c \x1d", " \n", "a \n\n\nb  \n c", "a᠎ ᠎b"]


def test_words_encode_like_the_library():
    lib, enc = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice([" ", " ", "\n", "a", "Bc", "1", "!", "'s", "é", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def optimum(items, capacity):
    """Fewest sequences, by trying everything."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in {b for b in bins if b >= items[i]}:
            k = bins.index(r)
            go(i + 1, bins[:k] + [r - items[i]] + bins[k + 1:])
        go(i + 1, bins + [capacity - items[i]])
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_runs_hold_everything_and_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 24])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    runs = packing.solve(Counter(items), capacity)
    assert Counter(s for p, m in runs for s in p * m) == Counter(items)
    assert all(sum(p) <= capacity for p, _ in runs)
    fixed, rest = packing.reduce_by_dominance(Counter(items), capacity)
    left = [s for s, n in rest.items() for _ in range(n)]
    assert sum(m for _, m in fixed) + optimum(left, capacity) == optimum(items, capacity)


def test_large_counts_are_few_runs():
    rng = random.Random(3)
    counts = {s: rng.randint(0, 10**7) for s in range(1, 1025)}
    runs = packing.solve(counts, 1024)
    got = Counter()
    for p, m in runs:
        for s in p:
            got[s] += m
    assert got == Counter({s: n for s, n in counts.items() if n})
    total = sum(s * n for s, n in counts.items())
    assert len(runs) < 10000 and sum(m for _, m in runs) <= 1.005 * total / 1024 + 5


def check(rows, docs, capacity=1024):
    lib = Tokenizer.from_file(PATH)
    by, at = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        at[r.sequence_id].append(r)
    want = sorted((d, k, s, n, zlib.crc32(np.asarray(ids[s:s + n], "<u4").tobytes()))
                  for d, t in docs for ids in [lib.encode(t or "", add_special_tokens=False).ids + [2]] for k, (s, n) in enumerate(packing.cut(len(ids), capacity)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for own in at.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    return len(at), -(-sum(w[3] for w in want) // capacity)


def test_query_against_the_library(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, bound = check(QUERIES["op5_packing"](spark, sf).collect(), docs)
    assert used <= bound + 3


def test_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, None), (101, "", "piece"), (7, "same id", "length")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, PATH, capacity=16).collect()
    check(got, [(r[0], r[1]) for r in rows], 16)
    assert packing.pack_documents(df.where("doc_id > 1000"), PATH).collect() == []
    null = packing.pack_documents(spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert len(null) == 2 and len({r.sequence_id for r in null}) == 1

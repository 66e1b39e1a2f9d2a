import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import byteids, idfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    """Bits of an unlimited Huffman code."""
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def best_cost(counts, limit):
    """Bits of the best code of at most ``limit`` bits, by trying all length profiles."""
    counts, best = sorted(counts, reverse=True), [1 << 60]

    def go(i, least, room, cost):
        if cost >= best[0] or room < 0:
            return
        if i == len(counts):
            best[0] = cost
            return
        for n in range(least, limit + 1):
            go(i + 1, n, room - (1 << (limit - n)), cost + n * counts[i])
    go(0, 1, 1 << limit, 0)
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_code_lengths_are_the_best_within_the_limit(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 1, 1, 2, 5, 40, 1000]) for _ in range(rng.randint(2, 9))])
    used = counts[counts > 0]
    for limit in (4, 20):
        n = idfile.code_lengths(counts, limit)
        assert ((n > 0) == (counts > 0)).all() and n.max(initial=0) <= limit
        if len(used) > 1:
            assert sum(2.0 ** -int(x) for x in n if x) == 1.0
            assert int((n * counts).sum()) == (huffman_cost(used.tolist()) if limit == 20 else best_cost(used.tolist(), 4))


def test_code_lengths_of_special_counts():
    assert idfile.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    assert idfile.code_lengths(np.array([0, 7])).tolist() == [0, 1]
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert idfile.code_lengths(np.array(fib), 12).max() == 12
    with pytest.raises(ValueError):
        idfile.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 511, 512, 5000])
@pytest.mark.parametrize("symbols", [1, 2, 300])
def test_blocks_round_trip(n, symbols):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, symbols - 1).astype(np.int64)
    lengths = idfile.code_lengths(np.bincount(ids, minlength=symbols) + 1).tobytes()
    for every in (1, 7, 256):
        data = idfile.encode_block(ids, [n], 5, lengths, every)
        got, docs, before = idfile.decode_block(data, lengths)
        assert (got == ids).all() and len(got) == n and docs.tolist() == [n] and before == 5


def test_damaged_blocks_are_refused():
    ids = np.random.default_rng(1).integers(0, 50, 3000)
    lengths = idfile.code_lengths(np.bincount(ids)).tobytes()
    data = bytearray(idfile.encode_block(ids, [3000], 0, lengths))
    with pytest.raises(ValueError):
        idfile.decode_block(bytes(data[:-9]), lengths)
    with pytest.raises(ValueError):
        idfile.decode_block(b"nope" + bytes(data[4:]), lengths)


def test_joined_checksums():
    rng = random.Random(2)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice([0, 1, 5, 1000])) for _ in range(rng.randint(0, 5))]
        assert idfile.crc_joined((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_long_texts_in_segments(monkeypatch):
    lib = Tokenizer.from_file(PATH)
    texts = ["one two,  three\nfour " * 40 + "end", " lead", "", None, "a   b " * 30, "x", "<|endoftext|> z"]
    for size in (1, 7, 50):
        monkeypatch.setattr(byteids, "SEGMENT", size)
        ids, n = byteids.WordIds(PATH).batch(texts, 9)
        want = [lib.encode(t or "", add_special_tokens=False).ids + [9] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def brute(rows):
    """(doc_id, start, n, crc) in ascending order of ids, null first."""
    lib, out, start = Tokenizer.from_file(PATH), [], 0
    coded = [(i, np.asarray(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows]
    order = lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(np.frombuffer(x[1], "<u4").astype("<u2").tobytes()))
    for i, b in sorted(coded, key=order):
        out.append((i, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    return out


@pytest.mark.parametrize("block", [1, 5, 64, 1 << 17])
def test_files_against_brute_force(spark, block):
    rows = [(5, "five five"), (-2, None), (5, "again, longer"), (None, "no id"), (7, ""), (5, "five five"), (1000, "long " * 400), (None, None),
            (8, "tab\tx  y <|endoftext|>")] + [(2000 + i, f"row {i}") for i in range(50)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, ids string, uid int").repartition(3)
    path = idfile.new_path(spark)
    idfile.write_ids(df, PATH, path, block=block, every=16)
    got = sorted((tuple(r) for r in idfile.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    whole = {}
    for r in idfile.read_pieces(spark, path).collect():
        whole.setdefault(r.start, []).append((r["at"], bytes(r.ids)))
    assert [zlib.crc32(b"".join(x for _, x in sorted(whole[s]))) for _, s, _, _ in got] == [c for *_, c in got]


def test_empty_table_and_text_ids(spark):
    path = idfile.new_path(spark)
    idfile.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert idfile.read_documents(spark, path).collect() == []
    path = idfile.new_path(spark)
    idfile.write_ids(spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string"), PATH, path)
    assert [(r.doc_id, r.start, r.n_tokens) for r in idfile.read_documents(spark, path).orderBy("start").collect()] == [("a", 0, 3), ("b", 3, 2)]


def test_query_against_the_library(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_idfile"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == brute(docs)

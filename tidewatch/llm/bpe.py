"""BPE encoding and decoding over a table of distinct words.

Words are runs without ASCII white space; the tokenizers meant here never merge across white space,
so a text's ids are its words' ids, one after the other. Three steps:

1. Split. Documents are split where they are read, in blocks of about ``BLOCK`` bytes of text. A block
   becomes one row of word positions (numbers into its own list of distinct words, the most frequent
   first, packed) and one row per word bucket with the block's distinct words of that bucket. Text is
   never shuffled, and a word counts once per block, so frequent words make no hot key.
2. Encode. All rows of a bucket meet in one task, which encodes each distinct word once, by the
   tokenizers library, and answers every block with its words' ids.
3. Join back. A block's ids and positions meet again; a document's ids are those of its words by
   position, and its decoded text joins ids to their pieces once per distinct word of the block.

Positions and words come from two passes over the documents, which is cheaper than keeping the split.
The key of a block is a hash of its word list, and a block whose words are not all answered fails the
job: so should the input come in another order the second time (it should be a stored table), no wrong
ids can result.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids of rows may be null
or repeat; an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import release, tasks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BLOCK = 4_000_000  # bytes of text whose words share one list
AT_ONCE = 20_000  # words per call of the library


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizer of a file, and the piece of each id."""
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    pieces = [""] * (1 + max(lib.get_vocab(True).values(), default=0))
    for piece, i in lib.get_vocab(True).items():
        pieces[i] = piece
    return lib, pieces


def packed(*parts: bytes) -> bytes:
    return zstandard.compress(b"".join([len(p).to_bytes(8, "little") + p for p in parts]), 3)


def unpacked(blob: bytes) -> list[memoryview]:
    raw, at, out = memoryview(zstandard.decompress(blob)), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(raw[at + 8:at + 8 + n])
        at += 8 + n
    return out


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 byte by byte, the lowest bytes of all first: high bytes compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(raw: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def split_words(df: DataFrame, buckets: int, positions: bool, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per block of documents, with ``positions`` one row (block, docs, data) of its documents and their
    words' positions, without it rows (block, bucket, data) of its distinct words by bucket."""
    kind = df.schema[doc_id].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        type_ = None
        ids, texts, size = [], [], 0

        def rows():
            index = defaultdict()
            index.default_factory = index.__len__
            found = [np.fromiter(map(index.__getitem__, t.split()), np.uint32) for t in texts]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
            counts = np.bincount(flat, minlength=len(index))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            words = list(index)
            words = [words[i] for i in order.tolist()]
            own_key = pa.array([xxhash.xxh64_intdigest(b" ".join(words), number % (1 << 63)) - (1 << 63)], pa.int64())
            if positions:
                data = packed(planes(np.array([len(f) for f in found])), planes(rank[flat]))
                return [pa.RecordBatch.from_arrays(
                    [own_key, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, type_)), pa.array([data], pa.binary())],
                    names=["block", "docs", "data"])]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            by = np.argsort(bucket, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []
            out = [packed(planes(np.diff(part, prepend=0)), b" ".join([words[i] for i in part.tolist()])) for part in parts]
            return [pa.RecordBatch.from_arrays(
                [pa.array(own_key.to_pylist() * len(out), pa.int64()), pa.array([int(bucket[part[0]]) for part in parts], pa.int32()), pa.array(out, pa.binary())],
                names=["block", "bucket", "data"])]

        for b in batches:
            type_ = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if size + len(t) > block and texts:
                    yield from rows()
                    number, ids, texts, size = number + 1, [], [], 0
                    release()
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield from rows()
        ids, texts = [], []
        release()

    return df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(
        work, f"block long, docs array<{kind}>, data binary" if positions else "block long, bucket int, data binary")


def encode_words(words: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """(block, ids): the blocks' distinct words as ids. Each distinct word is encoded once, in the task of its bucket."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, _ = library(tokenizer)
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                steps, own = unpacked(data)
                own = bytes(own).split(b" ")
                new = [w for w in own if w not in known]
                for i in range(0, len(new), AT_ONCE):
                    part = new[i:i + AT_ONCE]
                    got = lib.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)
                    known.update((w, np.asarray(e.ids, np.uint32)) for w, e in zip(part, got))
                ids = [known[w] for w in own]
                out = packed(bytes(steps), planes(np.array([len(x) for x in ids])), planes(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([out], pa.binary())], names=["block", "ids"])
        known.clear()
        release()

    return words.select("block", "data", "bucket").repartition(buckets, "bucket").select("block", "data").mapInArrow(work, "block long, ids binary")


def encode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_tokens, ids, decoded): ``ids`` as little-endian unsigned 32-bit numbers, as
    the library's encode without special tokens gives them, ``decoded`` as its decode with special tokens kept."""
    buckets = tasks(df)
    kind = df.schema[doc_id].dataType.simpleString()
    coded = encode_words(split_words(df, buckets, False, doc_id, text, block), tokenizer, buckets)
    docs = split_words(df, buckets, True, doc_id, text, block)
    # a few blocks to a task, by the size of the scanned files
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if df.inputFiles() else 0
    parts = max(buckets, min(size, 1 << 50) // (2 * BLOCK))
    answer = coded.repartition(parts, "block").groupBy("block").agg(F.collect_list("ids").alias("ids"))
    both = docs.repartition(parts, "block").join(answer, "block", "left").select("docs", "data", "ids")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = library(tokenizer)
        for b in batches:
            for k in range(b.num_rows):
                docs = b.column(0).slice(k, 1).flatten()
                yield from _joined(docs, b.column(1)[k].as_py(), b.column(2)[k].as_py() or [], pieces)
                release()

    return both.mapInArrow(work, f"doc_id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("doc_id", doc_id)


def _joined(docs: pa.Array, data: bytes, answers: list[bytes], pieces: list[str]) -> Iterator[pa.RecordBatch]:
    """Documents of one block: ids and decoded text by word position."""
    lens, flat = (numbers(x) for x in unpacked(data))
    parts = [[numbers(x) for x in unpacked(a)] for a in answers]
    at = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    number = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    ids = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
    if len(at) != (int(flat.max()) + 1 if len(flat) else 0):
        raise RuntimeError("a block's words are not all encoded: the documents came in another order the second time; store them first")
    n, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], start[at] = number, np.cumsum(number) - number
    listed, words = ids.tolist(), [""] * len(at)
    for i, s, k in zip(at.tolist(), (np.cumsum(number) - number).tolist(), number.tolist()):
        words[i] = pieces[listed[s]] if k == 1 else " ".join([pieces[j] for j in listed[s:s + k]])
    silent = bool(len(n)) and not n.all()  # words without any id leave no gap in the decoded text
    ends = np.cumsum(lens, dtype=np.int64)
    step = 512
    for i in range(0, len(lens), step):
        out_n, out_ids, out_text = [], [], []
        for e, m in zip(ends[i:i + step].tolist(), lens[i:i + step].tolist()):
            p = flat[e - m:e]
            k = n[p]
            total = int(k.sum())
            src = np.repeat(start[p] - (np.cumsum(k) - k), k) + np.arange(total)
            out_n.append(total)
            out_ids.append(ids[src].astype("<u4").tobytes())
            text = [words[j] for j in p.tolist()]
            out_text.append(" ".join([w for w in text if w] if silent else text))
        yield pa.RecordBatch.from_arrays([docs.slice(i, step), pa.array(out_n, pa.int64()), pa.array(out_ids, pa.binary()),
                                          pa.array(out_text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


def decode(df: DataFrame, tokenizer: str, row_key: str, ids: str = "ids") -> DataFrame:
    """(row_key, decoded) of any array column of ids, by a join with the table of pieces.

    The table has one row per id of the tokenizer file, a fixed size, so it is broadcast. An unknown
    id has no piece and is left out, as the library does; ``row_key`` tells rows apart."""
    _, pieces = library(tokenizer)
    vocab = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(pieces) if p], "id int, piece string")
    long = df.select(row_key, F.posexplode_outer(ids).alias("pos", "id"))
    got = long.join(F.broadcast(vocab), "id", "left").groupBy(row_key).agg(
        F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return got.select(row_key, F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))

"""Token ids in files: canonical length-limited Huffman codes, blocks that decode by themselves.

Writing takes three steps:

1. Documents become ids where they are read, each followed by the end id, and are stored with a number
   that tells rows apart.
2. Ids are counted over all documents. The counts, at most one per id of the tokenizer, give code
   lengths of at most ``LIMIT`` bits by package-merge, the shortest total there is under that limit.
   Codes are canonical, so the lengths alone are kept as the table ``codes``.
3. Documents are range-partitioned and sorted by id and written as the table ``blocks``: a row holds
   ``BLOCK`` ids of consecutive documents, with how many ids each has there, the bits, and the bit
   offset of every ``EVERY``-th id as a checkpoint. A document may run over many blocks.

Reading needs a block and the lengths only. A table of 2^(longest code) entries gives the id and the bits
of the next code; since each checkpoint is a place to begin, all stretches of a block are decoded in
step. Each stretch must end where the next one begins, so damaged bits fail the job.

Layout of a block's ``data``, little-endian: magic ``TWH1``, ids, documents, spacing of checkpoints
(32 bits each), ids of the first document in earlier blocks (64 bits), then per document its ids here,
per checkpoint its bit offset (32 bits each), then the bits, highest first.

Defined cases: a null or empty text is the end id alone; rows of one doc_id follow each other, ordered by
content, and each keeps its own entry; null ids come first; an empty table gives empty files and an
empty result; other columns are not looked at. Texts of any length pass through in segments; their
ids, 4 bytes each, are held once."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import release, slices, tasks
from tidewatch.llm.byteids import forget, word_ids
from tidewatch.plans.lineage import shared_folder, stored

LIMIT = 18  # bits of the longest code, more if the different ids need them
BLOCK = 1 << 18  # ids of a block
EVERY = 128  # ids between two checkpoints
AT_ONCE = 2_000_000  # bytes of texts encoded together
MAGIC = b"TWH1"
HEAD = struct.Struct("<4sIIIQ")


# --- codes --------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of each id, 0 for an id that never occurs: package-merge over the counts."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} different ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, coins = weights, []  # coins: whether an entry of a level is an id or a package of two
    for _ in range(limit - 1):
        pairs = level[:len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        coins.append(by < len(weights))
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.uint8)
    for own in reversed(coins):
        n = int(own[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids in code order, code of each id, width of the longest code)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    width = int(lengths.max(initial=1))
    room = np.left_shift(np.int64(1), width - lengths[ids].astype(np.int64))
    codes = np.zeros(len(lengths), np.uint64)
    codes[ids] = (np.cumsum(room) - room) >> (width - lengths[ids].astype(np.int64))
    return ids, codes, width


@lru_cache(maxsize=2)
def coder(lengths: bytes) -> np.ndarray:
    """Code and length (lowest 5 bits) of each id."""
    n = np.frombuffer(lengths, np.uint8)
    return canonical(n)[1] << np.uint64(5) | n


@lru_cache(maxsize=2)
def decoder(lengths: bytes) -> tuple[np.ndarray, int]:
    """Id and code length (lowest 5 bits) of the first code in each ``width`` bits, and the width; 0 where no code fits."""
    n = np.frombuffer(lengths, np.uint8)
    ids, _, width = canonical(n)
    room = np.left_shift(1, width - n[ids].astype(np.int64))
    table = np.zeros(1 << width, np.uint32)
    table[:room.sum()] = np.repeat(ids << 5 | n[ids], room)
    return table, width


# --- blocks -----------------------------------------------------------------------------------------------
def encode_block(ids: np.ndarray, docs: list[int], before: int, lengths: bytes, every: int = EVERY) -> bytes:
    """One block; ``docs`` says how many of the ids belong to each document."""
    found = coder(lengths)[ids]
    n = (found & np.uint64(31)).astype(np.int64)
    if not n.all():
        raise ValueError("an id without a code")
    end = np.cumsum(n)
    at = end - n
    # a code lies in at most two words of 32 bits
    word, shifted = at >> 5, found >> np.uint64(5) << (64 - (at & 31) - n).astype(np.uint64)
    out = np.zeros(int(end[-1] + 31) // 32 + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    size = (int(end[-1]) + 7) // 8 if len(ids) else 0
    head = HEAD.pack(MAGIC, len(ids), len(docs), every, before)
    return head + np.array(docs, "<u4").tobytes() + at[::every].astype("<u4").tobytes() + out.astype(">u4").tobytes()[:size]


def decode_block(data: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, ids of each document in the block, ids of the first one in earlier blocks)."""
    magic, n, n_docs, every, before = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    docs = np.frombuffer(data, "<u4", n_docs, HEAD.size)
    at = HEAD.size + 4 * n_docs
    lanes = -(-n // every)
    start = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, offset=at + 4 * lanes)
    table, width = decoder(lengths)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
    last, mask, spare = len(words) - 1, np.int64((1 << width) - 1), 32 - width
    out = np.zeros((every, lanes), np.uint32)
    pos = start.copy()
    tail = n - (lanes - 1) * every if lanes else 0
    for k in range(every if lanes > 1 else tail):
        if k == tail:  # the last stretch is shorter
            pos, ended = pos[:-1], pos[-1]
        code = (words.take(np.minimum(pos >> 3, last)).astype(np.int64) >> (spare - (pos & 7))) & mask
        found = table.take(code)
        out[k, :len(pos)] = found
        pos = pos + (found & 31)
    out >>= 5
    if lanes:
        pos = pos if tail == every or lanes == 1 else np.append(pos, ended)
        if (pos[:-1] != start[1:]).any() or (pos[-1] + 7) // 8 != len(raw) - 8:
            raise ValueError("damaged block of ids")
    return out.T.ravel()[:n], docs, before


# --- checksums of parts ------------------------------------------------------------------------------------
_POLY = 0xEDB88320  # fixed value of crc32


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the one of crc32, highest power in the lowest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def crc_joined(parts: Iterable[tuple[int, int]]) -> int:
    """crc32 of bytes that come in parts, from (bytes, crc32) of each part in order."""
    crc = 0
    for size, own in parts:
        power, square, n = 1 << 31, 1 << 30, 8 * size
        while n:
            power = _times(power, square) if n & 1 else power
            square, n = _times(square, square), n >> 1
        crc = _times(power, crc) ^ own
    return crc


# --- tables -------------------------------------------------------------------------------------------------
def token_ids(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, n, ids): each document's ids and the end id, little-endian, in 2 bytes where all ids of the tokenizer allow.

    Each task adds a row with a negative uid, whose ``ids`` are its counts of all ids (64 bits each)."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(tokenizer)
        part = TaskContext.get().partitionId()
        uid, kind, type_ = part << 40, _kind(len(enc.opens), end_id), None
        counts = np.zeros(max(len(enc.opens), end_id + 1), np.int64)
        for b in batches:
            type_ = b.column(0).type
            for at, texts in slices(b.column(1), AT_ONCE):
                ids, lens = enc.batch(texts, end_id)
                counts += np.bincount(ids, minlength=len(counts))
                raw, ends = memoryview(ids.astype(kind)).cast("B"), np.cumsum(lens) * int(kind[-1])
                own = [raw[e - n:e] for e, n in zip(ends.tolist(), (lens * int(kind[-1])).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(lens))), b.column(0).slice(at, len(lens)), pa.array(lens),
                                                  pa.array(own, pa.binary())], names=["uid", "doc_id", "n", "ids"])
                uid += len(lens)
            release()
        if type_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int64()), pa.nulls(1, type_), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary())],
                                             names=["uid", "doc_id", "n", "ids"])
        release()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(work, f"uid long, doc_id {kind}, n long, ids binary")


def _kind(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents: the tasks' counts, added up in Spark; at most a row per id comes back."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.frombuffer(x.as_buffer(), np.int64)
                total = own + total if len(total) else own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    rows = ids.where("uid < 0").select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r.id for r in rows), default=0), np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def id_blocks(ids: DataFrame, lengths: bytes, kind: str, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """(part, number, first, n_ids, docs, data): blocks in ascending doc_id order; ``first`` counts the part's ids before."""
    docs_type = ids.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(docs_type)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part = TaskContext.get().partitionId()
        docs, counts, held, have, before, number = [], [], [], 0, 0, 0

        def row(type_):
            data = encode_block(np.concatenate(held), counts, before, lengths, every)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([number * block], pa.int64()), pa.array([have], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(docs, type_)), pa.array([data], pa.binary())],
                names=["part", "number", "first", "n_ids", "docs", "data"])

        type_ = arrow
        for b in batches:
            type_ = b.column(0).type
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                own, at = np.frombuffer(x.as_buffer(), kind), 0
                while at < len(own):
                    take = min(len(own) - at, block - have)
                    docs.append(i)
                    counts.append(take)
                    held.append(own[at:at + take])
                    have, at = have + take, at + take
                    if have == block:
                        yield row(type_)
                        docs, counts, held, have, number = [], [], [], 0, number + 1
                        before = at if at < len(own) else 0
                        release()
        if have:
            yield row(type_)
        release()

    keys = [F.asc_nulls_first("doc_id"), F.asc("n"), F.asc("_c"), F.asc("uid")]
    dealt = ids.where("uid >= 0").withColumn("_c", F.crc32("ids")).repartitionByRange(tasks(ids), *keys).sortWithinPartitions(*keys)
    return dealt.select("doc_id", "ids").mapInArrow(work, f"part int, number long, first long, n_ids long, docs array<{docs_type}>, data binary")


def write_ids(df: DataFrame, tokenizer: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK,
              every: int = EVERY, limit: int = LIMIT) -> None:
    """Write the tables ``codes`` and ``blocks`` under ``path``."""
    spark = df.sparkSession
    ids = stored(token_ids(df, tokenizer, end_id, doc_id, text), "ids")
    kind = _kind(len(word_ids(tokenizer).opens), end_id)
    counts = id_counts(ids)
    lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length())).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    id_blocks(ids, lengths, kind, block, every).write.parquet(f"{path}/blocks")


def read_pieces(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(start, doc_id, at, n, crc[, ids]): of each document in each block its ids there, ``at`` ids into the
    document; ``start`` counts the ids of all documents before it. Blocks are decoded where they are read."""
    lengths = bytes(spark.read.parquet(f"{path}/codes").first().lengths)
    found = spark.read.parquet(f"{path}/blocks")
    # one row per written part
    parts = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = found.join(F.broadcast(base), "part").select((F.col("base") + F.col("first")).alias("first"), "docs", "data")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for k in range(b.num_rows):
                got, n, before = decode_block(b.column(2)[k].as_buffer(), lengths)
                ends = np.cumsum(n, dtype=np.int64)
                at = np.zeros(len(n), np.int64)
                at[:1] = before
                raw = memoryview(np.ascontiguousarray(got, "<u4")).cast("B")
                spans = [(4 * (e - m), 4 * e) for e, m in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(b.column(0)[k].as_py() + ends - n - at), b.column(1).slice(k, 1).flatten(), pa.array(at), pa.array(n.astype(np.int64)),
                        pa.array([zlib.crc32(raw[i:j]) for i, j in spans], pa.int64())]
                if ids:
                    cols.append(pa.array([bytes(raw[i:j]) for i, j in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["start", "doc_id", "at", "n", "crc", *(["ids"] if ids else [])])
                release()

    kind = found.schema["docs"].dataType.elementType.simpleString()
    return rows.mapInArrow(work, f"start long, doc_id {kind}, at long, n long, crc long" + (", ids binary" if ids else ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files. The pieces of a document that
    runs over several blocks meet by its start; their checksums are joined without their ids."""
    pieces = read_pieces(spark, path, ids=False)
    own = pieces.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"),
                                      F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [p[0]["crc"] if len(p) == 1 else crc_joined((4 * x["n"], x["crc"]) for x in p) for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(work, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    """A place for files under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tidewatch-idfile-{uuid.uuid4().hex}"

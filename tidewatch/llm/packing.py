"""Best-fit packing of documents into sequences, with Martello-Toth dominance reduction.

A document is its token ids and an end id. Longer ones are cut into pieces of ``capacity``, the
first of which may be shorter. Pieces of one length are interchangeable, so the packing problem is
its histogram of lengths: at most ``capacity`` counts, however many documents there are. That
histogram is reduced and packed on the driver into runs (one pattern of lengths, times a number of
sequences); the documents stay in Spark, are ranked inside their length and look up their place.

Reduction: for the longest piece left, sets of at most two partners that provably dominate every
other set holding it (no other choice can lead to fewer sequences) are fixed for good, as many at a
time as the counts allow; the shrunken rest goes by best-fit decreasing.

Defined cases: a null or empty text is the end id alone; ids may be null or repeat, as every row is
packed for itself; an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import release, slices
from tidewatch.llm.byteids import WordIds, word_ids  # noqa: F401
from tidewatch.plans.lineage import stored

PER_RANK = 5_000  # pieces of one length ranked in one group
AT_ONCE = 4_000_000  # bytes of texts encoded together
PIECES = "uid long, doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document; ``uid`` tells rows apart, whatever their ids."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_ids(tokenizer)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for done, part in slices(b.column(1), AT_ONCE):
                ids, lens = enc.batch(part, end_id)
                raw, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(lens)
                # of each text: pieces, tokens of the first one; then of each piece: its text, number, place and length
                n = -(-lens // capacity)
                first = lens - (n - 1) * capacity
                doc = np.repeat(np.arange(len(part)), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(k == 0, 0, first[doc] + (k - 1) * capacity)
                length = np.where(k == 0, first[doc], capacity)
                at = 4 * ((ends - lens)[doc] + start)
                crc = [zlib.crc32(raw[i:i + m]) for i, m in zip(at.tolist(), (4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(doc))), b.column(0).take(pa.array(doc + done)), pa.array(k.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64())], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
                uid += len(doc)
        release()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(work, PIECES.format(id=kind))


# --- the packing problem as a histogram ------------------------------------------------------------
class _Counts:
    """Lengths that are left, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for s in items:
            self.n[s] -= times
            if self.n[s] == 0:
                del self.n[s]
                self.sizes.pop(bisect_left(self.sizes, s))

    def left(self, s: int, used: tuple[int, ...]) -> int:
        return self.n.get(s, 0) - used.count(s)

    def largest(self, most: int, used: tuple[int, ...]) -> int:
        """Largest length up to ``most`` that is left beside ``used``; 0 if none."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.left(self.sizes[i], used) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def least(self, k: int, used: tuple[int, ...]) -> int:
        """Sum of the k smallest lengths left beside ``used``; a sum too large for any sequence if there are fewer."""
        total = 0
        for s in self.sizes:
            m = min(k, max(0, self.left(s, used)))
            total, k = total + m * s, k - m
            if not k:
                return total
        return 1 << 60


def _dominating(c: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the piece ``j`` that dominates every feasible set holding it, if one is found."""
    room = capacity - j
    k = c.largest(room, (j,))
    if not k:
        return (j,)
    # one partner: it fills the sequence, or no two pieces fit beside j
    if k == room or c.least(2, (j,)) > room:
        return (j, k)
    if c.least(3, (j,)) <= room:
        return None
    # two partners: k covers every single piece; {k, b} covers a pair {x, y} if y <= b or x + y <= k
    b = c.largest(room - k, (j, k))
    if not b:
        return None
    for y in c.sizes[bisect_right(c.sizes, b):]:
        if 2 * y > room:
            break
        if c.left(y, (j,)) <= 0:
            continue
        x = c.largest(room - y, (j, y))
        if x >= y and x + y > k:
            return None
    return (j, k, b)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed runs, counts of the rest): dominating sets of the longest pieces, fixed for good."""
    c, fixed = _Counts(counts), []
    at = len(c.sizes) - 1
    while at >= 0:
        at = min(at, len(c.sizes) - 1)
        if at < 0:
            break
        j = c.sizes[at]
        found = _dominating(c, j, capacity)
        if found is None:
            at -= 1
            continue
        uses = {s: found.count(s) for s in found}
        # what is left, and so the proof, changes only when a count comes down to one or none
        exact = sum(found) == capacity and len(found) <= 2 or len(found) == 1
        times = min((c.n[s] - (0 if exact else 2)) // u for s, u in uses.items())
        times = max(1, times)
        c.take(found, times)
        fixed.append((found, times))
        at = bisect_right(c.sizes, j) - 1
    return fixed, dict(c.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: sequences with the same content are one run."""
    open_: dict[int, list[list]] = {}  # room left -> [pattern, number]
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], number: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append([pattern, number])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                pattern, number = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, pattern, number = capacity, (), n
            each = room // s
            full = min(number, n // each)
            if full:
                add(room - each * s, pattern + (s,) * each, full)
                number, n = number - full, n - full * each
            if number and n and n < each:
                add(room - n * s, pattern + (s,) * n, 1)
                number, n = number - 1, 0
            if number and pattern:
                add(room, pattern, number)
    return [(p, m) for room in rooms for p, m in open_[room]]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths, number of sequences) that hold each length as often as ``counts`` says."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to a stored table of ``pieces``."""
    counts = {int(r.length): int(r.n) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base = [], 0  # (length, first sequence, offset, how many)
    for pattern, times in solve(counts, capacity):
        at = 0
        for s in pattern:
            slots.append((s, base, at, times))
            at += s
        base += times
    slots.sort()
    size, first, offset, times = (np.array(x, np.int64) for x in (zip(*slots) if slots else ((),) * 4))
    # of one length, slots are taken in order: rank -> slot by its first rank
    before = np.cumsum(times) - times
    start = before - (before[np.searchsorted(size, size)] if len(size) else before)
    keys = (size << 44) + start
    parts = F.greatest(F.lit(1), F.element_at(F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, 1 + n // PER_RANK)]), F.col("length"))
                       if counts else F.lit(1))
    dealt = found.withColumn("_g", F.pmod(F.xxhash64("uid"), parts.cast("long")))
    groups = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_g", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy("uid")) - 1)
    ranked = local.join(groups, ["length", "_g"]).withColumn("rank", F.col("_r") + F.col("_o"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            i = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[i] + rank - start[i]), pa.array(offset[i])],
                                             names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*cols).mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    return pack(stored(pieces(df, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)

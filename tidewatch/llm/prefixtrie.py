"""Trie of conversation prefixes over vertical bitmaps.

A node is a distinct sequence of first turns; conversations that begin with it are its members. Per node
this gives members, children, childless nodes and repeated words below it, and who ends there.

1. ``keyed`` replaces a turn by the md5 of its role and text and by its number of words, so texts are not
   shuffled.
2. Conversations are range-partitioned by id; a task cuts its range into shards of consecutive ids, of at
   most ``SHARD`` conversations and about ``TURNS`` turns. A shard's index has, per position and turn, the
   bitset of its conversations with that turn there, and per position the bitset of those that end. From the
   root, depth first, the first member left of a node names a posting; the intersection of both bitsets is
   a child, and members are crossed off until none is left: one intersection per child. Popcounts are the
   members, the intersection with the ends is the shard's list of ends.
3. Shards agree on nodes by their key, the md5 chain of their turns: a node's owner is its smallest member
   in any shard. What is asked of subtrees is additive: over members, the words of a node count once per
   member; over nodes, once less, which only the owner's shard takes off. So each shard adds up its own
   tree from the leaves, whatever its depth, and no round per level is needed.
4. A node's rows, one per shard that has it, are added up in the order of shards, that is of ids; the
   digest of its ends is fed with the shards' lists one by one.

A turn or conversation that a third of all share gives a row per shard, not per conversation. Only one
conversation's own turns must fit in a task, about 300 bytes a turn.

Defined cases: null role or text is empty; rows without conv_id belong to no conversation; turns go by
``turn``, null first, then by key, and repeated rows are several turns; conversations whose only rows have
a null key have no turns and end at the root; an empty table has no nodes; other columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import release, tasks
from tidewatch.plans.lineage import stored

SHARD = 1024  # conversations of a shard
TURNS = 1 << 17  # turns of a shard, unless one conversation has more
ROOT = bytes(16)
WORD = "[^\\x20\\x09-\\x0D]+"
LOCAL = "shard long, no int, parent int, node binary, depth int, n long, words long, least long, inner boolean, ends string"


def keyed(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, turn_key, words) of turns; equal keys are equal roles and texts."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))).alias("turn_key"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))


def walk(turns: list[list[bytes]], words: list[list[int]], ids: list[int]) -> Iterator[tuple]:
    """Nodes (parent, key, depth, members, words, smallest member, has children, ends) of a shard's conversations,
    numbered in the order given, parents first; ``ids`` ascend."""
    postings: list[dict[bytes, int]] = []
    ended: dict[int, int] = {}
    for i, own in enumerate(turns):
        bit = 1 << i
        for d, k in enumerate(own):
            if d == len(postings):
                postings.append({})
            postings[d][k] = postings[d].get(k, 0) | bit
        ended[len(own)] = ended.get(len(own), 0) | bit
    stack, number = [((1 << len(turns)) - 1, 0, -1, ROOT, 0)], 0
    while stack:
        members, depth, parent, key, n_words = stack.pop()
        over = members & ended.get(depth, 0)
        rest, ends, b = members ^ over, [], over
        while b:
            low = b & -b
            ends.append(str(ids[low.bit_length() - 1]))
            b ^= low
        yield (parent, key, depth, members.bit_count(), n_words, ids[(members & -members).bit_length() - 1], rest != 0, ",".join(ends) or None)
        while rest:
            i = (rest & -rest).bit_length() - 1
            turn = turns[i][depth]
            child = rest & postings[depth][turn]
            rest ^= child
            stack.append((child, depth + 1, number, hashlib.md5(key + turn).digest(), words[i][depth]))
        number += 1


def shard_nodes(turns: DataFrame, shard: int = SHARD, most: int = TURNS) -> DataFrame:
    """Nodes of every shard; shards are numbered in the order of their ids."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = [f.split()[0] for f in LOCAL.split(", ")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, keys, words, have = [], [], [], 0

        def out():
            rows, n = [], 0
            for row in walk(keys, words, ids):
                rows.append((number, n, *row))
                n += 1
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for c, k, w in zip(*[x.to_pylist() for x in b.columns]):
                if not ids or ids[-1] != c:
                    if len(ids) == shard or have >= most:
                        yield from out()
                        number, ids, keys, words, have = number + 1, [], [], [], 0
                    ids.append(c)
                    keys.append([])
                    words.append([])
                if k is not None:
                    keys[-1].append(k)
                    words[-1].append(w)
                    have += 1
        if ids:
            yield from out()
        release()

    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("turn_key")]
    dealt = turns.repartitionByRange(tasks(turns), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn_key", "words").mapInArrow(work, LOCAL)


def _runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows of consecutive batches with the same value in a column."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[x.to_pylist() for x in b.columns]):
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def roll_up(nodes: DataFrame) -> DataFrame:
    """Each shard's tree added up from its leaves, from nodes that know their owner and whether any shard has children of them."""
    names = ["node", "shard", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # columns: shard, no, parent, node, depth, n, words, least, owner, branch, ends
        for rows in _runs(batches, 0):
            size = len(rows)
            own = [r[7] == r[8] for r in rows]
            saved = [r[5] * r[6] - (r[6] if o else 0) for r, o in zip(rows, own)]
            leaves = [int(o and not r[9]) for r, o in zip(rows, own)]
            children = [0] * size
            for i in range(size - 1, 0, -1):
                p = rows[i][2]
                saved[p] += saved[i]
                leaves[p] += leaves[i]
                children[p] += own[i]
            above = [None if r[2] < 0 else rows[r[2]][8] for r in rows]
            for i in range(0, size, 10_000):
                part = rows[i:i + 10_000]
                cols = [[r[3] for r in part], [r[0] for r in part], [r[8] for r in part], [r[4] for r in part], above[i:i + 10_000], [r[5] for r in part],
                        children[i:i + 10_000], leaves[i:i + 10_000], saved[i:i + 10_000], [r[10] for r in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), *[pa.int64()] * 8, pa.string()])], names=names)
        release()

    dealt = nodes.repartition("shard").sortWithinPartitions("shard", "no")
    return dealt.select("shard", "no", "parent", "node", "depth", "n", "words", "least", "owner", "branch", "ends").mapInArrow(
        work, "node binary, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", ends string")


def merged(parts: DataFrame) -> DataFrame:
    """One row per node from its shards' rows, a shard at a time in the order of ids."""
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, some, out = None, hashlib.sha256(), False, []

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:8]], pa.array(cols[8], pa.string())],
                                              names=["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

        for b in batches:
            for node, _, conv, depth, parent, n, children, leaves, saved, ends in zip(*[x.to_pylist() for x in b.columns]):
                if held is None or held[0] != node:
                    if held is not None:
                        out.append((*held, sha.hexdigest()))
                        if len(out) == 10_000:
                            yield batch()
                    held, sha, some = [node, conv, depth, parent, 0, 0, 0, 0], hashlib.sha256(), False
                for k, x in enumerate((n, children, leaves, saved)):
                    held[4 + k] += x
                if ends is not None:
                    sha.update((f",{ends}" if some else ends).encode())
                    some = True
        if held is not None:
            out.append((*held, sha.hexdigest()))
            yield batch()
        release()

    dealt = parts.repartition("node").sortWithinPartitions("node", "shard")
    return dealt.mapInArrow(work, "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                  "saved_tokens long, ends_sha256 string")


def trie(turns: DataFrame, shard: int = SHARD, most: int = TURNS) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) from rows as ``keyed`` gives them.

    ``conv_id`` is the node's smallest member, ``saved_tokens`` the words that members repeat in its subtree."""
    same = Window.partitionBy("node")
    nodes = shard_nodes(stored(turns.select("conv_id", "turn", "turn_key", "words"), "turns"), shard, most)
    nodes = nodes.withColumn("owner", F.min("least").over(same)).withColumn("branch", F.max("inner").over(same))
    return merged(roll_up(nodes))


def with_shared_heads(turns: DataFrame, every: int, heads: Column, most: int) -> DataFrame:
    """Rows as ``keyed`` gives them, where a conversation c begins with the first h turns of conversation
    c - c % every (all if it has fewer, none if it is absent) in place of its own first h turns.

    ``heads`` gives h from ``conv_id``, at most ``most``. A row with a null key stands for each
    conversation, so those left without turns stay. One shuffle: conversations of a base meet by its id."""
    base = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    place = F.row_number().over(Window.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("turn"), F.asc("turn_key"))) - 1
    placed = base.withColumn("place", place.cast("long")).withColumn("h", heads.cast("long"))
    row = lambda at, key, words: F.struct(at.alias("turn"), key.alias("turn_key"), words.alias("words"))
    first = placed.where((F.col("conv_id") == F.col("base")) & (F.col("place") < most)).groupBy("base").agg(
        F.array_sort(F.collect_list(row(F.col("place"), F.col("turn_key"), F.col("words")))).alias("head"))
    both = placed.join(first, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    none = F.array(row(F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("long")))
    own = F.when(F.col("place") >= F.col("h"), F.array(row(F.col("place") - F.col("h") + F.col("taken"), F.col("turn_key"), F.col("words"))))
    head = F.when((F.col("place") == 0) & (F.col("taken") > 0), F.slice("head", F.lit(1), F.greatest(F.lit(1), F.col("taken").cast("int"))))
    mark = F.when(F.col("place") == 0, none)
    empty = F.slice(none, 1, 0)
    return both.select("conv_id", F.explode(F.concat(*[F.coalesce(x, empty) for x in (mark, head, own)])).alias("r")).select("conv_id", "r.*")

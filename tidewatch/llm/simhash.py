"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

Fingerprint: a document's words are its runs of bytes other than ASCII white space, A-Z lower-cased;
its features are the shingles of ``words`` words, repeats included; each is hashed with XXH64 (seed
42), and a bit is set if it is set in over half the hashes. No words: fingerprint zero.

Join: distinct fingerprints form a binary trie, highest bit first. Two copies of the trie are walked
together, node pair by node pair: the pair's differing bits so far are its error, and a pair whose
error exceeds the budget is dropped with everything below it. The top of the walk works on counts
only: prefixes are counted in Spark (a table bounded by the parameter ``node``, not by the rows) and
heavy ones are counted deeper, until a leaf has at most ``node`` fingerprints. Each surviving pair of
leaves then goes on inside one task, level by level over numpy ranges. A task gives a spanning forest
of the matches it found, not all matches, so a dense group costs as many edges as it has members;
the forests' edges make the same components as all links do. Components come from alternating
large-star and small-star rounds over fingerprints, not over documents.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows with a
null or repeated id stay as they are, and the smallest non-null id names a component (null if there
is none); an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import append, tasks
from tidewatch.plans.lineage import stored

SEED = 42
NODE = 32_768  # fingerprints of a trie leaf handled as one block
LEAVES = 4096  # the block grows with the table so that about this many leaves are enough
BLOCK = 65_536  # shingles, or node pairs x 4, worked on at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        last = ends[np.minimum(np.arange(i, j) + words - 1, len(w) - 1)].tolist()
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[i:j].tolist(), last)], np.uint64, j - i)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, fp: str = "fp", uid: str | None = None) -> DataFrame:
    """``df`` with its fingerprints: the 64 bits as a signed long."""
    def start():
        return lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return append(df, text, start, f"{fp} long", uid)


# --- the trie walk inside a task -----------------------------------------------------------------
class _Forest:
    """Union-find over numpy arrays; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            far = a != b
            a, b = a[far], b[far]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.arange(len(self.up))
        r = self._roots(x)
        return x[r != x], r[r != x]


class _Node:
    """A trie node's sorted fingerprints, with the number of ones before each place at a depth."""

    def __init__(self, x: np.ndarray):
        self.x, self.ones = x, {}

    def middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where bit ``depth`` turns to 1 inside each range; ranges share the bits above it."""
        if depth not in self.ones:
            bit = (self.x >> np.uint64(63 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
        c = self.ones[depth]
        return hi - (c[hi] - c[lo])


def walk(a: np.ndarray, b: np.ndarray, depth: int, error: int, budget: int, same: bool, forest: _Forest, bucket: int = 8) -> None:
    """Link in ``forest`` (indexes of a, then of b) all fingerprints of two trie nodes within the budget.

    ``a`` and ``b`` are sorted and distinct; their nodes have ``error`` differing bits above ``depth``.
    Node pairs with few fingerprints on both sides are compared directly."""
    shift = 0 if same else len(a)
    na = _Node(a)
    nb = na if same else _Node(b)
    # blocks of node pairs (from a, to a, from b, to b, error), each block at one depth
    todo = [(depth, np.array([[0], [len(a)], [0], [len(b)], [error]], np.int64))]
    while todo:
        d, pairs = todo.pop()
        if pairs.shape[1] > BLOCK:
            todo += [(d, pairs[:, i:i + BLOCK]) for i in range(0, pairs.shape[1], BLOCK)]
            continue
        small = (pairs[1] - pairs[0] <= bucket) & (pairs[3] - pairs[2] <= bucket) | (d >= 64)
        if small.any():
            _verify(a, b, pairs[:, small], budget, same, shift, forest)
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        a0, a1, b0, b1, e = pairs
        am, bm = na.middle(a0, a1, d), nb.middle(b0, b1, d)
        down = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am, a1, b0, bm, e + 1)]
        out = []
        for k, (x0, x1, y0, y1, err) in enumerate(down):
            keep = (x1 > x0) & (y1 > y0) & (err <= budget)
            if same and k == 3:
                keep &= a0 != b0  # of one node with itself, the mixed pair counts once
            out.append(np.stack([v[keep] for v in (x0, x1, y0, y1, err)]))
        todo.append((d + 1, np.concatenate(out, axis=1)))


def _verify(a, b, pairs, budget, same, shift, forest) -> None:
    na, nb = pairs[1] - pairs[0], pairs[3] - pairs[2]
    for i in range(0, len(na), 8192):
        s = slice(i, i + 8192)
        n = na[s] * nb[s]
        at = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        x, y = pairs[0][s][at] + k // nb[s][at], pairs[2][s][at] + k % nb[s][at]
        if same:
            x, y = x[x < y], y[x < y]
        near = np.bitwise_count(a[x] ^ b[y]) <= budget
        if near.any():
            forest.link(x[near], y[near] + shift)


# --- the top of the walk ----------------------------------------------------------------------------
def _leaves(fps: DataFrame, node: int) -> list[tuple[int, int]]:
    """(first fingerprint, depth) of trie nodes with at most ``node`` fingerprints, in order.

    Prefixes are counted 12 bits deep, then 8 bits deeper below those still too heavy, of which
    there are at most rows / node."""
    u = F.col("fp")
    top = {int(r.p) & 0xFFF: r["count"] for r in fps.groupBy(F.shiftrightunsigned(u, 52).alias("p")).count().collect()}
    out: list[tuple[int, int]] = []
    heavy, depth = _cut(top, 0, 0, 12, node, out), 12
    while heavy and depth < 64:
        step = min(8, 64 - depth)
        at = fps.withColumn("p", F.shiftrightunsigned(u, 64 - depth)).where(F.col("p").isin(heavy) if len(heavy) <= 200 else F.lit(True))
        below: dict[int, dict[int, int]] = {}
        wanted = set(heavy)
        for r in at.groupBy("p", F.shiftrightunsigned(u, 64 - depth - step).alias("q")).count().collect():
            if r.p in wanted:
                below.setdefault(r.p, {})[r.q & ((1 << step) - 1)] = r["count"]
        heavy = [h for p, counts in below.items() for h in _cut(counts, p, depth, step, node, out)]
        depth += step
    out += [(p << (64 - depth), depth) for p in heavy]
    return sorted(out)


def _cut(counts: dict[int, int], prefix: int, depth: int, step: int, node: int, out: list) -> list[int]:
    """Cut a counted subtree into light nodes, added to ``out``; gives the prefixes still too heavy at its foot."""
    heavy, todo = [], [(0, 0)]
    while todo:
        value, d = todo.pop()
        low, high = value << (step - d), (value + 1) << (step - d)
        n = sum(c for k, c in counts.items() if low <= k < high)
        if not n:
            continue
        if n <= node:
            out.append((((prefix << d) | value) << (64 - depth - d), depth + d))
        elif d == step:
            heavy.append((prefix << step) | value)
        else:
            todo += [(value * 2, d + 1), (value * 2 + 1, d + 1)]
    return heavy


def leaf_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """(leaf, leaf, depth, error) of the leaf pairs that the walk from the root keeps."""
    top = _Node(np.array([s for s, _ in leaves], np.uint64))
    out, todo = [], [(0, len(leaves), 0, len(leaves), 0, 0)] if leaves else []
    while todo:
        a0, a1, b0, b1, d, e = todo.pop()
        if e > budget or a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1 and b1 - b0 == 1 and d >= min(leaves[a0][1], leaves[b0][1]):
            out.append((a0, b0, d, e))
            continue
        am, bm = int(top.middle(a0, a1, d)), int(top.middle(b0, b1, d))
        a_leaf, b_leaf = a1 - a0 == 1 and leaves[a0][1] <= d, b1 - b0 == 1 and leaves[b0][1] <= d
        if a_leaf or b_leaf:  # one side is cut no further: the other's leaves are met at this depth
            out += [(i, j, d, e) for i in range(a0, a1) for j in range(b0, b1)]
            continue
        todo += [(a0, am, b0, bm, d + 1, e), (am, a1, bm, b1, d + 1, e), (a0, am, bm, b1, d + 1, e + 1)]
        if (a0, a1) != (b0, b1):
            todo.append((am, a1, b0, bm, d + 1, e + 1))
    return out


def links(fps: DataFrame, budget: int = 3, node: int | None = None) -> DataFrame:
    """(u, v): edges whose components are those of all fingerprint pairs within the budget.

    ``fps`` has a distinct column ``fp`` and should be a stored table."""
    spark = fps.sparkSession
    node = node or max(NODE, fps.count() // LEAVES)
    leaves = _leaves(fps, node)
    pairs = leaf_pairs(leaves, budget)
    starts = np.array([s for s, _ in leaves], np.uint64)

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"leaf": np.searchsorted(starts, b["fp"].to_numpy().view(np.uint64), side="right") - 1, "fp": b["fp"]})

    block = fps.select("fp").mapInPandas(place, "leaf long, fp long").groupBy("leaf").agg(F.collect_list("fp").alias("f"))
    block = stored(block, "trie-leaves")
    todo = spark.createDataFrame([(int(a), int(b), int(d), int(e)) for a, b, d, e in pairs] or [(0, 0, 0, 0)], "a long, b long, depth int, error int")
    both = todo.join(block.select(F.col("leaf").alias("a"), F.col("f").alias("fa")), "a").join(
        block.select(F.col("leaf").alias("b"), F.when(F.lit(True), F.col("f")).alias("fb")), "b")
    both = both.repartition(max(tasks(fps), min(len(pairs), 4 * tasks(fps))), "a", "b")

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                same = r.a == r.b
                x = np.sort(np.asarray(r.fa, np.int64).view(np.uint64))
                y = x if same else np.sort(np.asarray(r.fb, np.int64).view(np.uint64))
                forest = _Forest(len(x) if same else len(x) + len(y))
                walk(x, y, r.depth, r.error, budget, same, forest)
                u, v = forest.edges()
                every = (x if same else np.concatenate((x, y))).view(np.int64)
                yield pd.DataFrame({"u": every[u], "v": every[v]})

    return both.mapInPandas(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest member of each component with at least one edge.

    Large-star joins every larger neighbour to a node's smallest one, small-star does the same with
    the smaller neighbours; a hot node's smallest neighbour is a combined minimum, and its edges
    are joined back, so no node's neighbours are gathered. Ends when nothing changes."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        kept = (near.where("v > u") if large else near).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            kept = kept.unionByName(low.select("u", F.col("m").alias("v")))
        return kept.where("u != v").distinct()

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(now)
    while seen[0]:
        now = stored(star(star(now, True), False), "stars")
        last, seen = seen, state(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("fp"), F.col("v").alias("root"))).distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3,
                    node: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id): ``fingerprint`` in 16 hex digits; ``component_id`` is the
    smallest id of the documents reachable by links of at most ``budget`` differing bits."""
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    docs = stored(fingerprints(rows, "t", words).select("i", "fp"), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.min("i").alias("least")), "distinct-fingerprints")
    comp = components(links(fps, budget, node))
    # only fingerprints with a link need more than their own smallest id
    linked = comp.join(fps, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    every = fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return docs.join(every, "fp").select(F.col("i").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3, node: int | None = None) -> DataFrame:
    """Rows of ``df``, all columns, one of each group of near duplicates: that with the smallest id,
    nulls last; of several rows with that id, any one."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("_text"))
    docs = stored(fingerprints(rows, "_text", words, "_fp", "_uid").drop("_text"), "fingerprinted")
    id_ = F.col("row")[doc_id]
    slim = docs.select(F.col("_fp").alias("fp"), "_uid", F.struct(id_.isNull(), id_, "_uid").alias("_k"))
    first = slim.groupBy("fp").agg(F.min("_k").alias("_k"))
    fps = stored(first, "distinct-fingerprints")
    root = components(links(fps, budget, node))
    linked = fps.join(root, "fp")
    kept = linked.groupBy("root").agg(F.min("_k").alias("_k")).select(F.col("_k._uid").alias("_uid")).unionByName(
        fps.join(root, "fp", "left_anti").select(F.col("_k._uid").alias("_uid")))
    # what goes is usually less than what stays, and its keys may be few enough to broadcast
    gone = stored(slim.select("_uid").join(kept, "_uid", "left_anti"), "duplicates")
    return docs.join(gone, "_uid", "left_anti").select("row.*")

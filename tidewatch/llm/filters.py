"""Interaction audit of document filters over sorted posting lists.

How much a filter removes depends on the filters before it. For each part of the corpus and every order of
the filters this gives what each step removes, what it would have removed alone, and which labelled
documents go with it.

1. Each text is read once, in Python, into a bit per failed filter and a digest. A filter is a function of
   the text, or ``REPEATED``: the text is identical to that of a smaller doc_id, wherever that one stands
   and whether or not another filter removes it. Its first documents are a minimum per digest, which
   combines before the shuffle, so a large group of copies meets in no task.
2. Rows go by doc_id, sorted. A task cuts them into id ranges of ``RANGE`` rows and keeps, per part and
   filter, the sorted list of failing rows (rows are numbered by part and doc_id in a range, since ids may
   repeat or be null).
3. All orders need only the sizes of ``filter minus union of some others``: 5 filters, 80 sizes. Unions and
   differences run over the lists by galloping k-way merges: a window takes the next ids of the lists up
   to a common bound, which is found in each list by doubling steps, and the windows' sizes are added up per
   part. Labelled documents are posting lists too, merged in the same way.
4. Sizes are summed over tasks in Spark; orders are read off them by a join with the table of orders.

Defined cases: a null text is empty, a null part is the empty string; a null doc_id has no smaller id, so
it never fails ``REPEATED``, and has no label; equal doc_ids are several documents, of which none repeats
another one; a document counts as labelled if any label row of its id says so; an empty table gives an
empty table; other columns are not looked at."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import release, texts_of
from tidewatch.plans.lineage import stored

RANGE = 1 << 16  # rows of an id range
STEP = 1 << 12  # ids of a list in a window
PARTS = 20_000  # parts whose sums a task holds before it hands them on
REPEATED = None
SIGNS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(65, 91))


# --- filters on texts ------------------------------------------------------------------------------------
def words(text: str) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def short(text: str) -> bool:
    return len(words(text)) < 200


def repetitive(text: str) -> bool:
    w = words(text)
    return 100 * len(set(w)) < 50 * len(w)


def shouting(text: str) -> bool:
    raw = text.encode("utf-8", "surrogatepass")
    return 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * len(text)


def signs(text: str) -> bool:
    return SIGNS.search(text) is not None


FILTERS: dict[str, Callable[[str], bool] | None] = {"A": short, "B": repetitive, "C": shouting, "D": signs, "E": REPEATED}


# --- posting lists -----------------------------------------------------------------------------------------
def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """Place of the first of the sorted ids above ``bound``, from ``at`` on by doubling steps."""
    step = 1
    while at + step < len(ids) and ids[at + step] <= bound:
        at, step = at + step, 2 * step
    return at + int(np.searchsorted(ids[at:at + step], bound, side="right"))


def windows(lists: list[np.ndarray], step: int = STEP) -> Iterator[list[np.ndarray]]:
    """The lists side by side in windows that cover the same ids, with at most ``step`` of each list."""
    at = [0] * len(lists)
    while True:
        ends = [x[min(i + step, len(x)) - 1] for i, x in zip(at, lists) if i < len(x)]
        if not ends:
            return
        bound = min(ends)
        to = [gallop(x, i, bound) if i < len(x) else i for i, x in zip(at, lists)]
        yield [x[i:j] for i, j, x in zip(at, to, lists)]
        at = to


def union(lists: list[np.ndarray], step: int = STEP) -> np.ndarray:
    """Sorted union of sorted lists."""
    lists = [x for x in lists if len(x)]
    if len(lists) < 2:
        return lists[0] if lists else np.zeros(0, np.int64)
    out = []
    for w in windows(lists, step):
        both = np.sort(np.concatenate(w), kind="stable")  # merges the sorted runs
        out.append(both[np.concatenate([[True], both[1:] != both[:-1]])])
    return np.concatenate(out)


def difference(ids: np.ndarray, others: list[np.ndarray], step: int = STEP) -> np.ndarray:
    """Those of the sorted ids that are in none of the other lists."""
    others = [x for x in others if len(x)]
    if not len(ids) or not others:
        return ids
    out = []
    for own, *rest in windows([ids, *others], step):
        for x in rest:
            if len(x) and len(own):
                own = own[x[np.minimum(np.searchsorted(x, own), len(x) - 1)] != own]
        out.append(own)
    return np.concatenate(out)


def intersection(ids: np.ndarray, other: np.ndarray, step: int = STEP) -> np.ndarray:
    out = []
    for own, x in windows([ids, other], step):
        if len(x) and len(own):
            out.append(own[x[np.minimum(np.searchsorted(x, own), len(x) - 1)] == own])
    return np.concatenate(out) if out else ids[:0]


def steps(n: int) -> list[tuple[int, int]]:
    """(filter, bits of the filters before it): every step that some order of ``n`` filters has."""
    return [(f, sum(1 << o for o in before)) for f in range(n)
            for k in range(n) for before in combinations([o for o in range(n) if o != f], k)]


def removed(lists: list[np.ndarray], step: int = STEP) -> list[np.ndarray]:
    """For each of ``steps``: the failing ids of the filter that none of those before it has removed."""
    unions = {0: np.zeros(0, np.int64)}
    for bits in range(1, 1 << len(lists)):
        low = (bits & -bits).bit_length() - 1
        unions[bits] = union([unions[bits & (bits - 1)], lists[low]], step)
    return [difference(lists[f], [unions[before]], step) for f, before in steps(len(lists))]


def range_sizes(part: np.ndarray, n_parts: int, fails: np.ndarray, marks: list[np.ndarray], n_filters: int, step: int = STEP) -> np.ndarray:
    """Sizes of one id range: [part, step of ``steps``, 0 = documents, then those of each mark].

    Rows come in the order of their ids; ``fails`` has a bit per failed filter."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(n_parts + 1))
    fails = fails[order]
    lists = [np.flatnonzero(fails >> f & 1) for f in range(n_filters)]  # per part one after the other
    posted = [np.flatnonzero(m[order]) for m in marks]
    out = np.zeros((n_parts, len(steps(n_filters)), 1 + len(marks)), np.int64)
    for k, own in enumerate([lists, *[[intersection(x, m, step) for x in lists] for m in posted]]):
        for s, left in enumerate(removed(own, step)):
            out[:, s, k] = np.diff(np.searchsorted(left, bounds))
    return out


# --- Spark ---------------------------------------------------------------------------------------------------
def failures(df: DataFrame, filters: dict[str, Callable[[str], bool] | None] = FILTERS, doc_id: str = "doc_id", text: str = "text",
             part: str = "source") -> DataFrame:
    """(doc_id, part, fails, digest): a bit per failed filter on the text, and a digest of the text."""
    own = [(1 << i, f) for i, f in enumerate(filters.values()) if f is not REPEATED]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, digests = [], []
            for t in texts_of(b.column(2)):
                t = t or ""
                bits.append(sum(bit for bit, f in own if f(t)))
                digests.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int64()), pa.array(digests, pa.binary())],
                                             names=["doc_id", "part", "fails", "digest"])
        release()

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("t")).mapInArrow(
        work, f"doc_id {kind}, part string, fails long, digest binary")


def step_sizes(rows: DataFrame, n_filters: int, marks: list[str], range_rows: int = RANGE, step: int = STEP) -> DataFrame:
    """(part, filter, before, n, marks ..., documents) summed over all rows (doc_id, part, fails, marks ...)."""
    all_steps = steps(n_filters)
    names = ["part", "filter", "before", "n", *marks, "documents"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def add(table: pa.Table) -> None:
            code = table.column("part").combine_chunks().dictionary_encode()
            part, labels = code.indices.to_numpy(), code.dictionary.to_pylist()
            sizes = range_sizes(part, len(labels), table.column("fails").to_numpy(), [table.column(m).to_numpy() for m in marks], n_filters, step)
            for p, own, n in zip(labels, sizes, np.bincount(part, minlength=len(labels)).tolist()):
                if p in sums:
                    sums[p][0] += own
                    sums[p][1] += n
                else:
                    sums[p] = [own.copy(), n]

        def out():
            for p, (own, n) in sums.items():
                cols = [[p] * len(all_steps), [f for f, _ in all_steps], [b for _, b in all_steps], *own.T.tolist(), [n] * len(all_steps)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)
            sums.clear()

        held, have = [], 0
        for b in batches:
            while b.num_rows:
                own = b.slice(0, range_rows - have)
                held.append(own)
                have, b = have + own.num_rows, b.slice(own.num_rows)
                if have == range_rows:
                    add(pa.Table.from_batches(held))
                    held, have = [], 0
                    if len(sums) > PARTS:
                        yield from out()
        if held:
            add(pa.Table.from_batches(held))
        yield from out()
        release()

    sized = rows.sortWithinPartitions("doc_id").select("part", "fails", *marks).mapInArrow(
        work, ", ".join(["part string", *[f"{n} long" for n in names[1:]]]))
    return sized.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names[3:]])


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Callable[[str], bool] | None] = FILTERS, marks: dict[str, str] | None = None,
          doc_id: str = "doc_id", text: str = "text", part: str = "source", range_rows: int = RANGE, step: int = STEP) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost ..., shapley), a row per part,
    order of the filters and step. ``marks`` names conditions on the labels (by doc_id) whose losses are counted."""
    marks = marks or {"good": "quality = 1", "toxic": "toxic = 1"}
    names, n = list(filters), len(filters)
    rows = stored(failures(df, filters, doc_id, text, part), "failures")
    kind = rows.schema["doc_id"].dataType
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    repeats = sum(1 << i for i, f in enumerate(filters.values()) if f is REPEATED)
    if repeats:
        rows = rows.join(firsts, ["doc_id", "digest"], "left")
        again = F.col("first").isNull() & F.col("doc_id").isNotNull()
        rows = rows.withColumn("fails", F.col("fails") + F.when(again, F.lit(repeats)).otherwise(F.lit(0)))
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast(kind).alias("doc_id")).agg(
        *[F.max(F.coalesce(F.expr(c), F.lit(False)).cast("long")).alias(m) for m, c in marks.items()])
    rows = rows.select("doc_id", "part", "fails").join(marked, "doc_id", "left").fillna(0, list(marks))
    sizes = step_sizes(rows, n, list(marks), range_rows, step)
    # what a step of an order needs: sizes with the filters before it, with none, and with all others
    table = sizes.groupBy("part").agg(F.max("documents").alias("documents"), F.map_from_entries(F.collect_list(
        F.struct((F.col("filter") * (1 << n) + F.col("before")).alias("k"), F.struct("n", *marks).alias("v")))).alias("s"))
    session, full = df.sparkSession, (1 << n) - 1
    key = lambda f, before: (f << n) + before
    all_orders = []
    for order in permutations(range(n)):
        upto = [key(f, sum(1 << o for o in order[:k])) for k, f in enumerate(order)]
        for k, f in enumerate(order):
            all_orders.append(("".join(names[i] for i in order), k + 1, f, key(f, 0), key(f, full - (1 << f)), upto[:k + 1]))
    orders = session.createDataFrame(all_orders, "filter_order string, step int, f long, alone long, others long, upto array<long>")
    # removed up to a step: each filter of the order without those before it
    gone = F.aggregate("upto", F.lit(0).cast("long"), lambda a, k: a + F.col("s")[k]["n"])
    # over all orders a set of k filters comes before a filter k! (n - 1 - k)! times
    fact = [1]
    for i in range(1, n + 1):
        fact.append(fact[-1] * i)
    share = F.array(*[F.lit(fact[k] * fact[n - 1 - k]).cast("long") for k in range(n)])
    shapley = sizes.groupBy("part", F.col("filter").alias("f")).agg(
        F.sum(F.col("n") * F.element_at(share, F.bit_count("before") + 1)).cast("long").alias("shapley"))
    out = shapley.join(table, "part").join(F.broadcast(orders), "f")
    here, alone, others = (F.col("s")[c] for c in (F.element_at("upto", -1), F.col("alone"), F.col("others")))
    return out.select("part", "filter_order", "step", (F.col("documents") - gone).alias("kept"), here["n"].alias("removed"),
                      (alone["n"] - here["n"]).alias("redundant"), others["n"].alias("unique_fails"),
                      *[here[m].alias(f"{m}_lost") for m in marks], "shapley")

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefixtrie as X


def sequences(rows):
    """conv_id -> turns ((role, text)) in order, from rows (conv_id, turn, role, text)."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            md5 = hashlib.md5(f"{len(key[0])}:{key[0]}{key[1]}".encode()).digest()
            by.setdefault(c, []).append((turn is not None, turn or 0, md5, key))
    return {c: [x[3] for x in sorted(own, key=lambda x: x[:3])] for c, own in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node by comparing all prefixes."""
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[:len(n)] == n]
        saved = sum((len(members[n]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids(node)), sum(not kids(n) for n in below),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows, parts=3):
    more = [(*r, "x", b"y") for r in rows]
    return spark.createDataFrame(more, "conv_id long, turn long, role string, text string, node string, turn_key binary").repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.drop("node").collect()), key=str)


def some(seed, n=70):
    rng = random.Random(seed)
    texts = ["a b", "", None, "x\ty\x1cz \n w", "long " * 9, "é ü"]
    rows = []
    for _ in range(n):
        c = rng.choice([None, -45, -20, -7, -1, *range(0, 30), *range(61, 80), 10**15 + 7])
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows + rows[:3]


@pytest.mark.parametrize("seed, size", [(1, (1024, 1 << 17)), (2, (1, 1)), (3, (2, 5)), (4, (1000, 3))])
def test_trie_against_brute_force(spark, seed, size):
    rows = some(seed)
    assert got(X.trie(X.keyed(table(spark, rows)), *size)) == brute(sequences(rows))


@pytest.mark.parametrize("seed", [5, 6])
def test_shared_heads_against_brute_force(spark, seed):
    rows = some(seed, 120)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    turns = X.with_shared_heads(X.keyed(table(spark, rows)), 20, h, 3)
    want = rebuilt(sequences(rows))
    assert any(not own for own in want.values())
    assert got(X.trie(turns, 7, 20)) == brute(want)


def test_equal_conversations_and_long_ones(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)] + [(500, t, "user", "again " * 3) for t in range(2000)]
    out = {r.depth: r for r in X.trie(X.keyed(table(spark, rows)), 16, 64).collect() if r.conv_id == 0}
    assert out[4].n_convs == 300 and out[4].n_children == 0 and out[0].n_leaves == 2 and out[1].saved_tokens == 299 * 8
    assert out[4].ends_sha256 == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()


def test_walk_of_no_turns():
    assert list(X.walk([[], []], [[], []], [3, 9])) == [(-1, X.ROOT, 0, 2, 0, 3, False, "3,9")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert X.trie(X.keyed(empty)).collect() == []


def test_query_against_brute_force(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, sf)) == brute(rebuilt(sequences(rows)))

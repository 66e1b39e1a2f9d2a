import random

import numpy as np
import pytest
import xxhash

from tidewatch.llm import simhash


def brute_fp(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    f = sorted(fps)
    for i, a in enumerate(f):
        for b in f[:i]:
            if bin(a ^ b).count("1") <= budget:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in f}


@pytest.mark.parametrize("text", [None, "", " \t\n", "A", "a B", "One two three", "É ü x y Z", "a\x1cb c d " * 50, "w " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("node,spread", [(4, 64), (64, 64), (4, 12), (100000, 20), (2, 6)])
def test_links_give_brute_force_components(spark, node, spread):
    rng = random.Random(node * 100 + spread)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1}
    while len(fps) < 60 if spread == 6 else len(fps) < 250:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(spread)
        fps.add(x)
    want = brute_components(fps, 3)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, 3, node).collect()]
    assert all(bin(u ^ v).count("1") >= 1 for u, v in edges)
    got = {f: f for f in fps}

    def find(x):
        while got[x] != x:
            x = got[x]
        return x
    for u, v in edges:
        assert want[u] == want[v]
        got[max(find(u), find(v))] = min(find(u), find(v))
    assert {f: find(f) for f in fps} == want


def test_components_of_a_chain(spark):
    n = 60
    e = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(200, 300)], "u long, v long")
    got = {r.fp: r.root for r in simhash.components(e).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 200: 200, 300: 200}


def test_near_duplicates_edge_cases(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    rows = [(5, t, "x"), (3, t, "y"), (9, t.upper(), None), (1, None, "x"), (2, "", "x"), (7, "one other text here", None), (7, "one other text here", None),
            (None, t, "z"), (None, "lonely words stand apart", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    want = sorted(((i, f"{brute_fp(t):016x}", {"lonely words stand apart": None, None: 1, "": 1, "one other text here": 7}.get(t, 3)) for i, t, _ in rows), key=str)
    assert got == want
    assert simhash.near_duplicates(df.where("doc_id > 100")).collect() == []


def test_query_against_brute_force(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fp(r.text) for r in docs}
    comp = brute_components(set(fp.values()), 3)
    least = {}
    for d, f in fp.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf).collect()}
    assert got == {d: (f"{f:016x}", least[comp[f]]) for d, f in fp.items()}
    assert np.unique([c for _, c in got.values()]).size < len(got)

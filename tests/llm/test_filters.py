import random
from itertools import permutations

import numpy as np
import pytest

from tidewatch.llm import filters as X


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("step", [1, 3, 4096])
def test_merges_against_sets(seed, step):
    r = np.random.default_rng(seed)
    lists = [np.flatnonzero(r.random(int(r.integers(0, 300))) < p) for p in (0.01, 0.5, 0.95, 0.2)]
    sets = [set(x.tolist()) for x in lists]
    assert X.union(lists, step).tolist() == sorted(set.union(*sets))
    assert X.difference(lists[1], [lists[0], lists[3]], step).tolist() == sorted(sets[1] - sets[0] - sets[3])
    assert X.intersection(lists[2], lists[3], step).tolist() == sorted(sets[2] & sets[3])
    for w in X.windows(lists, step):
        assert all(len(x) <= step for x in w)


def test_gallop():
    ids = np.array([1, 4, 4, 9, 20, 30, 31, 32])
    for at in range(len(ids)):
        for bound in range(int(ids[at]), 40):
            assert X.gallop(ids, at, bound) == int(np.searchsorted(ids, bound, side="right"))


def test_filters_on_texts():
    assert X.words("a\tb\x0bc\x1cd\x85e\n") == [b"a", b"b", "c\x1cd\x85e".encode()]
    assert X.short("w " * 199) and not X.short("w " * 200)
    assert not X.repetitive("") and not X.repetitive("a a") and X.repetitive("a a a")
    assert not X.shouting("") and X.shouting("A") and not X.shouting("A" + "é" * 49) and X.shouting("A" + "é" * 48) and not X.shouting("ÄÖ")
    assert X.signs("a|b") and X.signs("100%") and not X.signs("a@b!")


def brute(docs, labels, kinds):
    """docs: (doc_id, text, source). Every order, document by document."""
    fails = []
    for i, t, _ in docs:
        own = {n for n, f in kinds.items() if f is not X.REPEATED and f(t or "")}
        if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs):
            own |= {n for n, f in kinds.items() if f is X.REPEATED}
        fails.append(own)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, total = [], {}
    for part in {s or "" for *_, s in docs}:
        rows = [(i, own) for (i, _, s), own in zip(docs, fails) if (s or "") == part]
        for order in permutations(kinds):
            left = rows
            for k, f in enumerate(order):
                gone = [(i, own) for i, own in left if f in own]
                left = [(i, own) for i, own in left if f not in own]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in own for _, own in rows) - len(gone),
                            sum(own == {f} for _, own in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f])
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("size", [(1 << 16, 1 << 12), (7, 2), (1, 1)])
def test_audit_against_brute_force(spark, size):
    rng = random.Random(5)
    texts = [None, "", "x " * 250, "x y z " * 70, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}#" for i in range(210)), "Short $ One", "plain words"]
    docs = [(rng.choice([None, -4, *range(60)]), rng.choice(texts), rng.choice([None, "", "s", "s", "t"])) for _ in range(90)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, part int, fails int").repartition(3)
    got = X.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), range_rows=size[0], step=size[1]).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, labels, X.FILTERS)


def test_other_filters_and_empty_table(spark):
    kinds = {"x": lambda t: "a" in t, "y": X.REPEATED}
    docs = [(1, "a", "p"), (2, "a", "q"), (3, "b", "p"), (4, "b", "p")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), none, kinds).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, [], kinds)
    assert X.audit(spark.createDataFrame([], "doc_id long, text string, source string"), none).collect() == []

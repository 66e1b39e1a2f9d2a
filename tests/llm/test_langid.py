import random

import numpy as np
import pytest

from tidewatch.llm import langid as L


def brute_phrases(sample, x):
    """Greedy longest matches with parts of the sample, by searching it."""
    s, i, n = " ".join(map(str, sample)), 0, 0
    s = f" {s} "
    while i < len(x):
        k = 0
        while i + k < len(x) and " " + " ".join(map(str, x[i:i + k + 1])) + " " in s:
            k += 1
        i, n = i + max(1, k), n + 1
    return n


@pytest.mark.parametrize("seed", range(20))
def test_parse_equals_search(seed):
    r = random.Random(seed)
    a = r.randint(2, 5)
    sample = [r.randrange(a) for _ in range(r.randint(1, 120))]
    texts = [[r.randrange(a + 1) for _ in range(r.randint(0, 60))] for _ in range(30)]
    texts.sort(key=len, reverse=True)
    m = max(map(len, texts))
    x = np.array([t + [0] * (m - len(t)) for t in texts], np.int32).T
    got = L.Automaton(sample, a + 1).phrases(x, np.array([len(t) for t in texts]))
    assert got.tolist() == [brute_phrases(sample, t) for t in texts]


def test_symbols():
    assert "".join(chr(c) if c else "_" for c in L.symbols("Añ1 2!!bÉ\n ")) == "añ_bé_"
    assert len(L.symbols(None)) == len(L.symbols("")) == 0


def test_bits_add_up_over_stretches(monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 16)
    m = L.Model({"a": L.symbols("the cat sat on the mat"), "b": L.symbols("le chat est sur le tapis")})
    texts = ["the cat " * 9, None, "chat", "", "123"]
    bits = m.bits(texts)
    for i, t in enumerate(texts):
        x = m.numbers(L.symbols(t)).tolist()
        for k, own in enumerate(("the cat sat on the mat", "le chat est sur le tapis")):
            s = m.numbers(L.symbols(own)).tolist()
            n = sum(brute_phrases(s, x[j:j + 16]) for j in range(0, len(x), 16))
            assert bits[i, k] == pytest.approx(n * np.log2(len(s)) / max(1, len(x)))


def test_edge_cases(spark):
    en, fr = "the cat sat on the mat and that is all ", "le chat est sur le tapis et voila tout "
    rows = [(i, (en, fr)[i % 2] * 5, ("en", "fr")[i % 2], 1) for i in range(40)] + [
        (50, None, "en", 1), (51, "", None, 1), (52, "12 !?", None, 1), (None, en, None, 1), (53, fr * 2000, None, 1), (53, fr * 2000, None, 1), (54, "字", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred): r.score for r in L.identify(df, L.train(df)).collect()}
    assert got[50, "und"] == got[51, "und"] == got[52, "und"] == 0.0
    assert got[None, "en"] > 0.9 and got[53, "fr"] > 0.9 and all(0 <= s <= 1 for s in got.values())
    assert L.identify(df.limit(0), L.train(df)).collect() == []
    none = L.identify(df, L.train(df.where("lang = 'zz'"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_query_on_held_out_rows(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_langid"](spark, sf).collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 2000 and np.mean(held) > 0.98

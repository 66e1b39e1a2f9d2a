import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_fp
from tidewatch.llm import query_langid, query_toxicity, toxicity

SF = "/root/testdata/sf0.01"


def brute_distinct(rows):
    """Ids of the rows that stay: the smallest of each group."""
    fp = {r.doc_id: brute_fp(r.text) for r in rows}
    comp, least = brute_components(set(fp.values()), 3), {}
    for d, f in fp.items():
        least[comp[f]] = min(d, least.get(comp[f], d))
    return set(least.values())


def test_run_against_brute_force(spark):
    """Each stage against its plain form on what the stage before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = query_toxicity.model(docs, labels)
    s = toxicity.Scorer(m.net)
    rows = [r for r, v in zip(rows, s.score([r.text for r in rows])) if v < m.cuts.get(r.lang, 0.5)]
    left = docs.where(F.col("doc_id").isin([r.doc_id for r in rows]))
    langs, scores = query_langid.model(left).predict([r.text for r in rows])
    rows = [r for r, v, c in zip(rows, langs, scores) if v != "und" and c >= P.SURE]
    kept = brute_distinct(rows)
    rows = [r for r in rows if r.doc_id in kept]
    got = P.run(spark, SF).collect()
    used, bound = check(got, [(r.doc_id, r.text) for r in rows])
    assert used <= bound + 3
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    total = {r.doc_id for r in docs.collect()}
    assert len({r.doc_id for r in got}) > 0.7 * len(total) and len({r.doc_id for r in got} & toxic) < 0.4 * len(toxic)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, flagged int, row string, _fp int"


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(r.randint(0, 99)) for _ in range(40))
    rows = [(i, text(), ("en", "fr")[i % 2], "s", 1, "keep", 7, "mine", 5) for i in range(60)]
    rows += [(60, None, None, None, None, None, None, None, None), (None, rows[3][1], "en", None, 1, "x", 1, "y", 2), (61, "", "en", "s", 0, "x", 1, "y", 2),
             (5, rows[5][1], "en", "s", 1, "keep", 7, "mine", 5), (62, rows[7][1] + " ", "en", "s", 1, "b", 1, "c", 2), (63, "long " * 30_000, "en", "s", 1, "b", 1, "c", 2)]
    return spark.createDataFrame(rows, ODD)


def test_stages_keep_columns_and_handle_odd_rows(spark, odd):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        kept = [r for i, r in rows.items() if i is not None and i < 60]
        assert kept and all((r.score, r.flagged, r.row, r._fp) == ("keep", 7, "mine", 5) for r in kept), name
    ids = sorted(((r.doc_id is None, r.doc_id) for r in P.keep_distinct(spark, odd, SF).collect()), key=str)
    assert ids == sorted(((False, i) for i in [*range(61), 63]), key=str)
    assert {r.doc_id for r in P.keep_identified(spark, odd, SF).collect()} & {60, 61} == set()


def test_empty_table(spark, odd):
    none = odd.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).collect() == [], name

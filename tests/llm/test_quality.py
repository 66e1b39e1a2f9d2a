import numpy as np

from tidewatch.llm import quality as Q


def test_statistics_of_odd_texts():
    for t in (None, "", " \n", "a", "A" * 5000, "w " * 50_000, "é\n" * 10, "\ud800"):
        assert np.isfinite(Q.statistics(t)).all() and len(Q.statistics(t)) == len(Q.statistics(""))
    assert Q.statistics("a b a b")[13] == 2 / 3


def test_logistic_meets_its_gradient():
    r = np.random.default_rng(0)
    x = np.c_[r.normal(size=(300, 3)), np.ones(300)]
    y = (r.random(300) < Q.sigmoid(x @ [2, -1, 0, 0.5])).astype(float)
    w = Q.logistic(x, y, 1.0)
    g = x.T @ (Q.sigmoid(x @ w) - y) + np.r_[1.0, 1.0, 1.0, 1e-6] * w
    assert np.abs(g).max() < 1e-4
    assert np.isfinite(Q.logistic(np.c_[np.r_[-1.0, 1.0], [1, 1]], np.r_[0.0, 1.0], 1e-3)).all()  # separable


def test_views_teach_each_other():
    r = np.random.default_rng(1)
    n = 3000
    y = (r.random(n) < 0.7).astype(float)
    t, m = r.normal(size=(n, 3)), np.c_[r.integers(0, Q.NAMES, n), r.normal(size=n)].astype(float)
    t[:, 0] += 3 * y
    m[:, 1] += 3 * y
    acc = lambda model: ((model.scores(t[2000:], m[2000:])[0] >= 0.5) == y[2000:]).mean()
    alone, taught = Q.co_train(t[:60], m[:60], y[:60], t[:0], m[:0], 1), Q.co_train(t[:60], m[:60], y[:60], t[60:2000], m[60:2000], 1)
    assert acc(taught) > 0.88 and acc(taught) >= acc(alone)
    assert (Q.co_train(t[:5], m[:5], np.ones(5), t[:0], m[:0], 1).scores(t, m)[0] == 1).all()
    assert (Q.co_train(t[:0], m[:0], np.zeros(0), t[:0], m[:0], 1).scores(t, m)[0] == 0).all()


def test_edge_cases(spark):
    good, bad = "This is a fine and sober sentence about {} things. ", "x### {}$$$ | y%%% | "
    rows = [(i, "".join((good, bad)[i % 3 == 0].format(i * k) for k in range(5)), f"s{i % 4}", "en", i * 10, 0.5) for i in range(300)]
    rows += [(None, None, None, None, None, None), (900, "", "s1", None, 0, None), (1, rows[1][1], "s1", "en", 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 300, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 300]) > 0.97
    none = docs.limit(0)
    assert Q.score(none, Q.train(none, labels.limit(0))).collect() == []


def test_query_on_held_out_rows(spark):
    from tidewatch.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_quality"](spark, sf).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    acc = np.mean([p == q for p, q in held])
    print("held out", len(held), acc, "low found", np.mean([p == 0 for p, q in held if q == 0]), "high kept", np.mean([p == 1 for p, q in held if q == 1]))
    assert len(got) == 10_000 and acc > 0.93

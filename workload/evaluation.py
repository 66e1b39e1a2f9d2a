"""Metrics, thresholds, calibration, bootstrap, subgroups and result tables on scored line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import constants as K
from tidewatch.operators import bootstrap, calibrate, ensemble, guards, metrics, results, split, subgroups, thresholds
from tidewatch.functions.exprs import grid_edges
from tidewatch.operators.joins import spread_join
from workload.base import SCORED, query, rounded, scored, table, wide, wide_sql

MODELS = {"model_a": "p_a", "model_b": "p_b"}
LONG = (f"{SCORED}, long AS (SELECT 'model_a' AS model_name, row_id, row_num, split, y, p_a AS p FROM scored "
        "UNION ALL SELECT 'model_b', row_id, row_num, split, y, p_b FROM scored)")


def long_scores(spark, sf):
    s = scored(spark, sf)
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(c).cast("double").alias("p")) for m, c in MODELS.items()]))
    return s.select("row_id", "row_num", "split", "y", parts.alias("s")).select("s.model_name", "row_id", "row_num", "split", "y", "s.p")


def curve_sql(src: str, groups: str, p: str = "p", w: str | None = None, name: str = "") -> str:
    """cnt/pts CTEs: score counts and running totals by falling score."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    pos, neg = (("sum(y)", "sum(1 - y)") if w is None else (f"sum({w} * y)", f"sum({w} * (1 - y))"))
    return (f"cnt{name} AS (SELECT {g}{p} AS p, {pos} AS pos, {neg} AS neg FROM {src} GROUP BY {g}{p}), "
            f"pts{name} AS (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(neg) OVER ({part}ORDER BY p DESC) AS fp FROM cnt{name})")


_TWO = "sum(pos) > 0 AND sum(neg) > 0"
AUC = f"CASE WHEN {_TWO} THEN sum(neg * (tp - pos / 2.0e0)) / (sum(pos) * 1.0e0 * sum(neg)) END"
AP = f"CASE WHEN {_TWO} THEN sum(pos * (tp * 1.0e0 / (tp + fp))) / sum(pos) ELSE 0.0 END"
PR = f"CASE WHEN {_TWO} THEN sum(pos * (tp * 1.0e0 / (tp + fp) + coalesce((tp - pos) * 1.0e0 / nullif(tp + fp - pos - neg, 0), 1.0)) / 2) / sum(pos) END"
BRIER = "sum(pos * (1 - p) * (1 - p) + neg * p * p) / (sum(pos) + sum(neg))"


def rates_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    d = lambda a, b: f"coalesce(({a}) * 1.0e0 / nullif({b}, 0), 0.0)"
    pr, re = d(tp, f"{tp} + {fp}"), d(tp, f"{tp} + {fn}")
    return {"accuracy": d(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"), "precision": pr, "recall": re, "specificity": d(tn, f"{tn} + {fp}"),
            "f1": f"coalesce(2 * {pr} * {re} / nullif({pr} + {re}, 0), 0.0)", "npv": d(tn, f"{tn} + {fn}")}


def full_sql(src: str, groups: str, thr: str, pre: str = "", digits: int = 6) -> str:
    """Every metric of a points table at a threshold."""
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    inner = (f"SELECT {g}{AUC} AS auc_roc, {AP} AS average_precision, {PR} AS pr_auc, {BRIER} AS brier_score, sum(pos) AS P, sum(neg) AS N, "
             f"coalesce(sum(pos) FILTER (p >= {thr}), 0) AS tp, coalesce(sum(neg) FILTER (p >= {thr}), 0) AS fp, max({thr}) AS threshold FROM {src}{by}")
    r = rates_sql(fn="(P - tp)", tn="(N - fp)")
    rr = ", ".join(f"round({v}, {digits}) AS {k}" for k, v in r.items())
    ms = ", ".join(f"round({m}, {digits}) AS {m}" for m in ("auc_roc", "average_precision", "pr_auc", "brier_score"))
    return (f"SELECT {g}{ms}, CAST(P + N AS BIGINT) AS n, round(P * 1.0e0 / (P + N), {digits}) AS positive_rate, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
            f"CAST(P - tp AS BIGINT) AS fn, CAST(N - fp AS BIGINT) AS tn, CAST(threshold AS DOUBLE) AS threshold, {rr} FROM ({inner}) z")


# --- metrics ---------------------------------------------------------------------------------
@query("binary_metrics", f"WITH {LONG}, {curve_sql('long', 'model_name, split')} " + full_sql("pts", "model_name, split", "0.5e0"))
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(long_scores(spark, sf), 0.5, ["model_name", "split"]))


def _rank_query(col: str, expr: str):
    @query(col if col != "auc" else "auc_roc", f"WITH {LONG}, {curve_sql('long', 'model_name')} SELECT model_name, round({expr}, 6) AS {col} FROM pts GROUP BY model_name")
    def run(spark, sf):
        return rounded(metrics.ranking_metrics(long_scores(spark, sf), ["model_name"]).select("model_name", col))
    return run


_rank_query("auc_roc", AUC)
_rank_query("average_precision", AP)


@query("pr_auc_trapezoid", f"WITH {LONG}, {curve_sql('long', 'model_name')} SELECT model_name, round({PR}, 6) AS pr_auc FROM pts GROUP BY model_name")
def pr_auc_trapezoid(spark, sf):
    return rounded(metrics.ranking_metrics(long_scores(spark, sf), ["model_name"]).select("model_name", "pr_auc"))


@query("brier", f"WITH {LONG} SELECT model_name, split, round(avg((p - y) * (p - y)), 6) AS brier_score FROM long GROUP BY 1, 2")
def brier(spark, sf):
    return rounded(metrics.brier(long_scores(spark, sf), ["model_name", "split"]))


_TOT = "(SELECT sum(pos) AS n_pos, sum(neg) AS n_neg FROM cnt) t"


@query("roc_points", f"WITH {SCORED}, {curve_sql('scored', '', 'p_a')} SELECT round(p, 9) AS threshold, round(fp * 1.0e0 / n_neg, 9) AS fpr, round(tp * 1.0e0 / n_pos, 9) AS tpr FROM pts, {_TOT}")
def roc_points(spark, sf):
    return rounded(metrics.roc_points(scored(spark, sf), p="p_a").withColumn("threshold", F.col("threshold").cast("double")), 9).select(
        "fpr", "tpr", "threshold")


@query("pr_points", f"WITH {SCORED}, {curve_sql('scored', '', 'p_b')} SELECT CAST(p AS DOUBLE) AS threshold, round(tp * 1.0e0 / (tp + fp), 9) AS precision, round(tp * 1.0e0 / n_pos, 9) AS recall FROM pts, {_TOT}")
def pr_points(spark, sf):
    return rounded(metrics.pr_points(scored(spark, sf), p="p_b"), 9)


# --- thresholds -----------------------------------------------------------------------------
def table_sql(src: str, groups: str, name: str = "") -> str:
    """CTE tt: the threshold table of a (groups, y, p) source."""
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    join = f"JOIN tot{name} USING ({groups})" if groups else f"CROSS JOIN tot{name}"
    r = rates_sql(fn="(n_pos - tp)", tn="(n_neg - fp)")
    return (f"tot{name} AS (SELECT {g}sum(y) AS n_pos, sum(1 - y) AS n_neg FROM {src}{by}), "
            f"tc{name} AS (SELECT {g}p, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT {g}CAST(p AS DOUBLE) AS p, y AS pos, 1 - y AS neg FROM {src} "
            f"UNION ALL SELECT {g}unnest([0.0e0, 1.0e0]), 0, 0 FROM tot{name}) u GROUP BY {g}p), "
            f"tw{name} AS (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS tp, sum(neg) OVER ({part}ORDER BY p DESC) AS fp FROM tc{name}), "
            f"tt{name} AS (SELECT {g}p AS threshold, {', '.join(f'{r[k]} AS {k}' for k in ('precision', 'recall', 'f1', 'specificity', 'npv'))}, "
            f"CAST(n_neg - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(n_pos - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, "
            f"CAST(fp * 1.0e0 + (n_pos - tp) * 2.0e0 AS DOUBLE) AS cost FROM tw{name} {join})")


_VALID = "valid AS (SELECT model_name, y, p FROM long WHERE split = 'validation')"
_SA = "sa AS (SELECT y, p_a AS p FROM scored)"


@query("threshold_table", f"WITH {LONG}, {_VALID}, {table_sql('valid', 'model_name')} SELECT model_name, threshold, "
       + ", ".join(f"round({k}, 9) AS {k}" for k in ("precision", "recall", "f1", "specificity", "npv")) + ", tn, fp, fn, tp, cost FROM tt")
def threshold_table(spark, sf):
    v = long_scores(spark, sf).where("split = 'validation'")
    t = thresholds.threshold_table(v, ["model_name"])
    return t.withColumns({k: F.round(k, 9) for k in ("precision", "recall", "f1", "specificity", "npv")})


def policy_sql(groups: str, src: str = "tt") -> str:
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    s = lambda order: f"max(({order}, threshold, precision, recall, f1))"
    f = lambda order, cond: f"{s(order)} FILTER ({cond})"
    return (f"pol AS (SELECT {g}{f('threshold', 'recall >= 0.85')} AS hs, {f('recall, precision', 'precision > (tp + fn) * 1.0e0 / (tp + fn + fp + tn)')} AS hs1, "
            f"{s('recall, precision')} AS hs2, {s('f1')} AS bf, {f('threshold', 'precision >= 0.65 AND tp + fp > 0')} AS hp, "
            f"{f('precision, recall', 'recall >= 0.2')} AS hp1, {s('precision, recall')} AS hp2 FROM {src}{by}), "
            "sel AS (" + " UNION ALL ".join(
                f"SELECT {g}'{n}' AS policy, {t} AS threshold, {fb} AS fallback_used, {pr} AS precision, {re} AS recall, {f1} AS f1 FROM pol"
                for n, t, fb, pr, re, f1 in [
                    ("high_sensitivity", *_pick("hs", "hs1", "hs2")), ("balanced_f1", *_one("bf")), ("high_precision", *_pick("hp", "hp1", "hp2"))]) + ")")


def _pick(a, b, c):
    at = lambda i: f"coalesce(CASE WHEN {a} IS NOT NULL THEN {a}[{i + 1}] END, CASE WHEN {b} IS NOT NULL THEN {b}[{i + 2}] END, {c}[{i + 2}])"
    return at(1), f"({a} IS NULL)", at(2), at(3), at(4)


def _one(a):
    return f"{a}[2]", "false", f"{a}[3]", f"{a}[4]", f"{a}[5]"


_POL = f"WITH {LONG}, {_VALID}, {table_sql('valid', 'model_name')}, {policy_sql('model_name')}"


@query("threshold_policies", _POL + " SELECT model_name, policy, threshold, fallback_used, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sel")
def threshold_policies(spark, sf):
    t = thresholds.threshold_table(long_scores(spark, sf).where("split = 'validation'"), ["model_name"])
    out = thresholds.select_policies(t, ["model_name"])
    return out.withColumns({k: F.round(k, 6) for k in ("precision", "recall", "f1")})


def _best(name: str, order: str) -> str:
    return (f"SELECT '{name}' AS strategy, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, cost FROM "
            f"(SELECT * FROM tt ORDER BY {order}, threshold LIMIT 1) x{name}")


@query("optimal_threshold", f"WITH {SCORED}, {_SA}, {table_sql('sa', '')} " + " UNION ALL ".join(
    [_best("f1", "f1 DESC"), _best("cost", "cost"), _best("balanced", "abs(precision - recall)")]))
def optimal_threshold(spark, sf):
    t = thresholds.threshold_table(scored(spark, sf).select("y", F.col("p_a").alias("p")))
    out = None
    for s in ("f1", "cost", "balanced"):
        one = thresholds.optimal_threshold(t, s)
        out = one if out is None else out.unionByName(one)
    return out.select("strategy", "threshold", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")], "cost")


def grid_sql(src: str, grid: list[float], p: str) -> str:
    pts = ", ".join(f"{t!r}e0" for t in grid)
    return (f"gr AS (SELECT unnest([{pts}]) AS threshold), conf AS (SELECT threshold, sum(y) FILTER ({p} >= threshold) AS tp0, "
            f"count(*) FILTER ({p} >= threshold) AS pp, sum(y) AS P, count(*) AS T FROM {src}, gr GROUP BY 1), "
            "cf AS (SELECT threshold, CAST(coalesce(tp0, 0) AS BIGINT) AS tp, CAST(pp - coalesce(tp0, 0) AS BIGINT) AS fp, "
            "CAST(P - coalesce(tp0, 0) AS BIGINT) AS fn, CAST(T - P - (pp - coalesce(tp0, 0)) AS BIGINT) AS tn FROM conf)")


_R = rates_sql()


@query("utility_sweep", f"WITH {SCORED}, {grid_sql('scored', thresholds.linear_grid(0.1, 0.9, 17), 'p_a')}, r AS (SELECT threshold, "
       + ", ".join(f"{_R[k]} AS {k}" for k in ("accuracy", "precision", "recall", "f1")) + """ FROM cf)
SELECT threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
 round((recall * 1.5 + precision) / 2.5, 6) AS clinical_utility, round((recall + precision) / 2, 6) AS balanced,
 round(coalesce(3.25 * precision * recall / nullif(2.25 * precision + recall, 0), 0), 6) AS f_beta FROM r""")
def utility_sweep(spark, sf):
    return _keep_threshold(thresholds.utility_sweep(scored(spark, sf), p="p_a"))


def _keep_threshold(df, digits=6):
    return df.select(*[F.col(c) if c == "threshold" or t != "double" else F.round(c, digits).alias(c) for c, t in df.dtypes])


@query("cost_sweep", f"WITH {SCORED}, {grid_sql('scored', thresholds.linear_grid(0.01, 0.99, 99), 'p_a')}, c AS (SELECT fn_cost, threshold, fp * 1.0e0 + fn * fn_cost AS cost, {_R['f1']} AS f1 "
       "FROM cf, (SELECT unnest([1.0e0, 2.0e0, 4.0e0, 8.0e0, 16.0e0]) AS fn_cost) f) SELECT fn_cost, threshold, cost, round(f1, 6) AS f1 FROM c QUALIFY row_number() OVER (PARTITION BY fn_cost ORDER BY cost, threshold) = 1")
def cost_sweep(spark, sf):
    return _keep_threshold(thresholds.cost_sweep(scored(spark, sf), p="p_a"))


@query("named_thresholds", f"WITH {SCORED}, {grid_sql('scored', sorted(K.NAMED_THRESHOLDS.values()), 'p_a')} SELECT CASE threshold "
       + " ".join(f"WHEN {v}e0 THEN '{k}'" for k, v in K.NAMED_THRESHOLDS.items()) + " END AS name, threshold, tp, fp, fn, tn, "
       + ", ".join(f"round({v}, 6) AS {k}" for k, v in _R.items()) + " FROM cf")
def named_thresholds(spark, sf):
    return _keep_threshold(thresholds.named_thresholds(scored(spark, sf), p="p_a"))


_FIXED = (_POL + ", fx AS (SELECT * FROM long WHERE split IN ('validation', 'test')), " + curve_sql("fx", "model_name, split")
          + ", ap AS (SELECT c.*, s.policy AS threshold_policy, s.threshold AS thr FROM pts c JOIN sel s USING (model_name)), rec AS ("
          + full_sql("ap", "model_name, split, threshold_policy", "thr") + ")")
_FIELDS = ", ".join(K.RESULT_FIELDS)


@query("fixed_thresholds", _FIXED + f" SELECT {_FIELDS} FROM rec")
def fixed_thresholds(spark, sf):
    return _keep_threshold(thresholds.fixed_thresholds(long_scores(spark, sf)))


# --- calibration ------------------------------------------------------------------------------
def bin_sql(p: str, n: int = 10) -> str:
    e = grid_edges(n)
    return "CASE " + " ".join(f"WHEN {p} >= {e[i]!r}e0 AND {p} {'<=' if i == n - 1 else '<'} {e[i + 1]!r}e0 THEN {i}" for i in range(n)) + " END"


_BINS = f"bins AS (SELECT model_name, {bin_sql('p')} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS oy FROM long GROUP BY 1, 2)"


@query("ece", f"WITH {LONG}, {_BINS} SELECT model_name, round(sum(n * abs(mp - oy)) / sum(n), 6) AS expected_calibration_error FROM bins GROUP BY 1")
def ece(spark, sf):
    return rounded(metrics.ece(long_scores(spark, sf), ["model_name"]))


_E = grid_edges(10)


@query("calibration_curve", f"WITH {LONG}, {_BINS}, f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_E[i]!r}e0, {_E[i + 1]!r}e0)" for i in range(10))
       + ") t(bin, lower, upper)) SELECT f.bin, lower, upper, coalesce(n, 0) AS n, round(mp, 6) AS mean_predicted_probability, round(oy, 6) AS observed_event_rate FROM f LEFT JOIN (SELECT * FROM bins WHERE model_name = 'model_a') b ON b.bin = f.bin")
def calibration_curve(spark, sf):
    out = metrics.calibration_curve(scored(spark, sf), p="p_a")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_predicted_probability", "observed_event_rate")})


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))"


def newton_sql(src: str, groups: str, ridge: float, steps: int = 10) -> str:
    """Ten Newton steps as a chain of CTEs; k10 holds a (intercept) and b (slope)."""
    g = f"{groups}, " if groups else ""
    by = f" GROUP BY {groups}" if groups else ""
    out = [f"nc AS MATERIALIZED (SELECT {g}{_LOGIT} AS x, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {g}p)"]
    for i in range(1, steps + 1):
        if i == 1:
            frm, a, b = "nc", "0.0e0", "0.0e0"
        else:
            frm = f"nc JOIN k{i - 1} USING ({groups})" if groups else f"nc CROSS JOIN k{i - 1}"
            a, b = "a", "b"
        mu = f"(1 / (1 + exp(-greatest(-50.0e0, least(50.0e0, {a} + {b} * x)))))"
        out.append(
            f"s{i} AS MATERIALIZED (SELECT {g}any_value({a}) AS a0, any_value({b}) AS b0, sum((pos + neg) * {mu} * (1 - {mu})) AS h00, sum((pos + neg) * {mu} * (1 - {mu}) * x) AS h01, "
            f"sum((pos + neg) * {mu} * (1 - {mu}) * x * x) + {ridge} AS h11, sum(pos - (pos + neg) * {mu}) AS g0, sum((pos - (pos + neg) * {mu}) * x) - {ridge} * any_value({b}) AS g1, "
            f"sum(pos) AS sp, sum(neg) AS sn FROM {frm}{by}), "
            f"k{i} AS MATERIALIZED (SELECT {g}CASE WHEN sp > 0 AND sn > 0 THEN a0 + (h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0) END AS a, "
            f"CASE WHEN sp > 0 AND sn > 0 THEN b0 + (h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0) END AS b FROM s{i})")
    return ", ".join(out)


@query("calibration_slope", f"WITH {LONG}, {newton_sql('long', 'model_name, split', 1e-6)} SELECT model_name, split, round(a, 5) AS calibration_intercept, round(b, 5) AS calibration_slope FROM k10")
def calibration_slope(spark, sf):
    return rounded(calibrate.calibration_slope(long_scores(spark, sf), ["model_name", "split"]), 5)


_VA = "va AS (SELECT y, p_a AS p FROM scored WHERE split = 'validation')"


@query("platt_scale", f"WITH {SCORED}, {_VA}, {newton_sql('va', '', 1.0)} SELECT row_id, split, round(1 / (1 + exp(-greatest(-50, least(50, a + b * {_LOGIT.replace('p)', 'p_a)')})))), 5) AS p_calibrated FROM scored, k10 WHERE split <> 'train'")
def platt_scale(spark, sf):
    s = scored(spark, sf).select("row_id", "split", "y", F.col("p_a").alias("p"))
    fitted = calibrate.fit_platt(s.where("split = 'validation'"))
    return rounded(calibrate.apply_platt(s.where("split <> 'train'"), fitted).select("row_id", "split", "p_calibrated"), 5)


@query("platt_metadata", f"WITH {SCORED}, {_VA}, {newton_sql('va', '', 1.0)} SELECT 'platt_scaling' AS method, 'validation' AS fit_split, (SELECT count(*) FROM va) AS fit_n, "
       "round((SELECT avg(y) FROM va), 5) AS fit_positive_rate, round(b, 5) AS coefficient, round(a, 5) AS intercept, 1.0e0 AS C FROM k10")
def platt_metadata(spark, sf):
    s = scored(spark, sf).select("split", "y", F.col("p_a").alias("p"))
    return rounded(calibrate.fit_platt(s.where("split = 'validation'")), 5)


def _isotonic_sql(score: str) -> str:
    """Max-min form of the isotonic fit over the distinct validation scores: the value at i is the largest, over starts a
    up to i, of the smallest mean of a..b over ends b from i on."""
    return f"""iso_c AS (SELECT {score} AS p, sum(y) AS s, count(*) AS n FROM scored WHERE split = 'validation' GROUP BY 1),
iso_r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(s) OVER (ORDER BY p) AS cs, sum(n) OVER (ORDER BY p) AS cn, s, n FROM iso_c),
iso_t AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM iso_r a JOIN iso_r b ON b.i >= a.i),
iso_m AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM iso_t),
iso AS (SELECT p, max(m) AS v FROM iso_m JOIN iso_r USING (i) GROUP BY p)"""


@query("isotonic_scale", f"WITH {SCORED}, {_isotonic_sql('p_b')} SELECT row_id, split, s.p_b AS p, round(v, 6) AS p_calibrated FROM scored s LEFT JOIN iso ON iso.p = s.p_b")
def isotonic_scale(spark, sf):
    s = scored(spark, sf).select("row_id", "split", "y", F.col("p_b").alias("p"))
    out = calibrate.apply_isotonic(s, calibrate.fit_isotonic(s.where("split = 'validation'"))).drop("y")
    return out.withColumn("p_calibrated", F.round("p_calibrated", 6))


_FINE = "round(p_a, 2)"


@query("isotonic_curve", f"WITH {SCORED}, {_isotonic_sql(_FINE)} SELECT p, n, CAST(s AS BIGINT) AS pos, round(v, 6) AS p_calibrated FROM iso_c JOIN iso USING (p)")
def isotonic_curve(spark, sf):
    """The fitted curve at every validation score, to two decimals."""
    s = scored(spark, sf).where("split = 'validation'").select("y", F.expr(_FINE).alias("p"))
    seen = s.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"))
    out = calibrate.apply_isotonic(seen, calibrate.fit_isotonic(s))
    return out.select("p", "n", "pos", F.round("p_calibrated", 6).alias("p_calibrated"))


# --- bootstrap ----------------------------------------------------------------------------------
B = 200
_W = "CASE " + " ".join(f"WHEN u / 4294967296.0e0 < {c}e0 THEN {k}" for k, c in enumerate(
    [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183,
     0.9999167588507119, 0.9999897508033253])) + " ELSE 8 END"


def mixed(src: str, name: str, expr: str, out: str) -> str:
    """CTE ``name``: ``src`` with ``out``, the 32-bit mix of an expression; each step is a column, as it is used twice."""
    m = 4294967295
    return (f"{name}_1 AS (SELECT *, {expr} AS _x FROM {src}), {name}_2 AS (SELECT * EXCLUDE _x, (xor(_x, _x >> 16) * 569420461) & {m} AS _x FROM {name}_1), "
            f"{name}_3 AS (SELECT * EXCLUDE _x, (xor(_x, _x >> 15) * 1935289751) & {m} AS _x FROM {name}_2), "
            f"{name} AS (SELECT * EXCLUDE _x, xor(_x, _x >> 15) AS {out} FROM {name}_3)")


def boot_sql(src: str, groups: str, thr: str) -> str:
    steps = ["seed0 AS (SELECT 12345::BIGINT AS s0)", mixed("seed0", "seed1", "s0", "s"), mixed("seed1", "seed2", "xor(s, 1013904242)", "s2"),
             "rep0 AS (SELECT unnest(range(1, " + str(B + 1) + ")) AS b, s FROM seed2)", mixed("rep0", "rep1", "xor(b, s)", "r"),
             f"row0 AS (SELECT *, row_num & 4294967295 AS lo, (row_num >> 32) & 4294967295 AS hi FROM {src}, (SELECT s, s2 FROM seed2) q)",
             mixed("row0", "row1", "xor(lo, s)", "a0"), mixed("row1", "row2", "xor(a0, hi)", "a"),
             mixed("row2", "row3", "xor(lo, s2)", "b0"), mixed("row3", "row4", "xor(b0, hi)", "c"),
             "cell0 AS (SELECT row4.* EXCLUDE (s, s2, lo, hi, a0, b0), rep1.b, rep1.r FROM row4, rep1)",
             mixed("cell0", "cell1", "xor(a, r)", "t"), mixed("cell1", "cell2", "xor(t, c)", "u"),
             f"bw AS (SELECT *, {_W} AS w FROM cell2)", "bs AS (SELECT * EXCLUDE (a, c, r, t, u) FROM bw WHERE w > 0)"]
    return ", ".join(steps) + ", " + curve_sql("bs", groups, "p", "w") + ", bm AS (" + full_sql("pts", groups, thr, digits=15) + ")"


_BOOT = ("auc_roc", "average_precision", "brier_score", "accuracy", "precision", "recall", "specificity", "f1", "npv")


@query("bootstrap_ci", f"WITH {SCORED}, src AS (SELECT row_num, y, p_a AS p FROM scored), {boot_sql('src', 'b', '0.5e0')} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(quantile_cont({m}, 0.025), 6) AS ci_lower, round(quantile_cont({m}, 0.975), 6) AS ci_upper, count({m}) AS n_success, {B} AS n_boot, 0.95::DOUBLE AS confidence FROM bm" for m in _BOOT))
def bootstrap_ci(spark, sf):
    s = scored(spark, sf).select("row_num", "y", F.col("p_a").alias("p"))
    return rounded(bootstrap.bootstrap_ci(s, "row_num", n_boot=B))


@query("paired_bootstrap", f"WITH {LONG}, {boot_sql('long', 'model_name, b', '0.5e0')}, d AS (SELECT b, max(auc_roc) FILTER (model_name = 'model_a') - max(auc_roc) FILTER (model_name = 'model_b') AS d FROM bm GROUP BY b), "
       + curve_sql("long", "model_name", name="_f") + f", e AS (SELECT model_name, {AUC} AS v FROM pts_f GROUP BY 1), x AS (SELECT max(v) FILTER (model_name = 'model_a') AS ea, max(v) FILTER (model_name = 'model_b') AS eb FROM e) "
       "SELECT 'model_a' AS model_a, 'model_b' AS model_b, 'auc_roc' AS metric, round(any_value(ea), 6) AS estimate_a, round(any_value(eb), 6) AS estimate_b, round(any_value(ea - eb), 6) AS difference, "
       "round(quantile_cont(d, 0.025), 6) AS ci_lower, round(quantile_cont(d, 0.975), 6) AS ci_upper, least(1.0, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END)))::DOUBLE AS p_value_two_sided, "
       f"{B} AS n_boot, count(d) AS n_success, 0.95::DOUBLE AS confidence FROM d, x")
def paired_bootstrap(spark, sf):
    return rounded(bootstrap.paired_difference(scored(spark, sf), "row_num", metric="auc_roc", model_a=("model_a", "p_a"),
                                               model_b=("model_b", "p_b"), n_boot=B))


# --- subgroups ------------------------------------------------------------------------------------
_SUB = ["age", "gender", "lactate_max", "panel_missing_count_0_6h", "total_lab_count", "first_careunit", "ventilated", "risk", "mortality"]


def _sub(spark, sf):
    return wide(spark, sf, _SUB).withColumnsRenamed({"mortality": "y", "risk": "p"})


_BAND = "CASE WHEN age <= 49 THEN '<50' WHEN age <= 64 THEN '50-64' WHEN age <= 79 THEN '65-79' WHEN age > 79 THEN '80+' END"
_QUART = "CASE WHEN r <= 1 + (n - 1) * 1.0e0 / 4 THEN 'Q1' WHEN r <= 1 + (n - 1) * 2.0e0 / 4 THEN 'Q2' WHEN r <= 1 + (n - 1) * 3.0e0 / 4 THEN 'Q3' ELSE 'Q4' END"
_LABELS = (f"WITH {wide_sql(_SUB)}, rk AS (SELECT *, row_number() OVER (ORDER BY total_lab_count, md5(CAST(stay_id AS VARCHAR)), stay_id) AS r, count(*) OVER () AS n FROM wide), "
           f"lab AS (SELECT stay_id, mortality AS y, risk AS p, {_BAND} AS g_age_group, gender AS g_sex, first_careunit AS g_icu_unit_type, "
           "CASE WHEN lactate_max IS NULL THEN 'lactate_not_measured' ELSE 'lactate_measured' END AS g_lactate_measured, "
           "CASE WHEN panel_missing_count_0_6h > (SELECT median(panel_missing_count_0_6h) FROM wide) THEN 'high_missingness' ELSE 'low_missingness' END AS g_missingness_level, "
           f"CASE WHEN ventilated = 1 THEN 'ventilated' ELSE 'not_ventilated' END AS g_ventilation_status, {_QUART} AS g_measurement_intensity_quartile FROM rk)")
_G = ["g_age_group", "g_sex", "g_icu_unit_type", "g_lactate_measured", "g_missingness_level", "g_ventilation_status",
      "g_measurement_intensity_quartile"]


@query("subgroup_labels", _LABELS + " SELECT stay_id, " + ", ".join(_G) + " FROM lab")
def subgroup_labels(spark, sf):
    return subgroups.subgroup_labels(_sub(spark, sf), "stay_id").select("stay_id", *_G)


@query("rank_quartile", f"WITH e AS (SELECT event_id, floor(value) AS v, row_number() OVER (ORDER BY floor(value), md5(CAST(event_id AS VARCHAR)), event_id) AS r, count(*) OVER () AS n FROM events) "
       f"SELECT event_id, v::BIGINT AS v, CAST(substr({_QUART}, 2) AS INTEGER) AS quartile FROM e")
def rank_quartile(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor("value").alias("v"))
    return subgroups.rank_quartile(e, "v", "event_id")


_SUBLONG = ("sl AS (" + " UNION ALL ".join(f"SELECT '{g[2:]}' AS subgroup_variable, CAST({g} AS VARCHAR) AS subgroup, y, p FROM lab WHERE {g} IS NOT NULL" for g in _G) + ")")


@query("subgroup_metrics", _LABELS + f", {_SUBLONG}, {curve_sql('sl', 'subgroup_variable, subgroup')}, m AS ({full_sql('pts', 'subgroup_variable, subgroup', '0.3e0')}), "
       + newton_sql("sl", "subgroup_variable, subgroup", 1e-6)
       + " SELECT subgroup_variable, subgroup, n < 30 AS small_subgroup, CASE WHEN n < 30 THEN 'small subgroup; interpret cautiously' ELSE 'aggregate subgroup estimate' END AS interpretation_note, "
       "positive_rate AS mortality_rate, auc_roc, average_precision, brier_score, round(b, 4) AS calibration_slope, round(a, 4) AS calibration_intercept, recall AS recall_at_screening_threshold, "
       "precision AS precision_at_screening_threshold, specificity AS specificity_at_screening_threshold, threshold, n FROM m JOIN k10 USING (subgroup_variable, subgroup)")
def subgroup_metrics(spark, sf):
    lab = subgroups.subgroup_labels(_sub(spark, sf), "stay_id")
    out = rounded(subgroups.subgroup_metrics(lab, threshold=0.3))
    return out.withColumns({c: F.round(c, 4) for c in ("calibration_slope", "calibration_intercept")})


# --- ensembles and result tables -------------------------------------------------------------------
def _pred(spark, sf):
    return long_scores(spark, sf).select("model_name", "split", "row_id", F.col("y").alias("y_true"), F.col("p").alias("p_pred"))


@query("prediction_contract", f"""WITH {LONG} SELECT * FROM (VALUES ('column:split', true), ('column:model_name', true), ('column:y_true', true), ('column:p_pred', true),
 ('forbidden:subject_id', true), ('forbidden:hadm_id', true), ('forbidden:stay_id', true), ('forbidden:patient_id', true), ('forbidden:icustay_id', true)) t(check_name, passed)
UNION ALL SELECT 'has_rows', count(*) > 0 FROM long UNION ALL SELECT 'labels_binary', count(*) FILTER (y NOT IN (0, 1)) = 0 FROM long
UNION ALL SELECT 'scores_in_range', count(*) FILTER (p < 0 OR p > 1) = 0 FROM long""")
def prediction_contract(spark, sf):
    return guards.prediction_contract(_pred(spark, sf))


@query("prediction_pivot", f"WITH {SCORED} SELECT row_id, y AS y_true, CAST(p_a AS DOUBLE) AS model_a, CAST(p_b AS DOUBLE) AS model_b FROM scored")
def prediction_pivot(spark, sf):
    return ensemble.prediction_pivot(_pred(spark, sf), list(MODELS))


@query("ensemble_average", f"WITH {SCORED}, src AS (SELECT split, y, (p_a + p_b) / 2 AS p FROM scored), {curve_sql('src', 'split')} " + full_sql("pts", "split", "0.5e0"))
def ensemble_average(spark, sf):
    s = ensemble.ensemble_average(scored(spark, sf), ["p_a", "p_b"], "p")
    return rounded(metrics.binary_metrics(s, 0.5, ["split"]))


@query("primary_results", _FIXED + f" SELECT {_FIELDS} FROM rec WHERE split = 'test' AND threshold_policy = 'balanced_f1' ORDER BY average_precision DESC")
def primary_results(spark, sf):
    rec = thresholds.fixed_thresholds(long_scores(spark, sf))
    return _keep_threshold(results.primary_results(rec).select(*K.RESULT_FIELDS))


_CI = ["auc_roc", "brier_score"]


@query("model_comparison", _FIXED + f", te AS (SELECT model_name, row_num, y, p FROM long WHERE split = 'test'), " + boot_sql("te", "model_name, b", "0.5e0").replace("cnt ", "cnt_b ").replace("FROM cnt)", "FROM cnt_b)").replace("pts AS", "pts_b AS").replace("FROM pts ", "FROM pts_b ")
       + ", ci AS (SELECT model_name, " + ", ".join(
           f"round(quantile_cont({m}, 0.025), 6) AS {m}_ci_lower, round(quantile_cont({m}, 0.975), 6) AS {m}_ci_upper, count({m}) AS {m}_ci_n_success" for m in _CI)
       + f" FROM bm GROUP BY 1) SELECT {_FIELDS}, " + ", ".join(f"{m}_ci_lower, {m}_ci_upper, {m}_ci_n_success" for m in _CI)
       + " FROM rec JOIN ci USING (model_name) WHERE split = 'test' AND threshold_policy = 'balanced_f1'")
def model_comparison(spark, sf):
    rows = long_scores(spark, sf)
    ivs = None
    for m in MODELS:
        iv = bootstrap.bootstrap_ci(rows.where((F.col("split") == "test") & (F.col("model_name") == m)), "row_num", n_boot=B, metrics=tuple(_CI))
        iv = iv.withColumn("model_name", F.lit(m))
        ivs = iv if ivs is None else ivs.unionByName(iv)
    out = results.model_comparison(thresholds.fixed_thresholds(rows), ivs, _CI)
    return _keep_threshold(out.select(*K.RESULT_FIELDS, *[f"{m}_ci_{x}" for m in _CI for x in ("lower", "upper", "n_success")]))


_RUNS = f"{SCORED}, runs AS (SELECT 'score_a' AS run_name, y, p_a AS p FROM scored UNION ALL SELECT 'score_b', y, p_b FROM scored UNION ALL SELECT 'average', y, (p_a + p_b) / 2 FROM scored)"


@query("ablation_table", f"WITH {_RUNS}, {curve_sql('runs', 'run_name')}, m AS (SELECT run_name, {AUC} AS auc_roc, {AP} AS average_precision FROM pts GROUP BY 1), b AS (SELECT * FROM m WHERE run_name = 'score_b') "
       "SELECT m.run_name, round(m.auc_roc, 6) AS auc_roc, round(m.average_precision, 6) AS average_precision, round(m.auc_roc - b.auc_roc, 6) AS delta_auc_roc, "
       "round(m.average_precision - b.average_precision, 6) AS delta_average_precision FROM m, b")
def ablation_table(spark, sf):
    s = scored(spark, sf)
    runs = F.explode(F.array(*[F.struct(F.lit(n).alias("run_name"), e.cast("double").alias("p")) for n, e in {
        "score_a": F.col("p_a"), "score_b": F.col("p_b"), "average": (F.col("p_a") + F.col("p_b")) / 2}.items()]))
    long = s.select("y", runs.alias("s")).select("y", "s.run_name", "s.p")
    m = metrics.ranking_metrics(long, ["run_name"])
    return rounded(results.ablation_table(m, "score_b", ["auc_roc", "average_precision"]))


_FOLD = ("ent AS (SELECT entity, max(y) AS y FROM scored GROUP BY 1), rk AS (SELECT entity, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(entity AS VARCHAR) || '|42'), entity) AS r, "
         "count(*) OVER (PARTITION BY y) AS n FROM ent), fo AS (SELECT entity, (r - 1) % least(5, (SELECT min(n) FROM rk)) AS fold FROM rk)")


@query("cv_metrics", f"WITH {SCORED}, {_FOLD}, src AS (SELECT fold, s.y, p_a AS p FROM scored s JOIN fo USING (entity)), {curve_sql('src', 'fold')}, "
       f"m AS (SELECT fold, {AUC} AS auc_roc, {AP} AS average_precision FROM pts GROUP BY 1) " + " UNION ALL ".join(
           f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS folds FROM m" for c in ("auc_roc", "average_precision")))
def cv_metrics(spark, sf):
    s = scored(spark, sf).withColumn("p", F.col("p_a"))
    rows = spread_join(s, split.fold_entities(s, "entity", "y", k=5), ["entity"], by=["row_num"])
    return rounded(results.fold_metrics(metrics.ranking_metrics(rows, ["fold"]), ["auc_roc", "average_precision"]))


@query("odds_ratios", "WITH c AS (SELECT l_suppkey AS feature, ln(sum(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0 END) + 0.5) - ln(sum(CASE WHEN l_returnflag <> 'R' THEN 1.0e0 ELSE 0 END) + 0.5) AS k FROM lineitem GROUP BY 1) "
       "SELECT feature, round(k, 6) AS coefficient, round(exp(k), 6) AS odds_ratio, round((exp(k) - 1) * 100, 6) AS pct_change FROM c")
def odds_ratios(spark, sf):
    r = F.col("l_returnflag") == "R"
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feature")).agg(
        (F.log(F.sum(F.when(r, 1.0).otherwise(0)) + 0.5) - F.log(F.sum(F.when(~r, 1.0).otherwise(0)) + 0.5)).alias("coefficient"))
    return rounded(results.odds_ratios(c))


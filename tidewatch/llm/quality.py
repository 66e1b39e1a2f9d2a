"""Quality by co-training of a text view and a metadata view.

The text view is statistics of a document's content, cut into bins; the metadata view is its columns:
hashed values of names, bins of numbers. Each is a logistic regression. From labelled rows they start
apart; in every round each labels the rows of an unlabelled pool that it is most sure of for the other,
which learns from them. At the end each is calibrated by Platt scaling on rows kept out of the fit, and
a logistic regression over the two calibrated logits gives the score of every document: the probability
of quality 1.

The fit takes bounded samples, picked by id hash: ``LABELLED`` labelled training rows and ``POOL``
rows without a training label. Counts and cuts of the fit come from them; scoring is a map over all rows.

Defined cases: a null or empty text and null metadata have values of their own; a null label is no
training row; with labels of one class only, or none, every score is that class's rate, or 0; repeated
rows are scored alike; an empty table gives an empty table; extra columns are kept."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import append, sampled

LABELLED, POOL = 8000, 8000
BINS, NAMES = 12, 64  # bins of a number, hashed values of a name
ROUNDS, STEP, SURE = 5, 0.05, 0.9  # pool rows labelled per round and view, as a share; how sure a view must be

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_OTHER = np.zeros(256)
_OTHER[33:128] = 1
_OTHER -= _UPPER + _LOWER + _DIGIT
_STOP = np.zeros(256)
_STOP[[33, 44, 46, 58, 59, 63]] = 1  # ! , . : ; ?


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text as a whole."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    top = counts.most_common(1)[0][1] if counts else 0
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    marks = float(_OTHER @ c)
    return [np.log1p(len(words)), lens.mean(), lens.std(), float(lens.max()), float(_UPPER @ c) / size, float(_DIGIT @ c) / size, marks / size,
            (marks - float(_STOP @ c)) / size, float(_STOP @ c) / size, float(_SPACE @ c) / size, float(c[128:].sum()) / size,
            len(counts) / n ** 0.8, top / n, pairs / max(1, len(words) - 1), np.log1p(len(lines)), len(words) / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)), float(c[124]) / n, float(c[33]) / n, float((lens <= 3).mean())]


def metadata(names: list, numbers: list) -> list[float]:
    """A row's columns: hashed names (-1 for null), numbers on a log scale (NaN for null)."""
    out = [-1.0 if v is None else float(zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % NAMES) for v in names]
    return out + [float("nan") if v is None else float(np.sign(v) * np.log1p(abs(float(v)))) for v in numbers]


class View:
    """Logistic regression over bins of numbers and over names."""

    def __init__(self, x: np.ndarray, names: int = 0):
        self.names = names  # the first columns are names
        self.cuts = [np.unique(np.quantile(col[~np.isnan(col)], np.arange(1, BINS) / BINS)) if (~np.isnan(col)).any() else np.zeros(0) for col in x.T[names:]]
        self.width = [NAMES + 1] * names + [len(c) + 2 for c in self.cuts]
        self.start = np.cumsum([0] + self.width)
        self.w = np.zeros(self.start[-1] + 1)
        self.scale = (1.0, 0.0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the active cells of each row, one per column."""
        out = np.empty(x.shape, np.int64)
        for k in range(x.shape[1]):
            col = x[:, k]
            if k < self.names:
                out[:, k] = self.start[k] + np.where(col < 0, NAMES, col)
            else:
                cuts = self.cuts[k - self.names]
                out[:, k] = self.start[k] + np.where(np.isnan(col), len(cuts) + 1, np.searchsorted(cuts, col, side="right"))
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w[self.cells(x)].sum(axis=1) + self.w[-1] if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        cells = self.cells(x)
        full = np.zeros((len(x), len(self.w)))
        full[np.arange(len(x))[:, None], cells] = 1
        full[:, -1] = 1
        self.w = logistic(full, y, penalty)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps with halving; the last column is the intercept."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w)
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * d) > now:
            rate /= 2
        w = w - rate * d
        now, before = loss(w), now
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Model:
    """Two calibrated views and their combination; ``rate`` alone where nothing could be learnt."""

    def __init__(self, rate: float, text: View | None = None, meta: View | None = None, mix: np.ndarray | None = None):
        self.rate, self.text, self.meta, self.mix = rate, text, meta, mix

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, text score, metadata score."""
        if self.mix is None:
            return (np.full(len(t), self.rate),) * 3
        a, b = (v.scale[0] * v.logit(x) + v.scale[1] for v, x in ((self.text, t), (self.meta, m)))
        return sigmoid(np.stack([a, b, np.ones(len(t))], axis=1) @ self.mix), sigmoid(a), sigmoid(b)


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray, names: int, seed: int = 5) -> Model:
    """Views of labelled rows (t, m, y) and of the pool; ``names`` of the metadata columns are names."""
    if len(set(y.tolist())) < 2:
        return Model(float(y.mean()) if len(y) else 0.0)
    order = np.random.default_rng(seed).permutation(len(y))
    held, used = order[:len(y) // 4], order[len(y) // 4:]
    views = [View(np.concatenate([t, pool_t])), View(np.concatenate([m, pool_m]), names)]
    data = [[t[used], y[used]], [m[used], y[used]]]
    pools, free = [pool_t, pool_m], np.ones(len(pool_t), bool)
    share = y[used].mean()
    for r in range(ROUNDS + 1):
        for v, (x, label) in zip(views, data):
            if len(set(label.tolist())) == 2:
                v.fit(x, label)
        if r == ROUNDS or not free.any():
            break
        picks = []
        for k in (0, 1):
            p = np.where(free, sigmoid(views[k].logit(pools[k])), np.nan)
            n = max(1, int(STEP * len(free)))
            high = [i for i in np.argsort(-np.nan_to_num(p, nan=-1), kind="stable")[:int(np.ceil(n * share))] if free[i] and p[i] >= SURE]
            low = [i for i in np.argsort(np.nan_to_num(p, nan=2), kind="stable")[:int(np.ceil(n * (1 - share)))] if free[i] and p[i] <= 1 - SURE]
            picks.append((high, low))
        for k, (high, low) in enumerate(picks):
            rows, label = np.array(high + low, int), np.r_[np.ones(len(high)), np.zeros(len(low))]
            other = data[1 - k]
            other[0], other[1] = np.concatenate([other[0], pools[1 - k][rows]]), np.concatenate([other[1], label])
            free[rows] = False
    stack = []
    for v, x in zip(views, (t, m)):
        z = v.logit(x[held])
        if len(set(y[held].tolist())) == 2:
            slope, shift = logistic(np.stack([z, np.ones(len(z))], axis=1), y[held], 1e-3)
            v.scale = (float(slope), float(shift)) if slope > 0 else (0.0, float(np.log(share / (1 - share))))
        stack.append(v.scale[0] * z + v.scale[1])
    mix = logistic(np.stack([*stack, np.ones(len(held))], axis=1), y[held], 1.0) if len(set(y[held].tolist())) == 2 else np.array([1.0, 0.0, 0.0])
    return Model(share, *views, mix)


def _features(df: DataFrame, text: str, names: list[str], numbers: list[str]) -> DataFrame:
    def start():
        def make(texts, *columns):
            t = [statistics(x) for x in texts]
            m = [metadata(list(r[:len(names)]), list(r[len(names):])) for r in zip(*columns)] if columns else [[] for _ in texts]
            return [pa.array(t, pa.list_(pa.float64())), pa.array(m, pa.list_(pa.float64()))]
        return make
    return append(df, [text, *names, *numbers], start, "_t array<double>, _m array<double>")


def _matrix(rows, name: str, width: int) -> np.ndarray:
    return np.array([[float("nan") if v is None else v for v in r[name]] for r in rows], float).reshape(len(rows), width)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          names: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",), labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on bounded samples; ``labels`` holds the training rows only."""
    names, numbers = list(names), list(numbers)
    y = labels.select(F.col(doc_id).alias("_i"), F.col(label).cast("double").alias("_y")).where("_y IN (0, 1) AND _i IS NOT NULL").distinct()
    rows = docs.select(F.col(doc_id).alias("_i"), *[F.col(c) for c in (text, *names, *numbers)])
    n, total = y.count(), docs.count()
    some = y.where(sampled(F.xxhash64("_i"), 1.3 * labelled / n)) if n > 2 * labelled else y
    # at most 2 x labelled numbers, so texts need not be shuffled to meet them
    seen = _features(rows.join(F.broadcast(some), "_i"), text, names, numbers).select("_i", "_y", "_t", "_m").orderBy(F.xxhash64("_i"), "_i", "_y", "_t").limit(labelled).collect()
    left = rows.where(sampled(F.xxhash64("_i", F.lit("pool")), 2.0 * pool / total)) if total > 3 * pool else rows
    free = _features(left, text, names, numbers).select("_i", "_t", "_m").join(y.select("_i").distinct(), "_i", "left_anti").orderBy(F.xxhash64("_i", F.lit("pool")), "_t").limit(pool).collect()
    wide = len(statistics("")), len(names) + len(numbers)
    return co_train(_matrix(seen, "_t", wide[0]), _matrix(seen, "_m", wide[1]), np.array([r["_y"] for r in seen], float),
                    _matrix(free, "_t", wide[0]), _matrix(free, "_m", wide[1]), len(names))


def score(df: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """``df`` with score, predicted (cut at 0.5), text_score and meta_score; columns of these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed size: bins and weights

    def start():
        def make(texts, *columns):
            t = np.array([statistics(x) for x in texts], float).reshape(len(texts), -1)
            m = np.array([metadata(list(r[:len(names)]), list(r[len(names):])) for r in zip(*columns)], float).reshape(len(texts), -1)
            s = shared.value.scores(t, m)
            return [pa.array(s[0]), pa.array((s[0] >= 0.5).astype(np.int32)), pa.array(s[1]), pa.array(s[2])]
        return make

    return append(df, [text, *names, *numbers], start, "score double, predicted int, text_score double, meta_score double")

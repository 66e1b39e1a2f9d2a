"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed embeddings: of the word and of its first letters. Filters
of several widths run over the whole text, each filter keeps its maximum, and a logistic layer turns
the maxima into a score, calibrated by Platt scaling on rows kept out of the fit. Neither language,
source, id nor label enter a score. Decision thresholds are calibrated by language as a second
output: ``flagged`` compares the score with its language's threshold.

The fit takes all labelled rows and whole texts (``train``): counts that start the embeddings are summed in Spark, then
each pass over the rows is a job whose tasks go on from the common net, and the next net is the mean of theirs, an
embedding's over the tasks that changed it. A fifth of the rows, by id hash, is held out of the fit; on all of these the
score and the thresholds are calibrated. Only the net, of a fixed size, and sums reach the driver. With ``max_rows`` the
fit runs on the driver instead, on a bounded sample of rows and characters. Scoring is a map over all rows and whole texts.

Defined cases: a null or empty text scores like a text of blanks; a null label is no training row;
different labels of one id all count; with labels of one class only, or none, every score is that
class's rate, or 0; a null or unknown language has the threshold 0.5; an empty table gives an empty
table; other columns are not looked at."""

from __future__ import annotations

import copy
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.base import append, blocks, sampled, texts_of
from tidewatch.operators.ranking import fit_edges, running_totals
from tidewatch.plans.lineage import stored

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
MAX_ROWS, MAX_CHARS = 6000, 30_000_000
BLOCK = 4_000_000  # characters scored at once
KEEP = 400_000  # distinct tokens whose answers a task keeps
SEEN = 2  # training texts that a bucket must be met in
START = 0.02  # spread of new embeddings: a word never seen in training hardly moves a filter
PAD = max(WIDTHS) - 1  # blanks between texts, so that no filter sees two of them


def features(token: str) -> tuple[int, int, int]:
    """Buckets of a token: its letters and digits without what surrounds them, and their first 4 and 5."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    w = token[a:b]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("w" + w, "p" + w[:4], "q" + w[:5]))


class Texts:
    """Token numbers of a block of texts: text k is tokens[start[k]:end[k]], blanks around it."""

    def __init__(self, texts: Iterable[str | None]):
        index: dict[str, int] = {}
        parts, sizes = [], []
        for t in texts:
            words = t.lower().split() if t else []
            for w in words:
                if w not in index:
                    index[w] = len(index) + 1
            parts.append(np.fromiter((index[w] for w in words), np.int32, len(words)))
            sizes.append(len(words))
        self.buckets = np.array([(0, 0, 0)] + [features(w) for w in index], np.int64)
        self.end = np.cumsum(np.array(sizes, np.int64) + PAD) if sizes else np.zeros(0, np.int64)
        self.start = self.end - np.array(sizes, np.int64) - PAD
        blank = np.zeros(PAD, np.int32)
        self.tokens = np.concatenate([blank] * (not parts) + [x for p in parts for x in (p, blank)])


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, START, (BUCKETS, DIM)), "v": r.normal(0, 0.3, len(WIDTHS) * FILTERS), "c": np.zeros(1)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale = (1.0, 0.0)


class Scorer:
    """Scores texts with a net, keeping each distinct token's answers to all filter columns for the next texts."""

    def __init__(self, net: Net):
        self.net = net
        self.columns = np.concatenate([net.p[f"W{w}"][o] for w in WIDTHS for o in range(w)], axis=1)
        self._forget()

    def _forget(self) -> None:
        self.index = defaultdict()
        self.index.default_factory = self.index.__len__
        self.index[""]  # row 0, the blank
        self.known = np.zeros((1, self.columns.shape[1]), np.float32)
        self.rows = 1

    def _learn(self) -> None:
        """Answers of the tokens seen since the last call."""
        new = list(islice(reversed(self.index), len(self.index) - self.rows))[::-1]
        if not new:
            return
        if len(self.index) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros((len(self.index) + 50_000 - len(self.known), self.known.shape[1]), np.float32)])
        for i in range(0, len(new), 20_000):
            part = new[i:i + 20_000]
            x = self.net.p["E"][np.array([features(w) for w in part])].mean(axis=1)
            self.known[self.rows:self.rows + len(part)] = x @ self.columns
            self.rows += len(part)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > KEEP:
            self._forget()
        number = self.index.__getitem__
        parts = [np.fromiter(map(number, t.lower().split()), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        self._learn()
        z = np.full(len(parts), self.net.p["c"][0], float)
        if not parts:
            return z
        blank = np.zeros(PAD, np.int32)
        tokens = np.concatenate([blank] + [x for p in parts for x in (p, blank)])  # a place looks back, so never into the next text
        end = np.cumsum([len(p) + PAD for p in parts])
        start = end - [len(p) + PAD for p in parts]
        n, at = int(end[-1]), 0
        for i, w in enumerate(WIDTHS):
            best = np.full((len(z), FILTERS), -np.inf, np.float32)
            for a in range(0, n, 1 << 16):  # pieces bounded by memory; a text may go through several
                b = min(n, a + (1 << 16))
                back = PAD - w + 1
                r = self.known[tokens[a + back:b + back], at:at + FILTERS]
                for o in range(1, w):
                    r += self.known[tokens[a + back + o:b + back + o], at + o * FILTERS:at + (o + 1) * FILTERS]
                first, last = np.searchsorted(end, a, side="right"), np.searchsorted(start, b, side="left")
                cut = np.maximum(start[first:last], a) - a
                best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(r, cut, axis=0))
            at += w * FILTERS
            z += np.maximum(best + self.net.p[f"b{w}"], 0) @ self.net.p["v"][i * FILTERS:(i + 1) * FILTERS]
        return z

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.net.scale[0] * self.logits(texts) + self.net.scale[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str], y: np.ndarray, *, epochs: int | None = None, batch: int = 32, rate: float = 0.05, drop: float = 0.5, seed: int = 7) -> Net:
    """Train on labelled texts; a fifth of them calibrates the score. Words are dropped at random in
    training, so that more than the first telling word is learnt."""
    net, r = Net(seed), np.random.default_rng(seed)
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        net.p["v"][:] = 0
        rate_ = y.mean() if len(y) else 0.0
        net.p["c"][0] = 35.0 * (1 if rate_ else -1)
        return net
    order = r.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    t = Texts(texts)
    seen = _start(net, t, used, y)
    epochs = epochs or max(8, min(60, 12_000 // len(used)))
    step = _stepper(net, _memory(net), seen, rate)
    for _ in range(epochs):
        r.shuffle(used)
        for i in range(0, len(used), batch):
            _learn(net, t, used[i:i + batch], y, r, drop, step)
    net.scale = _platt(Scorer(net).logits([texts[k] for k in held]), y[held])
    return net


def _memory(net: Net) -> dict[str, np.ndarray]:
    return {k: np.full(v.shape, 1e-4, np.float32) for k, v in net.p.items()}


def _stepper(net: Net, memory: dict[str, np.ndarray], seen: np.ndarray, rate: float):
    """One parameter's step against its gradient, by the squares of its gradients so far."""
    def step(key, grad, rows=None):
        if rows is not None:
            rows, grad = rows[seen[rows]], grad[seen[rows]]
        p, m = net.p[key], memory[key]
        if rows is None:
            m += grad * grad
            p -= rate * grad / np.sqrt(m)
        else:
            m[rows] += grad * grad
            p[rows] -= rate * grad / np.sqrt(m[rows])
    return step


def _hits(t: Texts, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts of each class that hold each bucket."""
    hits = np.zeros((2, BUCKETS))
    for k in rows:
        own = np.unique(t.buckets[np.unique(t.tokens[t.start[k]:t.end[k] - PAD])])
        hits[int(y[k]), own] += 1
    return hits


def _start(net: Net, t: Texts, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Start embeddings from counts; gives the buckets that are in use.

    A bucket met in fewer than ``SEEN`` texts stays zero: it could only teach single texts by heart.
    The first number of the others is how surely they tell the classes apart, their log odds over
    its standard error, and the first filter looks at it."""
    return _begin(net, _hits(t, rows, y), np.array([(y[rows] == c).sum() for c in (0, 1)]))


def _begin(net: Net, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    odds = np.log((hits[1] + 1) / (total[1] + 2)) - np.log((hits[0] + 1) / (total[0] + 2))
    sure = odds / np.sqrt(1 / (hits[1] + 1) + 1 / (hits[0] + 1))
    seen = hits.sum(axis=0) >= SEEN
    net.p["E"] *= seen[:, None]
    net.p["E"][:, 0] = seen * np.clip(sure / 4, -2, 2)
    net.p["W1"][0, 0, 0], net.p["v"][0] = 2.0, 1.0
    return seen


def _learn(net: Net, t: Texts, rows: np.ndarray, y: np.ndarray, r, drop: float, step) -> None:
    """One step of gradient descent: gradients reach only the places where a filter has its maximum."""
    spans = [t.tokens[t.start[k]:t.end[k]] for k in rows]
    bounds = np.cumsum([0] + [len(s) for s in spans])
    tokens = np.concatenate([np.zeros(PAD, np.int32)] + spans)
    tokens = np.where(r.random(len(tokens)) < drop, 0, tokens)
    seen, at = np.unique(tokens, return_inverse=True)
    buckets = t.buckets[seen]
    x = net.p["E"][buckets].mean(axis=1)
    x[seen == 0] = 0.0
    x = x[at]
    n = len(tokens) - PAD
    place, pool = {}, []
    for w in WIDTHS:
        z = sum(x[PAD - w + 1 + o:n + PAD - w + 1 + o] @ net.p[f"W{w}"][o] for o in range(w))
        place[w] = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(bounds[:-1], bounds[1:])])
        pool.append(np.take_along_axis(z, place[w], axis=0) + net.p[f"b{w}"])
    pool = np.concatenate(pool, axis=1)
    act = np.maximum(pool, 0)
    g = (_sigmoid(act @ net.p["v"] + net.p["c"][0]) - y[rows]) / len(rows)
    g = g.astype(np.float32)
    back = g[:, None] * net.p["v"][None, :] * (pool > 0)
    step("v", act.T @ g)
    step("c", np.array([g.sum()]))
    grads: dict[int, np.ndarray] = {}
    where, what = [], []
    for i, w in enumerate(WIDTHS):
        gb = back[:, i * FILTERS:(i + 1) * FILTERS]
        dw = np.empty_like(net.p[f"W{w}"])
        for o in range(w):
            p = place[w] + PAD - w + 1 + o
            dw[o] = np.einsum("bfd,bf->df", x[p], gb)
            where.append(at[p].ravel())
            what.append((gb[:, :, None] * net.p[f"W{w}"][o].T[None, :, :]).reshape(-1, DIM))
        step(f"W{w}", dw)
        step(f"b{w}", gb.sum(axis=0))
    where, what = np.concatenate(where), np.concatenate(what)
    live = (seen[where] != 0) & what.any(axis=1)
    where, what = buckets[where[live]], np.repeat(what[live][:, None, :] / buckets.shape[1], buckets.shape[1], axis=1)
    rows_, inv = np.unique(where.ravel(), return_inverse=True)
    total = np.zeros((len(rows_), DIM), np.float32)
    np.add.at(total, inv, what.reshape(-1, DIM))
    step("E", total, rows_)


def _platt(z: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on z (Newton, lightly pulled to slope 1)."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    s = max(1e-6, float(np.abs(z).max()))
    a = np.array([s, 0.0])
    x = np.stack([z / s, np.ones(len(z))], axis=1)
    pull = np.array([penalty, 0.0]) * len(z) / s
    for _ in range(60):
        p = _sigmoid(x @ a)
        grad = x.T @ (p - y) + pull * (a - np.array([s, 0.0]))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        d = np.linalg.solve(hess, grad)
        d *= min(1.0, 5.0 / max(1e-12, np.abs(d).max()))
        a = a - d
        if np.abs(d).max() < 1e-8:
            break
    return (float(a[0] / s), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def thresholds(score: np.ndarray, y: np.ndarray, lang: list[str | None], least: int = 30) -> dict[str, float]:
    """Per language, the cut with the fewest errors, nearest to 0.5; languages with fewer than
    ``least`` rows of either class keep 0.5."""
    out = {}
    langs = np.array([v if v is not None else "" for v in lang], object)
    for v in sorted(set(langs.tolist()) - {""}):
        s, t = score[langs == v], y[langs == v]
        if min((t == 1).sum(), (t == 0).sum()) < least:
            continue
        cuts = np.unique(np.concatenate(([0.5], (lambda u: (u[1:] + u[:-1]) / 2)(np.unique(s)))))
        pos, neg = np.sort(s[t == 1]), np.sort(s[t == 0])
        wrong = np.searchsorted(pos, cuts) + len(neg) - np.searchsorted(neg, cuts)
        best = cuts[wrong == wrong.min()]
        out[v] = float(best[np.abs(best - 0.5).argmin()])
    return out


class Model:
    """A fitted net with its thresholds by language."""

    def __init__(self, net: Net, cuts: dict[str, float]):
        self.net, self.cuts = net, cuts


def choose(sizes: list[int], max_rows: int, max_chars: int) -> list[int]:
    """Places of the rows to train on, in order: the first ``max_rows`` up to the greatest length at which their
    total is at most ``max_chars``, then any others that still fit."""
    n = np.array(sizes, np.int64)
    lengths = np.unique(n)

    def first(k: int) -> np.ndarray:
        return np.flatnonzero(n <= lengths[k])[:max_rows]

    low, high = -1, len(lengths) - 1  # the total rises with the length
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if n[first(k)].sum() <= max_chars else (low, k - 1)
    taken = set(first(low).tolist()) if low >= 0 else set()
    left = max_chars - sum(sizes[k] for k in taken)
    for k, size in enumerate(sizes):
        if len(taken) == max_rows:
            break
        if k not in taken and size <= left:
            taken.add(k)
            left -= size
    return sorted(taken)


PASS_ROWS = 4000  # rows of a task in a pass, at least
WORKERS = 64  # tasks of a pass, at most: each sends a net


def _pieces(net: Net) -> list[tuple[str, int]]:
    """(parameter, first row) of the parts in which nets travel."""
    return [(k, i) for k, v in net.p.items() for i in range(0, len(v), 4096)]


def _opened(sent: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their ``width`` numbers each) of a piece as it travels."""
    n = len(sent) // (4 * (1 + width))
    return np.frombuffer(sent, np.int32, n), np.frombuffer(sent, np.float32, offset=4 * n).reshape(n, width)


def _pass(data: DataFrame, net: Net, memory: dict[str, np.ndarray], seen: np.ndarray, tasks: int, seed: int, batch: int = 32, rate: float = 0.05, drop: float = 0.5) -> None:
    """One pass of all tasks over their rows (y, t); ``net`` and ``memory`` become the means of theirs.

    Only embeddings in use travel to the tasks, and only those that a task changed travel back."""
    lean = copy.copy(net)
    lean.p = {k: v[seen] if k == "E" else v for k, v in net.p.items()}
    shared = data.sparkSession.sparkContext.broadcast((lean, {k: v[seen] if k == "E" else v for k, v in memory.items()}, seen))
    pieces = _pieces(net)
    widths = [2 * net.p[k][0].size for k, _ in pieces]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory_, seen_ = shared.value
        net_ = copy.copy(own)
        net_.p, mem = {k: v.copy() for k, v in own.p.items()}, {k: v.copy() for k, v in memory_.items()}
        net_.p["E"], mem["E"] = np.zeros((len(seen_), DIM), np.float32), np.ones((len(seen_), DIM), np.float32)
        net_.p["E"][seen_], mem["E"][seen_] = own.p["E"], memory_["E"]
        start = mem["E"].copy()
        step, r, met = _stepper(net_, mem, seen_, rate), np.random.default_rng([seed, TaskContext.get().partitionId()]), 0
        for b in batches:
            y, at = b.column(0).to_numpy(zero_copy_only=False), 0
            for texts in blocks(texts_of(b.column(1)), BLOCK):
                t, label = Texts(texts), y[at:at + len(texts)]
                at, order = at + len(texts), r.permutation(len(texts))
                for i in range(0, len(order), batch):
                    _learn(net_, t, order[i:i + batch], label, r, drop, step)
                met += len(texts)
        if not met:
            return
        for n, (k, i) in enumerate(pieces):
            p, m = (x[i:i + 4096].reshape(-1, widths[n] // 2) for x in (net_.p[k], mem[k]))
            moved = np.flatnonzero((m != start[i:i + 4096]).any(axis=1)) if k == "E" else np.arange(len(p))
            if len(moved):
                sent = moved.astype(np.int32).tobytes() + np.hstack([p[moved], m[moved]]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([sent], pa.binary())], names=["piece", "sent"])

    def mean(t: pa.Table) -> pa.Table:
        width = widths[t["piece"][0].as_py()]
        total, times = np.zeros((4096, width)), np.zeros(4096)
        for x in sorted(x.as_py() for x in t["sent"]):
            rows, values = _opened(x, width)
            total[rows] += values
            times[rows] += 1
        rows = np.flatnonzero(times)
        sent = rows.astype(np.int32).tobytes() + (total[rows] / times[rows, None]).astype(np.float32).tobytes()
        return pa.table({"piece": t["piece"][:1], "sent": pa.array([sent], pa.binary())})

    found = data.select("y", "t").coalesce(tasks).mapInArrow(work, "piece int, sent binary").groupBy("piece").applyInArrow(mean, "piece int, sent binary").collect()
    for f in found:
        (k, i), width = pieces[f.piece], widths[f.piece]
        rows, values = _opened(f.sent, width)
        for x, now in zip((net.p[k], memory[k]), np.hsplit(values, 2)):
            x[i + rows] = now.reshape(-1, *x.shape[1:])
    shared.destroy()


def _fit(data: DataFrame, n: int, total: np.ndarray, seed: int = 7) -> Net:
    """The net fitted on rows (y, t), ``n`` of them, ``total`` by class; each pass takes all of them."""
    net = Net(seed)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((2, BUCKETS))
        for b in batches:
            y, at = b.column(0).to_numpy(zero_copy_only=False), 0
            for texts in blocks(texts_of(b.column(1)), BLOCK):
                hits += _hits(Texts(texts), np.arange(len(texts)), y[at:at + len(texts)])
                at += len(texts)
        c, bucket = np.nonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(bucket, pa.int64()), pa.array(hits[c, bucket])], names=["c", "b", "n"])

    hits = np.zeros((2, BUCKETS))
    found = data.select("y", "t").mapInArrow(count, "c long, b long, n double").groupBy("c", "b").agg(F.sum("n").alias("n")).toPandas()
    hits[found["c"], found["b"]] = found["n"]
    seen, memory = _begin(net, hits, total), _memory(net)
    for k in range(max(4, min(60, 12_000 // n)) if n > 6000 else max(8, min(60, 12_000 // n))):
        _pass(data, net, memory, seen, max(1, min(WORKERS, n // PASS_ROWS)), seed + k)
    return net


def _calibrated(held: DataFrame, net: Net) -> Model:
    """The net with its scale and thresholds by language, from rows (y, t, lang) kept out of its fit."""
    if held.select("y").distinct().count() < 2:
        return Model(net, {})
    shared = held.sparkSession.sparkContext.broadcast(net)

    def start():
        own = Scorer(shared.value)
        return lambda texts: [pa.array(np.concatenate([own.logits(part) for part in blocks(texts, BLOCK)] or [np.zeros(0)]))]

    z = stored(append(held, "t", start, "z double").groupBy("lang", "z").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "held-scores")
    top = z.agg(F.max(F.abs("z")).alias("s"), F.sum(F.col("pos") + F.col("neg")).alias("n")).first()
    s = max(1e-6, top.s)
    a, pull = np.array([s, 0.0]), np.array([1e-2, 0.0]) * top.n / s
    for _ in range(60):  # Newton as in ``_platt``, its sums from Spark
        x = F.col("z") / F.lit(s)
        p = 1 / (1 + F.exp(-F.least(F.greatest(F.lit(float(a[0])) * x + F.lit(float(a[1])), F.lit(-35.0)), F.lit(35.0))))
        w, g = (F.col("pos") + F.col("neg")) * p * (1 - p), (F.col("pos") + F.col("neg")) * p - F.col("pos")
        r = z.agg(*[F.sum(v).alias(k) for k, v in {"g0": g * x, "g1": g, "h00": w * x * x, "h01": w * x, "h11": w}.items()]).first()
        grad = np.array([r.g0, r.g1]) + pull * (a - np.array([s, 0.0]))
        d = np.linalg.solve(np.array([[r.h00, r.h01], [r.h01, r.h11]]) + np.diag(pull + 1e-9), grad)
        d *= min(1.0, 5.0 / max(1e-12, np.abs(d).max()))
        a = a - d
        if np.abs(d).max() < 1e-8:
            break
    net.scale = (float(a[0] / s), float(a[1])) if a[0] > 0 else (1.0, 0.0)
    return Model(net, _cuts(z, net.scale))


def _cuts(z: DataFrame, scale: tuple[float, float], least: int = 30) -> dict[str, float]:
    """``thresholds`` of counts (lang, z, pos, neg) of whole tables: a language's cuts are 0.5 and the middles between its scores."""
    at = F.least(F.greatest(F.lit(scale[0]) * F.col("z") + F.lit(scale[1]), F.lit(-35.0)), F.lit(35.0))
    counts = z.where("lang IS NOT NULL AND lang <> ''").groupBy("lang", (1 / (1 + F.exp(-at))).alias("s")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(counts, "held-counts")
    edges = fit_edges(counts, "s")
    upto = running_totals(counts, ["lang"], "s", ["pos", "neg"], edges)
    sums = counts.groupBy("lang").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.when(F.col("s") < 0.5, F.col("pos")).otherwise(F.col("neg"))).alias("half"))
    # the cut above a score leaves its positives below and takes the negatives above; the last score has no middle
    errors = upto.join(sums.where(f"P >= {least} AND N >= {least}"), "lang").select(
        "lang", "s", "half", (F.col("cum_pos") + F.col("N") - F.col("cum_neg")).alias("e"), (F.col("cum_pos") + F.col("cum_neg") < F.col("P") + F.col("N")).alias("inner"))
    errors = stored(errors, "held-errors")
    least_ = errors.groupBy("lang").agg(F.min(F.when(F.col("inner"), F.col("e"))).alias("low"), F.max("half").alias("half")).withColumn("low", F.coalesce(F.least("low", "half"), F.col("half")))
    out = {r.lang: 0.5 for r in least_.where("half <= low").collect()}
    # of each side of 0.5 the nearest score with the fewest errors, and the next score above it
    best = errors.join(least_.where("half > low").select("lang", "low"), "lang").where("inner AND e = low")
    ends = best.groupBy("lang").agg(F.max(F.when(F.col("s") < 0.5, F.col("s"))).alias("below"), F.min(F.when(F.col("s") >= 0.5, F.col("s"))).alias("above"))
    sides = ends.select("lang", F.explode(F.array("below", "above")).alias("low")).where("low IS NOT NULL")
    nexts = sides.join(counts.select("lang", "s"), "lang").where("s > low").groupBy("lang", "low").agg(F.min("s").alias("high")).collect()
    for r in sorted(nexts, key=lambda r: (r.lang, r.low)):
        cut = (r.low + r.high) / 2
        if r.lang not in out or abs(cut - 0.5) < abs(out[r.lang] - 0.5):
            out[r.lang] = cut
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
          max_rows: int | None = None, max_chars: int = MAX_CHARS) -> Model:
    """Fit on all labelled rows of ``docs``; ``labels`` holds the training rows only. With ``max_rows``, see ``train_on_sample``."""
    if max_rows is not None:
        return train_on_sample(docs, labels, doc_id, text, lang, label, max_rows, max_chars)
    y = labels.select(F.col(doc_id).alias("_i"), F.col(label).cast("double").alias("y")).where("y IN (0, 1) AND _i IS NOT NULL").distinct()
    rows = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("t"), F.col(lang).alias("lang") if lang in docs.columns else F.lit(None).cast("string").alias("lang"))
    # texts meet their labels by a shuffle of both at every size, so disk and memory grow as the input does; only the labels are
    # hashed. In a fixed order, so that the same rows give the same net
    data = stored(rows.join(y.hint("shuffle_hash"), "_i").sortWithinPartitions("_i", F.xxhash64("t"), "y").withColumn("held", F.pmod(F.xxhash64("_i", F.lit(11)), F.lit(5)) == 0), "labelled")
    counts = {(r.held, r.y): r.n for r in data.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    total = np.array([counts.get((False, c), 0) for c in (0.0, 1.0)])
    if not total.all():  # one class, or none, in the rows to fit on
        found = {c for (_, c) in counts}
        return Model(fit([""] * len(found), np.array(sorted(found))) if len(found) < 2 else fit(["", ""], np.array([0.0, 0.0 if total[0] else 1.0])), {})
    return _calibrated(data.where("held").select("y", "t", "lang"), _fit(data.where("NOT held"), int(total.sum()), total))


def train_on_sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
                    max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; ``labels`` holds the training rows only."""
    y = labels.select(F.col(doc_id).alias("_i"), F.col(label).cast("double").alias("y")).where("y IN (0, 1) AND _i IS NOT NULL").distinct()
    rows = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("t"), F.col(lang).alias("lang") if lang in docs.columns else F.lit(None).cast("string").alias("lang"))
    rows = rows.withColumns({"n": F.coalesce(F.length("t"), F.lit(0)), "h": F.xxhash64("t")})
    total, reach = y.count(), max_rows
    while True:
        # some more than are needed are picked by hash, so that few rows are sorted
        some = y.where(sampled(F.xxhash64("_i"), 1.3 * reach / total)) if total > 2 * reach else y
        # at most about 2 x reach numbers, so texts need not be shuffled to meet them
        found = rows.where(F.col("n") <= max_chars).join(F.broadcast(some), "_i").select("_i", "y", "n", "h", "lang")
        met = found.orderBy(F.xxhash64("_i"), "_i", "y", "h").limit(2 * reach).collect()
        chosen = [met[k] for k in choose([r.n for r in met], max_rows, max_chars)]
        if len(chosen) == max_rows or 2 * sum(r.n for r in chosen) > max_chars or total <= 2 * reach and len(met) < 2 * reach:
            break
        reach *= 4  # most of them were too long
    keys = docs.sparkSession.createDataFrame(list({(r["_i"], r.h) for r in chosen}), found.select("_i", "h").schema)
    held = rows.where(F.col("n") <= max_chars).select("_i", "h", "t").join(F.broadcast(keys), ["_i", "h"]).dropDuplicates(["_i", "h"])
    of = {(r["_i"], r.h): r.t or "" for r in held.collect()}
    texts, ys, langs = [of[r["_i"], r.h] for r in chosen], [r.y for r in chosen], [r.lang for r in chosen]
    ys = np.array(ys)
    net = fit(texts, ys)
    return Model(net, thresholds(Scorer(net).score(texts), ys, langs))


def score(df: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with score, predicted (cut at 0.5) and flagged (cut at the language's threshold); columns of
    these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model.net)  # a fixed size: the table of embeddings

    def start():
        net = Scorer(shared.value)

        def make(texts):
            return [pa.array(np.concatenate([net.score(part) for part in blocks(texts, BLOCK)] or [np.zeros(0)]))]
        return make

    cut = F.lit(0.5)
    if lang in df.columns:
        for v, c in model.cuts.items():
            cut = F.when(F.col(lang) == v, F.lit(c)).otherwise(cut)
    out = append(df, text, start, "score double")
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "flagged": F.col("score") >= cut})

"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text. A text is parsed against it:
each phrase is the longest match with any part of the sample, the next phrase begins where it ends,
and a letter the sample never has is a phrase of its own. n phrases against a sample of m symbols
cost about n log2(m) bits; the language with the fewest bits per symbol wins.

Texts are lower-cased and runs of anything but letters become one blank. They are parsed in stretches
of ``STRETCH`` symbols, whole texts, no phrase crossing a border; all stretches of a block advance
together, one symbol a step, through the automata's transition tables.

The fit takes a bounded sample: per language ``ROWS`` rows with the smallest id hash, up to
``PER_ROW`` symbols of each, ``SYMBOLS`` in total. Rows that a first fit assigns to another language
are left out of the second. Language, source and id never enter a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if
nothing could be learnt; equal costs go to the language first in order; repeated rows are scored
alike; an empty table gives an empty table; other columns are not looked at."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.base import append, blocks, sampled

ROWS, PER_ROW, SYMBOLS = 400, 1000, 30_000
STRETCH = 1024
BLOCK = 4_000_000  # symbols parsed at once
SHARP = 8.0  # how fast a score falls with bits per symbol
LETTERS = 250  # letters told apart; rarer ones of the sample count as unknown


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; 0 for each run of other than letters."""
    if not text:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(letter_table()[x], x, 0)
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    return x[keep]


class Automaton:
    """Suffix automaton of a sequence of small numbers, as a table of restarting parses.

    ``table[state * width + symbol]`` is (next state * width) * 4 + phrases ended by the step."""

    def __init__(self, seq: list[int], width: int):
        self.size = len(seq)
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        t = np.full((len(nxt), width), -1, np.int64)
        for s, out in enumerate(nxt):
            for c, to in out.items():
                t[s, c] = to
        root = t[0].copy()
        restart = np.where(root >= 0, root * width * 4 + 1, 2)  # the phrase so far ends, and perhaps the symbol is one itself
        t = np.where(t >= 0, t * width * 4, restart[None, :])
        t[0] = np.where(root >= 0, root * width * 4, 1)
        self.table = t.astype(np.int32).ravel()

    def phrases(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``x`` (symbols down the rows); columns come with falling length."""
        state = np.zeros(x.shape[1], np.int32)
        count = np.zeros(x.shape[1], np.int32)
        alive = np.searchsorted(-lens, -np.arange(x.shape[0]), side="left")
        for j in range(x.shape[0]):
            k = alive[j]
            v = self.table[state[:k] + x[j, :k]]
            count[:k] += v & 3
            state[:k] = v >> 2
        return count + (state != 0)


class Model:
    def __init__(self, samples: dict[str, np.ndarray]):
        """``samples``: code points by language, as ``symbols`` gives them."""
        self.langs = sorted(samples)
        found, n = np.unique(np.concatenate([*samples.values(), np.zeros(1, np.uint32)]), return_counts=True)
        found = found[np.argsort(-n, kind="stable")]
        found = np.sort(found[found != 0][:LETTERS])
        self.width = len(found) + 2  # the blank, the letters, any other letter
        self.letters = found
        self.parse = [Automaton(self.numbers(samples[v]).tolist(), self.width) for v in self.langs]

    def numbers(self, x: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.letters, x)
        hit = (i < len(self.letters)) & (self.letters[np.minimum(i, len(self.letters) - 1)] == x) if len(self.letters) else np.zeros(len(x), bool)
        return np.where(x == 0, 0, np.where(hit, i + 1, self.width - 1)).astype(np.int32)

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Bits per symbol of each text (rows) for each language (columns)."""
        seqs = [self.numbers(symbols(t)) for t in texts]
        lens = np.array([len(s) for s in seqs], np.int64)
        total = np.zeros((len(seqs), len(self.langs)))
        if not self.langs or not lens.sum():
            return total
        flat = np.concatenate(seqs)
        ends = np.cumsum(lens)
        pieces = -(-lens // STRETCH)
        text = np.repeat(np.arange(len(seqs)), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - lens)[text] + k * STRETCH
        size = np.minimum(STRETCH, ends[text] - start)
        order = np.argsort(-size, kind="stable")
        text, start, size = text[order], start[order], size[order]
        at = start[None, :] + np.arange(size[0])[:, None]
        x = flat[np.minimum(at, len(flat) - 1)]
        for i, a in enumerate(self.parse):
            total[:, i] = np.bincount(text, a.phrases(x, size), len(seqs)) * np.log2(max(2, a.size))
        return total / np.maximum(lens, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and bool(letter_table()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.bits(texts)
        best = bits.argmin(axis=1)
        share = np.exp(-SHARP * (bits - bits.min(axis=1, keepdims=True))) if len(texts) else bits
        return [self.langs[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, 1.0 / share.sum(axis=1), 0.0)


def fit(rows: list[tuple[str, str]]) -> Model:
    """From (language, text) rows: fit, drop the rows that are told to be another language, fit again."""
    def sample(rows):
        parts: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for lang, text in rows:
            x = symbols(text)[:PER_ROW]
            room = SYMBOLS - size.get(lang, 0)
            if len(x) and room > 0 and x.any():
                parts.setdefault(lang, []).append(x[:room])
                size[lang] = size.get(lang, 0) + len(parts[lang][-1])
        return Model({v: np.concatenate([y for x in p for y in (x, np.zeros(1, np.uint32))]) for v, p in parts.items()})

    first = sample(rows)
    # a row is in its own language's sample, so only a clear answer for another one counts
    told = first.predict([t for _, t in rows])[0]
    kept = [r for r, v in zip(rows, told) if v == r[0]]
    return sample(kept) if {r[0] for r in kept} == set(first.langs) else first


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on a bounded sample of ``docs``, which holds the training rows only."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("v"), F.col(text).alias("t"), F.xxhash64(F.col(doc_id)).alias("h"))
    # some more than are needed of each language are picked by hash, so that few rows are ranked
    counts = {r.v: r.n for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()}
    picked = F.lit(True)
    for v, n in counts.items():
        if n > 4 * ROWS:
            picked = F.when(F.col("v") == v, sampled(F.col("h"), 2 * ROWS / n)).otherwise(picked)
    rows = rows.where(picked)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("h", "t"))
    cut = F.substring("t", 1, 8 * PER_ROW)  # more than the sample takes of a row
    found = rows.withColumn("r", rank).where(F.col("r") <= ROWS).select("v", cut.alias("t"), "r").orderBy("v", "r").collect()
    return fit([(r.v, r.t) for r in found])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (columns of these names are replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size per language

    def start():
        def make(texts):
            langs, scores = [], []
            for part in blocks(texts, BLOCK):
                v, s = shared.value.predict(part)
                langs += v
                scores.append(s)
            return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))]
        return make

    return append(df, text, start, "lang_pred string, score double")

"""Ids of whole texts by a byte-level tokenizer file, each distinct word given to the library once.

The pattern of these tokenizers takes at most one space before a word and otherwise never goes from a
word into white space, so a text can be cut before each single space and the parts encoded by themselves.
Texts where that doesn't hold go to the library whole. Of new words, runs of Latin letters, perhaps with
signs after them, are what the pattern cuts out itself, so they go right to the library's BPE model. Other
words of a batch are joined into long strings, which the library encodes much faster than as many short
ones: in the answer a word begins where a piece begins with a space. Ids of texts are then gathered by
word number in numpy."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE = 300_000  # distinct words whose ids a worker keeps
AT_ONCE = 2_000  # words joined to one string
SEGMENT = 1_000_000  # characters of a text that are split into words at a time
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# letters and signs after them, perhaps the same again on the next line
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?]{{0,3}})(?:\n([{_LETTERS}]+)([.,;:!?]{{0,3}}))?")
# a space next to other white space or at the end, in the words of Arrow's expressions; white space is taken widely
_ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_DOUBLE = re.compile(r" (?=[\s᠎]|\Z)")
_UNSAFE = re.compile(r"[\s᠎] (?:[\s᠎]|\Z)")


class WordIds:
    """Ids of texts; ``end`` is an id that follows each text, if given."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(True)
        self.opens = np.zeros(1 + max(vocab.values(), default=0), bool)
        self.opens[[i for piece, i in vocab.items() if piece.startswith("Ġ")]] = True
        # letters as the model sees them; None if the file's steps are not those of a byte-level tokenizer
        alphabet = [chr(c) for c in range(256) if re.fullmatch(f"[{_LETTERS}]", chr(c))]
        try:
            seen = {c: self.lib.pre_tokenizer.pre_tokenize_str(" " + c) for c in alphabet}
            self.letters = {ord(c): x[0][0][1:] for c, x in seen.items() if len(x) == 1 and x[0][0][:1] == "Ġ"}
        except AttributeError:
            self.letters = {}
        self.direct = len(self.letters) == len(alphabet) and self.lib.normalizer is None and self.lib.post_processor is None
        self.tails: dict[str, list[int]] = {}  # ids of the few runs of signs after letters
        self.newline = self.lib.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        """Forget all words. The old table refers to itself by its factory, so it is emptied at once."""
        if hasattr(self, "index"):
            self.index.default_factory = None
            self.index.clear()
        self.index: dict = defaultdict()  # a word after a space, or (word,) of a text's first one -> its number
        self.index.default_factory = self.index.__len__
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.len = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _store(self, numbers: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Keep ids of words that begin at ``at``, one after the other."""
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), np.uint32)])
        self.flat[self.used:need] = ids
        self.start[numbers] = self.used + at
        self.len[numbers] = np.diff(at, append=len(ids))
        self.used = need

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 10_000):
            out += [np.asarray(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts[i:i + 10_000], add_special_tokens=False)]
        return out

    def _tail(self, signs: str) -> list[int]:
        if signs not in self.tails:
            self.tails[signs] = self._each([signs])[0].tolist()
        return self.tails[signs]

    def _learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        known = len(self.start)
        new = list(islice(self.index, known, None))
        if not new:
            return
        self.start, self.len = (np.concatenate([x, np.zeros(len(new), np.int32)]) for x in (self.start, self.len))
        plain, ids, lens, joined, alone = [], [], [], [], []
        model, letters, direct = self.lib.model.tokenize, self.letters, self.direct
        for i, w in enumerate(new):
            if type(w) is tuple:
                alone.append(i)
            elif direct and w.isascii() and w.isalpha():
                own = [t.id for t in model("Ġ" + w)]
                plain.append(i)
                ids += own
                lens.append(len(own))
            elif direct and (m := _PLAIN.fullmatch(w)):
                stem, tail, stem2, tail2 = m.groups()
                own = [t.id for t in model("Ġ" + (stem if stem.isascii() else stem.translate(letters)))]
                if tail:
                    own += self._tail(tail)
                if stem2 is not None:
                    own += self.newline
                    own += [t.id for t in model(stem2 if stem2.isascii() else stem2.translate(letters))]
                    if tail2:
                        own += self._tail(tail2)
                plain.append(i)
                ids += own
                lens.append(len(own))
            elif w and w.strip() == w and "᠎" not in w:
                joined.append(i)
            else:
                alone.append(i)
        if plain:
            self._store(known + np.array(plain), np.array(ids, np.uint32), np.cumsum(lens) - lens)
        parts = [joined[i:i + AT_ONCE] for i in range(0, len(joined), AT_ONCE)]
        for part, ids in zip(parts, self._each([" " + " ".join([new[i] for i in part]) for part in parts])):
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part) and not at[0]:
                self._store(known + np.array(part), ids, at)
            else:  # a tokenizer of another kind
                alone += part
        if alone:
            found = self._each([w[0] if type(w) is tuple else " " + w for w in (new[i] for i in alone)])
            n = np.fromiter(map(len, found), np.int64, len(found))
            self._store(known + np.array(alone), np.concatenate(found), np.cumsum(n) - n)

    def _words(self, text: str) -> Iterator[list]:
        """The words of a text, one segment after the other; the first word of the text is a tuple."""
        at = 0
        while at <= len(text):
            to = text.find(" ", at + SEGMENT)
            to = len(text) if to < 0 else to
            words = text[at:to].split(" ")
            if not at:
                words[0] = (words[0],)
            yield words
            at = to + 1

    def batch(self, texts: list[str | None] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each text has). A null text is empty.

        Texts whose spaces all stand alone are split and their distinct words found by Arrow; of the others, those
        that cannot be cut at spaces go to the library whole."""
        if len(self.index) > CACHE:
            self.clear()
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(column, _ODD)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(column, token))
        odd = odd.to_numpy(zero_copy_only=False)
        plain = column if not odd.any() else column.filter(pa.array(~odd))
        lists = pc.split_pattern(plain, " ")
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        found = flat.dictionary_encode()
        number = self.index.__getitem__
        known = found.dictionary.to_pylist()
        word = np.fromiter(map(number, known), np.int64, len(known))[found.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        first = [(w,) for w in flat.take(pa.array(offsets[:-1] - offsets[0])).to_pylist()]
        word[offsets[:-1] - offsets[0]] = np.fromiter(map(number, first), np.int64, len(first))
        size, whole = np.diff(offsets), {}
        if odd.any():
            counts, parts, at = np.zeros(len(column), np.int64), [], 0
            counts[~odd] = size
            for k, t in zip(np.flatnonzero(odd).tolist(), column.filter(pa.array(odd)).to_pylist()):
                parts.append(word[at:at + int(counts[:k][~odd[:k]].sum()) - at])
                at += len(parts[-1])
                if any(s in t for s in self.special) or _DOUBLE.search(t) and _UNSAFE.search(t):
                    whole[k] = t
                else:
                    for words in self._words(t):
                        parts.append(np.fromiter(map(number, words), np.int64, len(words)))
                        counts[k] += len(words)
            word, size = np.concatenate([*parts, word[at:]]), counts
        whole = dict(zip(whole, self._each(list(whole.values()))))
        self._learn()
        if end is not None:
            word = np.insert(word, np.cumsum(size), self._end(end))
            size = size + 1
        n, ends = self.len[word], np.cumsum(size, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.flat[np.repeat(self.start[word] - total[:-1].astype(np.int32), n) + np.arange(total[-1], dtype=np.int32)]
        cut = total[ends] if len(column) else np.zeros(0, np.int64)
        lens = np.diff(cut, prepend=0)
        if whole:
            ids = np.concatenate([p for k, (a, m) in enumerate(zip((cut - lens).tolist(), lens.tolist())) for p in (*([whole[k]] if k in whole else []), ids[a:a + m])])
            lens = lens + np.array([len(whole.get(k, ())) for k in range(len(lens))], np.int64)
        return ids, lens

    def _end(self, end: int) -> int:
        """Number of the word that is the end id alone; all other words have their ids already."""
        if (None, end) not in self.index:
            number = self.index[(None, end)]
            self.start, self.len = (np.append(x, np.int32(0)) for x in (self.start, self.len))
            self._store(np.array([number]), np.array([end], np.uint32), np.zeros(1, np.int64))
        return self.index[(None, end)]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        return self.batch([text])[0].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The encoder of a file, one per worker; it lives on between tasks."""
    return WordIds(path)


def forget() -> None:
    """Drop encoders that an earlier stage has left in this worker."""
    word_ids.cache_clear()

"""Token ids of whole texts, with each distinct piece of text encoded once by the tokenizers library."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache
from itertools import chain, count, islice

import numpy as np

# The word patterns of the two public tokenizers, over the characters
# whose letter, number and space classes are the same in every Unicode version.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN = "\u0000-\u001b -~¡-įı-ɏ‐-‧"
_SPACE = " \t\n\u000b\f\r"
# Endings begin with an apostrophe, so words can be tried before them.
PATTERNS = {
    "word": f"[{_LETTERS}]+|[{_NUMBERS}]|{_ENDINGS}|[^{_SPACE}{_LETTERS}{_NUMBERS}]+",
    "byte": f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|{_ENDINGS}| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+",
}
_STRANGE = re.compile(f"[^{_PLAIN}]")
_CUT = re.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
_LONG = 1 << 20


def _pieces(text: str) -> list[str]:
    """A long text cut before single blanks between two words, where no token can cross."""
    out, at = [], 0
    while len(text) - at > _LONG:
        cut = _CUT.search(text, at + _LONG)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def _numbering(words: list[str] = ()) -> defaultdict:
    """Numbers words in order of arrival; the new ones are the last keys."""
    return defaultdict(count(len(words)).__next__, zip(words, range(len(words))))


class Encoder:
    """``ids(text)`` as the library gives them with ``add_special_tokens=False``.

    Strings of special tokens inside a text are ordinary text. A word's ids do not depend
    on its neighbours, so distinct words are encoded once and looked up after. A store of more
    than ``keep`` words drops those that were met only once. A text with characters outside the plain
    ranges goes to the library as it is.
    """

    def __init__(self, path: str, kind: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind, self.keep = kind, keep
        self.find = re.compile(PATTERNS[kind]).findall
        vocabulary = self.library.get_vocab()
        self.largest = max(vocabulary.values())
        self.marks = {glue: np.zeros(self.largest + 1, bool) for glue in (" ", "", "\n")}
        for token, n in vocabulary.items():
            self.marks[" "][n] = token.endswith("</w>")
            self.marks[""][n] = token.startswith("\u0120")  # a leading blank in the byte vocabulary
            self.marks["\n"][n] = token == "\u010a"
        self._reset()

    def _reset(self) -> None:
        self.numbers = _numbering()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.met = np.zeros(1 << 16, np.int64)
        self.words = self.used = 0

    def _trim(self) -> None:
        """Keep the words that were met again; none if these fill half the store."""
        again = np.flatnonzero(self.met[: self.words] > 1)
        words, flat, first, counts, met = list(self.numbers), self.flat, self.first[again], self.count[again], self.met[again]
        self._reset()
        if not 0 < len(again) <= self.keep // 2:
            return
        self.numbers = _numbering([words[k] for k in again.tolist()])
        self._grow(len(again))
        ends = np.cumsum(counts)
        ids = flat[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1])]
        self._store(np.arange(len(again)), ids, counts)
        self.met[: len(again)] = met // 2
        self.words = len(again)

    def _grow(self, words: int) -> None:
        while words > len(self.first):
            self.first, self.count, self.met = [np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.met)]

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, places: np.ndarray, ids, counts: np.ndarray) -> None:
        """Keep the ids of the words numbered ``places``, one word's ids after another's."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[places] = counts
        self.first[places] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def _store_apart(self, places: np.ndarray, words: list[str]) -> None:
        each = self._library_ids(words)
        counts = np.fromiter(map(len, each), np.int64, len(each))
        self._store(places, np.fromiter(chain.from_iterable(each), np.uint32, int(counts.sum())), counts)

    def _store_joined(self, places: np.ndarray, words: list[str], glue: str) -> None:
        """Encode many words as one text that the library cuts into just these words."""
        ids = np.array(self._library_ids([glue.join(words)])[0], np.uint32)
        at = self.marks[glue][ids]
        if glue == "\n":  # the mark is the line feed between two words
            counts = np.diff(np.concatenate(([-1], np.flatnonzero(at), [len(ids)]))) - 1
            ids = ids[~at]
        elif glue:  # on a word's last id
            counts = np.diff(np.concatenate(([-1], np.flatnonzero(at))))
        else:  # on its first id
            counts = np.diff(np.concatenate((np.flatnonzero(at), [len(ids)])))
        if len(counts) == len(words):
            self._store(places, ids, counts)
        else:
            self._store_apart(places, words)

    def _learn(self) -> None:
        """Encode the new words. A word of letters, alone or after a blank, can be joined with others."""
        new = list(islice(self.numbers, self.words, None))
        if not new:
            return
        self._grow(self.words + len(new))
        if self.kind == "word":
            kinds = np.zeros(len(new), np.int8)
        else:
            kinds = np.array([1 if w.isalpha() else 0 if w[0] == " " and w[1:].isalpha() else 2 for w in new], np.int8)
        for kind, glue in enumerate([" " if self.kind == "word" else "", "\n", None]):
            mine = np.flatnonzero(kinds == kind)
            step = 1024 if glue is None else 256
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                words = [new[k] for k in part.tolist()]
                if glue is None:
                    self._store_apart(self.words + part, words)
                else:
                    self._store_joined(self.words + part, words, glue)
        self.words += len(new)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null is empty."""
        plain: list[np.ndarray] = []
        owner, sizes = [], []
        out: list[list[np.ndarray]] = [[] for _ in texts]
        if len(self.numbers) > self.keep:
            self._trim()
        for i, text in enumerate(texts):
            for part in _pieces(text) if text else ():
                if _STRANGE.search(part):
                    out[i].append(np.array(self._library_ids([part])[0], np.uint32))
                else:
                    words = self.find(part.lower() if self.kind == "word" else part)
                    plain.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
                    sizes.append(len(words))
                    owner.append((i, len(out[i])))
                    out[i].append(np.zeros(0, np.uint32))
        self._learn()
        if plain:
            at = np.concatenate(plain)
            self.met[: self.words] += np.bincount(at, minlength=self.words)
            counts = self.count[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            where = np.repeat(self.first[at] - (ends - counts), counts) + np.arange(total)
            flat = self.flat[where]
            bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
            for (i, k), a, b in zip(owner, bounds, bounds[1:]):
                out[i][k] = flat[a:b]
        none = np.zeros(0, np.uint32)
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else none for parts in out]


@cache
def encoder(path: str, kind: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, kind)

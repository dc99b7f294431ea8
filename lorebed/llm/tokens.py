"""Whole-text token ids at speed: words are encoded once, by the tokenizers library, and remembered.

A byte-level BPE with the usual pre-tokenizer never lets a token span the place where white space follows another
character. A text can therefore be cut there, and the ids of the pieces joined are the ids of the text. Pieces
(a word with its leading space) repeat, so each worker keeps a bounded dictionary of them. Marks after a word's letters
are tokens of their own, so a new word with marks is made of the word's ids and the marks'.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable
from itertools import chain

import numpy as np


def default_vocabulary() -> str:
    """The path of the public vocabulary that the queries use; operators take any path of the same kind."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Unicode White_Space, as the pre-tokenizer's \s reads it (fixed value).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_RUNS = ("  ", "\n\n", " \n", "\n ")


class UnitEncoder:
    """Encode texts with a byte-level BPE file; ``memory`` bounds the number of remembered units."""

    def __init__(self, vocabulary: str, memory: int = 800_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: The same without byte-level cutting, for ASCII letters after a blank: one piece that reads as it is but for the blank.
        self.letters = None
        if self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel":
            self.letters = Tokenizer.from_file(vocabulary)
            self.letters.pre_tokenizer = CharDelimiterSplit(" ")
        words = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if len(words) <= 1 << 16 else np.dtype("<u4")
        self.n_bytes = np.zeros(max(words.values()) + 1, dtype=np.int64)  # a byte-level token has a character a byte
        for word, at in words.items():
            self.n_bytes[at] = len(word)
        self.memory, self.longest = memory, longest
        #: Ids by unit without its leading blank; units that start with a line feed have none. False: cut by the general rule.
        self.after_blank: dict[str, bytes | bool] = {}
        self.as_is: dict[str, bytes] = {}
        #: Ids of the marks that follow a word's letters.
        self.marks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _learn(self, units: set[str]) -> list[str]:
        """Encode units that are new; those too long to be kept are returned."""
        known, marked, letters, others = self.after_blank, [], [], []
        for unit in units:
            if unit.isalpha():
                (letters if unit.isascii() else others).append(unit)
            else:
                core = unit.rstrip(string.punctuation)
                if core != unit and core.isalpha() and len(unit) <= self.longest:
                    marked.append((unit, core, unit[len(core) :]))
                else:
                    others.append(unit)
        cores = {core for _, core, _ in marked}.difference(known, letters, others)
        letters += [x for x in cores if x.isascii()]
        others += [x for x in cores if not x.isascii()]
        if self.letters:
            self._learn_parts(self.letters, letters, "\u0120", " \u0120")
        else:
            others += letters
        self._learn_others(others)
        if len(self.marks) > self.memory:
            self.marks.clear()
        for unit, core, marks in marked:
            ids = self.marks.get(marks)
            if ids is None:
                both = self._ids([" " + core + marks])[0]
                if not both.startswith(known[core]):
                    raise ValueError("the vocabulary does not cut words from the marks that follow them")
                ids = self.marks[marks] = both[len(known[core]) :]
            known[unit] = known[core] + ids
        return [x for x in units if len(x) > self.longest]

    def _learn_others(self, units: list[str]) -> None:
        known, plain, lines = self.after_blank, [], []
        for unit in units:
            line = unit[:1] == "\n"
            if unit.split() == [unit[line:]]:
                (lines if line else plain).append(unit)
            else:  # "" and a line feed are the end of a text; other white space is for the general rule
                known[unit] = self._ids([unit or " "])[0] if unit in ("", "\n") else False
        self._learn_parts(self.tokenizer, plain, " ", " ")
        self._learn_parts(self.tokenizer, lines, "", "")

    def _learn_parts(self, tokenizer, units: list[str], first: str, between: str, at_once: int = 2048, a_text: int = 32) -> None:
        """The ids of units, joined to short texts; where each ends is told by its bytes (``first`` is one, if any, in byte-level text)."""
        width, one = self.dtype.itemsize, len(first)
        for start in range(0, len(units), at_once):
            part = units[start : start + at_once]
            texts = [first + between.join(part[i : i + a_text]) for i in range(0, len(part), a_text)]
            found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([x.ids for x in found]), dtype=np.int64)
            sizes = map(len, part if tokenizer is self.letters or all(map(str.isascii, texts)) else [x.encode() for x in part])
            ends = np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(part)) + one)
            last = np.searchsorted(done := np.cumsum(self.n_bytes[ids]), ends)
            if not np.array_equal(done[last], ends):
                raise ValueError("the vocabulary is not a byte-level one that cuts words at white space")
            raw, cuts = ids.astype(self.dtype).tobytes(), ((last + 1) * width).tolist()
            self.after_blank.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _general(self, text: str) -> bytes:
        units = _UNITS.findall(text)
        new = list({x for x in units if x not in self.as_is})
        self.as_is.update(zip(new, self._ids(new), strict=True))
        out = b"".join(map(self.as_is.__getitem__, units))
        for unit in new:
            if len(unit) > self.longest:
                del self.as_is[unit]
        return out

    def encode(self, texts: list[str], end: int | None = None) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``; ``end`` is appended to each."""
        for known in (self.after_blank, self.as_is):
            if len(known) > self.memory:
                known.clear()
        # Where no two blanks or line feeds meet, a unit starts at each; one that starts a line keeps the line feed.
        cut = [None if any(x in text for x in _RUNS) else text.replace("\n", " \n").split(" ") for text in texts]
        heads = [parts.pop(0) if parts else None for parts in cut]
        # The batch's own words: most are many times in it, and a small dictionary stays near.
        words = set(chain.from_iterable(x for x in cut if x))
        own = dict(zip(words, map(self.after_blank.get, words), strict=True))
        new = {x for x, ids in own.items() if ids is None}
        long = self._learn(new)
        own.update(zip(new, map(self.after_blank.__getitem__, new), strict=True))
        get, last, out = own.__getitem__, b"" if end is None else np.array([end], dtype=self.dtype).tobytes(), []
        for text, head, parts in zip(texts, heads, cut, strict=True):
            try:
                ids = self._general(text) if parts is None else self._general(head) + b"".join(map(get, parts))
            except TypeError:  # a unit with other white space in it
                ids = self._general(text)
            out.append(ids + last)
        for unit in long:
            del self.after_blank[unit]
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(vocabulary: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file; reused workers keep what they have learnt."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = UnitEncoder(vocabulary)
    return _encoders[vocabulary]


def slices(batch, count: int = 256):
    """Parts of an Arrow batch, so that Python objects of few documents live at once."""
    for start in range(0, batch.num_rows, count):
        yield batch.slice(start, count)

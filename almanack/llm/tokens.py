"""Tokenising Arrow columns of whole texts with a given tokenizer file."""

from __future__ import annotations

import os
import sys
import types
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time.
ENCODE_BYTES = 8 << 20

PROBE = "One two\nthree  four\tfive, 6 sixes' 7"
PLAIN_PROBE = ["Word", "naïve,", "STRASSE.", "Ærø...", "größer", "x"]

#: Letters below U+0250, which no Unicode version or normal form changes, and closing punctuation.
#: The dotted capital I is left out, as its lower case is two characters.
PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)(?P<marks>[.,]*)$"


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: a byte's own letter, or the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


Words = tuple[pa.Array, pa.Array]  # distinct words, and their unsigned 32-bit ids in a row


def no_words() -> Words:
    return pa.array([""]), pa.array([b""], pa.large_binary())


class WordCachedTokenizer:
    """Encodes texts and keeps the ids of words already seen, up to ``limit`` words.

    A tokenizer that drops white space before it looks at words gives a text the ids of its
    words in a row, so each distinct word of a slice is encoded once. Whether the given file is
    such a tokenizer is probed first; any other encodes whole texts. Only ASCII white space
    splits, so every other character is left to the tokenizer. Words of plain letters go straight
    to the tokenizer's merging model, if a probe shows the same ids. The limit bounds memory: the
    cache has a young and an old half; a full young half replaces the old one, and words found
    in the old half become young again. Both are Arrow arrays, so a slice's words are looked up
    at once. The cache is kept for the life of a worker process.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        whole = self._plain([PROBE, f" {PROBE}\n"])
        self.by_word = whole[0] == whole[1] == list(chain.from_iterable(self._plain(PROBE.split())))
        self.bytes = byte_letters()
        self.model = self.tokenizer.model
        self.halves: list[Words] = [no_words(), no_words()]
        try:
            self.straight = self._letters(pa.array(PLAIN_PROBE))[1].to_pylist() == self._packed(PLAIN_PROBE)
        except Exception:  # a model without such tokens
            self.straight = False
        # Tasks of one worker come with functions of their own, so what they share is a module's.
        state = sys.modules.setdefault("almanack_worker", types.ModuleType("almanack_worker"))
        self.halves = state.__dict__.setdefault(f"words of {path}", [no_words(), no_words()])

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._plain(texts)]

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text starts (one more entry at the end)."""
        if not self.by_word:
            each = self._plain(texts.to_pylist())
            stops = np.cumsum([0, *map(len, each)], dtype=np.int64)
            return np.fromiter(chain.from_iterable(each), np.uint32, stops[-1]), stops
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids = self._of(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint32)[ends[0] : ends[-1]]
        bounds = np.asarray(words.offsets, dtype=np.int64)
        return flat, ends[bounds - bounds[0]] - ends[0]

    def _of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        if 2 * len(self.halves[0][0]) > self.limit:
            self.halves[:] = no_words(), self.halves[0]
        at = pc.index_in(words, value_set=self.halves[0][0])
        fresh = words.filter(pc.is_null(at))
        if len(fresh):
            self.halves[0] = tuple(pa.concat_arrays(x) for x in zip(self.halves[0], self._learn(fresh), strict=True))
            at = pc.index_in(words, value_set=self.halves[0][0])
        return self.halves[0][1].take(at)

    def _learn(self, words: pa.Array) -> Words:
        """Words that aren't young, in another order, and their ids."""
        at = pc.index_in(words, value_set=self.halves[1][0])
        parts = [(words.filter(pc.is_valid(at)), self.halves[1][1].take(at.drop_null()))]
        words = words.filter(pc.is_null(at))
        if self.straight:
            parts.append(self._letters(words))
            words = words.filter(pc.is_null(pc.extract_regex(words, PLAIN)))
        parts.append((words, pa.array(self._packed(words.to_pylist()), pa.large_binary())))
        return tuple(pa.concat_arrays(x) for x in zip(*parts, strict=True))

    def _letters(self, words: pa.Array) -> Words:
        """The words of plain letters and closing punctuation, and their ids."""
        split = pc.extract_regex(words, PLAIN)
        words, split = words.filter(pc.is_valid(split)), split.drop_null()
        letters = pc.utf8_lower(split.field("letters")).dictionary_encode()
        marks = split.field("marks").dictionary_encode()
        tokenize, spelt = self.model.tokenize, letters.dictionary.to_pylist()
        spelt = [x if x.isascii() else "".join(map(self.bytes.__getitem__, x.encode())) for x in spelt]
        stems = pa.array([array("I", [t.id for t in tokenize(x)]).tobytes() for x in spelt], pa.large_binary())
        ends = pa.array(self._packed(marks.dictionary.to_pylist()), pa.large_binary())
        joined = pc.binary_join_element_wise(stems.take(letters.indices), ends.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        return words, joined

"""Token ids of texts by a public tokenizer file, with a memo of written words.

A text is cut where its vocabulary never joins characters: before white space that
follows other characters, and between a letter and the marks that end a word. The ids
of a text are those of its pieces, one after the other, and words that recur are
encoded once per worker.
"""

from __future__ import annotations

import re
import string
import sys
from array import array
from collections.abc import Callable

import numpy as np

from eventloom.llm.common import kept_in_worker

#: written words, and pieces of them, that a worker remembers
MEMO = 3 << 17

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: marks that end a word; an apostrophe may begin a contraction
_MARKS = string.punctuation.replace("'", "")
_M = re.escape(_MARKS)
_PIECE = re.compile(rf"[^\S ](?=\S)|\s*\S*[{_L}](?=[{_M}]*(?:\s|\Z))|[{_M}]+(?=\s|\Z)|\s*\S+|\s+")
#: one unit of the vocabulary before merging
_LETTERS = re.compile(rf"[{_L}]+").fullmatch
_WIDE = re.compile("[^\x00-ɏ]")
# white space to Python only, or to some libraries only, and the letter whose lower case
# ends in a mark: such texts are encoded whole
_ODD = re.compile("[\x1c-\x1f\x85\u0130᠎​⁠﻿]")
#: white space of several characters, whose last one may belong to the next word
_WIDE_SPACE = re.compile(r"\s\s")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1
    characters for themselves, the others from U+0100 on in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(seen))
    return {b: 256 + n for n, b in enumerate(hidden)}


class _Memo(dict):
    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        got = self[key] = self.make(key)
        return got


class _Words(_Memo):
    """Written words; those of letters, with or without marks at the end, go straight
    to the vocabulary's merges. ``lead`` is the white space before each word."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead, self.cores = encoder, lead, {}
        self.first = lead.replace(" ", encoder.space)
        self.direct = encoder.direct and (not encoder.drops_space if lead else True)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
            self.cores.clear()
        core = word.rstrip(_MARKS)
        got = self.cores.get(core)
        if got is None:
            if self.direct and _LETTERS(core) and not (self.encoder.drops_case and core != core.lower()):
                unit = core if core.isascii() else core.encode().decode("latin-1").translate(self.encoder.letters)
                got = self.cores[core] = _packed(self.encoder.merge(self.first + unit))
            else:
                got = self[word] = self.encoder.joined(self.lead + word)
                return got
        if len(core) != len(word):
            got += self.encoder.pieces[word[len(core) :]]
        self[word] = got
        return got


def _packed(tokens: list) -> bytes:
    ids = array("I", [x.id for x in tokens])
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, as bytes,
    without added special tokens. A text that holds the string of an added token of the
    vocabulary is encoded whole, so the string gets the id the library gives it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [re.compile(re.escape(t.content), re.IGNORECASE).search for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what the vocabulary does not tell apart
        self.drops_space = self._whole(" a") == self._whole("a")
        self.drops_case = self._whole("AÉ") == self._whole("aé")
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])
        self.merge = self.tokenizer.model.tokenize
        unit = "é".encode().decode("latin-1").translate(self.letters)
        self.direct = _packed(self.merge(("" if self.drops_space else self.space) + "a" + unit)) == self._whole(" aé")
        self.pieces = _Memo(self._piece)
        self.words, self.spaced = _Words(self, ""), _Words(self, " ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spaced = piece[0] == " " and not self.drops_space
        letters = piece[1:] if spaced else piece
        if self.direct and _LETTERS(letters) and not (self.drops_case and piece != piece.lower()):
            unit = letters.encode().decode("latin-1").translate(self.letters)
            return _packed(self.merge((self.space if spaced else "") + unit))
        return self._whole(piece)

    def joined(self, text: str) -> bytes:
        """Ids of a text by its pieces."""
        found = _PIECE.findall(text)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def one(self, text: str) -> bytes:
        if _ODD.search(text) or any(found(text) for found in self.added):
            return self._whole(text)
        if self.drops_space:
            if self.drops_case and not _WIDE.search(text):
                text = text.lower()
            return b"".join(map(self.words.__getitem__, text.split()))
        if _WIDE_SPACE.search(text):
            return self.joined(text)
        # a single line end is a token of its own
        return self.pieces["\n"].join([self._line(line) for line in text.split("\n")])

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process."""
    return kept_in_worker(("encoder", path), lambda: Encoder(path))

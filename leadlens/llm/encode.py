"""Encoding with the tokenizers library, remembering the ids of pieces of text.

A text is cut only where no token can reach across, so the ids of a text are the ids of its pieces in order.  Words of a
corpus repeat; looking them up is several times faster than encoding them again.  The memory of a worker is bounded: the
first ``REMEMBER`` pieces and words stay, which the frequent ones are among; others are encoded each time.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

REMEMBER = 600_000  # of each: some 100 MB

# Letters that keep their byte form and case mapping under every Unicode version; a run of them is one pre-token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """``ids(text)`` equals ``tokenizer.encode(text, add_special_tokens=False).ids``.

    Two shapes of vocabulary are known: those that drop white space (any ASCII white space is a cut), and those that
    put one space before a word (a cut is before white space).  For the second, texts with other white space than
    ASCII's are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.spaced = (parts["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.pieces: dict = {}
        self.stems: dict[str, bytes] = {}
        # a word with closing marks, which fall into pre-tokens of their own
        self.word = re.compile(rf"(\n?)( ?[{_LETTERS}]+)([.,;:!?]*)" if self.spaced else rf"()([{_LETTERS}]+)([.,;:!?]*)")
        self.cuts = re.compile(r"[ \t\n\r\x0b\f]*[^ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+")
        self.other_space = re.compile(r"[^\S \t\n\r\x0b\f]")

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.spaced:
            if self.other_space.search(text) or any(s in text for s in self.special):
                return np.frombuffer(self._whole(text), self.code)
            keys = self.cuts.findall(text)
        else:
            keys = text.encode().split()  # of bytes, at ASCII white space only
        found = list(map(self.pieces.get, keys))
        if None in found:
            found = [self._learn(keys[k]) if piece is None else piece for k, piece in enumerate(found)]
        return np.frombuffer(b"".join(found), self.code)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, key: str | bytes) -> bytes:
        if (out := self.pieces.get(key)) is not None:
            return out
        text = key if self.spaced else key.decode()
        if match := self.word.fullmatch(text):
            before, word, after = match.groups()
            out = self._stem(word if self.spaced else word.lower())
            if before:
                out = self._stem(before) + out
            if after:
                out += self._stem(after)
        else:
            out = self._whole(text)
        if len(self.pieces) < REMEMBER:
            self.pieces[key] = out
        return out

    def _stem(self, part: str) -> bytes:
        """One pre-token of letters, marks or a line end, straight through the library's merge model."""
        out = self.stems.get(part)
        if out is None:
            mapped = part.encode().decode("latin-1").translate(self.letters)
            out = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.stems) < REMEMBER:
                self.stems[part] = out
        return out


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]

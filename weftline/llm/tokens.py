"""Token ids through the ``tokenizers`` library, at the speed of a dictionary.

Both vocabularies split a text before they merge bytes, and no merge crosses such a split. A text is therefore cut where a
split is certain, each distinct cut is encoded once by the library, and its ids are kept in a bounded cache. Texts in
which white space makes a split depend on its neighbours, and texts that contain a special string, are handed to the library
whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np
import regex

from .common import own_cache

#: Cached cuts of one worker process; the cache is emptied when full.
CACHE = 800_000
_UNSURE = re.compile(r"\s | \s|\s\s\s|\s\s\Z")
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: How the two vocabularies split a text before merging.
_SPLIT_BYTES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPLIT_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies name printable bytes by themselves and the others by code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


_LETTERS = _byte_letters()


class _Cut(dict):
    """Cut -> its ids as little-endian uint16. Cuts that differ in a mark behind them share the ids of their letters."""

    def __init__(self, tokenizer, lower: bool):
        self.model, self.lower = tokenizer.model, lower
        self.splits: dict[str, bytes] = {}

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.splits.clear()
        # Letter by letter, as a sigma's lower case must not depend on what follows it.
        word = (cut.lower() if cut.isascii() else "".join(map(str.lower, cut))) if self.lower else cut if cut[:1] == "\n" else " " + cut
        stem = word[not self.lower :]
        if stem.isalpha():  # letters only, perhaps with a mark behind, need no search for splits
            out = self._encoded(word)
        elif stem[-1:] in (",", ".") and stem[:-1].isalpha():
            out = self[cut[:-1]] + self._split(word[-1])
        else:
            out = b"".join(map(self._split, (_SPLIT_WORDS if self.lower else _SPLIT_BYTES).findall(word)))
        self[cut] = out
        return out

    def _split(self, split: str) -> bytes:
        if (out := self.splits.get(split)) is None:
            self.splits[split] = out = self._encoded(split)
        return out

    def _encoded(self, split: str) -> bytes:
        # Printable bytes are their own letters, so that only other ones need the table.
        if split.isascii() and (self.lower or split[:1] == " " and split[1:].isalnum()):
            letters = split if self.lower else "\u0120" + split[1:]
        else:
            letters = split.encode().decode("latin-1").translate(_LETTERS)
        return array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()


class Encoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``, in which a special string is its one id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.words = self.tokenizer.normalizer is not None
        self.cuts = _Cut(self.tokenizer, self.words)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.I)
        self.marks = {t[:2] for s in special for t in (s, s.lower(), s.upper(), s[0].lower() + s[1:2].upper(), s[0].upper() + s[1:2].lower())}

    def packed(self, text: str) -> bytes:
        """The ids as little-endian uint16."""
        if not text:
            return b""
        if any(c in text for c in self.marks) and self.special.search(text):
            return self._whole(text)
        plain = text.isascii()
        odd = any(c in text for c in _ODD_ASCII) or not plain and _ODD_SPACE.search(text)
        if self.words:
            if odd or not plain and not unicodedata.is_normalized("NFC", text):
                return self._whole(text)
            return b"".join(map(self.cuts.__getitem__, (text if "\u03a3" in text else text.lower()).split()))
        if odd and _UNSURE.search(text) or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith("\n\n"):
            return self._whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._whole(first) + b"".join(map(self.cuts.__getitem__, rest))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], "<u2").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text or ""), "<u2")


_ENCODERS: dict[str, Encoder] = {}


def _forget() -> None:
    _ENCODERS.clear()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    own_cache(_forget)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

"""Token ids of whole texts with the ``tokenizers`` library, word by word.

A text is cut into the tokenizer's pre-tokens, each distinct pre-token is
encoded once by the library's model, and its ids are kept (up to ``limit``
pre-tokens a worker) as little-endian bytes. Joining these gives exactly the
library's ids of the text. The cut is only made on texts of printable ASCII,
line ends and Latin-1 letters, where the library's classes of letters and
digits are plain ranges; all other texts go to the library as they are.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Callable

import numpy as np

#: fixed values: the letters among ASCII and Latin-1, the contractions and the
#: pre-token patterns of the two public tokenizers on such texts
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_OTHER = re.compile(rf"[^ -~\t\n\r{_LETTERS}]")
_BYTE = re.compile(rf"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf"{_CONTRACTIONS}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

PRETOKENS: dict[str, Callable[[str], list[str]]] = {
    "byte_bpe_50k.json": _BYTE.findall,
    "word_bpe_49k.json": lambda text: _WORD.findall(text.lower()),
}


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, all others
    for code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids of texts as bytes of ``dtype`` (16 bits where the vocabulary fits)."""

    def __init__(self, name: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(public_tokenizers.path(name))
        self.lib.encode_special_tokens = True
        self.model = self.lib.model
        self.cut = PRETOKENS.get(name)
        self.letters = byte_alphabet()
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {}
        self.limit = limit

    def _pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut is None or _OTHER.search(text):
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        parts, memo = self.cut(text), self.memo
        try:
            return b"".join([memo[s] for s in parts])
        except KeyError:
            if len(memo) > self.limit:
                memo.clear()
            tokenize, letters = self.model.tokenize, self.letters
            for s in parts:
                if s not in memo:
                    raw = s.encode().decode("latin-1").translate(letters)
                    memo[s] = self._pack([t.id for t in tokenize(raw)])
            return b"".join([memo[s] for s in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a worker process."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]

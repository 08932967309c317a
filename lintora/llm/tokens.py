"""Token ids by the tokenizers library, each distinct piece encoded once per worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Texts of these characters alone are lower-cased, composed and cut alike everywhere.
_PLAIN = re.compile(r"[\x20-\x26\x28-\x3b\x3d-\x7e\t\n\x0b\x0c\rÀ-ÖØ-öø-ÿ]*")
#: One digit, or a run of what is neither letter, digit nor white space.
_MARKS = re.compile(r"[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9\s]+")
_LONG_MARK = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9\s]{2}")
#: The same where no two marks touch and the commonest two are already set apart.
_OTHER_MARKS = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ\s.,]")
_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
_PIECES_BOUND = 250_000


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_LETTERS = byte_letters()


class Learned(dict):
    """A dictionary that learns what it lacks and starts anew when full."""

    def __init__(self, learn, bound: int):
        super().__init__()
        self.learn, self.bound = learn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        self[key] = value = self.learn(key)
        return value


class WordEncoder:
    """Ids (little-endian unsigned 32-bit) of whole texts, for lower-casing
    tokenizers that drop white space and never join pieces: the ids of a text
    are those of its pieces in turn. Texts of plain letters, digits and marks
    are cut into pieces here and only new pieces go to the library's model. In
    other texts (apostrophes, other scripts, possible special tokens), what
    stands between white space goes to the library as it is."""

    def __init__(self, path: str, bound: int = _PIECES_BOUND):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.ids = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size() + 1)]
        self.pieces = Learned(self._piece, bound)
        self.words = Learned(self._word, bound // 4)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text):
            return b"".join([self.words[w] for w in _SPACES.split(text) if w])
        text = text.lower()
        if _LONG_MARK.search(text):
            text = _MARKS.sub(r" \g<0> ", text)
        else:
            text = _OTHER_MARKS.sub(r" \g<0> ", text.replace(".", " . ").replace(",", " , "))
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([_LETTERS[b] for b in piece.encode()])
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; its caches serve all its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)

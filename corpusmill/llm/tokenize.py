"""Token ids from a public tokenizer file, many texts per call, with a bounded memory of words seen."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space. The tokenizer drops it and no token crosses it.
SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Texts of these characters only are split by PIECES exactly as the tokenizer file's own pattern does; others go through the whole tokenizer.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7EÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
SPECIAL = "<|"


def byte_alphabet() -> list[str]:
    """The byte-level alphabet of public BPE files: printable bytes stand for themselves, the rest follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as little-endian uint32 bytes.

    The model is run once per distinct word; at most ``limit`` words are remembered (the memory is emptied when full, which costs time only).
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join([self.alphabet[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _plain(self, text: str) -> bytes:
        words, pieces = self.words, PIECES.findall(text.lower())
        try:
            return b"".join([words[p] for p in pieces])
        except KeyError:
            if len(words) > self.limit:
                words.clear()
            for p in pieces:
                if p not in words:
                    words[p] = self._word(p)
            return b"".join([words[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text and PLAIN.fullmatch(text):
            return self._plain(text)
        return b"".join([self._plain(w) if SPECIAL not in w and PLAIN.fullmatch(w) else np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in SPACE.split(text) if w])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a Python worker holds beside the batch it was sent."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

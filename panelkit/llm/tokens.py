"""Token ids of a public word-end BPE file, by the ``tokenizers`` library, with remembered words.

The file's normaliser and splitter never look across white space, so a text is cut at ASCII white space and
each chunk's ids are remembered (as little-endian unsigned 32-bit bytes).  A new chunk of characters below
U+0250 in composed form is lower-cased and split here by the file's own rule, and the library's BPE model
encodes its words; any other chunk (other scripts, special tokens' strings, capital sigma) goes through the
whole library pipeline.  Both give exactly the ids of encoding the whole text (tested).

Memory is bounded: at most ``REMEMBERED`` chunks and words of at most ``LONGEST`` characters are kept per worker.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import regex

VOCABULARY = "word_bpe_49k.json"
REMEMBERED, LONGEST = 400_000, 64
SLICE = 1 << 20  # characters of a text that are cut into chunks at a time

# The splitting rule of the vocabulary file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable Latin-1 bytes stand for themselves,
    the others for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """What ``make`` gives for a key, remembered for keys of at most LONGEST characters."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = got
        return got


class Encoder:
    """``ids(text)``: the text's token ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.chunks = _Known(self._word), _Known(self._chunk)
        self.split = regex.compile(WORD).findall
        self.plain = re.compile("[\x00-\u024f]*").fullmatch
        self.letters = byte_letters()

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        found = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(found)}I", *found)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if b"<|" in chunk or not (text.isascii() or self.plain(text) and unicodedata.is_normalized("NFC", text)):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _slices(self, text: str) -> Iterator[str]:
        """The text in slices that end at ASCII white space (one slice where there is none)."""
        at = 0
        while len(text) - at > SLICE:
            hit = re.compile(r"[\t-\r ]").search(text, at + SLICE)
            if hit is None:
                break
            yield text[at:hit.start()]
            at = hit.end()
        yield text[at:]

    def ids(self, text: str | None) -> bytes:
        return b"".join(b"".join(map(self.chunks.__getitem__, part.encode("utf-8", "replace").split()))
                        for part in self._slices(text or ""))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file: Python workers are reused, so words stay known between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

"""A cache in front of a word-level byte-pair tokenizer.

The tokenizer treats each word by itself: white space is dropped, text is lower-cased, and no merge crosses a word. So
the ids of a text are those of its words in turn, and the ids of a word can be kept. Merges of new words run in
tiktoken, whose ranks are the tokenizer's own merges; the end of a word, part of its last symbol, is there a byte that
UTF-8 never has. Text that holds more than Latin-1 letters, and control characters, goes through the tokenizer itself,
piece by piece between ASCII white space, and text with the strings of special tokens as a whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from pathlib import Path

import regex
import tiktoken
from tokenizers import Tokenizer

from textloom.llm.common import CACHES

END = b"\xff"
#: Words in one cache; it is emptied when full.
KEPT_WORDS = 100_000
#: What the tokenizer splits a text into, as in its own file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin-1 without control characters and without the white space above ASCII.
PLAIN = re.compile(rb"[\x21-\x7e\xa1-\xff]*")
#: A full stop or comma that may be part of a longer run of signs. Where there is none, each is a piece that begins after a letter or digit.
IN_A_RUN = re.compile(rb"[^a-z0-9\s\xdf-\xf6\xf8-\xff][.,]")


def bytes_of_symbols() -> dict[str, int]:
    """The usual one-character names of the 256 bytes: printable ones name themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Words(dict):
    """Ids by Latin-1 word, worked out when first asked for."""

    def __init__(self, core: tiktoken.Encoding, whole: Tokenizer):
        super().__init__()
        self.core, self.whole = core, whole

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        if text.isalpha():
            found = self.merged(text)
        elif PLAIN.fullmatch(word):
            found = b"".join(map(self.merged, PIECES.findall(text)))
        else:
            found = packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found

    def merged(self, piece: str) -> bytes:
        return packed(self.core._core_bpe.encode_single_piece(piece.encode() + END))


class Others(dict):
    """Ids by UTF-8 piece between white space."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        try:
            found = self.words[text.lower().encode("latin-1")]
        except UnicodeEncodeError:
            found = packed(self.words.whole.encode(text, add_special_tokens=False).ids)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[piece] = found
        return found


def packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordBpe:
    """Texts to ids as little-endian unsigned 32-bit numbers, the same as the tokenizer's own without special tokens added."""

    _shared: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = bytes_of_symbols()
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in self.special:
                body, ended = (token[:-4], END) if token.endswith("</w>") else (token, b"")
                ranks[bytes(symbols[c] for c in body) + ended] = rank
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.words = Words(core, self.whole)
        self.others = Others(self.words)
        CACHES.extend([self.words, self.others])

    @classmethod
    def shared(cls, path: str) -> WordBpe:
        """One for each worker process, so that its cache lasts from task to task."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        try:
            found = text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.others.__getitem__, text.encode().split()))
        found = found.lower() if found.isascii() else text.lower().encode("latin-1")
        if not IN_A_RUN.search(found):
            found = found.replace(b".", b" .").replace(b",", b" ,")
        return b"".join(map(self.words.__getitem__, found.split()))

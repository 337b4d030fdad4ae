"""Terms of texts, cut from their UTF-8 bytes in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text that are cut into terms at a time.
PIECE = 4 << 20


def table_of(digits: bool) -> bytes:
    """For bytes.translate: A-Z to lower case, and all but letters, what is above ASCII and, if wanted, digits to spaces."""
    keep = lambda b: 97 <= b <= 122 or b >= 128 or digits and 48 <= b <= 57
    return bytes(b + 32 if 65 <= b <= 90 else b if keep(b) else 32 for b in range(256))


LETTERS, LETTERS_DIGITS = table_of(False), table_of(True)


def pieces(text: bytes | None, kept: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in lists, each of about ``most`` bytes of it; a term is never cut."""
    spaced = (text or b"").translate(kept)
    start = 0
    while len(spaced) - start > most:
        end = spaced.find(b" ", start + most)
        if end < 0:
            break
        yield spaced[start:end].split()
        start = end
    yield (spaced[start:] if start else spaced).split()

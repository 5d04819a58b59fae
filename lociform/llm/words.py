"""Words of a text in bytes: runs of letters a-z, digits and everything outside ASCII, with A-Z lower-cased."""

from __future__ import annotations

import numpy as np

SPACE = 32


def _fold(b: int) -> int:
    if b >= 128 or chr(b).isdigit() or chr(b).islower():
        return b
    return b + 32 if chr(b).isupper() else SPACE


_FOLDED = bytes(map(_fold, range(256)))


def spaced(text: str) -> bytes:
    """The text's words in UTF-8, each between two single spaces; ``b" "`` without words.

    All of the classes end at ASCII characters, so bytes and code points make
    the same words.
    """
    octets = np.frombuffer(b" " + text.encode("utf-8").translate(_FOLDED) + b" ", np.uint8)
    blank = octets == SPACE
    keep = np.ones(len(octets), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return octets[keep].tobytes()


def count(words: bytes) -> int:
    """How many words ``spaced`` gave."""
    return words.count(b" ") - 1

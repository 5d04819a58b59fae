"""Vectorised word shingles and MinHash signatures over batches of texts.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D`` after
lower-casing ``A``-``Z``; both rules are ASCII-only, so working on UTF-8 bytes
gives the same words as working on code points.  Many texts are hashed at
once with prefix sums; nothing loops over words in Python.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(base))]))


class _Powers:
    """Powers of the step and of its inverse, grown on demand."""

    up = _powers(_STEP, 1 << 16)
    down = _powers(pow(_STEP, -1, 1 << 64), 1 << 16)

    @classmethod
    def upto(cls, n: int) -> None:
        if n >= len(cls.up):
            cls.up, cls.down = _powers(_STEP, 2 * n), _powers(pow(_STEP, -1, 1 << 64), 2 * n)


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text`` in order, and where each begins and ends."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    _Powers.upto(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _Powers.up[: len(raw)], out=total[1:])
        return _mix((total[stop] - total[start]) * _Powers.down[start] + (stop - start).astype(np.uint64)), start, stop


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text`` in order, and where each begins."""
    return word_spans(text)[:2]


def range_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``first`` up to ``end``, for many ranges; equal sequences hash alike wherever they stand."""
    _Powers.upto(len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _Powers.up[: len(words)], out=total[1:])
        return _mix((total[end] - total[first]) * _Powers.down[first] + (end - first).astype(np.uint64))


def batch_shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """``shingle_hashes`` of each text; words of up to some 2 MB of texts are hashed together."""
    out: list[np.ndarray] = []
    raws = [(t or "").encode("utf-8") for t in texts]
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) <= 1 << 21):
            size += len(raws[hi]) + 1
            hi += 1
        words, start = word_hashes(b"\n".join(raws[lo:hi]))
        first = np.cumsum([0] + [len(r) + 1 for r in raws[lo:hi]])
        bounds = np.searchsorted(start, first).tolist()
        runs = _runs(words, width)
        for i, j in zip(bounds, bounds[1:]):
            if j - i >= width:
                own = np.sort(runs[i : j - width + 1])
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                out.append(own[fresh])
            else:
                out.append(_runs(words[i:j], j - i) if j > i else np.zeros(0, np.uint64))
        lo = hi
    return out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` words that begins at each place."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            acc = acc * _U(0x9E3779B97F4A7C15) + (words[k : len(words) - width + 1 + k] ^ _U(k + 1))
        return _mix(acc)


class Signer:
    """MinHash signatures: coordinate k is the least of ``h * a_k + b_k`` modulo 2**64."""

    def __init__(self, coordinates: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """uint32 array, a row per set; empty sets get zeros."""
        out = np.zeros((len(sets), len(self.a)), np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        for lo in range(0, len(full), 256):
            some = full[lo : lo + 256]
            joined = np.concatenate([sets[i] for i in some])
            starts = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
            with np.errstate(over="ignore"):
                for k in range(len(self.a)):
                    v = np.minimum.reduceat(joined * self.a[k] + self.b[k], starts)
                    out[some, k] = (v >> _U(32)).astype(np.uint32) ^ v.astype(np.uint32)
        return out

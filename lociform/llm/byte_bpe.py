"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be spanned by a token, so a cut between the two is certain.  A text is cut at
the pre-tokenizer's boundaries and at every such pair; each fragment is merged
on its own, and the ids are concatenated.  Fragments repeat far more often than
words, so most are answered from a bounded table, many at once.

Boundaries are found for a whole batch of texts at once with numpy, over one
array of code points and one of bytes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

#: Fixed values of the GPT-2 byte-level alphabet: the bytes that stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Suffixes that the pre-tokenizer keeps with their apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, BLANK, SPACE = 1, 2, 3, 4, 5
_BATCH = 1 << 18  # code points in one numpy pass


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte."""
    other = iter(range(256, 512))
    return {chr(b) if b in set(PRINTABLE) else chr(next(other)): b for b in range(256)}


def classes(spec: bytes) -> np.ndarray:
    """The pre-tokenizer's class of every code point.

    Letters, numbers and white space are those of Unicode.  The library's
    tables may be older than the ones read here, so it is asked for code points
    that were assigned of late.
    """
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    out = np.full(0x110000, OTHER, np.uint8)
    code = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, code.tolist()))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[code[m.start() : m.end()]] = kind
    split = Tokenizer.from_str(spec.decode()).pre_tokenizer.pre_tokenize_str
    late = [c for c in np.flatnonzero(out != OTHER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    for before, kind in (("!", OTHER), ("a", LETTER), ("1", NUMBER)):
        for lo in range(0, len(late), 1024):
            block = late[lo : lo + 1024]
            starts = {span[0] for _, span in split("".join(f"\n{before}{chr(c)}" for c in block))}
            out[[c for k, c in enumerate(block) if 3 * k + 2 not in starts]] = kind
    return out


def pool_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all items in a row, with their offsets and lengths."""
    count = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(count) - count, count


def gather(pool: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices ``pool[offset : offset + count]`` one after another."""
    stop = np.cumsum(count)
    at = np.repeat(offset - (stop - count), count)
    at += np.arange(len(at))
    return pool[at]


class _Known:
    """Exact table from fragments of up to 15 bytes to their ids, probed for many fragments at once.

    A slot holds a fragment's two 8-byte words, its length in the top byte (0
    marks a free slot), and where its ids are; nothing rests on a hash alone.
    A full table is emptied, so memory is bounded.
    """

    BITS, MOST, PROBES = 20, 1 << 18, 8
    SLOTS = 1 << BITS

    def __init__(self, merge):
        self.merge = merge
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros((self.SLOTS, 3), "<u8")
        self.pool = np.zeros(1 << 20, "<u4")
        self.used, self.entries = 0, 0

    def find(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and counts in the pool for the fragments between neighbours in ``at``; each below 2**24 ids long."""
        if self.entries > self.MOST or self.used > 1 << 24:
            self.clear()
        start, size = at[:-1], np.diff(at)
        words = np.ndarray((len(raw) + 9,), "<u8", buffer=raw + bytes(16), strides=(1,))
        head = np.minimum(size, 8)
        low, high = words[start] & _KEEP[head], words[start + head] & _KEEP[np.minimum(size - head, 7)]
        high |= np.minimum(size, 16).astype("<u8") << np.uint64(56)
        with np.errstate(over="ignore"):
            slot = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
            slot = ((slot ^ (slot >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.BITS)).astype(np.int64)
        place = np.zeros(len(size), "<u8")  # offset and count; 0 while unknown
        open_ = np.flatnonzero(size <= 15)
        for step in range(self.PROBES):
            got = self.slots[slot[open_] + step & self.SLOTS - 1]
            hit = (got[:, 0] == low[open_]) & (got[:, 1] == high[open_])
            place[open_[hit]] = got[hit, 2]
            open_ = open_[~hit & (got[:, 1] != 0)]
            if not len(open_):
                break
        new = np.flatnonzero(place == 0)
        if len(new):
            pieces = [raw[i : i + k] for i, k in zip(start[new].tolist(), size[new].tolist())]
            first: dict[bytes, int] = {}
            for k, piece in zip(new.tolist(), pieces):
                first.setdefault(piece, k)
            merged = [self.merge(piece) for piece in first]
            count = np.fromiter(map(len, merged), np.int64, len(merged))
            stop = self.used + np.cumsum(count)
            while stop[-1] > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
            self.pool[self.used : stop[-1]] = np.fromiter((i for ids in merged for i in ids), "<u4", int(count.sum()))
            self.used, self.entries = int(stop[-1]), self.entries + len(merged)
            where = ((stop - count) << 24 | count).astype("<u8")
            place[new] = [where[k] for k in map(dict(zip(first, range(len(first)))).__getitem__, pieces)]
            own = np.fromiter(first.values(), np.int64, len(first))
            self._keep(low[own], high[own], slot[own], where, size[own] <= 15)
        return (place >> np.uint64(24)).astype(np.int64), (place & np.uint64(0xFFFFFF)).astype(np.int64)

    def _keep(self, low, high, slot, where, short) -> None:
        left = np.flatnonzero(short)
        for step in range(self.PROBES):
            at, one = np.unique(slot[left] + step & self.SLOTS - 1, return_index=True)
            free = self.slots[at, 1] == 0
            own = left[one[free]]
            self.slots[at[free]] = np.stack([low[own], high[own], where[own]], axis=1)
            left = np.delete(left, one[free])


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], "<u8")


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: bytes, table: np.ndarray | None = None):
        import tiktoken

        data = json.loads(spec)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]]
        order = [data["model"]["vocab"][m.replace(" ", "")] for m in merges]
        if order != sorted(order):
            raise ValueError("ids must follow the order of the merges")
        self._known = _Known(tiktoken.Encoding("fragments", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece)
        self.token_bytes: list[bytes] = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        inside = np.zeros(1 << 16, bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                inside[a << 8 | b] = True
        self.certain = ~inside
        self._class = classes(spec) if table is None else table.copy()
        self._class[32] = SPACE
        self._bytes = pool_of(self.token_bytes)
        self._digits = pool_of([b"%d," % i for i in range(len(self.token_bytes))])

    def cuts(self, texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of all texts, the sorted byte offsets of all fragments, and of the texts' starts and the end."""
        joined = "".join(texts)
        raw = joined.encode("utf-8")
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        n = len(chars)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        kind = self._class[chars]
        white = kind >= BLANK
        kind = np.where(white, np.uint8(BLANK), kind)
        first = np.zeros(n + 1, bool)  # of a text
        first[starts] = True
        cut = np.ones(n + 1, bool)
        cut[1:n] = kind[1:] != kind[:-1]
        cut |= first
        run = cut.copy()
        # The last character of a run of white space stands apart from the run; a space joins what follows it.
        last = np.flatnonzero(white & run[1:] & ~first[1:])
        cut[last] = True
        spaces = last[chars[last] == 32]
        cut[spaces + 1] = False
        # Apostrophes that begin a run and are not joined to a space take a suffix along.
        marks = np.flatnonzero((chars == 39) & run[:-1] & cut[:-1])
        if len(marks):
            end = starts[np.searchsorted(starts, marks, side="right")]
            padded = np.concatenate([chars, np.zeros(2, "<u4")])
            a, b = padded[marks + 1], padded[marks + 2]
            for suffix in SUFFIXES:
                hit = (a == ord(suffix[0])) & (marks + 1 + len(suffix) <= end)
                if len(suffix) == 2:
                    hit &= b == ord(suffix[1])
                at = marks[hit]
                cut[at + 1] = False
                cut[at + 1 + len(suffix)] = True
                # a suffix is tried in order; the first that fits is taken
                keep = ~hit
                marks, a, b, end = marks[keep], a[keep], b[keep], end[keep]
        if len(raw) == n:
            at = np.flatnonzero(cut[:n])
            offsets = starts
        else:
            width = np.ones(n, np.int64)
            for limit in (0x80, 0x800, 0x10000):
                width += chars >= limit
            place = np.concatenate([[0], np.cumsum(width)])
            at, offsets = place[:n][cut[:n]], place[starts]
        octets = np.frombuffer(raw, np.uint8)
        mask = np.zeros(len(raw) + 1, bool)
        mask[at] = True
        if len(octets) > 1:
            mask[1 : len(raw)] |= self.certain[(octets[:-1].astype(np.uint16) << np.uint16(8)) | octets[1:]]
        mask[len(raw)] = True
        return raw, np.flatnonzero(mask), offsets

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        raw, at, offsets = self.cuts(texts)
        if len(at) < 2:
            return [b""] * len(texts)
        offset, count = self._known.find(raw, at)
        ids = gather(self._known.pool, offset, count).tobytes()
        ends = np.concatenate([[0], np.cumsum(count)])
        where = (4 * ends[np.searchsorted(at, offsets)]).tolist()
        return [ids[i:j] for i, j in zip(where, where[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; null counts as empty."""
        parts: list[str] = []
        plan: list[list[int | bytes]] = []
        for text in texts:
            todo: list[str | bytes] = [text or ""]
            for token, i in self.special.items():
                if token in todo[0] if len(todo) == 1 else True:
                    mark = np.array([i], "<u4").tobytes()
                    todo = [x for piece in todo for x in (_between(piece.split(token), mark) if isinstance(piece, str) else [piece])]
            own: list[int | bytes] = []
            for piece in todo:
                if isinstance(piece, bytes):
                    own.append(piece)
                else:
                    own.append(len(parts))
                    parts.append(piece)
            plan.append(own)
        done: list[bytes] = []
        lo, size = 0, 0
        for k, piece in enumerate(parts):
            size += len(piece)
            if size >= _BATCH or k == len(parts) - 1:
                done += self._plain(parts[lo : k + 1])
                lo, size = k + 1, 0
        return [done[own[0]] if len(own) == 1 else b"".join(x if isinstance(x, bytes) else done[x] for x in own) for own in plan]

    def decode(self, ids: bytes) -> str:
        return self._spell(self._bytes, ids).decode("utf-8", "replace")

    def decimals(self, ids: bytes) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._spell(self._digits, ids)[:-1]

    def _spell(self, pool: tuple[np.ndarray, np.ndarray, np.ndarray], ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4")
        return b"".join(gather(pool[0], pool[1][some], pool[2][some]).tobytes() for some in (own[k : k + _BATCH] for k in range(0, len(own), _BATCH)))


def _between(pieces: list[str], mark: bytes) -> list[str | bytes]:
    out: list[str | bytes] = [pieces[0]]
    for piece in pieces[1:]:
        out += [mark, piece]
    return out


class Vocabulary:
    """What the workers need to build a tokenizer: the file's bytes and its table of classes, read once on the driver."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.spec = f.read()
        self.table = classes(self.spec)

    _tokenizer: ByteBpe | None = None

    def tokenizer(self) -> ByteBpe:
        if Vocabulary._tokenizer is None or Vocabulary._tokenizer.spec != self.spec:
            Vocabulary._tokenizer = ByteBpe(self.spec, self.table)
            Vocabulary._tokenizer.spec = self.spec
        return Vocabulary._tokenizer

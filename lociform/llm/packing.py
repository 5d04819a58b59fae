"""Operator 5: sum-of-squares online packing of token ids into windows.

Each task packs the documents of its own input splits as they come.  A document
is cut into full windows and a rest; the rest goes to the fill level that
leaves the least sum of squared counts of partially filled windows, by an array
with one count for each level.

Windows still open at the end, or when they hold ``HELD`` tokens, are settled:
as many of the fullest as their tokens need stay as the rule filled them, and
only the pieces of the others move, whole where they fit and cut where nothing
does, so that all but one are full.  ``moved`` marks these pieces.  What stays
open of that one is cut into sequences of powers of two, so what a task pads
does not grow with its input.

Splits are put together until a task has some ``TASK`` bytes to pack, as every
task has windows to settle.  A sequence's id is the task's number and a counter;
a rerun task reads the same splits in the same order and gives the same ids.
Other splits of the same rows give other sequences and ids.

Defined results: a null or empty text is one separator; equal rows are packed
each; a text of any length fills windows of its own and one rest; an empty
table gives an empty result; a null ``doc_id`` stays null; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .common import id_and_text, saved, strings, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"
#: Tokens in open windows of a task before they are settled, and bytes of input that a task should have.
HELD, TASK = 1 << 22, 32 << 20


class Packer:
    """Online packer; ``rows`` gathers the pieces whose sequences are settled."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)  # partially filled windows by fill level
        self.open: defaultdict[int, list[list[tuple]]] = defaultdict(list)
        self.held = 0  # tokens in them
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        full = total // w * w
        for start in range(0, full, w):
            self._close([(doc_id, start, total, ids[4 * start : 4 * (start + w)], False)])
        if total > full:
            self._place((doc_id, full, total, ids[4 * full :], False))
            if self.held > HELD:
                self.settle()

    def _place(self, piece: tuple) -> None:
        size, w = len(piece[3]) // 4, self.window
        count = self.count
        # Change of the sum of squares for each level h = 0 (a new window) .. w - size.
        change = 2 * (count[size : w + 1] - count[: w + 1 - size]) + 2
        change[-1] = 1 - 2 * count[w - size] if size < w else 1
        change[0] = 2 * count[size] + 1 if size < w else 1
        fits = count[: w + 1 - size] > 0
        fits[0] = True
        change[~fits] = np.iinfo(np.int64).max
        level = len(change) - 1 - int(np.argmin(change[::-1]))  # ties go to the fullest
        pieces = []
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
            self.held -= level
        pieces.append(piece)
        if level + size == w:
            self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            count[level + size] += 1
            self.held += level + size

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids, moved in pieces:
            size = len(ids) // 4
            self.rows.append((doc_id, start, size, zlib.crc32(ids), total, self.next, offset, moved))
            offset += size
        self.next += 1

    def settle(self) -> None:
        """Closes all open windows: the emptiest ones give their pieces to the others."""
        w = self.window
        windows = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        stay = -(-self.held // w)
        spare = [(len(p[3]) // 4, k, p) for k, p in enumerate(p for pieces in windows[stay:] for p in pieces)]
        spare.sort(key=lambda x: x[:2])
        for pieces in windows[:stay]:
            room = w - sum(len(p[3]) // 4 for p in pieces)
            while room and spare:
                at = bisect_right(spare, room, key=lambda x: x[0]) - 1
                size, k, (doc_id, start, total, ids, _) = spare.pop(max(at, 0))
                if size > room:  # none fits: the smallest one is cut
                    insort(spare, (size - room, k, (doc_id, start + room, total, ids[4 * room :], True)), key=lambda x: x[:2])
                    ids, size = ids[: 4 * room], room
                pieces = [*pieces, (doc_id, start, total, ids, True)]
                room -= size
            if room <= w // 256 or (w - room) & (w - room - 1) == 0:
                self._close(pieces)
            else:
                self._halve(pieces, w - room)
        self.open.clear()
        self.count[:] = 0
        self.held = 0

    def _halve(self, pieces: list[tuple], left: int) -> None:
        """Closes the content of one window as sequences of powers of two, the largest first."""
        at = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            own = []
            while room:
                doc_id, start, total, ids, _ = pieces[at]
                size = min(room, len(ids) // 4)
                own.append((doc_id, start, total, ids[: 4 * size], True))
                if 4 * size == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc_id, start + size, total, ids[4 * size :], True)
                room -= size
            self._close(own)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, pa.bool_() if n == "moved" else pa.int64()) for n, c in zip(names, columns)], names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, separator: int = 0) -> DataFrame:
    """A row for each piece of a document: where it lies in the document and in its sequence.

    One pass over the scan without a shuffle.  A task holds one small batch of texts
    and the ids of its open windows, at most ``HELD``; the pieces, some 60 bytes each, are a table in
    the shared folder.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(window, (context.partitionId() if context else 0) << 32)
        bpe, end = known.value.tokenizer(), np.array([separator], "<u4").tobytes()
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                for doc_id, ids in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), bpe.encode(texts)):
                    packer.add(doc_id, ids + end)
                yield packer.batch()
        packer.settle()
        yield packer.batch()

    rows = id_and_text(docs)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return saved(rows.coalesce(max(1, min(-(-size // TASK), 1 << 30))).mapInArrow(tidy(run), SCHEMA), "packed")

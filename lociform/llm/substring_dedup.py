"""Operator 6: substring deduplication by sliding sentence spans.

Texts are cut into sentences; a sentence of more than ``LONG`` words is cut
further after words that a hash of the word picks, and of any ``GAP`` words in a
row without a cut, the one with the least hash (the last of equals) gets one.
Equal passages are so cut alike wherever they stand, save near their ends, and
no piece, here called sentence too, has more than ``GAP`` words.  From every
sentence on, the shortest run of at least ``SPAN`` sentences with at least
``WORDS`` words is hashed.  A repeat of 51 words with equal line ends always
holds an equal run: one begins after the first ``GAP`` words at most and ends
within 2 ``GAP`` + ``WORDS`` words, where cuts depend on words of the repeat
only.  Runs meet globally; every sentence that a repeated run covers is removed,
except in the run's first occurrence, by ``doc_id``, then row, then place.

Repeats inside a document are settled where it is read, so a document sends a
run once at most.  Runs are shuffled once and ranked in order as they stream by,
so a run of very many documents costs its task one short row for each.

Defined results: null text counts as empty, has no sentences and stays null;
words are runs of bytes between ASCII white space and compare without
regard to ASCII case; of equal rows the first
keeps its text; null ``doc_id`` comes last; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, strings, tidy
from .shingles import _mix, range_hashes, word_spans

SPAN, WORDS, LONG, PICK, GAP = 3, 20, 9, 2, 9
_END, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_END[list(b".!?")] = True
_CLOSE[list(b"\"')]")] = True


def _fill(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of every ``GAP`` words in a row that nothing ends, the one with the least hash, the last of equals."""
    before = np.concatenate([[0], np.cumsum(ends)])
    at = np.flatnonzero(before[GAP:] == before[:-GAP])
    place, least = at.copy(), words[at]
    for k in range(1, GAP):
        own = words[at + k]
        less = own <= least
        place[less], least[less] = at[less] + k, own[less]
    return place


class Batch:
    """Sentences and runs of many texts at once, as arrays over all of them."""

    def __init__(self, raws: list[bytes]):
        joined = b"\n".join(raws) + b"\n"
        octets = np.frombuffer(joined, np.uint8)
        words, start, stop = word_spans(joined)
        self.text_start = np.cumsum([0] + [len(r) + 1 for r in raws])  # of each text, and the end
        # A sentence ends after a word that closes with a mark, and before a line end.
        last = stop - 1
        for _ in range(3):
            last = np.where(_CLOSE[octets[last]] & (last > start), last - 1, last)
        lines = np.concatenate([[0], np.cumsum(octets == 10)])
        ends = _END[octets[last]] | (np.diff(lines[np.append(start, len(joined))]) > 0)
        # Long ones also end after words that the hash picks.
        close = np.flatnonzero(ends)
        size = np.diff(np.concatenate([[-1], close]))
        ends |= np.repeat(size > LONG, size) & (words % np.uint64(PICK) == 0)
        ends[_fill(words, ends)] = True
        self.last = np.flatnonzero(ends) + 1  # word after each sentence
        self.first = np.concatenate([[0], self.last[:-1]]).astype(np.int64) if len(self.last) else self.last
        self.byte = start[self.first] if len(self.first) else self.first  # where each sentence begins
        self.text = np.searchsorted(self.text_start, self.byte, side="right") - 1
        n = len(self.first)
        self.count = np.bincount(self.text, minlength=len(raws))  # sentences of each text
        self.ahead = np.cumsum(self.count) - self.count
        run = np.arange(n)
        final = np.maximum(run + SPAN - 1, np.searchsorted(self.last, self.first + WORDS))
        fits = (final < n) & (self.text[np.minimum(final, n - 1)] == self.text) if n else np.zeros(0, bool)
        self.run, self.final = run[fits], final[fits]
        a, b = self.first[self.run], self.last[self.final]
        self.high = range_hashes(words, a, b).view(np.int64)
        self.low = (range_hashes(_mix(words ^ np.uint64(0x5851F42D4C957F2D)), a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def earliest(self) -> np.ndarray:
        """Which runs are the first of their kind in their text."""
        order = np.lexsort((self.run, self.low, self.high, self.text[self.run]))
        same = np.zeros(len(order), bool)
        i, j = order[1:], order[:-1]
        same[1:] = (self.text[self.run[i]] == self.text[self.run[j]]) & (self.high[i] == self.high[j]) & (self.low[i] == self.low[j])
        out = np.zeros(len(order), bool)
        out[order[~same]] = True
        return out

    def covered(self, runs: np.ndarray) -> np.ndarray:
        """Which sentences the marked runs cover."""
        step = np.zeros(len(self.first) + 1, np.int64)
        np.add.at(step, self.run[runs], 1)
        np.add.at(step, self.final[runs] + 1, -1)
        return np.cumsum(step[:-1]) > 0


def occurrences(rows: DataFrame) -> DataFrame:
    """``high``, ``low`` (the run's hash; ``low`` above the 32 bits of the run's place), ``doc_id``, ``rid``: each
    document's first of each of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in strings(batch.column(2)):
                own = batch.slice(lo, len(texts))
                b = Batch([t.encode("utf-8") for t in texts])
                first = b.earliest()
                at = b.run[first]
                text = pa.array(b.text[at])
                low = b.low[first].astype(np.int64) << 32 | at - b.ahead[b.text[at]]
                yield pa.record_batch([pa.array(b.high[first]), pa.array(low), own.column(0).take(text), own.column(1).take(text)], names=["high", "low", "doc_id", "rid"])

    return rows.mapInArrow(tidy(run), "high long, low long, doc_id long, rid long")


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_sentences``, ``n_removed``, ``text`` without removed sentences, ``spans`` removed (code points)."""
    rows = id_and_text(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    # Taken apart after the shuffle, which the window then needs no more.
    found = occurrences(rows).repartition("high").select("high", F.shiftright("low", 32).cast("int").alias("low"), "doc_id", "rid", F.col("low").bitwiseAND((1 << 32) - 1).cast("int").alias("place"))
    order = W.partitionBy("high", "low").orderBy(F.col("doc_id").asc_nulls_last(), "rid")
    later = found.withColumn("at", F.row_number().over(order)).filter("at > 1").groupBy("rid").agg(F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                own = batch.slice(lo, len(texts))
                raws = [t.encode("utf-8") for t in texts]
                b = Batch(raws)
                marked = np.zeros(len(b.first), bool)  # runs that are not first, by their first sentence
                marked[b.run[~b.earliest()]] = True
                for k, places in enumerate(own.column(2).to_pylist()):
                    if places:
                        marked[b.ahead[k] + np.array(places)] = True
                gone = b.covered(marked[b.run])
                removed = np.bincount(b.text[gone], minlength=len(texts))
                kept, spans = list(texts), [[] for _ in texts]
                for k in np.flatnonzero(removed).tolist():
                    base, own_end = int(b.text_start[k]), len(raws[k])
                    begin = b.byte[b.ahead[k] : b.ahead[k] + b.count[k]] - base
                    end = np.append(begin[1:], own_end)
                    out, at, point = [], 0, 0
                    for i in np.flatnonzero(gone[b.ahead[k] : b.ahead[k] + b.count[k]]).tolist():
                        before = raws[k][at : begin[i]].decode("utf-8")
                        width = len(raws[k][begin[i] : end[i]].decode("utf-8"))
                        out.append(before)
                        point += len(before)
                        spans[k].append({"start": point, "end": point + width})
                        point += width
                        at = int(end[i])
                    kept[k] = "".join([*out, raws[k][at:].decode("utf-8")])
                yield pa.record_batch([own.column(0), pa.array(b.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string()), pa.array(spans, span)], names=["doc_id", "n_sentences", "n_removed", "text", "spans"])

    return rows.join(later, "rid", "left").select("doc_id", "text", "places").mapInArrow(tidy(cut), "doc_id long, n_sentences long, n_removed long, text string, spans array<struct<start:long,end:long>>")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: sentences, removed sentences, and the digest of what is kept."""
    return dedup(docs).select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))

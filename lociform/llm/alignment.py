"""Operator 13: alignment of two tokenizers' tokens over the bytes of a text.

A text stands as a space and the text.  A label string has one character for
each of its bytes: ``n`` where no token ends, ``a`` or ``b`` where a token of
one side ends, ``x`` where both do.  A regular expression takes spans up to each
``x``; how many ends of each side a span holds is how many of its tokens make
the group.  As no token is empty, the two tokens that end at an ``x`` are linked,
one pair for each group.

Pairs of ids are counted over the corpus: each task adds up its own pairs, so
what is shuffled is a task's distinct pairs.  The counted pairs go back to the
texts by a broadcast while there are at most ``PAIRS`` of them, and by a join on
the pair beyond it, where hot pairs are met apart.

Side A is a byte-level vocabulary of the tokenizers library, side B a
sentencepiece model that puts a space before the text.  If none of its pieces
has a space after another character, and it changes no text, a cut before each
run of spaces is certain, and fragments between such cuts are encoded once each.

Defined results: null and empty texts, and texts that either side does not give
back byte for byte (such as with U+2581), have no tokens: zeros, and an empty
digest; control strings inside texts are plain text; repeated rows are counted
each and stay repeated; a null ``doc_id`` stays null; very long texts are
aligned whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .byte_bpe import ByteBpe, Vocabulary, _Known, gather, pool_of
from .common import attached, forget, id_and_text, saved, strings, tidy

#: Counted pairs that are broadcast, at most (17 bytes each).
PAIRS = 1 << 22
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1 << 21
#: Code points that are aligned at once; a longer text is alone.
SLICE = 1 << 19

_SPAN = re.compile(rb"[^x]*x")
_LABELS = np.frombuffer(b"nabx", np.uint8)


def _pieces(model) -> list[bytes]:
    """Bytes of each piece: its text with U+2581 as a space, or the byte that ``<0xHH>`` names."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i in range(model.vocab_size()) for p in [model.id_to_piece(i)]]


def _stops(labels: bytes) -> np.ndarray:
    """Where the spans of a label string end; the string ends with one, and is scanned in parts that do so too."""
    parts, at, step = [np.zeros(0, np.int64)], 0, 1 << 20
    while at < len(labels):
        stop = labels.rfind(b"x", at, at + step) + 1 or labels.index(b"x", at) + 1
        parts.append(at + np.cumsum(np.fromiter(map(len, _SPAN.findall(labels[at:stop])), np.int64)))
        at = stop
    return np.concatenate(parts)


class PieceBpe:
    """Ids of a space and a text under a sentencepiece model."""

    def __init__(self, spec: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.token_bytes = _pieces(self._model)
        inner = any(b" " in t.lstrip(b" ") for t in self.token_bytes)
        probe = "  a   ﬁ　é\t\nA "
        changed = self._model.normalize(probe).replace("▁", " ") != f" {probe}"
        space = self._model.piece_to_id("▁")
        self.cuttable = not inner and not changed and self.token_bytes[space] == b" "
        # The model puts a space before every text but the empty one.
        self._known = _Known(lambda piece: self._model.encode(piece[1:].decode("utf-8"), num_threads=1) if len(piece) > 1 else [space])

    def encode(self, spaced: bytes, starts: np.ndarray, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; ``spaced`` has a space before each text."""
        if not self.cuttable:
            each = self._model.encode(list(texts), num_threads=1)
            return np.array([i for own in each for i in own], "<u4"), np.cumsum([0, *map(len, each)])
        blank = np.frombuffer(spaced, np.uint8) == 32
        mask = np.zeros(len(spaced) + 1, bool)
        mask[1:-1] = blank[1:] & ~blank[:-1]
        mask[starts] = True
        at = np.flatnonzero(mask)
        offset, count = self._known.find(spaced, at)
        ends = np.concatenate([[0], np.cumsum(count)])
        return gather(self._known.pool, offset, count), ends[np.searchsorted(at, starts)]


@dataclass
class Aligned:
    """Groups of some texts: ids of both sides in a row, how many of each a group takes, and where texts begin in each."""

    a: np.ndarray
    b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    text_group: np.ndarray


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, known: Vocabulary, model: bytes):
        self._a = ByteBpe(known.spec, known.table)
        self._a.special = {}
        self._b = PieceBpe(model)
        self._bytes = [pool_of(self._a.token_bytes), pool_of(self._b.token_bytes)]
        self._digits = pool_of([b"%d," % i for i in range(max(len(self._a.token_bytes), len(self._b.token_bytes)))])
        self.width = len(self._b.token_bytes)
        self.dtype = np.dtype(_pair_type(len(self._a.token_bytes), self.width))

    def tokens(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray], bytes, np.ndarray]:
        """Ids and text starts of both sides, bytes of the texts, and their starts there."""
        raw = [b" " + t.encode("utf-8") for t in texts]
        starts = np.cumsum([0, *map(len, raw)])
        own = self._a.encode([f" {t}" for t in texts])
        a, text_a = np.frombuffer(b"".join(own), "<u4"), np.cumsum([0, *(len(x) // 4 for x in own)])
        spaced = b"".join(raw)
        b, text_b = self._b.encode(spaced, starts, texts)
        return [a, b], [text_a, text_b], spaced, starts

    def _same(self, side: int, ids: np.ndarray, spaced: bytes) -> bool:
        pool, offset, count = self._bytes[side]
        at, step = 0, 1 << 18
        for k in range(0, len(ids), step):
            own = ids[k : k + step]
            part = gather(pool, offset[own], count[own]).tobytes()
            if not spaced.startswith(part, at):
                return False
            at += len(part)
        return at == len(spaced)

    def align(self, texts: Sequence[str]) -> Aligned:
        """Groups of the texts; texts without tokens have none."""
        ids, text, spaced, starts = self.tokens(texts)
        whole = [x != "" for x in texts]
        if not all(whole) or not all(self._same(s, ids[s], spaced) and np.array_equal(self._ends(s, ids[s])[text[s][1:]], starts[1:]) for s in (0, 1)):
            for k in range(len(texts)):
                whole[k] = whole[k] and all(self._same(s, ids[s][text[s][k] : text[s][k + 1]], spaced[starts[k] : starts[k + 1]]) for s in (0, 1))
            kept = np.array(whole)
            for s in (0, 1):
                count = np.diff(text[s])
                ids[s] = ids[s][np.repeat(kept, count)]
                text[s] = np.concatenate([[0], np.cumsum(np.where(kept, count, 0))])
            starts = np.concatenate([[0], np.cumsum(np.where(kept, np.diff(starts), 0))])
        label = np.zeros(starts[-1], np.uint8)
        for s in (0, 1):
            label[self._ends(s, ids[s])[1:] - 1] += 1 + s
        stops = _stops(_LABELS[label].tobytes())
        # How many ends of each side lie up to each stop; a span's own are the differences.
        inside = [np.diff(np.concatenate([[0], np.cumsum((label & (1 + s)) > 0)])[np.concatenate([[0], stops])]) for s in (0, 1)]
        return Aligned(ids[0], ids[1], inside[0], inside[1], text[0], text[1], np.searchsorted(stops, starts, side="right"))

    def _ends(self, side: int, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self._bytes[side][2][ids])])

    def links(self, got: Aligned) -> np.ndarray:
        """The linked pair of each group as one number: A's id times B's vocabulary, and B's id."""
        last_a, last_b = np.cumsum(got.in_a) - 1, np.cumsum(got.in_b) - 1
        return got.a[last_a].astype(self.dtype) * self.dtype.type(self.width) + got.b[last_b].astype(self.dtype)

    def shown(self, got: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        groups = len(got.in_a)
        stop_a, stop_b = np.cumsum(got.in_a), np.cumsum(got.in_b)
        both = np.empty(len(got.a) + len(got.b), np.int64)
        both[np.arange(len(got.a)) + np.repeat(stop_b - got.in_b, got.in_a)] = got.a
        both[np.arange(len(got.b)) + np.repeat(stop_a, got.in_b)] = got.b
        pool, offset, count = self._digits
        ends = np.cumsum(count[both])
        out = gather(pool, offset[both], count[both]).copy()
        if groups:
            out[ends[stop_a + stop_b - got.in_b - 1] - 1] = ord("|")
            out[ends[stop_a + stop_b - 1] - 1] = ord(";")
        where = np.concatenate([[0], ends])[got.text_a + got.text_b]
        line = out.tobytes()
        return [line[i : max(i, j - 1)] for i, j in zip(where.tolist(), where[1:].tolist())]


_aligner: tuple[bytes, bytes, Aligner] | None = None


def aligner(known: Vocabulary, model: bytes) -> Aligner:
    """One for each worker."""
    global _aligner
    if _aligner is None or _aligner[:2] != (known.spec, model):
        _aligner = (known.spec, model, Aligner(known, model))
    return _aligner[2]


def _shared(docs: DataFrame, tokenizer: str, model: str):
    """Both vocabulary files (a few MB, whatever the input's size), so that executors need no copy."""
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((vocabulary(tokenizer), f.read()))


def _mapped(docs: DataFrame, tokenizer: str, model: str, columns, schema: str) -> DataFrame:
    shared = _shared(docs, tokenizer, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*shared.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, texts in strings(batch.column(1), SLICE):
                got = both.align(texts)
                own = {"doc_id": batch.column(0).slice(lo, len(texts)), "row": pa.array(np.arange(row, row + len(texts)), pa.int64())}
                own |= {"n_a": pa.array(np.diff(got.text_a), pa.int64()), "n_b": pa.array(np.diff(got.text_b), pa.int64()), "n_groups": pa.array(np.diff(got.text_group), pa.int64())}
                own |= columns(both, got)
                row += len(texts)
                yield pa.record_batch(list(own.values()), names=list(own))

    return id_and_text(docs).mapInArrow(tidy(run), schema)


def align(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``doc_id``, counts and ``groups`` (``a1,a2|b1;a3|b2,b3``) of every text: one pass over the scan, no shuffle."""
    show = lambda both, got: {"groups": pa.array([x.decode() for x in both.shown(got)], pa.string())}
    return _mapped(docs, tokenizer, model, show, "doc_id long, row long, n_a long, n_b long, n_groups long, groups string").drop("row")


def _linked(both: Aligner, got: Aligned) -> dict[str, pa.Array]:
    links, where = both.links(got), got.text_group.tolist()
    return {
        "groups_sha256": pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in both.shown(got)], pa.string()),
        "links": pa.array([links[i:j].tobytes() for i, j in zip(where, where[1:])], pa.binary()),
    }


def _added(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a task with their counts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["pair", "n"])

    for batch in batches:
        column = batch.column(0)
        for k in range(0, len(column), 256):
            own, n = np.unique(np.frombuffer(b"".join(x for x in column.slice(k, 256).to_pylist()), dtype), return_counts=True)
            all_keys, at = np.unique(np.concatenate([keys, own.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(all_keys)).astype(np.int64)
            keys = all_keys
            if len(keys) > HELD:
                yield out()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield out()


def counted(linked: DataFrame, width: int, dtype: str) -> DataFrame:
    """``pair``, ``n`` and ``best`` (no other pair with the same B id has more) from the ``links`` of all texts."""
    pairs = linked.select("links").mapInArrow(tidy(lambda batches: _added(batches, dtype)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = saved(pairs.withColumn("b", F.col("pair") % width), "pairs")
    # One row for each id of the second vocabulary at most.
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    out = saved(pairs.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counted")
    forget(pairs)
    return out


def pairs(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """``a_id``, ``b_id``, ``n``, ``best``: how often two ids are linked over all texts."""
    width, dtype = _sizes(tokenizer, model)
    linked = saved(_mapped(docs, tokenizer, model, _linked, LINKED), "linked")
    out = counted(linked, width, dtype)
    forget(linked)
    return out.select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n", "best")


LINKED = "doc_id long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def _sizes(tokenizer: str, model: str) -> tuple[int, str]:
    """The size of the second vocabulary, and the type that holds a pair of ids."""
    import sentencepiece

    data = json.loads(vocabulary(tokenizer).spec)
    most = max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])])
    width = sentencepiece.SentencePieceProcessor(model_file=model).vocab_size()
    return width, _pair_type(most + 1, width)


def _pair_type(size: int, width: int) -> str:
    return "<u4" if size * width <= 1 << 32 else "<u8"


def report(docs: DataFrame, tokenizer: str, model: str, most_pairs: int = PAIRS) -> DataFrame:
    """One row per document: counts, the digest of its groups, and how common its links are over the corpus."""
    width, dtype = _sizes(tokenizer, model)
    linked = saved(_mapped(docs, tokenizer, model, _linked, LINKED), "linked")
    facts = counted(linked, width, dtype)
    if facts.count() <= most_pairs:
        out = _looked_up(linked, facts, dtype)
    else:
        out = _joined(linked, facts, dtype)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def _looked_up(linked: DataFrame, facts: DataFrame, dtype: str) -> DataFrame:
    got = facts.toArrow()
    order = np.argsort(got["pair"].to_numpy())
    known = tuple(got[c].to_numpy()[order] for c in ("pair", "n", "best"))
    shared = linked.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            sums = []
            for value in batch.column(batch.schema.get_field_index("links")):
                own, times = np.unique(np.frombuffer(value.as_py(), dtype), return_counts=True)
                at = np.searchsorted(pair, own.astype(np.int64))
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            kept = batch.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
            yield pa.record_batch([*kept.columns, pa.array([x for x, _ in sums], pa.int64()), pa.array([x for _, x in sums], pa.int64())], names=[*kept.schema.names, "n_best", "count_sum"])

    return linked.drop("row").mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")


def _joined(linked: DataFrame, facts: DataFrame, dtype: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0), batch.column(1)):
                own, times = np.unique(np.frombuffer(value.as_py(), dtype), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(own), row.as_py()), pa.int64()), pa.array(own.astype(np.int64), pa.int64()), pa.array(times, pa.int64())], names=["row", "pair", "times"])

    each = linked.select("row", "links").mapInArrow(tidy(run), "row long, pair long, times long")
    sums = attached(each, facts, "pair", "n").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return linked.drop("links").join(sums, "row", "left").withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero)).drop("row")

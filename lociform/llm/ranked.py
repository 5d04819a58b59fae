"""Operator 12: ranked lexical search over document-sharded postings.

The index is a table of shards.  A shard holds the documents of some input rows
(``SHARD`` bytes of text, or one longer text) and their postings in CSR form: terms in order, and for
each term the documents that hold it with an integer impact, computed once from
the term's occurrences and the document's length.  A search goes term at a time:
in every shard each item adds weight times impact into a dense array of scores,
one for each document, and takes its best by ``argpartition``; documents that
tie with the last place are told apart by ``doc_id``.  A task keeps one list of
the best for each item over all its shards, and lists are merged twice, by groups of tasks and
then by item.

Items are searched in blocks of about ``BLOCK`` bytes of terms, so what is
broadcast is bounded however many items there are; each block reads the index
once for its terms' document counts and once for the scores.

Defined results: null and empty texts have no terms, count nowhere and are never
found; repeated rows are documents of their own; a null ``doc_id`` ranks last
among equal scores; items without known terms get no rows, rows that share an
``item_id`` (null too) are one item with all their terms; very long texts and terms are
indexed whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import forget, id_and_text, saved, strings, tidy

#: Fixed values of the scoring: weights in thousandths, impacts in thousand-millionths, and the shares of the length.
WEIGHT, IMPACT, TERM, LENGTH, BASE_SHARE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 20, 50, 50

#: Bytes of text in a shard, and of terms in a block of items.
SHARD, BLOCK = 8 << 20, 4 << 20
#: Tasks whose lists of the best are merged first.
GROUP = 64

SHARDS = "doc_ids array<long>, terms binary, starts binary, rows binary, impacts binary"


@dataclass
class Index:
    """Shards, how many documents hold a term (``documents``), and how many terms they have in all (``total``)."""

    shards: DataFrame
    documents: int
    total: int

    def drop(self) -> None:
        forget(self.shards)


def build(docs: DataFrame) -> Index:
    """Two passes over the scan, no shuffle: lengths first, as impacts need their mean."""
    texts = id_and_text(docs)
    sums = texts.select("doc_id", "text").mapInArrow(tidy(_lengths), "documents long, total long").agg(F.sum("documents"), F.sum("total")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    return Index(saved(texts.mapInArrow(tidy(lambda batches: _shards(batches, documents, total)), SHARDS), "shards"), documents, total)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [words.count(words.spaced(text)) for _, texts in strings(batch.column(1)) for text in texts]
        yield pa.record_batch([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["documents", "total"])


def _shards(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for lo, texts in strings(batch.column(1)):
            for doc_id, text in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), texts):
                own = words.spaced(text)
                if len(own) < 2:
                    continue
                if parts and size + len(own) > SHARD:
                    yield _shard(ids, parts, documents, total)
                    ids, parts, size = [], [], 0
                ids.append(doc_id)
                parts.append(own)
                size += len(own)
    if parts:
        yield _shard(ids, parts, documents, total)


def _shard(ids: list[int | None], parts: list[bytes], documents: int, total: int) -> pa.RecordBatch:
    """Postings of some documents, by term and then by document."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    length = np.array([words.count(own) for own in parts], np.int64)
    term = np.fromiter((number[t] for own in parts for t in own.split()), np.int64, int(length.sum()))
    names = sorted(number)
    order = np.empty(len(names), np.int64)
    order[np.fromiter(map(number.__getitem__, names), np.int64, len(names))] = np.arange(len(names))
    row = np.repeat(np.arange(len(parts)), length)
    pair, times = np.unique(order[term] * len(parts) + row, return_counts=True)
    term, row = pair // len(parts), pair % len(parts)
    mass = BASE_SHARE + LENGTH_SHARE * length * documents // total
    impact = IMPACT * times // (TERM * times + LENGTH * mass[row])
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))])
    columns = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (b" ".join(names), starts.astype("<u4").tobytes(), row.astype("<u4").tobytes(), impact.astype("<u4").tobytes()))]
    return pa.record_batch(columns, names=["doc_ids", "terms", "starts", "rows", "impacts"])


@dataclass
class _Block:
    """Items of one block: for each its terms as numbers, and the number of each term."""

    items: list[int | None]
    terms: list[np.ndarray]
    number: dict[bytes, int]
    weight: np.ndarray | None = None

    def met(self, names: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the block's terms that a shard holds, and their places there."""
        get = self.number.get
        own = [(q, k) for k, t in enumerate(names.split(b" ")) if (q := get(t)) is not None]
        both = np.array(own, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _block(rows) -> _Block:
    number: dict[bytes, int] = {}
    own: dict[int | None, set[int]] = {}
    for item, names in rows:
        own.setdefault(item, set()).update(number.setdefault(t, len(number)) for t in bytes(names).split())
    return _Block(list(own), [np.array(sorted(x), np.int64) for x in own.values()], number)


def _terms_of(items: DataFrame) -> DataFrame:
    """``item_id``, ``terms``: the distinct terms of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), pa.array([b" ".join(sorted(set(words.spaced(t).split()))) for t in texts], pa.binary())], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(tidy(run), "item_id long, terms binary")


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's best ``k`` documents with a score above 0."""
    spark = items.sparkSession
    queries = saved(_terms_of(items), "queries")
    size = queries.agg(F.sum(F.length("terms") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    found = [_search(spark, index, _block(queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()), k) for b in range(blocks)]
    forget(queries)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(spark: SparkSession, index: Index, block: _Block, k: int) -> DataFrame:
    counts = np.zeros(len(block.number), np.int64)
    shared = spark.sparkContext.broadcast(block)
    for q, n in index.shards.select("terms", "starts").mapInArrow(tidy(lambda batches: _counts(batches, shared.value)), "q long, n long").groupBy("q").agg(F.sum("n")).collect():
        counts[q] = n
    shared.unpersist()
    with np.errstate(divide="ignore"):
        block.weight = np.where(counts > 0, np.floor(WEIGHT * np.log((2.0 * index.documents + 2) / (2.0 * counts + 1))), 0).astype(np.int64)
    shared = spark.sparkContext.broadcast(block)
    best = index.shards.mapInArrow(tidy(lambda batches: _best(batches, shared.value, k)), "item_id long, task long, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "task").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "task")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    out = saved(best.select("item_id", "rank", "doc_id", "score"), "found")
    shared.unpersist()
    return out


def _counts(batches: Iterator[pa.RecordBatch], block: _Block) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each of the block's terms."""
    n = np.zeros(len(block.number), np.int64)
    for batch in batches:
        for names, starts in zip(batch.column(0), batch.column(1)):
            q, at = block.met(names.as_py())
            n[q] += np.diff(np.frombuffer(starts.as_py(), "<u4").astype(np.int64))[at]
    q = np.flatnonzero(n)
    yield pa.record_batch([pa.array(q, pa.int64()), pa.array(n[q], pa.int64())], names=["q", "n"])


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, those that tie with the last told apart by id; in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    last = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
    above, ties = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
    return np.concatenate([above, ties[np.argsort(ids[ties], kind="stable")[: k - len(above)]]])


_NULL = np.iinfo(np.int64).max


def _best(batches: Iterator[pa.RecordBatch], block: _Block, k: int) -> Iterator[pa.RecordBatch]:
    """A task's best of each item over its shards; a null id stands as the largest number and is told by a flag."""
    empty = np.zeros((3, 0), np.int64)  # score, id, null
    kept = [empty] * len(block.items)
    for batch in batches:
        for ids, *packed in zip(*(batch.column(c) for c in range(5))):
            own = ids.values
            null = np.asarray(own.is_null()).astype(np.int64)
            ids = own.fill_null(_NULL).to_numpy(zero_copy_only=False)
            names, starts, rows, impacts = (x.as_py() for x in packed)
            starts, rows, impacts = (np.frombuffer(x, "<u4") for x in (starts, rows, impacts))
            place = np.full(len(block.number), -1, np.int64)
            q, at = block.met(names)
            place[q] = at
            scores = np.zeros(len(ids), np.int64)
            for n, terms in enumerate(block.terms):
                scores[:] = 0
                for t in terms[place[terms] >= 0].tolist():
                    a, b = starts[place[t]], starts[place[t] + 1]
                    scores[rows[a:b]] += block.weight[t] * impacts[a:b].astype(np.int64)
                some = np.flatnonzero(scores)
                some = some[top(scores[some], ids[some], k)]
                if len(some):
                    both = np.concatenate([kept[n], np.stack([scores[some], ids[some], null[some]])], axis=1)
                    kept[n] = both[:, top(both[0], both[1], k)]
    task = TaskContext.get().partitionId() // GROUP
    for n, (item, both) in enumerate(zip(block.items, kept)):
        if both.shape[1]:
            size = both.shape[1]
            columns = [pa.array([item] * size, pa.int64()), pa.array([task] * size, pa.int64()), pa.array(both[1], pa.int64(), mask=both[2] > 0), pa.array(both[0], pa.int64())]
            yield pa.record_batch(columns, names=["item_id", "task", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index, search, and drop the index."""
    index = build(docs)
    out = search(index, items, k)
    index.drop()
    return out

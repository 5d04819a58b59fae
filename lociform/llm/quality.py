"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In
a chunk, learned filters slide over learned byte vectors and are max-pooled; a
document's probability combines the mean and the maximum of its chunks' pooled
values.  Only bytes enter a score.

Training takes a bounded sample of labelled rows on the driver: at most ``SAMPLE``
rows of at most ``LONGEST`` bytes each, whole texts, chosen by a hash of their
ids.  Every round goes over all chunks of every text.  Scoring is one pass over
the scan, without a shuffle.

Defined results: null and empty texts are one chunk of padding and get a score;
equal texts get equal scores; repeated rows stay repeated, and each counts in
training; a ``doc_id`` with clashing labels has label 1; a very long text is
scored whole, in blocks of chunks; an empty table gives an empty result; without
usable labels of both kinds every document gets the
share of label 1 among them (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, strings, tidy

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE, DIM, FILTERS = 8, 4, 6, 24
#: The most labelled rows that training reads, and the most bytes of one; rounds, and the fewest steps.
SAMPLE, LONGEST, ROUNDS, STEPS = 4000, 1 << 16, 14, 800
#: Chunks that are convolved at once.
BLOCK = 256
PAD = 256


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks of symbols, padded; the last one ends with the text."""
    symbols = np.frombuffer(raw, np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(symbols) - OVERLAP) // step))
    out = np.full((n - 1) * step + CHUNK, PAD, np.uint16)
    out[: len(symbols)] = symbols
    return np.lib.stride_tricks.sliding_window_view(out, CHUNK)[::step]


class Net:
    """Parameters: byte vectors, filters, and the weights that combine pooled values."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (257, DIM)),
            "w": rng.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)),
            "b": np.zeros(FILTERS),
            "v": rng.normal(0, 0.1, 2 * FILTERS),
            "c": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.constant: float | None = None

    def convolved(self, block: np.ndarray) -> np.ndarray:
        """Filters at each place of each chunk; a window is two strides long, so each stride is multiplied once."""
        n = len(block)
        x = self.p["e"][block].reshape(-1, STRIDE * DIM)
        both = np.concatenate(np.split(self.p["w"], 2), 1)
        halves = (x @ both).reshape(n, CHUNK // STRIDE, 2 * FILTERS)
        return halves[:, :-1, :FILTERS] + halves[:, 1:, FILTERS:]

    def pooled(self, all_chunks: np.ndarray) -> np.ndarray:
        """Max-pooled filters of each chunk."""
        return np.concatenate([self.convolved(all_chunks[k : k + BLOCK]).max(1) for k in range(0, len(all_chunks), BLOCK)]) + self.p["b"]

    def placed(self, all_chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters of each chunk, and where each maximum lies."""
        top, best = [], []
        for k in range(0, len(all_chunks), BLOCK):
            h = self.convolved(all_chunks[k : k + BLOCK])
            best.append(h.argmax(1))
            top.append(np.take_along_axis(h, best[-1][:, None], 1)[:, 0])
        return np.concatenate(top) + self.p["b"], np.concatenate(best)

    def features(self, top: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum over a document's chunks of the squashed pooled values."""
        act = np.tanh(top)
        count = np.diff(np.append(starts, len(top)))
        mean = np.add.reduceat(act, starts, 0) / count[:, None]
        return np.concatenate([mean, np.maximum.reduceat(act, starts, 0)], 1), act

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text; a text's score does not depend on its neighbours."""
        out = np.zeros(len(texts))
        if self.constant is not None:
            return out + self.constant
        parts = [chunks((t or "").encode("utf-8")) for t in texts]
        lo = 0
        while lo < len(parts):
            hi, n = lo, 0
            while hi < len(parts) and (hi == lo or n + len(parts[hi]) <= BLOCK):
                n += len(parts[hi])
                hi += 1
            joined = parts[lo] if hi == lo + 1 else np.concatenate(parts[lo:hi])
            top = self.pooled(joined)
            starts = np.cumsum([0] + [len(p) for p in parts[lo : hi - 1]])
            f, _ = self.features(top, starts)
            out[lo:hi] = 1 / (1 + np.exp(-(f.astype(np.float64) @ self.p["v"] + self.p["c"][0])))
            lo = hi
        return out

    def gradients(self, some: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean logistic loss over documents, given by their chunks."""
        starts = np.cumsum([0] + [len(x) for x in some[:-1]])
        joined = np.concatenate(some)
        top, best = self.placed(joined)
        f, act = self.features(top, starts)
        p = 1 / (1 + np.exp(-(f @ self.p["v"] + self.p["c"][0])))
        d = ((p - y) * weight / len(some)).astype(np.float32)
        df = d[:, None] * self.p["v"][None]
        count = np.diff(np.append(starts, len(top)))
        doc = np.repeat(np.arange(len(some)), count)
        dact = df[doc, :FILTERS] / count[doc][:, None].astype(np.float32)
        hit = (act == f[doc, FILTERS:]).astype(np.float32)  # chunks that overlap may share their maximum
        hit /= np.add.reduceat(hit, starts, 0)[doc]
        dact = (dact + hit * df[doc, FILTERS:]) * (1 - act * act)
        at = np.lib.stride_tricks.sliding_window_view(joined, WIDTH, axis=1)[:, ::STRIDE]
        where = at[np.arange(len(top))[:, None], best]  # chunk, filter, width
        x = self.p["e"][where].reshape(len(top), FILTERS, -1)
        dx = (dact[:, :, None] * self.p["w"].T[None]).reshape(-1, DIM)
        e = np.stack([np.bincount(where.ravel(), dx[:, k], 257) for k in range(DIM)], 1).astype(np.float32)
        return {"e": e, "w": np.einsum("nf,nfd->df", dact, x), "b": dact.sum(0), "v": f.T @ d, "c": d.sum(keepdims=True)}


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Net:
    """Adam on the logistic loss, classes weighted evenly at half strength; deterministic."""
    net = Net(seed)
    if not len(texts) or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(texts) else 0.5
        return net
    rng = np.random.default_rng(seed)
    parts = [chunks(t.encode("utf-8")) for t in texts]
    share = labels.mean()
    weight = np.where(labels == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    s = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    rounds = max(ROUNDS, -(-STEPS * 32 // len(parts)) if len(parts) > 32 else STEPS)
    for turn in range(rounds):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * turn / rounds)) + 2e-4
        order = rng.permutation(len(parts))
        for lo in range(0, len(order), 32):
            own = order[lo : lo + 32]
            g = net.gradients([parts[i] for i in own], labels[own], weight[own])
            g["v"] += 1e-4 * net.p["v"]
            step += 1
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Net:
    """Trains on at most ``sample`` labelled rows of at most ``longest`` bytes outside the held-out fold, chosen by a hash of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & ~held_out("__id"))
    place = F.xxhash64("__id")
    chosen = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(place, "__id").limit(sample)
    rows = id_and_text(docs).filter(F.octet_length("text") <= longest).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.select("__id", "__y", "text").orderBy(place, "__id", "text").limit(sample).collect()  # an id may have several rows
    return train([r["text"] for r in rows], np.array([r["__y"] for r in rows], np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each document.  The network (some 30 KB) is broadcast."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in strings(batch.column(2)):
                own = batch.slice(lo, len(texts))
                p = known.value.score(texts)
                yield pa.record_batch([own.column(0), own.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs`` that the network does not reject; all columns, in the same pass."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, texts in strings(batch.column(at)):
                yield batch.slice(lo, len(texts)).filter(pa.array(known.value.score(texts) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)

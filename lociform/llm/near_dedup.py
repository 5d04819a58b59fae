"""Operator 10: near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every document gets its shingle set's digest, size and MinHash signature.
   Documents with equal sets are one node.
2. A node is posted under coordinate-value pairs.  All pairs have one order,
   frequent ones last, and a node is posted only under a prefix of its own: two
   nodes that agree in ``least`` of ``coordinates`` places share at least
   ``COLLISIONS`` postings there.
3. Each posting names a leader, its most typical node.  Nodes that collide and
   agree with a leader often enough are compared with it first, so that a
   cluster of many near copies joins by about one comparison a node.
   Then postings of up to ``SMALL`` nodes are merged: collisions are counted
   between nodes that no link joins so far, and pairs with ``COLLISIONS`` of them
   and ``least`` equal coordinates stay.
4. Longer postings are skipped in the merge, as their pairs would be quadratic.
   A node of such a posting is compared with the leader if it agrees with it
   often enough.  Nodes that no link joins with the leader are held against the
   leader's group by their signatures' low bytes alone, in blocks inside tasks;
   only nodes that agree often enough with one that no link joins with them
   need their sets.  These fall into parts that no such agreement crosses, and
   a part is compared in blocks of bounded bytes inside tasks that return a
   spanning forest of links.
5. All links are confirmed on full sets; components follow.

Steps 3 and 4 are complete together: a pair above the threshold shares
``COLLISIONS`` postings, which are all merged, or one that is skipped.  A pair at
the threshold agrees in ``least`` places but for a chance of about 1e-8 (six
standard deviations).

Pairs are compared by Spark's own array functions, a pair a row, so memory does
not grow with their number or with the length of a group.  Texts are read again
for the nodes that need their sets; beyond ``PICKED`` of them a bitmap of fixed
size keeps other texts out of the shuffle.

Defined results: null and empty texts and texts without words have no shingles
and are linked with nothing; fewer words than the width are one shingle; very
long texts have long sets, and fewer of them go in a block; repeated rows stay
repeated and share a component; a null ``doc_id`` counts in no minimum; an empty
table gives an empty result; ``report`` reads no other columns, and ``dedup``
hands all of them on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, forget, saved, strings, tidy
from .graph import components
from .shingles import Signer, batch_shingles

COORDINATES, COLLISIONS, SMALL = 64, 3, 64
#: Frequent coordinate-value pairs that are broadcast, at most (8 MB).
FREQUENT = 1 << 19
#: Hashes of all sets in one block, signatures in one block, and nodes that meet one copy of their leader's set.
BLOCK, SIGNED, FOLLOWERS = 1 << 19, 8192, 4096
#: Ids that are broadcast to pick texts, at most; beyond it they are joined, and a bitmap of ``WORDS`` longs goes before.
PICKED, WORDS = 1 << 17, 1 << 19


class Measure:
    """Shingle width and the least similarity, as a fraction in hundredths."""

    def __init__(self, width: int = 3, percent: int = 85):
        self.width, self.percent = width, percent
        j = percent / 100
        self.least = math.floor(COORDINATES * j - 6 * math.sqrt(COORDINATES * j * (1 - j)))
        self.prefix = COORDINATES - self.least + COLLISIONS

    def close(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)


def _key(text: Column) -> Column:
    """A hash of a document's id and text, by which it is found again."""
    return F.xxhash64(F.col("doc_id").cast("long"), text).alias("key")


def _picked(few: DataFrame) -> DataFrame:
    """``few``, broadcast unless it has more than ``PICKED`` rows."""
    return F.broadcast(few) if few.count() <= PICKED else few


def signatures(docs: DataFrame, measure: Measure, rid: str | None = None) -> DataFrame:
    """``doc_id``, ``rid`` (that column, null without), ``key``, ``n``, ``set_id`` (null without shingles), ``sig`` and
    ``low`` (low bytes of the coordinates, eight to a long) for each document."""
    width = measure.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(COORDINATES)
        for batch in batches:
            for lo, texts in strings(batch.column(3)):
                sets = batch_shingles(texts, width)
                sig = sign(sets)
                low = sig.astype(np.uint8).view("<i8")
                columns = [
                    *(batch.column(k).slice(lo, len(texts)) for k in range(3)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * low.shape[1]), pa.array(low.ravel())),
                ]
                yield pa.record_batch(columns, names=["doc_id", "rid", "key", "n", "set_id", "sig", "low"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(rid) if rid else F.lit(None)).cast("long").alias("rid"), _key(text), text.alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, rid long, key long, n long, set_id binary, sig binary, low array<long>")


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _tokens(sigs: list[bytes]) -> np.ndarray:
    """Coordinate-value pairs as integers, a row per node."""
    values = np.frombuffer(b"".join(sigs), "<u4").reshape(len(sigs), COORDINATES)
    return values.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)[None]


def _frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate-value pairs that more than ``SMALL`` nodes share, with their counts; of more than ``FREQUENT``, the most frequent ones.

    Counts cover all nodes.  Their order only decides which postings are short,
    never which pairs are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2048):
                token, count = np.unique(_tokens(batch.column(0).slice(k, 2048).to_pylist()), return_counts=True)
                yield pa.record_batch([pa.array(token), pa.array(count)], names=["token", "count"])

    counts = nodes.select("sig").mapInArrow(tidy(run), "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    often = saved(counts.filter(F.col("count") > SMALL), "often")
    steps = often.groupBy("count").agg(F.count("*").alias("pairs")).toPandas().sort_values("count", ascending=False)
    over = steps["count"][steps["pairs"].cumsum() > FREQUENT]
    rows = often.filter(F.col("count") > (over.max() if len(over) else 0)).toPandas().sort_values("token")
    forget(often)
    return rows["token"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def postings(nodes: DataFrame, measure: Measure) -> DataFrame:
    """``token``, ``node``, ``n``, ``typical`` for each node's prefix of coordinate-value pairs."""
    known = nodes.sparkSession.sparkContext.broadcast(_frequent(nodes))
    prefix = measure.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = known.value
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                some = batch.slice(lo, 4096)
                own = _tokens(some.column(2).to_pylist())
                often = np.zeros(own.shape, np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                    often = np.where(token[at] == own, count[at], 0)
                first = np.argsort(often, axis=1, kind="stable")[:, :prefix]
                picked = np.take_along_axis(own, first, 1)
                typical = np.log1p(often).sum(1)
                spread = lambda x: pa.array(np.repeat(x, prefix))
                yield pa.record_batch([pa.array(picked.ravel()), spread(some.column(0).to_numpy()), spread(some.column(1).to_numpy()), spread(typical)], names=["token", "node", "n", "typical"])

    return nodes.select("node", "n", "sig").mapInArrow(tidy(run), "token long, node long, n long, typical double")


def _star_pairs(shared: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Nodes and leaders of postings of up to ``SMALL`` nodes that collide and agree often enough: at most one pair a posting and node."""
    stars = shared.filter((F.col("size") <= SMALL) & (F.col("node") != F.col("leader"))).groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).count()
    return _agreeing(stars.filter(F.col("count") >= COLLISIONS).select("a", "b"), nodes, measure)


def _small_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Pairs from postings of up to ``SMALL`` nodes that collide and agree often enough, and have different ``roots(node, root)``."""
    placed = shared.filter(F.col("size") <= SMALL).join(roots, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    lists = placed.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("list"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    left = lists.select("list", F.posexplode("list").alias("at", "x"))
    met = left.select("x", F.explode(F.slice("list", F.col("at") + 2, F.lit(SMALL))).alias("y")).filter("x.root <> y.root")
    sized = 100 * F.least("x.n", "y.n") >= measure.percent * F.greatest("x.n", "y.n")
    pairs = met.filter(sized).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).groupBy("a", "b").count().filter(F.col("count") >= COLLISIONS).select("a", "b")
    return _agreeing(pairs, nodes, measure)


def _agreeing(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The ``pairs`` of nodes ``a`` and ``b`` that may have ``least`` equal coordinates."""
    return _agree(pairs.join(nodes.select(F.col("node").alias("b"), F.col("low").alias("y")), "b"), pairs.columns, nodes, measure)


def _agree(pairs: DataFrame, columns: list[str], nodes: DataFrame, measure: Measure) -> DataFrame:
    """The ``pairs``, which have the low bytes ``y`` of ``b``, that may have ``least`` equal coordinates."""
    pairs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("low").alias("x")), "a")
    return pairs.filter(COORDINATES - sum((_odd_bytes(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(COORDINATES // 8)), F.lit(0)) >= measure.least).select(*columns)


def _odd_bytes(x: Column) -> Column:
    """How many of a long's eight bytes are not zero: each byte's bits are folded into its lowest one."""
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return F.bit_count(x)


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` may be one of ``wanted``: a bitmap of ``WORDS`` longs at most is broadcast, whatever their number."""
    place = F.pmod(F.col("key"), F.lit(64 * WORDS))
    word, bit = F.shiftright(place, 6), F.pmod(place, F.lit(64)).cast("int")
    bits = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    met = rows.withColumn("word", word).join(F.broadcast(bits), "word")
    return met.filter(F.getbit("bits", bit) == 1).select(*rows.columns)


def _sets(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """``node``, ``set`` (hashes) of ``wanted(node, key, set_id)``, from the text of one document of each."""
    width = measure.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in strings(batch.column(2)):
                own = batch.slice(lo, len(texts))
                sets = batch_shingles(texts, width)
                same = pa.array([_digest(s) == i for s, i in zip(sets, own.column(1).to_pylist())], pa.bool_())
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch([own.column(0), hashes], names=["node", "set"]).filter(same)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows, few = docs.select(_key(text), text.alias("text")), wanted.count() <= PICKED
    # Repeated rows share a key; one shuffle by it serves for both steps.
    rows = rows.join(F.broadcast(wanted), "key").dropDuplicates(["key"]) if few else _among(rows, wanted).dropDuplicates(["key"]).join(wanted, "key")
    return rows.select("node", "set_id", "text").mapInArrow(tidy(run), "node long, set array<long>")


def _overlaps(pairs: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``, ``na``, ``nb``, ``both`` of ``pairs(a, b, slot)``: sizes of two full sets and of their intersection.

    The set of a leader, a ``b`` of very many pairs, has a copy for each slot.
    """
    seconds = pairs.select(F.col("b").alias("node")).distinct().join(leaders.select(F.col("leader").alias("node"), "slots"), "node", "left")
    ends = sets.join(_picked(seconds), "node").select(F.col("node").alias("b"), F.col("set").alias("y"), F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
    met = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).join(_picked(pairs), "a").join(ends, ["b", "slot"])
    return met.select("a", "b", F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb"), F.size(F.array_intersect("x", "y")).cast("long").alias("both"))


def _near_blocks(measure: Measure):
    least, percent = measure.least, measure.percent

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes of a block that agree often enough with one of another root, each with its root and the least root that such agreements join it with."""
        loose, every = pdf[pdf["first"] & pdf["loose"]], pdf[pdf["second"]]
        names, place = np.unique(np.concatenate([loose["root"], every["root"]]), return_inverse=True)
        own, other = place[: len(loose)], place[len(loose) :]
        top = np.arange(len(names))
        met = np.zeros(len(loose), bool), np.zeros(len(every), bool)
        if len(loose) and len(every):
            x, y = (np.stack(rows["low"].to_list()).view(np.uint8) for rows in (loose, every))
            y, m, n = np.ascontiguousarray(y.T), loose["n"].to_numpy(), every["n"].to_numpy()
            step = max(1, (1 << 22) // len(every))
            for lo in range(0, len(loose), step):
                some = slice(lo, lo + step)
                agree = np.zeros((len(x[some]), len(every)), np.uint8)
                for k in range(COORDINATES):
                    agree += x[some, k, None] == y[k]
                close = (agree >= least) & (own[some, None] != other)
                close &= 100 * np.minimum(m[some, None], n) >= percent * np.maximum(m[some, None], n)
                met[1][close.any(0)] = True
                for u in np.flatnonzero(close.any(1)):
                    met[0][lo + u] = True
                    joined = np.unique(np.append(top[other[close[u]]], top[own[lo + u]]))
                    if len(joined) > 1:
                        top[np.isin(top, joined)] = joined[0]
        out = pd.concat([loose[met[0]], every[met[1]]])[["node", "n", "root"]]
        return out.assign(top=names[top[np.concatenate([own[met[0]], other[met[1]]])]]).drop_duplicates("node")

    return run


def _block_links(measure: Measure):
    close = measure.close

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between loose nodes and all nodes of a block that have other roots; of these, a spanning forest."""
        loose, every = pdf[pdf["first"] & pdf["loose"]], pdf[pdf["second"]]
        if not len(every) or not len(loose):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        words, place = np.unique(np.concatenate(every["set"].to_list()), return_inverse=True)
        size = every["set"].str.len().to_numpy()
        starts = np.cumsum(size) - size
        nodes, roots = every["node"].to_numpy(), every["root"].to_numpy()
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        out = []
        mark = np.zeros(len(words), np.int32)
        for u, root, own in zip(loose["node"].tolist(), loose["root"].tolist(), loose["set"]):
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            at = at[words[at] == own]
            mark[at] = 1
            both = np.add.reduceat(mark[place], starts)
            mark[at] = 0
            new = close(both, len(own), size) & (roots != root)
            for v, other in zip(nodes[new].tolist(), roots[new].tolist()):
                x, y = find(root), find(other)
                if x != y:
                    top[x] = y
                    out.append((u, v))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


KEY = ["part", "band", "ub", "vb"]


def _blocks(rows: DataFrame, weight: Column, block: int, measure: Measure) -> DataFrame:
    """``rows(part, node, n, loose, ...)`` in blocks ``KEY``; in a block, ``loose`` rows that are ``first`` meet rows that are ``second``.

    A part of up to a block's weight is one.  In longer ones two nodes can be
    close only if their sizes are; they fall into bands of which neighbours
    alone can hold such nodes.  Bands are cut into blocks, and every block of
    loose nodes meets every block of its and the neighbouring bands.  Long parts
    are at most the weight of all rows by ``block``, so they are broadcast.
    """
    columns, yes, no, zero = rows.columns, F.lit(True), F.lit(False), F.lit(0)
    long = saved(rows.groupBy("part").agg(F.sum(weight).alias("all")).filter(F.col("all") > block).select("part"), "long")
    if not long.limit(1).count():
        return rows.select(*columns, *(zero.alias(c) for c in KEY[1:]), yes.alias("first"), yes.alias("second"))
    whole = rows.join(F.broadcast(long), "part", "left_anti").select(*columns, *(zero.alias(c) for c in KEY[1:]), yes.alias("first"), yes.alias("second"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(measure.percent / 100)) + 1e-9).cast("int")
    placed = rows.join(F.broadcast(long), "part", "left_semi").withColumn("band", band)
    near = placed.filter("loose").withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    cut = lambda df, name: df.groupBy("part", "band").agg(F.ceil(F.sum(weight) / block).cast("int").alias(name))
    counts = F.broadcast(saved(cut(near, "ublocks").join(cut(placed, "vblocks"), ["part", "band"]), "counts"))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    us = near.join(counts, ["part", "band"]).select(*columns, "band", slot("ublocks").alias("ub"), every("vblocks").alias("vb"), yes.alias("first"), no.alias("second"))
    vs = placed.join(counts, ["part", "band"]).select(*columns, "band", every("ublocks").alias("ub"), slot("vblocks").alias("vb"), no.alias("first"), yes.alias("second"))
    return whole.unionByName(us).unionByName(vs)


def _near(groups: DataFrame, roots: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """``part``, ``node``, ``n``, ``root``, ``loose`` for the nodes of ``groups(leader, node, n)`` that agree often enough with one of
    another root there; no agreement crosses parts, and a part's nodes that are not ``loose`` have one root."""
    leaders = roots.join(groups.select(F.col("leader").alias("node")).distinct(), "node").select(F.col("node").alias("leader"), F.col("root").alias("main"))
    rows = groups.join(roots, "node", "left").join(_picked(leaders), "leader", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.select(F.col("leader").alias("part"), "node", "n", "root", (F.col("root") != F.coalesce("main", "leader")).alias("loose"))
    rows = _blocks(rows, F.lit(1), SIGNED, measure).join(nodes.select("node", "low"), "node")
    near = saved(rows.groupBy(*KEY).applyInPandas(_near_blocks(measure), "node long, n long, root long, top long"), "near")
    tops = components(near.select(F.col("root").alias("a"), F.col("top").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("part"))
    placed = saved(near.select("node", "n", "root").distinct().join(tops, "root"), "placed")
    main = placed.groupBy("part", "root").agg(F.count("*").alias("count")).groupBy("part").agg(F.max_by("root", "count").alias("main"))
    out = saved(placed.join(main, "part").select("part", "node", "n", "root", (F.col("root") != F.col("main")).alias("loose")), "parts")
    forget(near, placed)
    return out


def labels(docs: DataFrame, measure: Measure | None = None, rid: str | None = None) -> DataFrame:
    """``doc_id``, ``rid``, ``n_shingles``, ``component_id``, ``root`` for each row of ``docs``; the last is null without shingles."""
    measure = measure or Measure()
    signed = saved(signatures(docs, measure, rid), "signed")
    nodes = _nodes(signed)
    numbered = saved(signed.select("doc_id", "rid", "n", "set_id"), "numbered")
    forget(signed)
    found = saved(links(docs, nodes, measure), "found")
    roots = components(found)
    placed = saved(nodes.select("node", "set_id", "rep", "rows").join(roots, "node", "left").select("set_id", "rep", "rows", F.coalesce("root", "node").alias("root")), "placed")
    least = saved(placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("size")), "least")
    by_set = saved(attached(placed, least, "root", "size").select("set_id", "component_id", "root", "rows"), "by_set")
    forget(found, nodes, placed, least)
    rows = numbered.select("doc_id", "rid", F.col("n").alias("n_shingles"), "set_id")
    named = attached(rows.filter("set_id IS NOT NULL"), by_set, "set_id", "rows").select("doc_id", "rid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")
    return named.union(rows.filter("set_id IS NULL").select("doc_id", "rid", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def _nodes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set, numbered; ``key`` is that of one of its documents."""
    grouped = signed.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("rows"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.max("low").alias("low"))
    return saved(grouped.select("set_id", "rep", "key", "rows", "n", "sig", "low", F.monotonically_increasing_id().alias("node")), "nodes")


def links(docs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Confirmed links between nodes; those left out join nodes that other links join."""
    posted = saved(postings(nodes, measure), "posted")
    sizes = posted.groupBy("token").agg(F.count("*").alias("size"), F.max(F.struct("typical", (-F.col("node")).alias("low"))).alias("top")).filter(F.col("size") > 1)
    shared = saved(posted.join(sizes, "token").select("token", "node", "n", "size", (-F.col("top.low")).alias("leader")), "shared")
    forget(posted)
    groups = saved(shared.filter(F.col("size") > SMALL).groupBy("leader", "node", "n").agg(F.max("size").alias("size")), "groups")
    slots = F.ceil(F.col("size") / FOLLOWERS).cast("int")
    leaders = groups.groupBy("leader").agg(F.max(slots).alias("slots"))
    stars = groups.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b"), F.pmod(F.xxhash64("node"), slots).cast("int").alias("slot"))
    heads = nodes.select(F.col("node").alias("b"), F.col("low").alias("y")).join(_picked(leaders.select(F.col("leader").alias("b"))), "b")
    stars = _agree(stars.join(_picked(heads), "b"), stars.columns, nodes, measure)
    first = saved(_star_pairs(shared, nodes, measure).select("a", "b", F.lit(0).alias("slot")).union(stars), "first")
    wanted = saved(_ends(first).distinct().join(nodes.select("node", "key", "set_id"), "node"), "wanted")
    sets = saved(_sets(docs, wanted, measure), "sets")
    forget()
    firm = saved(_firm(_overlaps(first, leaders, sets), measure), "firm")
    forget(first)
    roots = components(firm)
    pairs = saved(_small_pairs(shared, roots, nodes, measure).select("a", "b", F.lit(0).alias("slot")), "pairs")
    forget(shared)
    near = _near(groups, roots, nodes, measure) if groups.limit(1).count() else None
    forget(groups, roots)
    ends = _ends(pairs) if near is None else _ends(pairs).union(near.select("node"))
    new = saved(ends.distinct().join(wanted, "node", "left_anti").join(nodes.select("node", "key", "set_id"), "node"), "new")
    more = saved(_sets(docs, new, measure), "sets") if new.limit(1).count() else None
    forget(wanted, new)
    every = sets if more is None else sets.unionByName(more)
    known = [firm, saved(_firm(_overlaps(pairs, leaders.limit(0), every), measure), "known")]
    if near is not None:
        rows = _blocks(near, F.col("n"), BLOCK, measure)
        known.append(saved(every.join(_picked(rows), "node").groupBy(*KEY).applyInPandas(_block_links(measure), "a long, b long"), "known"))
    forget(pairs, sets, *([] if more is None else [more]), *([] if near is None else [near]))
    return reduce(DataFrame.unionByName, known)


def _firm(met: DataFrame, measure: Measure) -> DataFrame:
    return met.filter(measure.close(F.col("both"), F.col("na"), F.col("nb"))).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def report(docs: DataFrame, measure: Measure | None = None) -> DataFrame:
    """One row per document: its set's size, its component, and whether it is the one that stays."""
    return labels(docs, measure).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, measure: Measure) -> DataFrame:
    """``docs`` with one row of each component: that with the least ``doc_id``, then the least row number; all columns.

    Rows are numbered once, in a table written to the shared folder, so what
    goes does not depend on how ``docs`` comes out when it is read again.
    Documents without shingles stay.
    """
    rid = "__rid"
    while rid in docs.columns:
        rid += "_"
    docs = saved(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    named = saved(labels(docs, measure, rid).filter("root IS NOT NULL").select("root", "rid", "doc_id"), "named")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("rid").alias("r"))
    stay = named.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.r").alias("rid"))
    drop = saved(named.join(stay, "rid", "left_anti").select(F.col("rid").alias(rid)), "drop")
    if drop.count() <= PICKED:
        drop = F.broadcast(drop)
    return docs.join(drop, rid, "left_anti").drop(rid)

"""Operator 2: approximate nearest neighbours by a hierarchical k-means tree.

The measure is the largest inner product.  Vectors are lifted by one component
to equal length, which turns it into nearness.  The upper levels of a tree of
means are fitted on a bounded sample (``SAMPLE``) on the driver; a table too
large for a leaf of ``LEAF`` rows that way gets its lower levels from tasks, one
for each upper leaf, each on a bounded sample of its own rows (``LOWER``).  The
number of leaves so grows with the table, until all means fill ``TREE`` bytes.
Every row is filed under a leaf.

A query walks the tree best-bin-first through a priority queue.  The number of
leaves it visits is widened until calibration queries, whose true neighbours in
the whole table are known, reach a recall of ``RECALL``, and further for a query
whose leaves hold too few rows to give ``k``.  Candidates are the rows of visited
leaves and no others; they are scored exactly.  The sample only fits the tree and
prunes: its rows lie in leaves too, so a row worse than the ``k``-th best sample
row of the visited leaves cannot be among the best found, and is not handed on.

Leaves and their queries are cut into blocks of bounded size, so a leaf of very
many equal vectors spreads over many tasks, each returning its best ``k``.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id; a
query's own row is every row with its id; of rows with equal id and vector one
takes part; ties go to the smaller id; fewer candidates than ``k`` give all of
them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, tidy

#: The most rows that the upper tree is fitted on, calibration queries, and the recall they are to reach.
SAMPLE, QUERIES, RECALL = 16384, 256, 0.95
BRANCH, LEAF, BLOCK = 16, 256, 4096
#: Bytes of the sample and of a tree's means, at most; both are broadcast.
TREE = 1 << 25
#: Upper leaves of a tree in two parts, and rows that each of their lower parts is fitted on, about.
TOP, LOWER = 256, 4096


class Tree:
    """Means of each node, and leaves numbered from 0 in the order of the tree; ``share`` of the points in each leaf."""

    def __init__(self, points: np.ndarray, leaf: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.children: list[tuple[np.ndarray, list[int]]] = []  # means, and ids: of a node, or ~leaf
        self.share: list[float] = []
        self.visits = 1
        self.root = self._grow(points, np.arange(len(points)), max(leaf, 1.0), rng)

    @property
    def leaves(self) -> int:
        return len(self.share)

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        if len(own) > leaf:
            branch = min(BRANCH, max(2, round(len(own) / leaf)))
            means = points[rng.choice(own, branch, replace=False)]
            for _ in range(8):
                near = self._nearest(points[own], means)
                sums = np.zeros_like(means)
                np.add.at(sums, near, points[own])
                count = np.bincount(near, minlength=branch)
                means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], means)
            near = self._nearest(points[own], means)
            used = np.unique(near)
            if len(used) > 1:
                at = len(self.children)
                self.children.append((means[used], []))
                self.children[at][1].extend(self._grow(points, own[near == k], leaf, rng) for k in used)
                return at
        self.share.append(len(own) / len(points))
        return ~(len(self.share) - 1)

    def graft(self, lower: dict[int, Tree]) -> None:
        """Puts trees in the place of leaves; leaves are numbered anew."""
        share, self.share = self.share, []
        top = len(self.children)

        def place(child: int) -> int:
            if child >= 0:
                return child
            sub = lower.get(~child)
            if sub is None:
                self.share.append(share[~child])
                return ~(len(self.share) - 1)
            base, first = len(self.children), len(self.share)
            moved = lambda c: c + base if c >= 0 else c - first
            self.children += [(means, [moved(c) for c in ids]) for means, ids in sub.children]
            self.share += [share[~child] * x for x in sub.share]
            return moved(sub.root)

        for at in range(top):
            means, ids = self.children[at]
            self.children[at] = (means, [place(c) for c in ids])
        if self.root < 0:
            self.root = place(self.root)

    @staticmethod
    def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
        return np.argmax(x @ means.T - 0.5 * (means**2).sum(1)[None], axis=1)

    def file(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = ~node
            elif len(own):
                means, ids = self.children[node]
                near = self._nearest(points[own], means)
                todo += [(child, own[near == k]) for k, child in enumerate(ids)]
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best-bin-first: the open branch with the nearest mean is taken next."""
        queue = [(0.0, self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                means, ids = self.children[node]
                far = ((means - query) ** 2).sum(1)
                best = int(far.argmin())
                for k, (d, child) in enumerate(zip(far.tolist(), ids)):
                    if k != best:
                        heapq.heappush(queue, (d, child))
                node = ids[best]
            yield ~node

    def visit(self, query: np.ndarray, held: np.ndarray, least: int) -> list[int]:
        """The first ``visits`` leaves of a walk, and more until they hold ``least`` rows, of the ``held`` of each leaf."""
        found, rows = [], 0
        for leaf in self.walk(query):
            if len(found) >= self.visits and rows >= least:
                break
            found.append(leaf)
            rows += int(held[leaf])
        return found

    def calibrate(self, asked: np.ndarray, wanted: list[list[int]]) -> None:
        """Sets ``visits`` so that the leaves of the ``wanted`` rows of calibration queries are visited for a share ``RECALL`` of them."""
        ranks: list[int] = []
        for q, own in zip(asked, wanted):
            left = dict(Counter(own))
            for rank, leaf in enumerate(self.walk(q)):
                ranks += [rank] * left.pop(leaf, 0)
                if not left:
                    break
        ranks.sort()
        self.visits = 1 + ranks[max(int(np.ceil(RECALL * len(ranks))) - 1, 0)] if ranks else 1


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (floats, where the table has floats, or doubles) of the rows that take part."""
    own = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(~odd & F.exists("vector", lambda x: x != 0))


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all have the length of the longest."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))[:, None]], 1)


def _asked(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries as points: at the longest length, the added component 0."""
    return np.concatenate([x * (longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))], 1)


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` rows, chosen by a hash; equal rows once."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    pairs = {(i, tuple(v)): None for i, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist())}
    return np.array([i for i, _ in pairs], np.int64), np.array([v for _, v in pairs], np.float64)


def fit(rows: DataFrame, points: np.ndarray, n: int, longest: float) -> Tree:
    """The tree for ``n`` rows; ``points`` are the lifted sample."""
    want = max(1, min(-(-n // LEAF), TREE // (8 * points.shape[1])))
    if want <= len(points) // 16 or n <= len(points):
        return Tree(points, len(points) / want)
    tree = Tree(points, len(points) / TOP)
    top = rows.sparkSession.sparkContext.broadcast(tree)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, rng = top.value, np.random.default_rng(17)
        for batch in batches:
            if len(batch):
                leaf = upper.file(lift(_matrix(batch.column(0)), longest))
                keep = rng.random(len(leaf)) * n * np.array(upper.share)[leaf] < LOWER
                yield pa.record_batch([pa.array(leaf), batch.column(0)], names=["leaf", "vector"]).filter(pa.array(keep))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf = int(pdf["leaf"].iloc[0])
        own = lift(np.stack(pdf["vector"].to_numpy()).astype(np.float64), longest)
        sub = Tree(own, len(own) / max(top.value.share[leaf] * want, 1.0))
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps(sub)]})

    kind = dict(rows.dtypes)["vector"]
    lower = rows.select("vector").mapInArrow(tidy(pick), f"leaf long, vector {kind}").groupBy("leaf").applyInPandas(grow, "leaf long, tree binary")
    # At most TREE bytes of means in all, and as much again for the few nodes above the leaves.
    tree.graft({r["leaf"]: pickle.loads(r["tree"]) for r in lower.collect()})
    return tree


class Pruning:
    """Sample rows by the leaf that they lie in, one for each id."""

    def __init__(self, leaf: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        once = np.unique(ids, return_index=True)[1]
        order = once[np.argsort(leaf[once], kind="stable")]
        self.leaf, self.ids, self.vectors = leaf[order], ids[order], vectors[order]

    def bound(self, query: np.ndarray, own: int, leaves: list[int], k: int) -> float:
        """A score that the query's ``k``-th best row of these leaves reaches at least; minus infinity where that is not known."""
        lo, hi = np.searchsorted(self.leaf, leaves), np.searchsorted(self.leaf, leaves, side="right")
        if (hi - lo).sum() < k:
            return -np.inf
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
        at = at[self.ids[at] != own]
        return float(np.partition(self.vectors[at] @ query, -k)[-k]) if len(at) >= k else -np.inf


def _nearest_leaves(filed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[int]]:
    """Leaves of each query's ``k`` nearest rows of the whole table, by brute force in tasks."""
    known = filed.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = known.value
        score, leaf = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                some = batch.slice(lo, 4096)
                near = q @ _matrix(some.column(1)).T
                near[own[:, None] == some.column(0).to_numpy()[None]] = -np.inf
                score = np.concatenate([score, near], 1)
                leaf = np.concatenate([leaf, np.tile(some.column(2).to_numpy(), (len(q), 1))], 1)
                best = np.argsort(-score, 1, kind="stable")[:, :k]
                score, leaf = np.take_along_axis(score, best, 1), np.take_along_axis(leaf, best, 1)
        good = np.isfinite(score)
        yield pa.record_batch([pa.array(np.nonzero(good)[0]), pa.array(score[good]), pa.array(leaf[good])], names=["q", "score", "leaf"])

    found = filed.mapInArrow(tidy(run), "q long, score double, leaf long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    out: list[list[int]] = [[] for _ in queries]
    for row in found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "leaf").collect():
        out[row["q"]].append(row["leaf"])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _best(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best ``k`` rows of this block for each of its queries."""
        queries, rows = pdf[pdf["bound"].notna()], pdf[pdf["bound"].isna()]
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        q, x = (np.stack(part["vector"].to_numpy()).astype(np.float64) for part in (queries, rows))
        bounds = queries["bound"].to_numpy()
        ids = rows["vec_id"].to_numpy()
        out: list[tuple] = []
        for lo in range(0, len(q), 256):
            near = q[lo : lo + 256] @ x.T
            for i, own in zip(queries["vec_id"].to_numpy()[lo : lo + 256].tolist(), range(len(near))):
                score = near[own]
                score[ids == i] = -np.inf
                cut = max(np.partition(score, -k)[-k] if len(score) > k else -np.inf, bounds[lo + own])
                some = np.flatnonzero((score >= cut - 1e-9 * (1 + abs(cut) if np.isfinite(cut) else 1)) & (ids != i))
                exact = (x[some] * q[lo + own]).sum(1)  # one order of summation for all, so equal vectors tie
                order = np.lexsort((ids[some], -exact))[:k]
                out.append((np.full(len(order), i), ids[some][order], exact[order]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` nearest rows of ``vectors`` found."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors)
    # Most rows' length and the longest vector: one pass, one row for each length.
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norms = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("square")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not norms:
        return spark.createDataFrame([], schema)
    size, n, longest = norms[0]["size"], norms[0]["n"], float(norms[0]["square"]) ** 0.5
    rows = rows.filter(F.size("vector") == size)
    asks = usable(queries).filter(F.size("vector") == size)
    most = min(SAMPLE, max(QUERIES, TREE // (8 * size)))
    ids, some = sample(rows, most)
    tree = fit(rows, lift(some, longest), n, longest)
    known = spark.sparkContext.broadcast((tree, longest, Pruning(tree.file(lift(some, longest)), ids, some)))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, longest, _ = known.value
        for batch in batches:
            if len(batch):
                leaf = tree.file(lift(_matrix(batch.column(1)), longest))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "vector", "leaf"])

    kind = dict(rows.dtypes)["vector"]
    filed = saved(rows.mapInArrow(tidy(file), f"vec_id long, vector {kind}, leaf long"), "filed")
    own, q = sample(asks, QUERIES)
    if len(own):
        tree.calibrate(_asked(q, longest), _nearest_leaves(filed, own, q, k))
    # Rows of each leaf, and those that any query can list at least: its ids but for one, which may be the query's own.
    leaves = filed.groupBy("leaf").agg((F.countDistinct("vec_id") - 1).alias("ids"), F.count("*").alias("rows")).collect()
    held = np.zeros(tree.leaves, np.int64)
    for row in leaves:
        held[row["leaf"]] = row["ids"]
    visits = tree.visits
    held_by = spark.sparkContext.broadcast(held)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, longest, pruning = known.value
        tree.visits = visits
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                x = _matrix(part.column(1))
                found = [tree.visit(q, held_by.value, k) for q in _asked(x, longest)]
                bound = [pruning.bound(q, i, own, k) for q, i, own in zip(x, part.column(0).to_pylist(), found)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(bound, pa.float64()), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "vector", "bound", "leaves"])

    walked = saved(asks.mapInArrow(tidy(walk), f"vec_id long, vector {kind}, bound double, leaves array<long>"), "walked")
    asked = walked.select("vec_id", "vector", "bound", F.explode("leaves").alias("leaf"))
    # One row for each leaf of a tree of bounded size.
    blocks = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = F.broadcast(blocks(filed, "rblocks").join(blocks(walked.select(F.explode("leaves").alias("leaf")), "qblocks"), "leaf"))
    slot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(counts, "leaf").select("leaf", "vec_id", "vector", F.lit(None).cast("double").alias("bound"), slot("rblocks").alias("rb"), each("qblocks").alias("qb"))
    right = asked.join(counts, "leaf").select("leaf", "vec_id", "vector", "bound", each("rblocks").alias("rb"), slot("qblocks").alias("qb"))
    found = left.unionByName(right).groupBy("leaf", "rb", "qb").applyInPandas(_best(k), "query_id long, vec_id long, score double")
    # Equal ids with equal scores share a rank and count once.
    rank = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")

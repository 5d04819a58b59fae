"""Few variants, many samples: solvers work on coordinates of the span of their columns, whose rows stay in Spark.

Products with a kernel of m variants never leave the span of these variants'
standardised columns and the right-hand sides.  One pass over the samples takes
the triangular factor R of all those columns side by side (every task reduces
its rows, partial factors are stacked and reduced again).  Its columns have the
same inner products as the columns themselves, so solvers run on k-row arrays,
k being the number of columns, and give what they would give on n rows.  Random
signs are made from a hash of the sample where its row is read.  What solvers
find goes back to rows in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import limit_threads
from .kernels import Kernel

#: Variants up to which samples beyond the dense tier are handled by a span.
VARIANTS = 1024
#: Samples beyond which rows stay a table.
BEYOND = 4096
#: Rows that are reduced at once, and partial factors that reach the driver.
ROWS, PARTS = 4096, 8


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signs(samples: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Signs keyed by (seed, column, sample), wherever a sample's row lies."""
    with np.errstate(over="ignore"):
        own = _mixed(samples.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        keys = _mixed(np.arange(columns, dtype=np.uint64) + np.uint64(1) + np.uint64(seed % (1 << 31)) * np.uint64(1 << 32))
        return (_mixed(own[:, None] ^ keys[None]) >> np.uint64(63)).astype(float) * 2 - 1


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The k x k factor of at least as many columns; short stacks are filled up with zeros."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


class Span:
    """The columns of ``vectors(sample_idx, v)`` (arrays of ``width`` numbers), random signs, and all valid variants."""

    def __init__(self, geno: DataFrame, stats: DataFrame, vectors: DataFrame, width: int, n: int, random: tuple[tuple[int, int], ...] = ()):
        own = stats.filter("inv_sd > 0").select("variant_idx", "mean", "inv_sd").orderBy("variant_idx").limit(VARIANTS + 1).toPandas()
        if len(own) > VARIANTS:
            raise ValueError("too many variants for a span")
        self.spark, self.n, self.width, self.random = geno.sparkSession, n, width, random
        self.ids, self.mean, self.inv_sd = (own[c].to_numpy() for c in ("variant_idx", "mean", "inv_sd"))
        cells = geno.groupBy("sample_idx").agg(F.collect_list("variant_idx").alias("at"), F.collect_list(F.coalesce(F.col("dosage").cast("double"), F.lit(-1.0))).alias("dose"))
        self.rows = vectors.select("sample_idx", F.col("v").cast("array<double>").alias("v")).join(cells, "sample_idx", "left").persist()
        dense, k = self._dense(), width + sum(c for _, c in random) + len(self.ids)

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limit_threads(1)  # tasks share the cores already
            r = np.zeros((0, k))
            for batch in batches:
                for lo in range(0, len(batch), ROWS):
                    r = _triangle(np.concatenate([r, dense(batch.slice(lo, ROWS))]), k)
            yield pa.record_batch([pa.array([r.tobytes()] if len(r) else [], pa.binary())], names=["r"])

        def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limit_threads(1)  # tasks share the cores already
            r = np.zeros((0, k))
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    r = _triangle(np.concatenate([r, np.frombuffer(part).reshape(k, k)]), k)
            yield pa.record_batch([pa.array([r.tobytes()] if len(r) else [], pa.binary())], names=["r"])

        parts = self.rows.mapInArrow(reduce, "r binary").repartition(PARTS).mapInArrow(stack, "r binary").toArrow()["r"].to_pylist()
        self.r = _triangle(np.concatenate([np.zeros((0, k)), *(np.frombuffer(x).reshape(k, k) for x in parts)]), k)
        if not np.isfinite(self.r).all():
            raise ValueError("the response and the design must be finite")
        self.vectors, self.z = self.r[:, :width], self.r[:, k - len(self.ids) :]
        ends = np.cumsum([width, *(c for _, c in random)])
        self.signs = [self.r[:, a:b] for a, b in zip(ends, ends[1:])]

    def _dense(self):
        ids, mean, inv_sd, width, random = self.ids, self.mean, self.inv_sd, self.width, self.random

        def rows(batch: pa.RecordBatch) -> np.ndarray:
            """A batch's rows with all columns of the span."""
            sample = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            z = np.tile(-mean * inv_sd, (len(batch), 1))  # absent cells
            who = np.repeat(np.arange(len(batch)), np.nan_to_num(batch.column(2).value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            at, dose = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            place = np.minimum(np.searchsorted(ids, at), max(len(ids) - 1, 0))
            known = ids[place] == at if len(ids) else np.zeros(len(at), bool)
            who, place, dose = who[known], place[known], dose[known]
            z[who, place] = np.where(dose < 0, 0.0, (dose - mean[place]) * inv_sd[place])
            return np.concatenate([v, *(signs(sample, c, seed) for seed, c in random), z], 1)

        return rows

    def table(self, u: np.ndarray) -> DataFrame:
        """``sample_idx``, ``v``: the rows (arrays) of columns given by their coordinates."""
        scale = np.maximum(np.linalg.norm(self.r, axis=0), 1e-300)
        a = np.linalg.lstsq(self.r / scale, u, rcond=1e-13)[0] / scale[:, None]
        dense, c = self._dense(), u.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limit_threads(1)
            for batch in batches:
                for lo in range(0, len(batch), ROWS):
                    some = batch.slice(lo, ROWS)
                    out = dense(some) @ a
                    yield pa.record_batch([some.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * c), pa.array(out.ravel()))], names=["sample_idx", "v"])

        return self.rows.mapInArrow(run, "sample_idx long, v array<double>")

    def long(self, u: np.ndarray) -> DataFrame:
        """``sample_idx``, ``col``, ``v``: the same with a row for each number."""
        return self.table(u).select("sample_idx", F.posexplode("v").alias("col", "v"))

    def close(self) -> None:
        self.rows.unpersist()


class SpanKernel(Kernel):
    """Components over a span, ``Z diag(w_g) Z' / c_g``, from weights (components x variants) and divisors."""

    def __init__(self, span: Span, weights: np.ndarray, divisors: np.ndarray, means: np.ndarray, groups: list[list[int]] | None = None):
        self.span, self.weights, self.divisors, self.means, self.groups = span, weights, divisors, means, groups
        self.n, self.size = len(span.r), len(weights)

    @classmethod
    def build(cls, span: Span, stats: DataFrame, cmap: DataFrame) -> SpanKernel:
        """From ``cmap(component_idx, local_idx, variant_idx)``."""
        from ..operators.geno import component_stats

        known = {r["component_idx"]: r for r in component_stats(stats, cmap, span.n).collect()}
        size = max(known) + 1
        weights, place = np.zeros((size, len(span.ids))), {int(v): k for k, v in enumerate(span.ids)}
        for r in cmap.collect():
            if r["variant_idx"] in place:
                weights[r["component_idx"], place[r["variant_idx"]]] = 1.0
        out = cls(span, weights, np.array([float(known[g]["m_eff"]) if g in known else 0.0 for g in range(size)]), np.array([known[g]["mean_diag"] if g in known else 0.0 for g in range(size)]))
        out.cmap = cmap
        return out

    @classmethod
    def soft(cls, span: Span, stats: DataFrame, table: DataFrame, groups: int) -> SpanKernel:
        """From ``table(variant_idx, group_idx, w)``."""
        weights, total, filled = np.zeros((groups, len(span.ids))), np.zeros(groups), np.zeros(groups)
        place = {int(v): k for k, v in enumerate(span.ids)}
        for r in table.join(stats.select("variant_idx", "cnt"), "variant_idx").collect():
            total[r["group_idx"]] += r["w"]
            if r["variant_idx"] in place:
                weights[r["group_idx"], place[r["variant_idx"]]] += r["w"]
                filled[r["group_idx"]] += r["w"] * r["cnt"]
        if (total <= 0).any():
            raise ValueError("a group has no weight")
        return cls(span, weights, total, filled / span.n / total)

    def stacked(self, v: np.ndarray) -> np.ndarray:
        s = self.span.z.T @ v
        return np.stack([self.span.z @ (w[:, None] * s) / max(c, 1e-300) for w, c in zip(self.weights, self.divisors)])

    def mean_diag(self) -> np.ndarray:
        return self.means

    def scores(self, v: np.ndarray) -> DataFrame:
        """``component_idx``, ``variant_idx``, ``col``, ``score``: a row for each of the span's variants and columns."""
        s = self.span.z.T @ v
        rows = [(0, int(self.span.ids[i]), c, float(s[i, c])) for i in range(s.shape[0]) for c in range(s.shape[1])]
        return self.span.spark.createDataFrame(rows, "component_idx int, variant_idx long, col int, score double")

    def effects(self, alpha: np.ndarray, theta: np.ndarray) -> DataFrame:
        """``component_idx``, ``local_idx``, ``variant_idx``, ``beta``."""
        s, place = self.span.z.T @ alpha, {int(v): k for k, v in enumerate(self.span.ids)}
        rows = [(r["component_idx"], r["local_idx"], r["variant_idx"], float(theta[r["component_idx"]] / self.divisors[r["component_idx"]] * s[place[r["variant_idx"]]]) if r["variant_idx"] in place else 0.0) for r in self.cmap.collect()]
        return self.span.spark.createDataFrame(rows, "component_idx int, local_idx long, variant_idx long, beta double")

    def close(self) -> None:
        self.span.close()

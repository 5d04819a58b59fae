"""Covariance kernels as operators: they give products with a few vectors and never a sample-by-sample matrix.

``SparkKernel`` keeps packed genotype blocks as rows of a table and
computes a product in one job: the vectors are broadcast (samples x right-hand
sides), each task adds up its blocks, and partial sums meet by slices of
samples before the driver gets one n x c array for each component.  Blocks come
straight from the bytes of a BED file (``SparkKernel.of_bed``) or from a table of cells.
``DenseKernel`` is exact and for small sample counts.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 4096  # samples in one partial sum, a multiple of four
HELD = 1 << 20  # numbers that a task adds up before it passes them on, or that are broadcast
TILE = 256  # variants of a block that are unpacked at once
#: Rows of a component map that are broadcast to split blocks, at most (about 20 bytes each).
MAP_ROWS = 1 << 21
#: Columns of one product with the base kernel of ancestry components.
COLUMN_BUDGET = 256


class Kernel(ABC):
    """What a solver asks of covariance components; users may supply their own."""

    n: int
    size: int  # number of components

    @abstractmethod
    def stacked(self, v: np.ndarray) -> np.ndarray:
        """``K_g v`` of every component: size x n x columns."""

    @abstractmethod
    def mean_diag(self) -> np.ndarray:
        """Trace over n of every component."""

    def weighted(self, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.einsum("g,gnc->nc", theta, self.stacked(v))

    def core(self, u: np.ndarray) -> np.ndarray:
        """``U' K_g U`` of every component."""
        return np.einsum("nk,gnl->gkl", u, self.stacked(u))


class DenseKernel(Kernel):
    def __init__(self, matrices: list[np.ndarray]):
        self.k = np.stack(matrices)
        self.size, self.n = self.k.shape[:2]

    @classmethod
    def of(cls, kernel: Kernel) -> DenseKernel:
        """All components of a kernel as matrices: one product with the identity."""
        return cls(list(kernel.stacked(np.eye(kernel.n))))

    def stacked(self, v: np.ndarray) -> np.ndarray:
        return self.k @ v

    def mean_diag(self) -> np.ndarray:
        return np.einsum("gii->g", self.k) / self.n


class AdmixedKernel(Kernel):
    """``D_a^(1/2) K D_a^(1/2)`` for every ancestry: products over columns scaled by each ancestry's share.

    There are ancestries times right-hand sides of such columns; they are dealt
    into products of at most ``budget``, so what is broadcast and what tasks
    add up stays bounded however many there are.
    """

    def __init__(self, base: Kernel, q: np.ndarray, budget: int = COLUMN_BUDGET):
        if base.size != 1:
            raise ValueError("ancestry components need one base kernel")
        if budget < 1:
            raise ValueError("a product needs at least one column")
        self.base, self.root, self.budget = base, np.sqrt(q), budget
        self.n, self.size = q.shape

    def stacked(self, v: np.ndarray) -> np.ndarray:
        out = np.empty((self.size, self.n, v.shape[1]))
        pairs = [(a, c) for a in range(self.size) for c in range(v.shape[1])]
        for k in range(0, len(pairs), self.budget):
            a, c = np.array(pairs[k : k + self.budget]).T
            own = self.base.stacked(self.root[:, a] * v[:, c])[0]
            out[a, :, c] = (own * self.root[:, a]).T
        return out

    def mean_diag(self) -> np.ndarray:
        return self.base.mean_diag()[0] * (self.root**2).mean(0)

    def effects(self, alpha: np.ndarray, theta: np.ndarray) -> DataFrame:
        """Effects of every variant in each ancestry: a sample's effect adds them up by the roots of its shares."""
        parts = []
        for k in range(0, self.size, self.budget):
            own = self.base.scores(self.root[:, k : k + self.budget] * alpha[:, None])
            parts.append(own.select((F.col("col") + k).alias("component_idx"), "variant_idx", "score"))
        scores = parts[0]
        for more in parts[1:]:
            scores = scores.unionByName(more)
        return _scaled(scores, self.base.cmap().drop("component_idx"), ["variant_idx"], theta[: self.size] / np.maximum(self.base.m_eff[0], 1))


def admixed_rows(base: SparkKernel, q: DataFrame, v: DataFrame, width: int, budget: int = COLUMN_BUDGET) -> DataFrame:
    """``component_idx``, ``sample_idx``, ``col``, ``value``: products of ``AdmixedKernel`` from rows of shares ``q(sample_idx, ancestry, q)`` and of ``v(sample_idx, v)``.

    A row for each share above 0; nothing of n rows leaves Spark.
    """
    top = q.agg(F.max("ancestry")).first()[0]
    size = 0 if top is None else int(top) + 1
    own = q.groupBy("sample_idx").agg(F.array(*(F.sqrt(F.coalesce(F.sum(F.when(F.col("ancestry") == a, F.col("q"))), F.lit(0.0))) for a in range(size))).alias("root"))
    given = v.join(own, "sample_idx").persist()
    pairs, out = [(a, c) for a in range(size) for c in range(width)], None
    for k in range(0, len(pairs), budget):
        some = pairs[k : k + budget]
        got = base.rows(given.select("sample_idx", F.array(*(F.col("root")[a] * F.col("v")[c] for a, c in some)).alias("v")), len(some))
        each = F.array(*(F.struct(F.lit(a).alias("component_idx"), F.lit(c).alias("col"), F.col("root")[a].alias("root"), F.col("v")[i].alias("v")) for i, (a, c) in enumerate(some)))
        part = got.select("sample_idx", "v").join(given.select("sample_idx", "root"), "sample_idx").select("sample_idx", F.inline(each)).filter("root > 0")
        part = part.select("component_idx", "sample_idx", "col", (F.col("root") * F.col("v")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def _scaled(scores: DataFrame, cmap: DataFrame, on: list[str], scale: np.ndarray) -> DataFrame:
    """``component_idx``, ``local_idx``, ``variant_idx``, ``beta`` from scores and a factor for each component."""
    factors = scores.sparkSession.createDataFrame([(g, float(x)) for g, x in enumerate(scale)], "component_idx int, factor double")
    rows = scores.join(cmap, on).join(F.broadcast(factors), "component_idx")  # a row for each component
    return rows.select("component_idx", "local_idx", "variant_idx", (F.col("factor") * F.col("score")).alias("beta"))


class HybridKernel(Kernel):
    """Components of several kernels one after another, such as common and rare variants."""

    def __init__(self, *parts: Kernel):
        self.parts, self.n, self.size = parts, parts[0].n, sum(p.size for p in parts)
        if any(p.n != self.n for p in parts):
            raise ValueError("kernels differ in their samples")

    def stacked(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([p.stacked(v) for p in self.parts])

    def mean_diag(self) -> np.ndarray:
        return np.concatenate([p.mean_diag() for p in self.parts])


def pack(codes: np.ndarray) -> bytes:
    """Dosages 0, 1, 2 and 3 for missing, variant by variant, four to a byte with low bits first."""
    padded = np.zeros((codes.shape[0], -(-codes.shape[1] // 4) * 4), np.uint8)
    padded[:, : codes.shape[1]] = codes
    four = padded.reshape(codes.shape[0], -1, 4)
    return (four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).tobytes()


def unpack(raw: bytes, width: int, n: int) -> np.ndarray:
    """Inverse of ``pack``: width x n codes."""
    octets = np.frombuffer(raw, np.uint8).reshape(width, -1)
    return np.stack([octets >> (2 * k) & 3 for k in range(4)], 2).reshape(width, -1)[:, :n]


def blocks(geno: DataFrame, stats: DataFrame, cmap: DataFrame, n: int, width: int = 256) -> DataFrame:
    """Packed blocks of up to ``width`` variants; a block never crosses a component.

    ``component_idx``, ``block_id``, ``variants``, ``mean``, ``inv_sd``, ``packed``.
    """
    return packed_blocks(geno, stats, cmap.withColumn("block_id", F.floor(F.col("local_idx") / width).cast("int")), n)


def packed_blocks(geno: DataFrame, stats: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """As ``blocks``, from ``rows(component_idx, block_id, local_idx, variant_idx)``, which say what lies together.

    Cells of a block meet by slices of samples; only packed slices are put together.
    """
    step, key = SLICE, ["component_idx", "block_id"]
    rows = rows.join(stats.select("variant_idx", "mean", "inv_sd"), "variant_idx")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("local_idx")) - 1
    rows = rows.select(*(F.col(k).cast("int").alias(k) for k in key), "variant_idx", "mean", "inv_sd", place.alias("at"), F.count("*").over(Window.partitionBy(*key)).alias("width"))
    heads = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "variant_idx", "mean", "inv_sd"))).alias("own"))
    code = F.coalesce(F.col("dosage").cast("long"), F.lit(3))
    cell = (F.col("at") * step + F.col("sample_idx") % step) * 4 + code  # its place in the slice, and its code
    cells = geno.join(rows.select(*key, "variant_idx", "at", "width"), "variant_idx").groupBy(*key, F.floor(F.col("sample_idx") / step).cast("int").alias("slice")).agg(F.max("width").alias("width"), F.collect_list(cell).alias("cells"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column("cells")[k].values.to_numpy()
                codes = np.zeros(batch.column("width")[k].as_py() * step, np.uint8)
                codes[own >> 2] = own & 3
                yield pa.record_batch([*(batch.column(c).slice(k, 1) for c in ("component_idx", "block_id", "slice")), pa.array([pack(codes.reshape(-1, step))], pa.binary())], names=["component_idx", "block_id", "slice", "packed"])

    parts = cells.mapInArrow(build, "component_idx int, block_id int, slice int, packed binary").groupBy(*key).agg(F.collect_list(F.struct("slice", "packed")).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                count, parts = len(batch.column("variants")[k]), batch.column("parts")[k].values
                out = np.zeros((count, -(-n // 4)), np.uint8)
                for i in range(0 if parts is None else len(parts)):
                    lo = parts.field("slice")[i].as_py() * step // 4
                    own = np.frombuffer(parts.field("packed")[i].as_buffer(), np.uint8).reshape(count, -1)
                    out[:, lo : lo + step // 4] = own[:, : out.shape[1] - lo]
                yield pa.record_batch([*(batch.column(c).slice(k, 1) for c in batch.schema.names[:5]), pa.array([out.tobytes()], pa.binary())], names=[*batch.schema.names[:5], "packed"])

    schema = "component_idx int, block_id int, variants array<long>, mean array<double>, inv_sd array<double>, packed binary"
    lists = [F.col("own")[c].alias(name) for c, name in (("variant_idx", "variants"), ("mean", "mean"), ("inv_sd", "inv_sd"))]
    return heads.join(parts, key, "left").select(*key, *lists, "parts").mapInArrow(whole, schema)


def standardised(raw: bytes, mean: np.ndarray, inv_sd: np.ndarray, n: int) -> np.ndarray:
    """Standardised block, variants x samples; missing cells are 0."""
    codes = unpack(raw, len(mean), n)
    z = (codes - mean[:, None]) * inv_sd[:, None]
    z[codes == 3] = 0.0
    return z


def tiles(row: dict, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """A block's variants in standardised parts (from, to, values): a wide block is never unpacked whole."""
    mean, inv_sd = np.array(row["mean"]), np.array(row["inv_sd"])
    stride = len(row["packed"]) // max(len(mean), 1)
    for lo in range(0, len(mean), TILE):
        hi = min(lo + TILE, len(mean))
        yield lo, hi, standardised(row["packed"][lo * stride : hi * stride], mean[lo:hi], inv_sd[lo:hi], n)


def component_blocks(raw: DataFrame, cmap: DataFrame | None, width: int) -> DataFrame:
    """Blocks of ``bed.read_blocks`` (of ``width``) with a component; a block that several components share is split.

    Variants are picked from a block's bytes where it lies.  Only the map is
    grouped by block; beyond ``MAP_ROWS`` the packed blocks are shuffled once to
    meet it.
    """
    names = ["variants", "cnt", "mean", "inv_sd"]
    if cmap is None:
        return raw.select(F.lit(0).alias("component_idx"), F.col("block_id").cast("int").alias("block_id"), *names, "packed")
    own = cmap.groupBy(F.floor(F.col("variant_idx") / width).cast("long").alias("block_id")).agg(F.sort_array(F.collect_list(F.struct("component_idx", "variant_idx"))).alias("own"))
    if cmap.limit(MAP_ROWS + 1).count() <= MAP_ROWS:
        own = F.broadcast(own)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                octets = np.frombuffer(row["packed"], np.uint8).reshape(len(row["variants"]), -1)
                component = np.array([x["component_idx"] for x in row["own"]], np.int32)
                at = np.array([x["variant_idx"] for x in row["own"]], np.int64) - row["variants"][0]
                if len(at) and at.max() >= len(octets):
                    raise ValueError(f"component {component[at.argmax()]} names a variant that the file does not hold")
                for g in np.unique(component):
                    pick = at[component == g]
                    lists = [pa.array([np.array(row[c])[pick]]) for c in names]
                    yield pa.record_batch([pa.array([g], pa.int32()), pa.array([row["block_id"]], pa.int32()), *lists, pa.array([octets[pick].tobytes()], pa.binary())], names=["component_idx", "block_id", *names, "packed"])

    return raw.select("block_id", *names, "packed").join(own, "block_id").mapInArrow(split, "component_idx int, block_id int, variants array<long>, cnt array<long>, mean array<double>, inv_sd array<double>, packed binary")


def _moved(column: str, by: int) -> Column:
    return F.transform(column, lambda x: x + by).alias(column)


class SparkKernel(Kernel):
    """Kernel over a table of packed blocks."""

    extra: tuple[str, ...] = ()  # further columns of the table that a product reads
    least: float = 1.0  # smallest divisor
    cut: DataFrame | None = None  # the table by slices of samples, once rows were asked for

    def __init__(self, table: DataFrame, n: int, size: int, m_eff: np.ndarray, mean_diag: np.ndarray):
        self.table, self.n, self.size, self.m_eff, self.means = table.persist(), n, size, m_eff, mean_diag

    @classmethod
    def build(cls, geno: DataFrame, stats: DataFrame, cmap: DataFrame, n: int, width: int = 256) -> SparkKernel:
        from ..operators.geno import component_stats

        rows = {r["component_idx"]: r for r in component_stats(stats, cmap, n).collect()}
        size = max(rows) + 1
        return cls(blocks(geno, stats, cmap, n, width), n, size, np.array([rows[g]["m_eff"] if g in rows else 0 for g in range(size)], float), np.array([rows[g]["mean_diag"] if g in rows else 0.0 for g in range(size)]))

    @classmethod
    def of_blocks(cls, raw: DataFrame, n: int, cmap: DataFrame | None = None, width: int = 256) -> SparkKernel:
        """From ``bed.read_blocks(..., width=width)``: neither cells nor their statistics become rows."""
        table = component_blocks(raw, cmap, width).persist()
        filled = F.aggregate(F.zip_with("cnt", "inv_sd", lambda c, x: F.when(x > 0, c).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
        sums = table.select("component_idx", F.size(F.filter("inv_sd", lambda x: x > 0)).alias("m_eff"), filled.alias("filled"))
        rows = {r["component_idx"]: r for r in sums.groupBy("component_idx").agg(F.sum("m_eff").alias("m_eff"), F.sum("filled").alias("filled")).collect()}
        size = max(rows, default=-1) + 1
        m_eff = np.array([rows[g]["m_eff"] if g in rows else 0 for g in range(size)], float)
        return cls(table, n, size, m_eff, np.array([rows[g]["filled"] if g in rows else 0 for g in range(size)]) / n / np.maximum(m_eff, 1))

    @classmethod
    def of_bed(cls, spark, path: str, n: int, cmap: DataFrame | None = None, keep: np.ndarray | None = None, width: int = 256) -> SparkKernel:
        """From a BED file of ``n`` samples, of which ``keep`` flags those that stay."""
        from ..sources.bed import read_blocks

        return cls.of_blocks(read_blocks(spark, path, n, keep, width), n if keep is None else int(keep.sum()), cmap, width)

    @classmethod
    def joined(cls, parts: list[SparkKernel], widths: list[int]) -> SparkKernel:
        """Several sources of the same samples as one table, so that a product is one job whatever their number.

        Components follow one another, and so do variants: a source's numbers
        begin where the one before, of so many variants, ends.
        """
        if len(parts) != len(widths) or any(p.n != parts[0].n for p in parts) or any(p.extra for p in parts):
            raise ValueError("sources need the same samples, plain kernels and their numbers of variants")
        table, size, first = None, 0, 0
        for part, width in zip(parts, widths):
            own = part.table.select((F.col("component_idx") + size).alias("component_idx"), "block_id", _moved("variants", first), "mean", "inv_sd", "packed")
            table = own if table is None else table.unionByName(own)
            size, first = size + part.size, first + width
        return cls(table, parts[0].n, size, np.concatenate([p.m_eff for p in parts]), np.concatenate([p.means for p in parts]))

    def mean_diag(self) -> np.ndarray:
        return self.means

    def cmap(self) -> DataFrame:
        """The variants of each component, numbered inside it."""
        from ..operators.geno import component_map

        return component_map(self.table.select("component_idx", F.explode("variants").alias("variant_idx")))

    @staticmethod
    def weigh(row: dict, s: np.ndarray) -> np.ndarray:
        """What stands between Z' and Z in a product."""
        return s

    def _sum(self, v: np.ndarray, columns: int) -> np.ndarray:
        """Adds ``Z weigh(Z' v)`` (n x columns) over all blocks of each component."""
        n, size, weigh = self.n, self.size, type(self).weigh
        shared = self.table.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    parts = list(tiles(row, n)) if len(row["mean"]) <= TILE else None
                    t = weigh(row, np.concatenate([z @ shared.value for _, _, z in parts or tiles(row, n)]))
                    own = total.setdefault(row["component_idx"], np.zeros((n, t.shape[1])))
                    for lo, hi, z in parts or tiles(row, n):
                        own += z.T @ t[lo:hi]
            rows = [(g, lo, t[lo : lo + SLICE].tobytes()) for g, t in total.items() for lo in range(0, n, SLICE)]
            yield _rows(rows)

        schema = "g int, lo int, part binary"
        parts = self.table.select("component_idx", "mean", "inv_sd", "packed", *self.extra).mapInArrow(partial, schema).repartition("g", "lo").mapInArrow(_meet, schema)
        out = np.zeros((size, n, columns))
        for row in parts.toArrow().to_pylist():
            part = np.frombuffer(row["part"], float).reshape(-1, columns)
            out[row["g"], row["lo"] : row["lo"] + len(part)] = part
        shared.unpersist()
        return out

    def stacked(self, v: np.ndarray) -> np.ndarray:
        return self._sum(v, v.shape[1]) / np.maximum(self.m_eff, 1)[:, None, None]

    def _pieces(self) -> DataFrame:
        """The table by slices of samples, dealt by them: ``component_idx``, ``block_id``, ``slice``, ``mean``, ``inv_sd``, ``packed``."""
        if self.cut is None:
            step, names = SLICE, ["component_idx", "block_id", "mean", "inv_sd"]

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k in range(len(batch)):
                        octets = np.frombuffer(batch.column("packed")[k].as_buffer(), np.uint8).reshape(len(batch.column("mean")[k]), -1)
                        for lo in range(0, octets.shape[1], step // 4):
                            own = np.zeros((len(octets), step // 4), np.uint8)
                            some = octets[:, lo : lo + step // 4]
                            own[:, : some.shape[1]] = some
                            yield pa.record_batch([*(batch.column(c).slice(k, 1) for c in names), pa.array([lo * 4 // step], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=[*names, "slice", "packed"])

            rows = self.table.select(*names, "packed").mapInArrow(cut, "component_idx int, block_id int, mean array<double>, inv_sd array<double>, slice int, packed binary")
            self.cut = rows.repartition("slice").persist()
        return self.cut

    def _inner(self, v: DataFrame, width: int, names: list[str]) -> DataFrame:
        """``Z' V`` of every block from rows ``v(sample_idx, v)``, beside the block's columns ``names``: ``part`` holds variants x width numbers."""
        step = SLICE
        slices = v.groupBy(F.floor(F.col("sample_idx") / step).cast("int").alias("slice")).agg(F.collect_list((F.col("sample_idx") % step).cast("int")).alias("at"), F.flatten(F.collect_list("v")).alias("v"))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k in range(len(batch)):
                    mean, inv_sd, at, own = (batch.column(c)[k].values.to_numpy() for c in ("mean", "inv_sd", "at", "v"))
                    dense = np.zeros((step, width))
                    dense[at] = own.reshape(-1, width)
                    s = standardised(batch.column("packed")[k].as_py(), mean, inv_sd, step) @ dense
                    key = (batch.column("component_idx")[k].as_py(), batch.column("block_id")[k].as_py())
                    total[key] = total[key] + s if key in total else s
                if sum(x.size for x in total.values()) > HELD:
                    yield _rows([(*key, x.tobytes()) for key, x in total.items()])
                    total = {}
            yield _rows([(*key, x.tobytes()) for key, x in total.items()])

        schema = "g int, lo int, part binary"
        sums = self._pieces().join(slices, "slice").mapInArrow(partial, schema).repartition("g", "lo").mapInArrow(_meet, schema)
        return self.table.select("component_idx", "block_id", *names).join(sums.withColumnsRenamed({"g": "component_idx", "lo": "block_id"}), ["component_idx", "block_id"])

    def rows(self, v: DataFrame, width: int) -> DataFrame:
        """``component_idx``, ``sample_idx``, ``v``: what ``stacked`` gives, of rows ``v(sample_idx, v)`` with arrays of ``width`` numbers.

        Nothing of n rows leaves Spark: scores of blocks meet over slices of
        samples, then each slice takes them.  A component without variants has no rows.
        """
        step, n, weigh, parted, divisors = SLICE, self.n, type(self).weigh, type(self).parted, np.maximum(self.m_eff, type(self).least)

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    t = weigh(row, np.frombuffer(row["part"], float).reshape(-1, width))
                    yield _rows([(row["component_idx"], row["block_id"], np.ascontiguousarray(t).tobytes())])

        schema = "g int, lo int, part binary"
        t = self._inner(v, width, ["mean", *self.extra]).mapInArrow(between, schema).withColumnsRenamed({"g": "component_idx", "lo": "block_id"})
        numbers = int(self.table.agg(F.sum(F.size("mean"))).first()[0] or 0) * width * max(self.size, 1)
        t = F.broadcast(t) if numbers <= HELD else t  # scores of all variants

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k in range(len(batch)):
                    mean, inv_sd = (batch.column(c)[k].values.to_numpy() for c in ("mean", "inv_sd"))
                    z = standardised(batch.column("packed")[k].as_py(), mean, inv_sd, step)
                    own = z.T @ np.frombuffer(batch.column("part")[k].as_py(), float).reshape(len(mean), -1)
                    key = (batch.column("component_idx")[k].as_py(), batch.column("slice")[k].as_py())
                    total[key] = total[key] + own if key in total else own
                    if len(total) * own.size > HELD:
                        yield _rows([(*key, x.tobytes()) for key, x in total.items()])
                        total = {}
            yield _rows([(*key, x.tobytes()) for key, x in total.items()])

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _meet(batches):
                for row in batch.to_pylist():
                    lo = row["lo"] * step
                    some = min(step, n - lo)
                    own = np.frombuffer(row["part"], float).reshape(step, -1)[:some]
                    for g, x in parted(row["g"], own, divisors):
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(some + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel()))
                        yield pa.record_batch([pa.array(np.full(some, g, np.int32)), pa.array(np.arange(lo, lo + some)), flat], names=["component_idx", "sample_idx", "v"])

        parts = self._pieces().join(t, ["component_idx", "block_id"]).select("component_idx", "slice", "mean", "inv_sd", "packed", "part").mapInArrow(spread, schema)
        return parts.repartition("g", "lo").mapInArrow(out, "component_idx int, sample_idx long, v array<double>")

    @staticmethod
    def parted(g: int, own: np.ndarray, divisors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Components that lie in a slice's sums, over their divisors."""
        yield g, own / divisors[g]

    def row_scores(self, v: DataFrame, width: int, weighed: bool = False) -> DataFrame:
        """``scores`` of rows ``v(sample_idx, v)``, which stay in Spark."""
        weigh = type(self).weigh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    s, variants = np.frombuffer(row["part"], float).reshape(-1, width), np.array(row["variants"], np.int64)
                    if weighed:
                        valid = np.array(row["inv_sd"]) > 0
                        s, variants = weigh(row, s)[valid], variants[valid]
                    yield _scored(row["component_idx"], variants, s)

        return self._inner(v, width, ["variants", "mean", "inv_sd", *self.extra]).mapInArrow(run, _SCORES)

    def scores(self, v: np.ndarray, weighed: bool = False) -> DataFrame:
        """``component_idx``, ``variant_idx``, ``col``, ``score``: Z'V, left distributed; ``weighed``, what a product makes of it before Z, for valid variants."""
        shared, n, weigh = self.table.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v)), self.n, type(self).weigh

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    s = np.concatenate([z @ shared.value for _, _, z in tiles(row, n)])
                    variants = np.array(row["variants"], np.int64)
                    if weighed:
                        valid = np.array(row["inv_sd"]) > 0
                        s, variants = weigh(row, s)[valid], variants[valid]
                    yield _scored(row["component_idx"], variants, s)

        return self.table.mapInArrow(run, _SCORES)

    def effects(self, alpha: np.ndarray | DataFrame, theta: np.ndarray) -> DataFrame:
        """``component_idx``, ``local_idx``, ``variant_idx``, ``beta``: theta over the divisor times the product's inner half, left distributed.

        ``alpha`` is an array of n numbers, or rows (``sample_idx``, ``v``) with arrays of one.
        """
        scores = self.row_scores(alpha, 1, True) if isinstance(alpha, DataFrame) else self.scores(alpha[:, None], True)
        return _scaled(scores.drop("col"), self.cmap(), ["component_idx", "variant_idx"], theta[: self.size] / np.maximum(self.m_eff, 1e-300))

    def close(self) -> None:
        self.table.unpersist()
        if self.cut is not None:
            self.cut.unpersist()


class WeightKernel(SparkKernel):
    """``sum_b Z_b W_b Z_b' / c`` of block-diagonal symmetric weights; every group of blocks is a component.

    A row of the table is a block of the weights, dense and row by row (``w``),
    with its genotypes, so a product costs the same job as without weights.  A
    task holds one block at a time; its genotypes are unpacked in tiles.
    """

    extra = ("w",)
    least = 1e-300

    @classmethod
    def build(cls, geno: DataFrame, stats: DataFrame, w: DataFrame, n: int, groups: DataFrame | None = None, ranks: list[float] | None = None) -> WeightKernel:
        """From entries ``w(block_idx, i, j, w)`` and ``groups(block_idx, component_idx)``, one group where none are given."""
        ids = w.select("block_idx", F.col("i").alias("variant_idx")).union(w.select("block_idx", F.col("j"))).distinct()
        place = F.row_number().over(Window.partitionBy("block_idx").orderBy("variant_idx")) - 1
        rows = ids.withColumn("local_idx", place.cast("int"))
        known = rows.withColumn("component_idx", F.lit(0)) if groups is None else rows.join(groups, "block_idx")
        packed = packed_blocks(geno, stats, known.withColumnRenamed("block_idx", "block_id"), n)
        at = rows.select("block_idx", "variant_idx", "local_idx")
        cells = w.join(at.withColumnsRenamed({"variant_idx": "i", "local_idx": "row"}), ["block_idx", "i"]).join(at.withColumnsRenamed({"variant_idx": "j", "local_idx": "at"}), ["block_idx", "j"])
        cells = cells.groupBy(F.col("block_idx").alias("block_id")).agg(F.collect_list(F.struct("row", "at", "w")).alias("w"))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = None
            for batch in batches:
                k = k if k is not None else batch.schema.get_field_index("w")
                dense = []
                for mean, entries in zip(batch.column("mean"), batch.column(k)):
                    own = np.zeros((len(mean), len(mean)))
                    flat = entries.values.flatten()
                    own[flat[0].to_numpy(), flat[1].to_numpy()] = flat[2].to_numpy()
                    dense.append(own.tobytes())
                yield batch.set_column(k, "w", pa.array(dense, pa.binary()))

        table = packed.join(cells, "block_id")
        return cls.over(table.mapInArrow(fill, _with_weights(table)), n, ranks)

    @classmethod
    def of_files(cls, raw: DataFrame, weights: DataFrame, n: int, width: int = 256, ranks: list[float] | None = None) -> WeightKernel:
        """From ``bed.read_blocks`` and ``specs.weight_blocks``; neither weights nor genotypes pass through the driver."""
        each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("width") - 1)).alias("variant_idx")
        parts = component_blocks(raw, weights.select(F.col("block_id").cast("int").alias("component_idx"), each), width)
        lists = parts.groupBy(F.col("component_idx").alias("block_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("variants")[0].alias("at"), "variants", "mean", "inv_sd", "packed"))).alias("parts"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = batch.slice(k, 1).select(["component_idx", "block_id", "parts", "width", "w"]).to_pylist()[0]
                    lists = [[x for p in row["parts"] for x in p[c]] for c in ("variants", "mean", "inv_sd")]
                    if len(lists[0]) != row["width"]:
                        raise ValueError(f"weights of block {row['block_id']} are {row['width']} wide, for {len(lists[0])} variants")
                    octets = b"".join(p["packed"] for p in row["parts"])
                    yield pa.record_batch(
                        [pa.array([row["component_idx"]], pa.int32()), pa.array([row["block_id"]], pa.int32()), pa.array([lists[0]], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.float64())) for x in lists[1:]), pa.array([octets], pa.binary()), pa.array([row["w"]], pa.binary())],
                        names=["component_idx", "block_id", "variants", "mean", "inv_sd", "packed", "w"],
                    )

        table = weights.join(lists, "block_id").mapInArrow(join, "component_idx int, block_id int, variants array<long>, mean array<double>, inv_sd array<double>, packed binary, w binary")
        return cls.over(table, n, ranks)

    @classmethod
    def over(cls, table: DataFrame, n: int, ranks: list[float] | None = None) -> WeightKernel:
        """Over blocks with their weights.  The divisor c is the trace over n, so that every component has mean diagonal 1, or a group's effective rank."""
        table = table.persist()

        def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.select(["component_idx", "mean", "inv_sd", "packed", "w"]).to_pylist():
                    w, mean, inv_sd = block_weights(row), np.array(row["mean"]), np.array(row["inv_sd"])
                    octets = np.frombuffer(row["packed"], np.uint8).reshape(len(mean), -1)
                    own = 0.0
                    for lo in range(0, n, SLICE):  # of samples
                        some = min(SLICE, n - lo)
                        z = standardised(np.ascontiguousarray(octets[:, lo // 4 : -(-(lo + some) // 4)]).tobytes(), mean, inv_sd, some)
                        own += float((z * (w @ z)).sum())
                    yield pa.record_batch([pa.array([row["component_idx"]], pa.int32()), pa.array([own / n])], names=["g", "trace"])

        sums = {r["g"]: r["trace"] for r in table.mapInArrow(traces, "g int, trace double").groupBy("g").agg(F.sum("trace").alias("trace")).collect()}
        trace = np.array([sums.get(g, 0.0) for g in range(max(sums, default=-1) + 1)])
        if not trace.size or (trace <= 0).any():
            raise ValueError("weights must give every group a positive trace")
        c = trace if ranks is None else np.asarray(ranks, float)
        if len(c) != len(trace):
            raise ValueError("an effective rank is needed for every group")
        return cls(table, n, len(c), c, trace / c)

    @staticmethod
    def weigh(row: dict, s: np.ndarray) -> np.ndarray:
        return block_weights(row) @ s

    def stacked(self, v: np.ndarray) -> np.ndarray:
        return self._sum(v, v.shape[1]) / self.m_eff[:, None, None]


def _with_weights(table: DataFrame) -> str:
    return ", ".join(f"{f.name} {'binary' if f.name == 'w' else f.dataType.simpleString()}" for f in table.schema)


def block_weights(row: dict) -> np.ndarray:
    """The dense weights of one block."""
    return np.frombuffer(row["w"], float).reshape(len(row["mean"]), -1)


class SoftKernel(SparkKernel):
    """``Z diag(w_k) Z' / sum w_k`` for every group k of ``weights(variant_idx, group_idx, w)``: all groups share one product with Z'."""

    extra = ("w",)
    least = 1e-300

    @classmethod
    def build(cls, table: DataFrame, stats: DataFrame, weights: DataFrame, n: int, groups: int) -> SoftKernel:
        """Over a kept table of ``blocks`` of one component, which other weights use too; a variant without weights counts 0."""
        own = weights.join(stats.select("variant_idx", "cnt", "inv_sd"), "variant_idx")
        sums = {r["group_idx"]: r for r in own.groupBy("group_idx").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("inv_sd") > 0, F.col("w") * F.col("cnt")).otherwise(0.0)).alias("filled")).collect()}
        total = np.array([sums[g]["total"] if g in sums else 0.0 for g in range(groups)])
        if (total <= 0).any():
            raise ValueError("a group has no weight")
        each = weights.groupBy("variant_idx").agg(F.map_from_entries(F.collect_list(F.struct("group_idx", "w"))).alias("of"))
        each = each.select("variant_idx", F.array(*(F.coalesce(F.try_element_at("of", F.lit(g)), F.lit(0.0)) for g in range(groups))).alias("w"))
        rows = table.select("block_id", F.posexplode("variants").alias("at", "variant_idx")).join(each, "variant_idx", "left")
        rows = rows.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("w", F.array_repeat(F.lit(0.0), groups)).alias("w")))).alias("w"))
        rows = table.join(rows.select("block_id", F.flatten(F.transform("w", lambda x: x["w"])).alias("w")), "block_id")
        out = cls(rows, n, groups, total, np.array([sums[g]["filled"] for g in range(groups)]) / n / total)
        return out

    @staticmethod
    def weigh(row: dict, s: np.ndarray) -> np.ndarray:
        w = np.array(row["w"]).reshape(len(s), -1)  # variants x groups
        return (w[:, :, None] * s[:, None, :]).reshape(len(s), -1)

    @staticmethod
    def parted(g: int, own: np.ndarray, divisors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        yield from enumerate(np.moveaxis(own.reshape(len(own), len(divisors), -1), 1, 0) / divisors[:, None, None])

    def stacked(self, v: np.ndarray) -> np.ndarray:
        size, c = self.size, v.shape[1]
        out = self._sum(v, size * c)[0].reshape(self.n, size, c)
        return np.moveaxis(out, 1, 0) / self.m_eff[:, None, None]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each (g, lo)."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["g"], row["lo"])
            own = np.frombuffer(row["part"], float)
            total[key] = total[key] + own if key in total else own
    yield _rows([(*key, t.tobytes()) for key, t in total.items()])


_SCORES = "component_idx int, variant_idx long, col int, score double"


def _scored(g: int, variants: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    w, c = s.shape
    return pa.record_batch(
        [pa.array(np.full(w * c, g, np.int32)), pa.array(np.repeat(variants, c)), pa.array(np.tile(np.arange(c, dtype=np.int32), w)), pa.array(s.ravel())],
        names=["component_idx", "variant_idx", "col", "score"],
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    g, lo, part = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(g, pa.int32()), pa.array(lo, pa.int32()), pa.array(part, pa.binary())], names=["g", "lo", "part"])

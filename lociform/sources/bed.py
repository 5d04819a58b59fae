"""SNP-major BED files as Python data sources: a partition reads its range of variants, and only kept samples.

``lociform_bed`` gives ``variant_idx``, ``sample_idx``, ``dosage`` of the cells
that are not zero, or those of the columns that the reader's schema names.
``lociform_bed_blocks`` gives packed blocks of neighbouring variants with their
counts and statistics, straight from ranges of the file's bytes: no cell becomes
a row.  Samples to keep are an option (a bit for each, ``keep_bits``); kept
samples are renumbered in the file's order.  Filters on ``variant_idx``,
``sample_idx`` and ``block_id`` are pushed into the readers, which then read and
decode only what they ask for.  Files are read where the tasks run, so the path
must be one that every executor can open.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: The file's first bytes, and the dosage of each 2-bit code (3 stands for missing).
MAGIC = b"\x6c\x1b\x01"
DOSAGE = np.array([2, 3, 1, 0], np.uint8)


def decode(raw: bytes, n: int) -> np.ndarray:
    """variants x n dosages, 3 where missing."""
    octets = np.frombuffer(raw, np.uint8).reshape(-1, -(-n // 4))
    codes = np.stack([octets >> (2 * k) & 3 for k in range(4)], 2).reshape(len(octets), -1)[:, :n]
    return DOSAGE[codes]


def encode(dosage: np.ndarray) -> bytes:
    """Inverse of ``decode``."""
    code = np.array([3, 2, 0, 1], np.uint8)[dosage]
    padded = np.zeros((len(code), -(-code.shape[1] // 4) * 4), np.uint8)
    padded[:, : code.shape[1]] = code
    four = padded.reshape(len(code), -1, 4)
    return (four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6).tobytes()


def write_bed(path: str, dosage: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(MAGIC + encode(dosage))


def write_packed(packed: DataFrame, path: str, n: int, m: int) -> None:
    """Writes ``packed(variant_idx, first, packed)``, as ``geno.pack_2bit`` makes it, to one file.

    Every task puts its pieces of variants at their places, so a task that runs again
    writes the same bytes; the path must be one that every executor can open.
    """
    stride = -(-n // 4)
    with open(path, "wb") as f:
        f.write(MAGIC)
        f.truncate(len(MAGIC) + m * stride)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for v, first, octets in zip(*(c.to_pylist() for c in batch.columns)):
                    if first % 4 or first // 4 + len(octets) > stride:
                        raise ValueError(f"variant {v} has {len(octets)} bytes from sample {first} on, of {stride} in all")
                    f.seek(len(MAGIC) + v * stride + first // 4)
                    f.write(octets)
                    done += len(octets)
        yield pa.record_batch([pa.array([done], pa.int64())], names=["done"])

    done = packed.select("variant_idx", "first", "packed").mapInArrow(place, "done long").agg({"done": "sum"}).first()[0]
    if (done or 0) != m * stride:
        raise ValueError(f"{done} bytes of {m} variants were written, not {m * stride}")


#: Fixed values of packed blocks: dosages 0, 1, 2 and 3 for missing, low bits first; and each code's place in a BED file.
_TO_BLOCK = np.array([sum(int(DOSAGE[octet >> 2 * k & 3]) << 2 * k for k in range(4)) for octet in range(256)], np.uint8)
#: How many of an octet's four block codes are 1, 2 and 3.
_HELD = np.array([[sum((octet >> 2 * k & 3) == code for k in range(4)) for octet in range(256)] for code in (1, 2, 3)], np.uint8)
#: Smallest variance by which a variant is scaled.
VAR_FLOOR = 1e-6

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def keep_bits(keep: np.ndarray) -> str:
    """A flag for each sample as an option's value."""
    return base64.b64encode(zlib.compress(np.packbits(np.asarray(keep, bool)).tobytes())).decode()


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    """What both forms share: the file's shape, kept samples, and the variants that filters leave."""

    numbered = "variant_idx"  # the column whose filters choose variants

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.n, self.columns = options["path"], int(options["n"]), columns
        self.block = int(options.get("block", 4096))
        self.stride = -(-self.n // 4)
        size = os.path.getsize(self.path) - len(MAGIC)
        with open(self.path, "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a SNP-major BED file")
        if size % self.stride:
            raise ValueError("the file's size does not fit the number of samples")
        self.m = size // self.stride
        self.keep = None
        if options.get("keep"):
            self.keep = np.array([int(x) for x in options["keep"].split(",")], np.int64)
        elif options.get("keep_bits"):
            self.keep = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(base64.b64decode(options["keep_bits"])), np.uint8), count=self.n))
        if self.keep is not None and len(self.keep) and not (0 <= self.keep.min() and self.keep.max() < self.n):
            raise ValueError("kept samples lie outside the file")
        self.lo, self.hi, self.only, self.samples = 0, self.m, None, None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        for f in filters:
            if not self.take(f):
                yield f

    def take(self, f: Filter) -> bool:
        """Whether the reader applies a filter by itself."""
        if isinstance(f, IsNotNull):
            return True  # no column but the dosage holds nulls, and it is never asked for alone
        if not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) or len(f.attribute) != 1:
            return False
        if f.attribute[0] == self.numbered:
            self.lo, self.hi, self.only = _narrowed(f, self.lo, self.hi, self.only)
            return True
        return False

    def partitions(self) -> list[InputPartition]:
        lo, hi = self.lo, self.hi
        if self.only is not None:
            wanted = [v for v in sorted(self.only) if lo <= v < hi]
            ranges: list[_Range] = []
            for v in wanted:  # neighbours go together
                last = ranges[-1] if ranges else None
                if last and last.first + last.count == v and last.count < self.block:
                    last.count += 1
                else:
                    ranges.append(_Range(v, 1))
            return ranges or [_Range(0, 0)]
        return [_Range(k, min(self.block, hi - k)) for k in range(lo, hi, self.block)] or [_Range(0, 0)]

    def octets(self, f, first: int, count: int) -> np.ndarray:
        f.seek(len(MAGIC) + first * self.stride)
        return np.frombuffer(f.read(count * self.stride), np.uint8).reshape(count, self.stride)


def _narrowed(f: Filter, lo: int, hi: int, only: set[int] | None) -> tuple[int, int, set[int] | None]:
    """A range and a set of numbers under one more filter."""
    if isinstance(f, EqualTo | In):
        own = {int(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
        return lo, hi, own if only is None else only & own
    value = int(f.value)
    if isinstance(f, GreaterThan | GreaterThanOrEqual):
        return max(lo, value + isinstance(f, GreaterThan)), hi, only
    return lo, min(hi, value + isinstance(f, LessThanOrEqual)), only


class _Cells(_Reader):
    def take(self, f: Filter) -> bool:
        if isinstance(f, IsNotNull):
            return f.attribute != ("dosage",)
        if getattr(f, "attribute", None) == ("sample_idx",) and isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            n = self.n if self.keep is None else len(self.keep)
            lo, hi, only = _narrowed(f, 0, n, None)
            own = np.array(sorted(s for s in only if lo <= s < hi), np.int64) if only is not None else np.arange(max(lo, 0), max(min(hi, n), 0))
            self.samples = own if self.samples is None else np.intersect1d(self.samples, own)
            return True
        return super().take(f)

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        number = self.samples if self.samples is not None else np.arange(self.n if self.keep is None else len(self.keep))
        at = number if self.keep is None else self.keep[number]
        every = len(at) == self.n and self.keep is None
        with open(self.path, "rb") as f:
            for first in range(part.first, part.first + part.count, 256):
                count = min(256, part.first + part.count - first)
                octets = self.octets(f, first, count)
                g = decode(octets.tobytes(), self.n) if every else DOSAGE[octets[:, at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3]
                v, s = np.nonzero(g)
                own = {"variant_idx": lambda: pa.array(first + v), "sample_idx": lambda: pa.array(number[s].astype(np.int64))}
                cells = g[v, s]
                own["dosage"] = lambda: pa.array(np.where(cells == 3, 0, cells).astype(np.int8), mask=cells == 3)
                yield pa.record_batch([own[c]() for c in self.columns], names=self.columns)


class _Blocks(_Reader):
    numbered = "block_id"

    def __init__(self, options: dict, columns: list[str]):
        super().__init__(options, columns)
        self.width = int(options.get("width", 256))
        self.hi = -(-self.m // self.width)
        self.block = max(1, self.block // self.width)  # blocks in a partition

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        n = self.n if self.keep is None else len(self.keep)
        with open(self.path, "rb") as f:
            for k in range(part.first, part.first + part.count):
                first = k * self.width
                octets = _TO_BLOCK[self.octets(f, first, min(self.width, self.m - first))]
                if self.keep is not None:
                    octets = repacked(octets[:, self.keep >> 2] >> (2 * (self.keep & 3)).astype(np.uint8) & 3)
                elif n % 4:
                    octets[:, -1] &= (1 << 2 * (n % 4)) - 1
                own = block_statistics(octets, n) | {"block_id": k, "variants": np.arange(first, first + len(octets)), "packed": octets.tobytes()}
                yield pa.record_batch([pa.array([own[c]], _BLOCK_TYPES[c]) for c in self.columns], names=self.columns)


def repacked(codes: np.ndarray) -> np.ndarray:
    """Block codes, variants x samples, four to an octet."""
    padded = np.zeros((codes.shape[0], -(-codes.shape[1] // 4) * 4), np.uint8)
    padded[:, : codes.shape[1]] = codes
    four = padded.reshape(codes.shape[0], -1, 4)
    return four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6


def block_statistics(octets: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts and statistics of a block's variants from its octets, by table."""
    het, hom, miss = (held[octets].sum(1, dtype=np.int64) for held in _HELD)
    cnt = n - miss
    some = np.maximum(cnt, 1)
    mean = (het + 2 * hom) / some
    var = (het + 4 * hom) / some - mean * mean
    inv_sd = np.where((cnt > 0) & (var > 0), 1 / np.sqrt(np.maximum(var, VAR_FLOOR)), 0.0)
    return {"cnt": cnt, "het": het, "hom": hom, "miss": miss, "mean": mean, "var": np.where(cnt > 0, var, 0.0), "inv_sd": inv_sd}


_BLOCK_TYPES = {"block_id": pa.int64(), "packed": pa.binary()} | {c: pa.list_(pa.int64()) for c in ("variants", "cnt", "het", "hom", "miss")} | {c: pa.list_(pa.float64()) for c in ("mean", "var", "inv_sd")}


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociform_bed"

    def schema(self) -> str:
        return "variant_idx long, sample_idx long, dosage byte"

    def reader(self, schema) -> DataSourceReader:
        return _Cells(self.options, schema.names)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lociform_bed_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Blocks(self.options, schema.names)


BLOCKS = "block_id long, variants array<long>, cnt array<long>, het array<long>, hom array<long>, miss array<long>, mean array<double>, var array<double>, inv_sd array<double>, packed binary"


def _from(spark: SparkSession, source: type[DataSource], path: str, n: int, options: dict) -> DataFrameReader:
    spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format(source.name()).option("path", path).option("n", str(n))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader


def read_bed(spark: SparkSession, path: str, n: int, keep: list[int] | np.ndarray | None = None, block: int = 4096, columns: str | None = None) -> DataFrame:
    """Present cells of a BED file.

    ``keep`` holds sample positions, which are renumbered in the order given, or
    a flag for each sample; ``columns`` is a schema of those wanted.
    """
    reader = _from(spark, BedSource, path, n, {"block": block} | _kept(keep))
    return (reader.schema(columns) if columns else reader).load()


def read_blocks(spark: SparkSession, path: str, n: int, keep: np.ndarray | None = None, width: int = 256, block: int = 4096) -> DataFrame:
    """Packed blocks of ``width`` neighbouring variants with counts and statistics over the kept samples."""
    return _from(spark, BlockSource, path, n, {"block": block, "width": width} | _kept(keep)).load()


def _kept(keep) -> dict[str, str]:
    if keep is None:
        return {}
    if isinstance(keep, np.ndarray) and keep.dtype == bool:
        return {"keep_bits": keep_bits(keep)}
    return {"keep": ",".join(map(str, keep))}


def variant_rows(blocks: DataFrame) -> DataFrame:
    """``variant_idx`` and its statistics, a row for each variant of the blocks: what ``geno.variant_stats`` gives of cells."""
    names = ("variants", "cnt", "mean", "var", "inv_sd", "het", "hom", "miss")
    each = blocks.select(F.explode(F.arrays_zip(*names)).alias("s"))
    return each.select(F.col("s.variants").alias("variant_idx"), *(f"s.{c}" for c in names[1:]))

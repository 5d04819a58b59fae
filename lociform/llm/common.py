"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests in one process, a temporary folder takes its
    place; executors on other machines could not read that, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lociform-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch in jobs that this package starts itself; Spark's default is eight times as much.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_BYTES`` in the jobs that start inside: an executor holds several at a time."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs no rerun."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` wrote, once nothing reads them any more, and lets Spark delete the shuffles behind them.

    Spark deletes a shuffle's files when the driver's garbage collection finds its plan gone; long before memory runs short, disks may.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    SparkSession.active()._jvm.java.lang.System.gc()


#: A key with more rows than this share of all is hot, and so is none with fewer rows than the second figure.
HOT_SHARE, HOT_LEAST = 1 << 14, 100_000


def attached(rows: DataFrame, facts: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which hold one row for each key and, in ``size``, its number of rows.

    Rows of hot keys meet their facts by a broadcast, so that no task gets all
    of them; as a hot key holds more than a share of all rows, at most
    ``HOT_SHARE`` facts are broadcast.  The others are joined by key; rows of hot
    keys are spread over that join by a number of their own and meet nothing in
    it.  ``facts`` is a table that ``saved`` wrote.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    floor = max(HOT_LEAST, total // HOT_SHARE)
    hot = facts.filter(F.col(size) > floor)
    if not hot.limit(1).count():
        return rows.join(facts, key, how)
    values = F.struct(*(c for c in facts.columns if c != key))
    rows = rows.join(F.broadcast(hot.select(key, values.alias("__hot"))), key, "left")
    rows = rows.withColumn("__spread", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    out = rows.join(facts.filter(F.col(size) <= floor).select(key, F.lit(0).cast("long").alias("__spread"), values.alias("__cold")), [key, "__spread"], "left")
    out = out.withColumn("__hot", F.coalesce("__hot", "__cold")).drop("__cold", "__spread")
    if how == "inner":
        out = out.filter(F.col("__hot").isNotNull())
    return out.select(*(c for c in out.columns if c != "__hot"), "__hot.*")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for Arrow batches, after which the worker gives its memory back: Spark keeps workers for later tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # no such call in this C library
                pass

    return wrapped


def masked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with a mark in the place of each span (``start`` and ``end`` in code points, by start); spans that overlap get the first one's mark."""

    def step(acc: Column, s: Column) -> Column:
        # acc.at: the first code point that is not yet written
        begin, stop = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        joins = (s["start"] < acc["at"]) & (acc["at"] > 0)
        ahead = F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        part = F.when(joins, acc["out"]).otherwise(F.concat(acc["out"], ahead, mark(s)))
        return F.struct(part.alias("out"), stop.alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs meets a name that an operator uses."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def rewritten(df: DataFrame, changed: Column, text: Column) -> DataFrame:
    """The columns of ``row`` with ``text`` where ``changed``; ``n_chars``, where it is present, is counted anew there."""
    kinds = {f.name: f.dataType for f in df.schema["row"].dataType}
    df = df.select("row", changed.alias("changed"), F.when(changed, text).otherwise(F.col("row.text")).alias("new"))
    own = {"text": F.col("new")}
    if "n_chars" in kinds:
        own["n_chars"] = F.when(F.col("changed"), F.length("new").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return df.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in kinds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def strings(column: pa.Array, size: int = 1 << 21):
    """Python strings of an Arrow column in slices of bounded bytes, each with its first row's number."""
    lo, own = 0, 0
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for k, n in enumerate(lengths):
        own += n
        if own >= size or k == len(lengths) - 1:
            yield lo, column.slice(lo, k + 1 - lo).to_pylist()
            lo, own = k + 1, 0

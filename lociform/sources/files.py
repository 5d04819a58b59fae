"""Small whole files (summaries, specifications, weights) by Hadoop path, so they lie wherever Spark's tables lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def _at(path: str):
    context = SparkSession.active().sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def qualified(path: str) -> str:
    """The path with its file system, as Spark names files that it reads."""
    system, place = _at(path)
    return system.makeQualified(place).toString()


def put(path: str, data: bytes) -> None:
    """Writes one file, in the place of an older one."""
    system, place = _at(path)
    out = system.create(place, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(path: str) -> bytes:
    return bytes(SparkSession.active().read.format("binaryFile").load(path).select("content").first()[0])


def exists(path: str) -> bool:
    system, place = _at(path)
    return system.exists(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; in one process without
    that setting, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lociform-"))
    return f"{folder}/{name}-{uuid.uuid4().hex}"

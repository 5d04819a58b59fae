"""Component specifications and lists, small files read on the driver, and weight matrices, read in tasks."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

#: Keys of an array file that are not components, and names under which a rank may stand.
RESERVED = ("component_names", "component_annotations_json", "component_provenance_json")
RANK_KEYS = ("effective_rank", "retained_rank", "weight_rank", "rank")

SPEC = T.StructType(
    [
        T.StructField("component_idx", T.IntegerType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("variant_indices", T.ArrayType(T.LongType())),
        T.StructField("annotation", T.StringType()),
        T.StructField("provenance", T.StringType()),
    ]
)


def _row(k: int, c: dict) -> tuple:
    note = lambda x: None if x is None else json.dumps(x, sort_keys=True)
    return (k, c.get("name") or f"component_{k:03d}", sorted(int(i) for i in c["variant_indices"]), note(c.get("annotation")), note(c.get("provenance")))


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """Components of a ``.json`` or ``.npz`` file, in the file's order."""
    if path.endswith(".npz"):
        with np.load(io.BytesIO(files.get(path)), allow_pickle=False) as z:
            keys = sorted((k for k in z.files if k not in RESERVED), key=lambda k: int(k.rpartition("_")[2]))
            names = [str(x) for x in z["component_names"]] if "component_names" in z.files else [None] * len(keys)
            extra = {f: [json.loads(str(x)) for x in z[f"component_{f}s_json" if f == "annotation" else "component_provenance_json"]] if (f"component_{f}s_json" if f == "annotation" else "component_provenance_json") in z.files else [None] * len(keys) for f in ("annotation", "provenance")}
            rows = [_row(k, {"name": names[k], "variant_indices": z[key].tolist(), "annotation": extra["annotation"][k], "provenance": extra["provenance"][k]}) for k, key in enumerate(keys)]
    else:
        data = json.loads(files.get(path))
        rows = [_row(k, c) for k, c in enumerate(data["components"] if isinstance(data, dict) else data)]
    return spark.createDataFrame(rows, SPEC)


def spec_rows(spec: DataFrame) -> DataFrame:
    """``component_idx``, ``variant_idx`` of every claim."""
    return spec.select("component_idx", F.explode("variant_indices").alias("variant_idx"))


def write_spec(spec: DataFrame, path: str) -> None:
    """Writes a specification; it has one row for each component."""
    out = []
    for r in spec.orderBy("component_idx").collect():
        own = {"name": r["name"], "variant_indices": list(r["variant_indices"])}
        own |= {k: json.loads(r[k]) for k in ("annotation", "provenance") if r[k] is not None}
        out.append(own)
    files.put(path, json.dumps({"components": out}, indent=1).encode())


def load_weights(path: str) -> np.ndarray:
    """A square, non-empty, finite matrix from ``.npy``, ``.npz`` (one array), ``.csv`` or text."""
    return parse_weights(path, b"" if path.endswith(".rds") else files.get(path))


def parse_weights(path: str, data: bytes) -> np.ndarray:
    """``load_weights`` from a file's bytes."""
    if path.endswith(".npy"):
        w = np.load(io.BytesIO(data))
    elif path.endswith(".npz"):
        with np.load(io.BytesIO(data)) as z:
            if len(z.files) != 1:
                raise ValueError("a weight archive holds one array")
            w = z[z.files[0]]
    elif path.endswith(".rds"):
        raise ValueError("RDS files need R, which this engine does not call; save the matrix as .npy")
    else:
        w = np.loadtxt(io.BytesIO(data), delimiter="," if path.endswith(".csv") else None, ndmin=2)
    if w.ndim != 2 or w.shape[0] != w.shape[1] or not w.size:
        raise ValueError(f"weights must be a square matrix, not {w.shape}")
    if not np.issubdtype(w.dtype, np.number) or not np.isfinite(w).all():
        raise ValueError("weights must be finite numbers")
    return np.asarray(w, float)


def weight_blocks(spark: SparkSession, groups: list[list[str]], m: int | None = None) -> DataFrame:
    """``component_idx`` (a group), ``block_id``, ``first``, ``width``, ``w`` (8-byte floats row by row) of weight files.

    Files are read and parsed in tasks, a row for each; the driver gets their
    widths only.  The blocks of a group lie one after another along the variant
    axis and, where ``m`` is given, must cover it.
    """
    full = [[files.qualified(path) for path in own] for own in groups]
    for path in (p for own in full for p in own):
        if path.endswith(".rds"):
            load_weights(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                w = parse_weights(path.as_py(), data.as_py())
                yield pa.record_batch([pa.array([path.as_py()]), pa.array([len(w)], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["path", "width", "w"])

    read = spark.read.format("binaryFile").load(sorted({p for own in full for p in own}))
    parsed = read.select("path", "content").mapInArrow(parse, "path string, width long, w binary")
    widths = {r["path"]: r["width"] for r in parsed.select("path", "width").collect()}
    rows = []
    for group, own in enumerate(full):
        first = 0
        for path in own:
            rows.append((group, len(rows), path, first))
            first += widths[path]
        if m is not None and first != m:
            raise ValueError(f"blocks cover {first} of {m} variants")
    places = spark.createDataFrame(rows, "component_idx int, block_id int, path string, first long")
    return parsed.join(F.broadcast(places), "path").drop("path")  # a row for each file


def sidecar(path: str) -> dict:
    """Metadata next to a weight file, empty if there is none."""
    base = os.path.splitext(path)[0]
    for name in (base + ".json", base + ".meta.json", path + ".json"):
        if files.exists(name):
            return json.loads(files.get(name))
    return {}


def effective_rank(meta: dict, width: int) -> float:
    for key in RANK_KEYS:
        if key in meta:
            rank = float(meta[key])
            if not 0 < rank <= width * (1 + 1e-6):
                raise ValueError(f"{key} {rank} is not in (0, {width}]")
            return rank
    raise ValueError("no effective rank is given")


def weight_list(text: str) -> list[str]:
    """Paths between commas or line ends; ``#`` begins a comment."""
    return [x.strip() for line in text.splitlines() for x in re.sub("#.*", "", line).split(",") if x.strip()]


def weight_table(spark: SparkSession, matrices: list[np.ndarray], strict: bool = True, m: int | None = None) -> DataFrame:
    """``block_idx``, ``i``, ``j``, ``w`` of consecutive blocks along the variant axis, zeros left out."""
    width = sum(len(w) for w in matrices)
    if strict and m is not None and width != m:
        raise ValueError(f"blocks cover {width} of {m} variants")
    rows, first = [], 0
    for k, w in enumerate(matrices):
        i, j = np.nonzero(w)
        rows += [(k, int(first + a), int(first + b), float(w[a, b])) for a, b in zip(i, j)]
        first += len(w)
    return spark.createDataFrame(rows, "block_idx int, i long, j long, w double")


def q_fam_path(path: str) -> str:
    """``x.K.Q`` belongs to ``x.fam``."""
    return re.sub(r"\.[0-9]+\.Q$", "", path) + ".fam"

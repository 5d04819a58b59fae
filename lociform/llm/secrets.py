"""Operator 7: secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The
ledger holds the findings of each (blob, rule version) pair scanned so far; a
run scans only pairs that the ledger lacks, each once, appends them, and joins
findings back to all paths by blob.  The rule version is a digest of the rules.

Each unseen blob elects one of its rows, that with the least ``doc_id``, on
digests alone, and only elected texts are shuffled; a text that fills a third of
all rows is so no more work than another.

Defined results: null text counts as empty; equal texts share one blob and get
equal findings; repeated rows stay repeated; rows with a null ``doc_id`` are
scanned like others, and their id stays null; very long texts are scanned
whole; an empty table gives an empty result; ``report`` reads no other columns,
and ``redact`` hands all of them on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, attached, fresh_path, masked, rewritten, saved, small_batches, strings, tidy

#: Base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Rules that the method adds; they never replace a base span.
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
BEARER = re.compile(r"\b(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "keyblock", "bearer")

#: Assigned values shorter than this are no secrets.
LEAST = 8
#: The rule version: any change of a rule changes it.
RULES = hashlib.sha256("\n".join(f"{p.pattern} {p.flags}" for p in (ASSIGN, ACCESS, HEX, KEY_BLOCK, BEARER)).encode() + bytes([LEAST])).hexdigest()[:16]
#: Elected rows whose ids are broadcast, at most; beyond it texts are joined with them.
PICKED = 1 << 17

_HEXES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = b"h" * 32


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind as listed.  Cheap searches pass most texts by."""
    found = []
    low = text.lower()
    if "passw" in low or "token" in low or "secret" in low or "api" in low:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if _RUN in text.encode("utf-8").translate(_HEXES):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [("keyblock", *m.span()) for m in KEY_BLOCK.finditer(text)]
    if "gh" in text or "xox" in text or "eyJ" in text:
        found += [("bearer", *m.span()) for m in BEARER.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rules string, spans {SPANS}"


class Ledger:
    """Parquet folder of scanned (blob, rule version) pairs with their findings."""

    def __init__(self, spark: SparkSession, path: str, rules: str = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def entries(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, docs: DataFrame) -> None:
        """Scans the texts of ``docs`` whose blobs are not in the ledger under these rules, each once."""
        rows = _versions(docs)
        unseen = rows.groupBy("blob").agg(F.min("id").alias("id"))
        if _exists(self.spark, self.path):
            unseen = unseen.join(self.entries().filter(F.col("rules") == self.rules).select("blob"), "blob", "left_anti")
        unseen = saved(unseen, "unseen")
        n = unseen.count()
        if 0 < n <= PICKED:
            rows = rows.join(F.broadcast(unseen), ["id", "blob"], "left_semi")
        # Repeated rows go inside their splits before texts are shuffled.
        texts = rows.groupBy("id", "blob").agg(F.first("text").alias("text"))
        if n > PICKED:
            texts = texts.join(unseen, ["id", "blob"], "left_semi")
        if not n:
            return
        with small_batches(self.spark):
            texts.select("blob", "text").mapInArrow(tidy(_scan), f"blob binary, spans {SPANS}").select("blob", F.lit(self.rules).alias("rules"), "spans").write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """``blob``, ``spans`` under these rules; a retried append may have left a pair twice."""
        return self.entries().filter((F.col("rules") == self.rules) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans: list[list[dict]] = []
        for _, texts in strings(batch.column(1)):
            spans += [[{"kind": k, "start": i, "end": j} for k, i, j in scan(text)] for text in texts]
        yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["blob", "spans"])


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _versions(docs: DataFrame) -> DataFrame:
    """``id`` (the least number for null), ``blob``, ``text`` for each row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), _blob().alias("blob"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scan_paths(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """``doc_id``, ``blob``, ``spans`` (null if none) for every row of ``docs``; updates the ledger."""
    ledger.update(docs)
    paths = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _blob().alias("blob")), "paths")
    facts = saved(paths.groupBy("blob").agg(F.count("*").alias("n")).join(ledger.findings(), "blob", "left"), "facts")
    return attached(paths, facts, "blob", "n").select("doc_id", "blob", "spans")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """One row per document with counts, the digest of the base spans and all spans."""
    spans = F.coalesce(F.col("spans"), F.array().cast(SPANS))
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(spans, _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return scan_paths(docs, ledger).select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"), F.array_join(F.transform(spans, show), ",").alias("spans")
    )


def redact(docs: DataFrame, ledger: Ledger, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced together.

    Findings are joined back by blob.  All columns stay; ``n_chars``, where it
    is present, is counted anew for changed texts.
    """
    ledger.update(docs)
    blobs = docs.groupBy(_blob().alias("blob")).agg(F.count("*").alias("n"))
    facts = saved(blobs.join(ledger.findings(), "blob"), "facts")
    keyed = docs.select(as_row(docs), _blob().alias("blob"))
    if facts.count() <= PICKED:
        out = keyed.join(F.broadcast(facts), "blob", "left")
    else:
        out = attached(keyed, facts, "blob", "n", "left")
    return rewritten(out, F.col("spans").isNotNull(), masked(F.col("row.text"), F.col("spans"), lambda _: F.lit(mark)))


def new_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder, for a query over one snapshot."""
    return Ledger(spark, fresh_path(spark, "ledger"))

"""Operator 4: BPE encoding and decoding of whole texts.

Defined results: a null or empty text has no ids; equal texts get equal ids;
an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are not read; repeated rows stay repeated; a null ``doc_id`` stays
null.  Special tokens inside a text become their ids, as the tokenizers library
does by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import Vocabulary
from .common import id_and_text, strings, tidy

_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary file at ``path`` on the driver, read once."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) for each document.

    One pass over the scan without a shuffle.  The vocabulary file (a few MB,
    whatever the input's size) is broadcast, so executors need no copy of it.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = known.value.tokenizer()
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), pa.array(bpe.encode(texts), pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id``, ``text`` from what ``encode`` gives."""
    known = encoded.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = known.value.tokenizer()
        for batch in batches:
            for k in range(0, len(batch), 512):
                some = batch.slice(k, 512)
                yield pa.record_batch([some.column(0), pa.array([bpe.decode(x or b"") for x in some.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes every document in one pass; digests of ids and of the decoded text."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = known.value.tokenizer()
        for batch in batches:
            for lo, texts in strings(batch.column(1)):
                ids = bpe.encode(texts)
                columns = [
                    batch.column(0).slice(lo, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(bpe.decimals(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

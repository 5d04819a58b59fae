"""A training-data pipeline over ``documents``: each stage applies one operator to all that the stage before it kept.

Defined results: a null or empty text is scored like any other, and is one of
the equal texts (null counts as empty); null ids stay, and lose to numbers where
the largest id is kept; of repeated rows one is left; very long texts go through
whole; extra columns stay as they are until packing, whatever their names; an
empty table gives an empty result.  Each stage's result is a table in the shared
folder, so a lost executor costs no earlier stage, and is deleted once the next
one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociform.llm import exact_dedup, near_dedup, packing, quality, secrets
from lociform.llm.common import forget, saved, table
from lociform.llm.queries import tokenizer_path


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: runs of five words, a similarity of 0.8 or more."""
    return near_dedup.dedup(docs, near_dedup.Measure(width=5, percent=80))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that the scan finds are replaced by a mark."""
    return secrets.redact(docs, secrets.new_ledger(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows; a row for each piece of a document."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", judge), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", hide_secrets), ("packing", pack)]

#: Neither the classifier nor the tokenizer can be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's result is a table in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

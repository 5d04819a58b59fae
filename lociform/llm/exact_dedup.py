"""Operator 9: exact deduplication by skew-safe combining, in DataFrame functions only.

1. Locally: copies within an input split collapse before anything is shuffled.
2. Salted: each (digest, text, salt) group gets one winner; the salt is the
   split's number modulo ``salts``, so a text that fills a third of all rows
   meets in ``salts`` tasks, with one row from each split.
3. Globally: the at most ``salts`` winners of a text give what stays.

The full text is a grouping key at every stage, and a group's state is its
largest ``doc_id`` and its size, whatever it holds.  A digest that stage 3 has
seen with one text only stands for that text in the last join; rows of a digest
with several texts, should there ever be one, are joined by text.

Defined results: null text counts as empty; the row with the largest ``doc_id``
stays, a null ``doc_id`` counting as smallest; of repeated rows with the same
``doc_id`` all carry the same ``keep_id``, and one of them is kept; very long
texts are one value of one row like others; an empty table gives an empty
result; ``report`` reads no other columns, and ``dedup`` hands all of them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attached, id_and_text, saved


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """``digest``, ``text``, ``keep_id``, ``group_size`` for each text of ``rows(doc_id, text)``."""
    keyed = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = keyed.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))


def classes(docs: DataFrame, salts: int = 4096) -> DataFrame:
    """``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept`` for each row of ``docs``."""
    source = id_and_text(docs)
    rows = saved(source.select("doc_id", F.monotonically_increasing_id().alias("rid"), digest(F.col("text")).alias("digest")), "rows")
    facts = saved(winners(source, salts).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")), "winners")
    clash = facts.filter("texts > 1").select("digest")
    if clash.limit(1).count():
        return _by_text(source, salts)
    joined = saved(attached(rows, facts.drop("texts"), "digest", "group_size"), "joined")
    # One row of each text is kept: of those with its largest doc_id, the one with the least row number.
    first = joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    return joined.join(first, "rid", "left").select("doc_id", "digest", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"))


def _by_text(source: DataFrame, salts: int) -> DataFrame:
    """``classes`` where a digest stands for several texts: rows meet their winners by text."""
    rows = saved(source.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "rows")
    facts = saved(winners(rows, salts).withColumn("number", F.monotonically_increasing_id()), "winners")
    joined = saved(attached(rows, facts, "text", "group_size").drop("text"), "joined")
    first = joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("number").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    return joined.join(first, "rid", "left").select("doc_id", "digest", "keep_id", "group_size", F.coalesce("first", F.lit(False)).alias("kept"))


def report(docs: DataFrame, salts: int = 4096) -> DataFrame:
    """One row per document, dropped ones too."""
    return classes(docs, salts).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, salts: int = 4096) -> DataFrame:
    """``docs`` with one row of each text, the one with the largest ``doc_id``; all its columns.

    The rows themselves are combined, so ``docs`` is evaluated once and nothing
    is joined back.  Of repeated rows with that ``doc_id`` any one stays.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(
        digest(text).alias("digest"),
        text.alias("text"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        F.struct(F.col("doc_id").cast("long").alias("id"), (-F.monotonically_increasing_id()).alias("nrid")).alias("order"),
        F.struct(F.col("text").isNull().alias("null"), F.struct(*others).alias("others")).alias("row"),
    )
    best = lambda df, *keys: df.groupBy(*keys).agg(F.max_by("row", "order").alias("row"), F.max("order").alias("order"))
    kept = best(best(rows, "digest", "text", "salt"), "digest", "text")
    return kept.select(*(F.when(~F.col("row.null"), F.col("text")).alias(c) if c == "text" else F.col(f"row.others.`{c}`").alias(c) for c in docs.columns))

"""Exact deduplication against a plain reading."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lociform.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, rid long, digest string, n long"


def rows():
    r = random.Random(0)
    out = [(i, r.choice(["", None, "a", "A", "a ", "é", "é", "long " * 4000, "\x00"]) if i % 3 else "one very common text") for i in range(900)]
    out += [(5000 + i, f"unique {i}") for i in range(100)]
    r.shuffle(out)
    return [(*x, 1, "clash", 2) for x in out]


def plain(data):
    best, size = {}, {}
    for d, t, *_ in data:
        best[t or ""] = max(best.get(t or "", -1), d)
        size[t or ""] = size.get(t or "", 0) + 1
    want = sorted((d, best[t or ""], size[t or ""], d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in data)
    return best, want


def shown(docs, salts=4096):
    return sorted(tuple(r) for r in exact_dedup.report(docs, salts).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_report_and_dedup(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(7)
    best, want = plain(data)
    for salts in (2, 4096):
        assert shown(docs, salts) == want
        kept = exact_dedup.dedup(docs, salts)
        assert kept.columns == docs.columns
        assert sorted(kept.collect(), key=lambda r: r.doc_id) == sorted((r for r in docs.collect() if r.doc_id in best.values()), key=lambda r: r.doc_id)


@pytest.mark.parametrize("shape", ["repartition", "join", "sort"])
def test_no_text_is_lost_whatever_made_the_table(spark, shape):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1000).cast("string")).alias("text"), F.expr("map('a', id)").alias("wide"), F.array("id").alias("__rid"))
    if shape == "repartition":
        docs = docs.repartition(7)
    elif shape == "join":
        docs = docs.join(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("more")).repartition(5), "doc_id")
    else:
        docs = docs.orderBy(F.rand())
    kept = exact_dedup.dedup(docs).select("doc_id", "text").collect()
    assert len(kept) == len({r.text for r in kept}) == 1000 and min(r.doc_id for r in kept) == 1000


def test_hot_keys_and_colliding_digests(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(7)
    monkeypatch.setattr(common, "HOT_LEAST", 50)
    assert shown(docs) == plain(data)[1]
    monkeypatch.setattr(exact_dedup, "digest", lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 5), 64, "0")))
    assert [x[:4] for x in shown(docs)] == [x[:4] for x in plain(data)[1]]
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs).collect()) == sorted(plain(data)[0].values())


def test_repeated_rows_nulls_and_empty(spark):
    data = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = exact_dedup.report(docs).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)]
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.dedup(docs).collect()) == [(-1, "y"), (1, "x")]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.report(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0

"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lociform.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, item_id string, score string", "item_id long, text string, rank string"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t, *_ in docs]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    united = {}
    for item, text, *_ in items:
        united.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in united.items():
        rows = []
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=lambda x: tuple(map(str, x)))


def tables():
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "b2", "é", "中文", "gamma_delta", "X" * 3000, "the", "THE", "ſ", "\x00", "--"]
    docs = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))), None, None) for k in range(300)]
    docs += [(5, "alpha alpha", "", ""), (5, "alpha alpha", "", ""), (None, "alpha beta", "", ""), (None, "alpha beta", "", ""), (900, None, "", ""), (901, "", "", ""), (902, " .,-", "", "")]
    docs += [(1000 + k, "tie tie", "", "") for k in range(40)]
    docs += [(2000, "long " * 30000 + "tie", "", "")]
    items = [(1, "alpha, ALPHA the", ""), (2, "tie", ""), (3, "", ""), (4, None, ""), (5, "unknown words", ""), (6, "Beta é 中文 gamma", ""), (6, "long", ""), (None, "tie the", "")]
    return docs, items


@pytest.mark.parametrize("shard,block,k", [(8 << 20, 4 << 20, 50), (600, 40, 7), (1, 30, 1)])
def test_against_brute_force(spark, monkeypatch, shard, block, k):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "GROUP", 2)
    docs, items = tables()
    if block == 30:
        docs, items = docs[::3], items[:3]
    table = spark.createDataFrame(docs, DOCS).repartition(5)
    index = ranked.build(table)
    got = ranked.search(index, spark.createDataFrame(items, ITEMS), k).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=lambda x: tuple(map(str, x))) == brute(docs, items, k)
    index.drop()


def test_small_shards_are_many():
    docs, _ = tables()
    import pyarrow as pa

    batch = pa.record_batch([pa.array([d for d, *_ in docs], pa.int64()), pa.array([t or "" for _, t, *_ in docs], pa.string())], names=["doc_id", "text"])
    sizes = [len(b.column(0)[0]) for b in ranked._shards(iter([batch]), 300, 5000)]
    assert sizes and sum(sizes) == len([1 for _, t, *_ in docs if terms(t)])


def test_top_is_safe_with_ties():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 50, 400):
        scores, ids = r.integers(0, 6, n), r.permutation(n)
        for k in (1, 3, 50):
            own = ranked.top(scores, ids, k)
            assert sorted(zip(-scores[own], ids[own])) == sorted(zip(-scores, ids))[:k]


def test_empty(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "alpha", "")], ITEMS)
    assert ranked.ranked(none, items).count() == 0
    assert ranked.ranked(spark.createDataFrame([(1, "alpha", "", "")], DOCS), spark.createDataFrame([], ITEMS)).count() == 0

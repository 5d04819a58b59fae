"""Near-duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from lociform.llm import common, near_dedup
from lociform.llm.shingles import batch_shingles

SCHEMA = "doc_id long, text string, node long, token string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(data, width, percent):
    sets = [shingles(t, width) for _, t, *_ in data]
    top = list(range(len(data)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    by_word = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by_word.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                top[find(i)] = find(j)
        for x in s:
            by_word.setdefault(x, []).append(i)
    groups = {}
    for i, (d, *_) in enumerate(data):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(groups[find(i)])) for i, ((d, *_), s) in enumerate(zip(data, sets)))


def corpus(r, big):
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    out = ["", None, " \t\n", "one", "ONE", "two words", "Two\x0bWords", "é Ü", "É ü", "x" * 50000, "a b c", "a b c", "same " * 3000, "same " * 5000]
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice((5, 30, 80, 200)))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 15))):
                own[r.randrange(len(own))] = r.choice(vocab)
            out.append(r.choice((" ", "\n")).join(own))
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(big):  # one large group of near copies, some of them too far from the first
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(len(own))] = r.choice(vocab)
        out.append(" ".join(own))
    passage = [r.choice(vocab) for _ in range(60)]
    for _ in range(big):  # one passage that many documents share, and little else
        out.append(" ".join(passage + [r.choice(vocab) for _ in range(r.randint(5, 60))]))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components(spark, width, percent):
    r = random.Random(width)
    data = [(i, t, 1, "clash") for i, t in enumerate(corpus(r, 150))] + [(3, "one", 1, "clash")]
    r.shuffle(data)
    got = near_dedup.report(spark.createDataFrame(data, SCHEMA).repartition(5), near_dedup.Measure(width, percent)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(data, width, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


@pytest.mark.parametrize("shape", ["repartition", "join", "sort"])
def test_dedup_whatever_made_the_table(spark, shape):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijklmnop") * 2 + str(r.randrange(90)) for _ in range(60)) for _ in range(300)]
    data = [(k, base[k % 300] + (" more" if k % 2 else ""), k, "x") for k in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, __rid long, node string").repartition(7)
    if shape == "join":
        docs = docs.join(spark.range(900).select(F.col("id").alias("doc_id"), F.lit(1).alias("more")).repartition(5), "doc_id")
    elif shape == "sort":
        docs = docs.orderBy(F.rand())
    kept = near_dedup.dedup(docs, near_dedup.Measure(5, 80))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in brute(data, 5, 80)})


def test_long_postings_and_small_blocks(spark, monkeypatch):
    """Everything goes by leaders, in tiny blocks, with hot keys broadcast."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    monkeypatch.setattr(near_dedup, "FOLLOWERS", 16)
    monkeypatch.setattr(near_dedup, "PICKED", 0)
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    r = random.Random(9)
    data = [(i, t, 1, "clash") for i, t in enumerate(corpus(r, 120))] + [(None, "a b c", 1, "clash")] * 5
    got = near_dedup.report(spark.createDataFrame(data, SCHEMA).repartition(5), near_dedup.Measure(3, 85)).filter("doc_id IS NOT NULL").collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(data[:-5], 3, 85)


def test_shingles_count():
    r = random.Random(1)
    texts = corpus(r, 20)
    for width in (3, 5):
        assert [len(s) for s in batch_shingles(texts, width)] == [len(shingles(t, width)) for t in texts]
    one = [batch_shingles([t], 3)[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(one, batch_shingles(texts, 3)))


def test_empty_and_nulls(spark):
    assert near_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(None, "a b c d e", 1, ""), (5, "a b c d e", 1, ""), (None, None, None, None), (6, None, None, None)]
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in near_dedup.report(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(-1, -1, True), (-1, 5, False), (5, 5, True), (6, 6, True)]


def test_a_cluster_of_copies_takes_about_one_comparison_a_node(spark, monkeypatch):
    """Forty near copies of each of three texts: pairs of all of them would be 780 a text, each with a whole set."""
    rng, docs = np.random.default_rng(5), []
    for k in range(3):
        words = [f"w{k}x{x}" for x in rng.integers(0, 10**6, 300)]
        for c in range(40):
            own = list(words)
            own[int(rng.integers(0, 300))] = f"copy{k}x{c}"
            docs.append((100 * k + c, " ".join(own)))
    compared, overlaps = [], near_dedup._overlaps

    def counted(pairs, *more):
        compared.append(pairs.count())
        return overlaps(pairs, *more)

    monkeypatch.setattr(near_dedup, "_overlaps", counted)
    rows = near_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] // 100 * 100 for r in rows)
    assert sum(compared) < 4 * len(docs)


def test_a_shared_passage_alone_needs_no_sets(spark, monkeypatch):
    """Three hundred documents share three fifths of their runs: long postings, whose nodes were all compared with the leader on full sets."""
    r = random.Random(11)
    passage = [f"p{k}" for k in range(26)]
    docs = [(k, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(16)])) for k in range(300)]
    compared, wanted, overlaps, sets = [], [], near_dedup._overlaps, near_dedup._sets

    def counted(pairs, *more):
        compared.append(pairs.count())
        return overlaps(pairs, *more)

    def needed(docs, some, measure):
        wanted.append(some.count())
        return sets(docs, some, measure)

    monkeypatch.setattr(near_dedup, "SMALL", 16)
    monkeypatch.setattr(near_dedup, "_overlaps", counted)
    monkeypatch.setattr(near_dedup, "_sets", needed)
    rows = near_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in rows) == brute(docs, 3, 85)
    assert sum(compared) < len(docs) / 2 and sum(wanted) < len(docs), (compared, wanted)


def test_tiny_blocks_of_signatures_and_a_tiny_bitmap(spark, monkeypatch):
    """Parts longer than a block are cut by bands in both steps, and the bitmap lets other texts through."""
    for name, value in (("SMALL", 4), ("BLOCK", 2000), ("SIGNED", 7), ("PICKED", 0), ("WORDS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(13)
    data = [(i, t, 1, "clash") for i, t in enumerate(corpus(r, 60))] + [(3, "one", 1, "clash")] * 3
    got = near_dedup.report(spark.createDataFrame(data, SCHEMA).repartition(5), near_dedup.Measure(3, 85)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(data, 3, 85)


def test_texts_that_no_pair_needs_stay_out_of_the_shuffle(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("key"), "id")
    some = near_dedup._among(rows, rows.filter("id % 10 = 0")).select("id").collect()
    assert {x.id for x in some} >= set(range(0, 20000, 10)) and len(some) < 2100

"""Nearest neighbours against brute force."""

import numpy as np

from lociform.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, score string, leaf int"


def brute(rows, k):
    out = {}
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q in x:
        if q % 20 == 0:
            out[q] = sorted(((-float((x[i] * x[q]).sum()), i) for i in x if i != q))[:k]
    return out


def clusters(n, seed=3, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    x = (centres[rng.integers(0, 40, n)] + rng.normal(0, 0.4, (n, d))) * rng.uniform(0.2, 3, (n, 1))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def recall(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)
    got = neighbours.search(df, df.filter("vec_id % 20 = 0"), k).collect()
    want, by = brute(rows, k), {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(by) == set(want)
    hits = total = 0
    for q, own in by.items():
        assert len(own) == len(want[q]) and own == sorted(own)
        exact = dict((i, s) for s, i in want[q])
        hits += sum(i in exact for _, i in own)
        total += len(own)
        assert all(abs(exact[i] - s) < 1e-9 for s, i in own if i in exact)
    return hits / total


def test_recall_on_clusters_of_many_lengths(spark):
    assert recall(spark, clusters(3000)) >= 0.9


def test_recall_with_a_sample_far_below_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 256)
    monkeypatch.setattr(neighbours, "TREE", 1 << 16)
    assert recall(spark, clusters(3000, 5)) >= 0.9


def test_recall_and_rows_scored_beyond_the_sample(spark, monkeypatch):
    """A table of more rows than the sample; leaves alone give the recall, and only a part of the rows is scored."""
    rows = clusters(20000, 7, 12)
    scored = []
    calibrate = neighbours.Tree.calibrate

    def counted(self, asked, wanted):
        calibrate(self, asked, wanted)
        scored.append((self.visits, self.leaves))

    monkeypatch.setattr(neighbours.Tree, "calibrate", counted)
    x = np.array([v for _, v in rows])
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    asked = list(range(0, 20000, 200))
    got = neighbours.search(df, df.filter("vec_id % 200 = 0"), 20).collect()
    found = {q: set() for q in asked}
    for r in got:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
        assert len(found[q]) == 20
    assert hits / (20 * len(asked)) >= 0.9 and scored[0][1] > 50 and scored[0][0] < 0.7 * scored[0][1]


def test_results_come_from_leaves(spark, monkeypatch):
    """Where visited leaves answer nothing there is no result: nothing stands beside the tree."""
    import pandas as pd

    nothing = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    monkeypatch.setattr(neighbours, "_best", lambda k: lambda pdf: nothing)
    df = spark.createDataFrame([(i, v, "", 0) for i, v in clusters(800)], SCHEMA)
    assert neighbours.search(df, df.filter("vec_id % 20 = 0"), 20).count() == 0


def test_pruning_keeps_what_leaves_hold():
    rng = np.random.default_rng(2)
    x, leaf = rng.normal(size=(300, 6)), rng.integers(0, 12, 300)
    prune = neighbours.Pruning(leaf, np.arange(300), x)
    for q in range(40):
        leaves = rng.choice(12, rng.integers(1, 6), replace=False).tolist()
        inside = [i for i in range(300) if leaf[i] in leaves and i != q]
        bound = prune.bound(x[q], q, leaves, 20)
        assert bound == -np.inf if len(inside) < 20 else sum(x[i] @ x[q] >= bound - 1e-12 for i in inside) == 20


def test_equal_vectors_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(np.float32(c)) for c in rng.normal(size=3)]) for i in range(1200)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    got = neighbours.search(df, df.filter("vec_id = 40"), 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in brute(rows, 20)[40]]


def test_odd_vectors_take_no_part(spark):
    odd = [(20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [None, 1.0]), (120, [1.0, 2.0, 3.0]), (140, []), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.5]), (1, [1.0, 0.25]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in odd + good], SCHEMA)
    got = neighbours.search(df, df.filter("vec_id % 20 = 0"), 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 1.125), (0, 2, 2, -1.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert neighbours.search(none, none, 20).count() == 0
    assert neighbours.search(df.filter("vec_id = 0"), df.filter("vec_id = 0"), 20).count() == 0


def test_small_leaves_do_not_cut_the_list(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RECALL", 0)  # one leaf is enough for the calibration; some leaves hold fewer than 20 rows
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    sizes = [700, 700, 700, 700, 5, 3, 2, 5, 4]
    x = np.repeat(centres[: len(sizes)], sizes, axis=0) + rng.normal(0, 1e-3, (sum(sizes), 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(2801, [float(np.float32(c)) for c in v]) for v in centres[4] + rng.normal(0, 1e-3, (30, 12))]  # one id, many rows
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], SCHEMA)
    got = neighbours.search(df, df.filter("vec_id >= 2800 or vec_id % 700 = 0"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.rank)
    assert set(by) == {0, 700, 1400, 2100, *range(2800, len(x))}
    assert all(sorted(own) == list(range(1, 21)) for own in by.values())

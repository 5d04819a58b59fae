"""The quality classifier: coverage of whole texts, gradients, and held-out accuracy."""

import zlib

import numpy as np

from lociform.llm import quality
from lociform.llm.queries import op1_quality

SCHEMA = "doc_id long, text string, score double, held_out string"


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        raw = bytes(k % 251 for k in range(n))
        c = quality.chunks(raw)
        step = quality.CHUNK - quality.OVERLAP
        flat = np.concatenate([c[0], *(x[quality.OVERLAP :] for x in c[1:])])
        assert bytes(flat[:n].astype(np.uint8)) == raw and (flat[n:] == quality.PAD).all() and len(c) == max(1, -(-(n - quality.OVERLAP) // step))


def test_something_at_the_very_end_counts():
    good = [f"plain words in a row number {k} " * 30 for k in range(60)]
    bad = [g + "&&& ### $$$ %%%" for g in good]
    net = quality.train(good + bad, np.array([1] * 60 + [0] * 60, np.float32))
    p = net.score(good + bad)
    assert (p[:60] >= 0.5).mean() > 0.9 and (p[60:] < 0.5).mean() > 0.9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    known = {r.doc_id: r.quality for r in labels.collect()}
    own = [(known[i], got[i].score) for i in known if got[i].held_out]
    assert np.mean([(p >= 0.5) == (y == 1) for y, p in own]) > 0.93


def plain_score(net, text):
    """The definition in loops: windows of bytes, chunks, pooling, one probability."""
    raw = list((text or "").encode())
    step = quality.CHUNK - quality.OVERLAP
    count = max(1, -(-(len(raw) - quality.OVERLAP) // step))
    raw += [quality.PAD] * ((count - 1) * step + quality.CHUNK - len(raw))
    p = {k: v.astype(float) for k, v in net.p.items()}
    pooled = []
    for c in range(count):
        own = raw[c * step : c * step + quality.CHUNK]
        values = [p["e"][own[k : k + quality.WIDTH]].ravel() @ p["w"] + p["b"] for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        pooled.append(np.tanh(np.max(values, 0)))
    f = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
    return 1 / (1 + np.exp(-(f @ p["v"] + p["c"][0])))


def test_query_against_plain_loops(spark, tmp_path):
    texts = [None, "", "short", "é" * 700, *(("good words here " if k % 2 else "x9$ !! qq ") * (k * 7) for k in range(1, 40)), "long text " * 9000]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op1_quality(spark, str(tmp_path)).collect()}
    net = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert sorted(got) == list(range(len(texts)))
    for k, text in enumerate(texts):
        assert abs(got[k].score - plain_score(net, text)) < 1e-4 and got[k].predicted == int(got[k].score >= 0.5)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = quality.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some = [quality.chunks(bytes(rng.integers(0, 256, n, dtype=np.uint8))) for n in (40, 700, 1500)]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.7, 1.3])

    def loss():
        f, _ = net.features(net.pooled(np.concatenate(some)), np.cumsum([0] + [len(x) for x in some[:-1]]))
        p = 1 / (1 + np.exp(-(f @ net.p["v"] + net.p["c"][0])))
        return float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean())

    found = net.gradients(some, y, weight)
    for name, g in found.items():
        for at in np.argsort(-np.abs(g).ravel())[:6]:
            flat = net.p[name].reshape(-1)
            before, each = flat[at], []
            for delta in (1e-6, -1e-6):
                flat[at] = before + delta
                each.append(loss())
            flat[at] = before
            assert abs((each[0] - each[1]) / 2e-6 - g.ravel()[at]) < 1e-4 * max(1, abs(g.ravel()[at])), name


def test_sample_is_bounded_and_defined(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] * 2 + [(ids[0], "y" * 500)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1), (ids[0], 0)], "doc_id long, quality int").repartition(3)
    seen = []
    real, quality.train = quality.train, lambda texts, y: seen.append((texts, y.tolist()))
    try:
        for part in (1, 7):
            quality.fit(docs.repartition(part), labels, sample=12, longest=400)
    finally:
        quality.train = real
    assert seen[0] == seen[1] and len(seen[0][0]) == 12 and max(map(len, seen[0][0])) < 400
    assert all(y == 1 for t, y in zip(*seen[0]) if t == f"text {ids[0]}")


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5, "clash"), (1, "", 0.5, "clash"), (None, "x" * 100000, 0.5, "clash")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, none)
    assert [r.score for r in quality.score(docs, net).collect()] == [0.5, 0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, one)).count() == 3
    assert quality.score(docs.limit(0), net).count() == 0
    assert quality.keep_good(docs, net).columns == docs.columns

"""The pipeline's stages, each against a plain reading of what it keeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociform.llm import quality, secrets

from .test_near_dedup import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        kept = {r.doc_id for r in rows}
        if name == "quality":
            assert len(kept) < len(before) and all(r == before[r.doc_id] for r in rows)
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            right = [(labels[i] == 1) == (i in kept) for i in labels]
            assert np.mean(right) > 0.9
        elif name == "exact_dedup":
            best = {}
            for r in before.values():
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert kept == set(best.values())
        elif name == "near_dedup":
            sets = {i: shingles(r.text, 5) for i, r in before.items()}
            close = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
            assert all(not close(sets[i], sets[j]) for i in kept for j in kept if i < j)
            top = {i: i for i in before}
            for i in sorted(before):
                for j in sorted(before):
                    if i < j and close(sets[i], sets[j]):
                        a, b = top[i], top[j]
                        top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
            assert kept == set(top.values())
        elif name == "secrets":
            assert kept == set(before)
            for r in rows:
                assert (r.text == before[r.doc_id].text) == (not secrets.scan(before[r.doc_id].text)) and not secrets.scan(r.text)
                assert r.n_chars == len(r.text)
        else:
            assert kept == set(before)
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
        docs = out


def test_rows_with_nulls_repeats_and_no_labels(spark, tmp_path):
    data = [(1, "same text here and there", "en", "a", 24), (2, "same text here and there", None, "b", 24), (2, "same text here and there", "en", "b", 24), (None, "same text here and there", "en", None, 24), (3, None, None, None, None), (4, "", "", "", 0), (5, "password=abcdefgh12", "en", "x", 19)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.judge(spark, docs, str(tmp_path))
    assert out.count() == 7  # without labels nothing is known against a document
    out = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in out.filter("text <> ''").collect()) == [(2, "same text here and there"), (5, "password=abcdefgh12")]
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or -1) for r in near.collect()) == [1, 3, 4, 5]
    hidden = {r.doc_id: r.text for r in corpus_pipeline.hide_secrets(spark, docs, str(tmp_path)).collect()}
    assert hidden[5] == "[SECRET]" and hidden[3] is None
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).agg(F.sum("length")).first()[0] > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_scores_do_not_depend_on_neighbours():
    texts = ["", None, "word " * 3000, "é" * 700, "The The The " * 40]
    net = quality.train(["good text of many kinds " * 5, "&& ## && ##" * 9] * 8, np.array([1, 0] * 8, np.float32))
    together = net.score(texts)
    assert np.allclose(together, np.concatenate([net.score([t]) for t in texts]), atol=1e-6)
    assert ((together >= 0) & (together <= 1)).all() and hashlib.sha256(net.p["e"].tobytes()).hexdigest()

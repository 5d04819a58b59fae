"""Readers, writers and the streaming form."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import align, geno
from lociform.sources import bed, sinks, specs, text
from lociform.streaming import additive


def write(path, body):
    path.write_text(body)
    return str(path)


def test_text_files(spark, tmp_path):
    fam = text.read_fam(spark, write(tmp_path / "a.fam", "f1 i1 0 0 0 -9\n \nf2\ti2 0 0 0 -9\n")).orderBy("sample_idx").collect()
    assert [(r.sample_idx, r.iid) for r in fam] == [(0, "i1"), (2, "i2")]
    with pytest.raises(Exception, match="fewer than 2"):
        text.read_fam(spark, write(tmp_path / "b.fam", "f1 i1\nx\n"), strict=True).collect()
    for body, want in (("#FID IID SEX\na b 1\nc d 1\n", ["b", "d"]), ("#IID\nb\nd\n", ["b", "d"]), ("a b\nc d\n", ["b", "d"]), ("b\nd\n", ["b", "d"])):
        assert [r.iid for r in text.read_psam(spark, write(tmp_path / "a.psam", body)).orderBy("sample_idx").collect()] == want
    bim = text.read_bim(spark, write(tmp_path / "a.bim", "1 rs1 0 100 A G\n1 rs2 0 200 C T\n")).orderBy("variant_idx").first()
    assert tuple(bim) == (0, "1", "rs1", "0", "100", "A", "G")
    pvar = text.read_pvar(spark, write(tmp_path / "a.pvar", "##x\n#CHROM POS ID REF ALT\n1 100 rs1 G A,T\n")).first()
    assert tuple(pvar) == (0, "1", "rs1", ".", "100", "A", "G")
    pheno = align.parse_pheno(text.read_pheno(spark, write(tmp_path / "p", "FID IID Y\na i1 1.5\na i2 -9\na i3 NA\na i4 1.5f\na i5 -9.0\na i6 2e1\n")))
    assert {(r.iid, r.pheno) for r in pheno.collect()} == {("i1", 1.5), ("i6", 20.0)}
    covar = align.parse_covar(text.read_covar(spark, write(tmp_path / "c", "a i1 1 2\na i2 3 NA\na i3 -9 4\na i4 5 6\n")))
    assert {(r.iid, *r["cov"]) for r in covar.collect()} == {("i1", 1.0, 2.0), ("i4", 5.0, 6.0)}
    with pytest.raises(ValueError, match="1 rows"):
        text.read_covar(spark, write(tmp_path / "d", "a i1 1 2\na i2 3\na i3 1 2\n"))
    assert [r.iid for r in text.read_keep(spark, write(tmp_path / "k", "a i1\ni2\n")).collect()] == ["i1", "i2"]
    samples = spark.createDataFrame([(0, "x"), (1, "y")], "sample_idx long, iid string")
    q = text.read_admixture(spark, write(tmp_path / "x.2.Q", "0.25 0.75\n1.0 -0.0000001\n"), samples)
    assert {(r.sample_idx, r.ancestry, r.q) for r in q.collect()} == {(0, 0, 0.25), (0, 1, 0.75), (1, 0, 1.0), (1, 1, 0.0)}
    with pytest.raises(Exception, match="shares"):
        text.read_admixture(spark, write(tmp_path / "y.2.Q", "0.2 0.7\n1 0\n"), samples).collect()


def test_alignment(spark):
    samples = spark.createDataFrame([(k, f"i{k}") for k in range(5)], "sample_idx long, iid string")
    pheno = spark.createDataFrame([("i0", 1.0), ("i1", 2.0), ("i3", 3.0), ("zz", 4.0)], "iid string, pheno double")
    keep = spark.createDataFrame([("i1",), ("i3",)], "iid string")
    assert [r.iid for r in align.align(samples, pheno, None, keep).orderBy("sample_idx").collect()] == ["i1", "i3"]
    assert sorted(r.iid for r in align.dropped(samples, pheno, None, keep).collect()) == ["i0", "i2", "i4"]
    align.require_unique(samples, "samples")
    with pytest.raises(ValueError, match="i1"):
        align.require_unique(samples.union(spark.createDataFrame([(9, "i1")], samples.schema)), "samples")


def test_bed_files(spark, tmp_path):
    g = np.random.default_rng(0).integers(0, 4, (11, 7)).astype(np.uint8)
    path = str(tmp_path / "x.bed")
    bed.write_bed(path, g)
    assert np.array_equal(bed.decode(bed.encode(g), 7), g)
    rows = bed.read_bed(spark, path, 7, block=3).collect()
    assert {(r.variant_idx, r.sample_idx): r.dosage for r in rows} == {(int(v), int(s)): (None if g[v, s] == 3 else int(g[v, s])) for v, s in zip(*np.nonzero(g))}
    kept = bed.read_bed(spark, path, 7, keep=[5, 2], block=4).collect()
    assert {(r.variant_idx, r.sample_idx) for r in kept} == {(int(v), k) for k, s in enumerate((5, 2)) for v in np.flatnonzero(g[:, s])}
    with pytest.raises(Exception, match="size"):
        bed.read_bed(spark, path, 9).collect()


def test_specs_and_weights(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps({"components": [{"name": "a", "variant_indices": [3, 1]}, {"variant_indices": [0], "annotation": {"k": 1}}]}))
    spec = specs.read_spec(spark, path)
    assert [(r.name, r.variant_indices, r.annotation) for r in spec.orderBy("component_idx").collect()] == [("a", [1, 3], None), ("component_001", [0], '{"k": 1}')]
    specs.write_spec(spec, str(tmp_path / "t.json"))
    assert specs.read_spec(spark, str(tmp_path / "t.json")).collect() == spec.collect()
    np.savez(tmp_path / "s.npz", arr_10=np.array([5]), arr_2=np.array([1, 0]), component_names=np.array(["x", "y"]))
    assert [(r.name, r.variant_indices) for r in specs.read_spec(spark, str(tmp_path / "s.npz")).orderBy("component_idx").collect()] == [("x", [0, 1]), ("y", [5])]
    assert geno.overlapping(specs.spec_rows(spec)).count() == 0
    np.save(tmp_path / "w.npy", np.eye(2))
    (tmp_path / "w.json").write_text('{"rank": 2}')
    w = specs.load_weights(str(tmp_path / "w.npy"))
    assert specs.effective_rank(specs.sidecar(str(tmp_path / "w.npy")), 2) == 2
    assert specs.weight_table(spark, [w, np.ones((1, 1))], m=3).count() == 3
    with pytest.raises(ValueError):
        specs.weight_table(spark, [w], m=3)
    with pytest.raises(ValueError):
        specs.load_weights(write(tmp_path / "bad.csv", "1,2\n"))
    assert specs.weight_list("a, b # c\n\nd") == ["a", "b", "d"] and specs.q_fam_path("d/x.3.Q") == "d/x.fam"


def test_sinks(spark, tmp_path):
    sinks.write_keep(spark.createDataFrame([(1, "b"), (0, "a")], "sample_idx long, iid string"), str(tmp_path / "keep"))
    assert [r._c0 for r in spark.read.option("sep", "\t").csv(str(tmp_path / "keep")).collect()] == ["a", "b"]
    sinks.write_json(str(tmp_path / "m.json"), {"x": np.arange(2)})
    assert json.loads((tmp_path / "m.json").read_text())["x"] == [0, 1]
    assert sinks.text8(spark.createDataFrame([(1.0 / 3,)], "x double")).first().x == "0.33333333"


def test_stream_of_cells(spark, tmp_path):
    cells = spark.createDataFrame([(s, v, None if (s + v) % 5 == 0 else (s * v) % 3) for s in range(12) for v in range(4)], "sample_idx long, variant_idx long, dosage byte")
    cells.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = additive.maintain(stream, str(tmp_path / "sums"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert additive.totals(spark, str(tmp_path / "sums")).orderBy("variant_idx").collect() == additive.partial_sums(cells).select("variant_idx", *additive.SUMS).orderBy("variant_idx").collect()


def test_unique_order_checks(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "sample_idx long, iid string")
    assert align.order_mismatch(a, a).count() == 0
    assert align.order_mismatch(a, a.filter("sample_idx = 0")).first().position == 1
    with pytest.raises(ValueError, match="unknown"):
        align.subsequence(a, spark.createDataFrame([("q", 0)], "iid string, rank int"))
    assert align.subsequence(a, spark.createDataFrame([("y", 7), ("x", 3)], "iid string, rank int")).count() == 2
    with pytest.raises(ValueError, match="out of order"):
        align.subsequence(a, spark.createDataFrame([("y", 3), ("x", 7)], "iid string, rank int"))
    many = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("key")).repartition(6)
    got = align.ordered(many, "key").orderBy("key").collect()
    assert [r.number for r in got] == list(range(5000))


def test_ancestry_rows_meet_samples_by_id(spark, tmp_path):
    path = write(tmp_path / "z.2.Q", "0.25 0.75\n1.0 0\n0.5 0.5\n")
    fam = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b")], "sample_idx long, iid string")
    samples = spark.createDataFrame([(0, "a"), (1, "c")], "sample_idx long, iid string")
    got = sorted((r.sample_idx, r.ancestry, r.q) for r in text.read_admixture(spark, path, samples, fam=fam).collect())
    assert got == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.25), (1, 1, 0.75)]
    with pytest.raises(Exception, match="no ancestry shares"):
        text.read_admixture(spark, path, samples.union(spark.createDataFrame([(2, "zz")], samples.schema)), fam=fam).collect()


def test_end_of_order_checks(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "sample_idx long, iid string")
    assert a.agg(F.count("*")).first()[0] == 2


def test_lines_over_splits_and_folders(spark, tmp_path):
    want = [f"row {k} " + "x" * (k * 37 % 50) for k in range(3000)]
    write(tmp_path / "one", "\n".join(want) + "\n")
    (tmp_path / "many").mkdir()
    for k, (a, b) in enumerate(((0, 10), (10, 2500), (2500, 3000))):
        write(tmp_path / "many" / f"part-{k:05d}", "\n".join(want[a:b]) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("2048", "40000"):  # many splits, and several of them in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "16")
            for name in ("one", "many"):
                got = text.lines(spark, str(tmp_path / name)).collect()
                assert [r.raw for r in sorted(got, key=lambda r: r.line)] == want and sorted(r.line for r in got) == list(range(3000))
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert text.lines(spark, write(tmp_path / "none", "")).count() == 0


def test_selected_trace_and_packed_bytes(spark, tmp_path):
    trace = str(tmp_path / "trace")
    sinks.append_trace([{"round": 0, "stage": "fit"}], trace)
    sinks.append_trace([{"round": 1, "h2": 0.5}], trace)
    rows = spark.read.option("sep", "\t").option("header", True).csv(trace)
    assert rows.columns == [c for c, _ in sinks.TRACE] and sorted((r["round"], r.stage, r.h2) for r in rows.collect()) == [("0", "fit", None), ("1", None, "0.5")]
    g = np.random.default_rng(3).choice(4, (5, 41), p=(0.9, 0.05, 0.03, 0.02)).astype(np.uint8)
    g[2] = 0  # a variant without any cell
    cells = [(int(v), int(s), None if g[v, s] == 3 else int(g[v, s])) for v, s in zip(*np.nonzero(g))]
    packed = geno.pack_2bit(spark.createDataFrame(cells, "variant_idx long, sample_idx long, dosage byte"), spark.range(41), spark.range(5).withColumnRenamed("id", "variant_idx"))
    path = str(tmp_path / "side.bed")
    bed.write_packed(packed, path, 41, 5)
    with open(path, "rb") as f:
        assert np.array_equal(bed.decode(f.read()[3:], 41), g)


def test_packed_pieces(spark, tmp_path, monkeypatch):
    """No packed row holds all samples, and a file and the cells come out of the pieces."""
    monkeypatch.setattr(geno, "PIECE", 16)
    g = np.random.default_rng(4).choice(4, (3, 41), p=(0.7, 0.1, 0.1, 0.1)).astype(np.uint8)
    g[1] = 0
    cells = [(int(v), int(s), None if g[v, s] == 3 else int(g[v, s])) for v, s in zip(*np.nonzero(g))]
    packed = geno.pack_2bit(spark.createDataFrame(cells, "variant_idx long, sample_idx long, dosage byte"), spark.range(41), spark.range(3).withColumnRenamed("id", "variant_idx"))
    assert sorted((r["first"], len(r["packed"]), r["n"]) for r in packed.filter("variant_idx = 1").collect()) == [(0, 4, 16), (16, 4, 16), (32, 3, 9)]
    got = np.full_like(g, 9)
    for r in geno.unpack_2bit(packed).collect():
        got[r["variant_idx"], r["sample_idx"]] = 3 if r["dosage"] is None else r["dosage"]
    assert np.array_equal(got, g)
    path = str(tmp_path / "pieces.bed")
    bed.write_packed(packed, path, 41, 3)
    with open(path, "rb") as f:
        assert np.array_equal(bed.decode(f.read()[3:], 41), g)

"""Kernels from the bytes of BED files: pushdown, statistics, weights, several sources, column budgets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import geno as G
from lociform.plans import kernels as K
from lociform.plans import models
from lociform.plans.reml import Options
from lociform.sources import bed, specs

N, M = 47, 70


@pytest.fixture(scope="module")
def genotypes():
    r = np.random.default_rng(6)
    g = r.binomial(2, 0.3, (M, N)).astype(np.uint8)
    g[r.random(g.shape) < 0.05] = 3
    g[5] = 1  # no variance
    g[9] = 3  # all missing
    return g


@pytest.fixture(scope="module")
def path(tmp_path_factory, genotypes):
    out = str(tmp_path_factory.mktemp("bed") / "x.bed")
    bed.write_bed(out, genotypes)
    return out


def dense(g):
    z = np.zeros(g.shape)
    for k, row in enumerate(g):
        seen = row != 3
        if seen.any() and row[seen].var() > 0:
            z[k, seen] = (row[seen] - row[seen].mean()) / np.sqrt(max(row[seen].var(), 1e-6))
    return z


def shuffled(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_reader(spark, path, genotypes):
    rows = bed.read_bed(spark, path, N, block=8).filter("variant_idx >= 3 AND variant_idx < 20 AND sample_idx IN (1, 30, 46)").filter("variant_idx > 3 AND sample_idx > 1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter " not in plan
    got = {(r.variant_idx, r.sample_idx): 3 if r.dosage is None else r.dosage for r in rows.collect()}
    assert got == {(v, s): genotypes[v, s] for v in range(4, 20) for s in (30, 46) if genotypes[v, s]}
    assert bed.read_bed(spark, path, N).filter("variant_idx = 400").count() == 0 and bed.read_bed(spark, path, N).filter("sample_idx < 0").count() == 0
    assert bed.read_bed(spark, path, N).filter("dosage IS NOT NULL").count() == (np.isin(genotypes, (1, 2))).sum()


def test_only_kept_samples_are_decoded(path, monkeypatch):
    """The reader picks kept samples' codes; it never decodes whole rows then."""
    keep = np.zeros(N, bool)
    keep[[4, 5, 44]] = True
    seen = []
    monkeypatch.setattr(bed, "decode", lambda *a: seen.append(a) or np.zeros((1, 1), np.uint8))
    reader = bed._Cells({"path": path, "n": str(N), "keep_bits": bed.keep_bits(keep)}, ["variant_idx", "sample_idx", "dosage"])
    list(reader.pushFilters([bed.In(("sample_idx",), (0, 2)), bed.EqualTo(("variant_idx",), 7)]))
    parts = reader.partitions()
    assert [(p.first, p.count) for p in parts] == [(7, 1)]
    cells = [b for p in parts for b in reader.read(p)]
    assert not seen and {s for b in cells for s in b.column(1).to_pylist()} <= {0, 2}


def test_reader_needs_a_file_that_fits(tmp_path, path):
    with pytest.raises(ValueError, match="fit"):
        bed._Cells({"path": path, "n": str(N + 4)}, [])
    with pytest.raises(ValueError, match="outside"):
        bed._Cells({"path": path, "n": str(N), "keep": f"0,{N}"}, [])


@pytest.mark.parametrize("width", [8, 256])
def test_kernel_from_bytes(spark, path, genotypes, width):
    keep = np.arange(N) % 4 != 2
    z = dense(genotypes[:, keep])
    component = np.arange(M) % 3
    rows = spark.createDataFrame([(int(c), v) for v, c in enumerate(component) if v != 1], "component_idx int, variant_idx long")
    table = K.component_blocks(bed.read_blocks(spark, path, N, keep, width), None, width)
    assert not shuffled(table)
    v = np.random.default_rng(0).normal(size=(int(keep.sum()), 3))
    kernel = K.SparkKernel.of_bed(spark, path, N, G.component_map(rows), keep, width)
    out = kernel.stacked(v)
    for g in range(3):
        own = z[(component == g) & (np.arange(M) != 1)]
        m = (own != 0).any(1).sum()
        assert kernel.m_eff[g] == m and np.allclose(out[g], own.T @ (own @ v) / m)
        assert np.isclose(kernel.mean_diag()[g], (own**2).sum() / m / len(v), rtol=1e-9)
    kernel.close()
    whole = K.SparkKernel.of_bed(spark, path, N, None, keep, width)
    assert np.allclose(whole.stacked(v)[0], z.T @ (z @ v) / (z != 0).any(1).sum())
    whole.close()


def test_statistics_are_those_of_cells(spark, path):
    for keep in (None, np.arange(N) % 5 == 0):
        n = N if keep is None else int(keep.sum())
        a = bed.variant_rows(bed.read_blocks(spark, path, N, keep, 16)).orderBy("variant_idx").toPandas()
        b = G.variant_stats(bed.read_bed(spark, path, N, keep), spark.range(M).withColumnRenamed("id", "variant_idx"), n).orderBy("variant_idx").toPandas()
        assert sorted(a.columns) == sorted(b.columns)
        for c in a.columns:
            assert np.allclose(a[c], b[c], atol=1e-12), c


def test_components_outside_the_file(spark, path):
    rows = spark.createDataFrame([(0, 2), (0, M)], "component_idx int, variant_idx long")
    with pytest.raises(Exception, match="does not hold"):
        K.component_blocks(bed.read_blocks(spark, path, N, None, 64), G.component_map(rows), 64).collect()


def test_sources_in_one_table(spark, path, genotypes):
    z = dense(genotypes)
    parts = [K.SparkKernel.of_blocks(bed.read_blocks(spark, path, N, None, 8).filter(f), N, None, 8) for f in ("block_id < 3", "block_id >= 3 AND block_id < 5", "block_id >= 5")]
    kernel = K.SparkKernel.joined(parts, [M, M, M])
    v = np.random.default_rng(2).normal(size=(N, 2))
    jobs = spark.sparkContext.statusTracker()
    kernel.stacked(v)
    before = len(jobs.getJobIdsForGroup(None))
    out = kernel.stacked(v)
    assert len(jobs.getJobIdsForGroup(None)) - before <= 2  # however many sources (adaptive plans run a shuffle as a job)
    for k, (a, b) in enumerate(((0, 24), (24, 40), (40, M))):
        own = z[a:b]
        assert np.allclose(out[k], own.T @ (own @ v) / (own != 0).any(1).sum())
    alpha, theta = v[:, 0], np.array([1.0, 2.0, 3.0])
    got = {(r.component_idx, r.variant_idx): r.beta for r in kernel.effects(alpha, theta).collect()}
    assert len(got) == (z != 0).any(1).sum()
    assert all(np.isclose(beta, theta[g] * (z[x - g * M] @ alpha) / kernel.m_eff[g]) for (g, x), beta in got.items())
    with pytest.raises(ValueError):
        K.SparkKernel.joined(parts, [M])
    for k in (kernel, *parts):
        k.close()


def test_weight_files(spark, path, genotypes, tmp_path):
    r = np.random.default_rng(3)
    z, paths, ws = dense(genotypes), [], []
    for k, width in enumerate((33, 1, 36)):
        a = r.normal(size=(width, width))
        ws.append(a @ a.T / width + np.eye(width))
        paths.append(str(tmp_path / f"w{k}.npy"))
        np.save(paths[-1], ws[-1])
    v = r.normal(size=(N, 2))
    own = np.zeros((M, M))
    for a, w in zip((0, 33, 34), ws):
        own[a : a + len(w), a : a + len(w)] = w
    kernel = K.WeightKernel.of_files(bed.read_blocks(spark, path, N, None, 16), specs.weight_blocks(spark, [paths, paths], M), N, 16)
    c = np.trace(z.T @ own @ z) / N
    assert kernel.size == 2 and np.allclose(kernel.stacked(v), (z.T @ own @ (z @ v) / c)[None]) and np.allclose(kernel.mean_diag(), 1)
    got = {(x.component_idx, x.variant_idx): x.beta for x in kernel.effects(v[:, 0], np.array([0.5, 0.25])).collect()}
    want = own @ (z @ v[:, 0]) / c
    assert all(np.isclose(beta, (0.5, 0.25)[g] * want[x]) for (g, x), beta in got.items()) and len(got) == 2 * (z != 0).any(1).sum()
    kernel.close()
    with pytest.raises(ValueError, match="cover"):
        specs.weight_blocks(spark, [paths[:2]], M)


def test_a_wide_weight_block(spark, tmp_path):
    """4096 variants in one block: tiles of genotypes, one dense matrix, and nothing of it on the driver."""
    n, m = 24, 4096
    r = np.random.default_rng(4)
    g = r.binomial(2, 0.4, (m, n)).astype(np.uint8)
    bed.write_bed(str(tmp_path / "w.bed"), g)
    w = np.eye(m, dtype=np.float64) + np.diag(np.full(m - 1, 0.25), 1) + np.diag(np.full(m - 1, 0.25), -1)
    np.save(tmp_path / "w.npy", w)
    z, v = dense(g), r.normal(size=(n, 1))
    table = specs.weight_blocks(spark, [[str(tmp_path / "w.npy")]], m)
    kernel = K.WeightKernel.of_files(bed.read_blocks(spark, str(tmp_path / "w.bed"), n), table, n)
    want = z.T @ (w @ (z @ v))
    assert np.allclose(kernel.stacked(v)[0], want / (np.einsum("ij,ij->", z, w @ z) / n))
    kernel.close()


@pytest.mark.parametrize("budget", [1, 3, 256])
def test_column_budget(budget):
    r = np.random.default_rng(7)
    a = r.normal(size=(20, 30))
    widest = []

    class Base(K.DenseKernel):
        def stacked(self, v):
            widest.append(v.shape[1])
            return super().stacked(v)

    q, v = r.dirichlet((1, 1, 1, 1), 20), r.normal(size=(20, 5))
    base = Base([a @ a.T / 30])
    out = K.AdmixedKernel(base, q, budget).stacked(v)
    for k in range(4):
        d = np.sqrt(q[:, k])[:, None]
        assert np.allclose(out[k], d * (base.k[0] @ (d * v)))
    assert max(widest) <= budget and sum(widest) == 20


def test_ancestry_effects(spark, path, genotypes):
    z, r = dense(genotypes), np.random.default_rng(8)
    q, alpha, theta = r.dirichlet((1, 1, 1), N), r.normal(size=N), np.array([0.2, 0.3, 0.4])
    base = K.SparkKernel.of_bed(spark, path, N)
    kernel = K.AdmixedKernel(base, q, 2)
    got = {(x.component_idx, x.variant_idx): x.beta for x in kernel.effects(alpha, theta).collect()}
    beta = np.zeros((3, M))
    for (a, v), x in got.items():
        beta[a, v] = x
    again = sum(np.sqrt(q[:, a]) * (z.T @ beta[a]) for a in range(3))
    assert np.allclose(again, np.einsum("a,an->n", theta, kernel.stacked(alpha[:, None])[:, :, 0]))
    base.close()


def test_data_from_a_file_equals_data_from_cells(spark, path, genotypes):
    people = spark.createDataFrame([(k, f"i{k}") for k in range(N)], "sample_idx long, iid string")
    variants = spark.range(M).withColumnRenamed("id", "variant_idx")
    y = np.random.default_rng(9).normal(size=N)
    aligned = spark.createDataFrame([(k, f"i{k}", float(y[k]), [1.0]) for k in range(N) if k % 6], "sample_idx long, iid string, y double, x array<double>")
    one = variants.select((F.col("variant_idx") % 2).cast("int").alias("component_idx"), "variant_idx")
    a = models.Data.of_bed(spark, path, people, variants, aligned, one)
    b = models.Data.of(bed.read_bed(spark, path, N), variants, aligned, one)
    fits = [models.Model(d, Options(method="exact")) for d in (a, b)]
    left, right = (m.fit() for m in fits)
    assert np.allclose(left.theta, right.theta) and np.isclose(left.loglik, right.loglik)
    e, f = ({(r.component_idx, r.local_idx, r.variant_idx): r.beta for r in m.effects().snps.collect()} for m in fits)
    assert e.keys() == f.keys() and np.allclose([e[k] for k in sorted(e)], [f[k] for k in sorted(e)])
    picked = [3, 69, 3, 5, 30]
    z = dense(genotypes[:, [k for k in range(N) if k % 6]])
    assert np.allclose(a.columns(picked), z[picked].T) and np.allclose(b.columns(picked), z[picked].T) and a.columns([]).shape == (len(z[0]), 0)
    with pytest.raises(ValueError, match="unknown sample"):
        models.Data.of_bed(spark, path, people.filter("sample_idx > 2"), variants, aligned, one)
    a.close()
    b.close()


def test_soft_grouping_is_bounded(spark, path, monkeypatch):
    people = spark.createDataFrame([(k, f"i{k}") for k in range(N)], "sample_idx long, iid string")
    variants = spark.range(M).withColumnRenamed("id", "variant_idx")
    aligned = people.selectExpr("sample_idx", "iid", "cast(sample_idx as double) as y", "array(1.0D) as x")
    data = models.Data.of_bed(spark, path, people, variants, aligned, variants.selectExpr("0 as component_idx", "variant_idx"))
    monkeypatch.setattr(models, "DENSE", N * M - 1)
    with pytest.raises(ValueError, match="streamed"):
        models.relax(data, np.ones((M, 2)))
    data.close()


def test_prediction_needs_the_training_geometry(spark):
    frame = spark.createDataFrame
    stats = frame([(0, 1.0), (1, 1.0), (2, 0.0), (3, 1.0)], "variant_idx long, inv_sd double")
    cmap = frame([(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3)], "component_idx int, local_idx long, variant_idx long")
    good = [(0, 0, 0, 0.5), (0, 1, 1, 0.1), (1, 0, 3, 0.2)]
    schema = "component_idx int, local_idx long, variant_idx long, beta double"
    models.check_geometry(frame(good, schema), stats, cmap)
    for bad in (good[:2], [*good, (0, 0, 0, 0.1)], [*good, (2, 0, 0, 0.1)], [(1, 0, 0, 0.5), *good[1:]], [(0, 5, 0, 0.5), *good[1:]], [(0, 0, 0, float("nan")), *good[1:]], [*good, (0, 2, 2, 0.1)]):
        with pytest.raises(ValueError, match="differ"):
            models.check_geometry(frame(bad, schema), stats, cmap)

"""The six-by-four fixture: statistics, products, scan and likelihood against values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import geno, gwas
from lociform.plans.kernels import AdmixedKernel, DenseKernel, HybridKernel, SparkKernel
from lociform.plans.models import Data, Model
from lociform.plans.reml import Options, Problem

ROWS = [[0, 1, 2, 0], [1, 1, 0, 0], [2, 0, 1, 0], [0, None, 1, 0], [1, 2, 0, 0], [0, 0, 2, 0]]
Y = [1.2, 0.3, 2.5, -0.4, 0.9, -1.1]


@pytest.fixture(scope="module")
def data(spark):
    cells = [(s, v, g) for s, row in enumerate(ROWS) for v, g in enumerate(row) if g != 0]
    g = spark.createDataFrame(cells, "sample_idx long, variant_idx long, dosage byte")
    samples = spark.createDataFrame([(s, f"i{s}") for s in range(6)], "sample_idx long, iid string")
    variants = spark.createDataFrame([(v,) for v in range(4)], "variant_idx long")
    components = variants.select(F.lit(0).alias("component_idx"), "variant_idx")
    return Data(spark, g, variants, samples, np.array(Y), np.ones((6, 1)), components)


def close(got, want, tol=1e-6):
    assert np.allclose(np.array(got, float), np.array(want, float), atol=tol), (got, want)


def dense(data):
    g = np.array([[np.nan if x is None else x for x in row] for row in ROWS], float)
    mean = np.nanmean(g, 0)
    var = np.nanmean(g**2, 0) - mean**2
    z = (np.where(np.isnan(g), mean, g) - mean) * np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0)
    return z, z @ z.T / 3


def test_statistics(data):
    s = data.stats.orderBy("variant_idx").collect()
    assert [r.cnt for r in s] == [6, 5, 6, 6]
    close([r["mean"] for r in s], [2 / 3, 0.8, 1, 0])
    close([r.inv_sd for r in s], [1.34164079, 1.33630621, 1.22474487, 0])
    c = geno.component_stats(data.stats, data.cmap, 6).first()
    assert c.m_eff == 3
    close([c.mean_diag], [17 / 18])
    diag = [r.diag for r in geno.exact_diag(data.geno, data.stats, data.samples).orderBy("sample_idx").collect()]
    close(diag, [0.79047619, 0.59047619, 1.44761905, 0.26666667, 1.42380952, 1.14761905])


def test_products_in_both_tiers(data):
    v = data.vector(np.array(Y)[:, None])
    score = {r.variant_idx: r.score for r in geno.xtv(data.geno, data.stats, v).collect()}
    close([score[k] for k in range(3)], [5.27712043, 0.34743961, -1.34721936])
    want = [-2.09238095, 1.36761905, 3.02285714, -1.57333333, 1.52238095, -2.24714286]
    close([r.value for r in geno.kv(data.geno, data.stats, v, data.samples).orderBy("sample_idx").collect()], want)
    for width in (1, 3, 256):
        kernel = data.kernel(width)
        close(kernel.stacked(np.array(Y)[:, None])[0, :, 0], want)
        block = {r.variant_idx: r.score for r in kernel.scores(np.array(Y)[:, None]).collect()}
        close([block[k] for k in range(3)], [score[k] for k in range(3)])
        kernel.close()


def test_kernel_algebra(data):
    z, k = dense(data)
    kernel = data.kernel()
    full = DenseKernel.of(kernel)
    close(full.k[0], k)
    assert np.allclose(full.k[0], full.k[0].T) and np.linalg.eigvalsh(full.k[0]).min() > -1e-9
    q = np.eye(2)[[0, 1, 0, 1, 0, 1]]
    a = DenseKernel.of(AdmixedKernel(kernel, q))
    close(a.k[0] + a.k[1], k * (q @ q.T))
    h = HybridKernel(kernel, full)
    close(h.stacked(np.eye(6))[1], k)
    close(h.mean_diag(), [17 / 18, np.trace(k) / 6])
    w = geno.block_w_kv(data.geno, data.stats, geno.identity_w(data.stats), data.vector(np.array(Y)[:, None]), data.samples, 1 / 3)
    close([r.value for r in w.orderBy("sample_idx").collect()], k @ np.array(Y))
    parts = data.cmap.select((F.col("variant_idx") % 2).cast("int").alias("component_idx"), "variant_idx")
    split = SparkKernel.build(data.geno, data.stats, geno.component_map(parts), 6)
    close(np.einsum("g,gij->ij", split.m_eff, split.stacked(np.eye(6))), 3 * k)
    core = {(r.p, r.q): r.value for r in geno.projected_core(data.geno, data.stats, data.vector(np.eye(6)[:, :2])).collect()}
    close([core[0, 0], core[0, 1], core[1, 1]], [k[0, 0], k[0, 1], k[1, 1]])
    close(kernel.core(np.eye(6)[:, :2])[0], k[:2, :2])


def test_scan(data):
    rows = data.spark.createDataFrame([(s, y, [1.0]) for s, y in enumerate(Y)], "sample_idx long, y double, x array<double>")
    got = gwas.scan(data.geno, data.stats, rows, 1).orderBy("variant_idx").collect()
    want = [(0.33333333, 1.18, 0.50438081, 0.87952007, 0.37594326, 2.33950218, 0.07942160), (0.4, 0.09285714, 0.84563958, 0.06948792, 0.63281871, 0.10980700, 0.91785098), (0.5, -0.275, 0.69510940, -0.22453656, 0.56755445, -0.39562118, 0.71257777)]
    for r, w in zip(got, want):
        close([r.af, r.beta, r.se, r.beta_std, r.se_std, r.t, r.p], w)
    assert all(math.isnan(x) for x in (got[3].beta, got[3].se, got[3].t, got[3].p, got[3].beta_std))


def test_likelihood_effects_and_prediction(data):
    p = Problem(data.y, data.x, data.kernel(), options=Options(method="exact"))
    theta = p.start_theta()
    close(theta, [0.52941176, 0.5])
    e = p.evaluate(theta, 0)
    close([e.loglik], [-0.69159193])
    close(e.score, [0.04391279, 0.29513314])
    close(e.ai, [[0.28246409, 0.32259415], [0.32259415, 1.35011165]])
    close(e.py, [1.74853095, -0.73132001, 1.56204107, -0.65809437, -0.00156416, -1.91959349], 1e-5)
    step = 1e-5
    for k in range(2):
        d = np.eye(2)[k] * step
        close([(p.evaluate(theta + d, 0).loglik - p.evaluate(theta - d, 0).loglik) / (2 * step)], [e.score[k]])
    m = Model(data, Options(method="exact"))
    m.fit()
    m.result.theta = theta
    effects = m.effects()
    b = {r.variant_idx: r.beta for r in effects.snps.collect()}
    close([b[k] for k in range(3)], [0.56614037, 0.11498690, 0.12142732])
    u = [-0.32692231, 0.13519972, 0.88981651, -0.50637134, 0.28885743, -0.48058002]
    close(effects.random[0], u)
    got = m.predict(effects, data.geno, data.samples, data.x).orderBy("sample_idx").collect()
    close([r.random_effect for r in got], u)
    close([r.y_pred for r in got], m.result.y_mean + m.result.y_scale * (effects.fixed[0] + np.array(u)))


def test_invalid_options(data):
    with pytest.raises(ValueError):
        geno.block_ranges([2, 3], 4)
    assert geno.block_ranges([1, 3], 4) == [(0, 0, 1), (1, 1, 4)]
    with pytest.raises(ValueError):
        AdmixedKernel(HybridKernel(data.kernel(), data.kernel()), np.ones((6, 1)))

"""Solvers against dense algebra and closed forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociform.functions import linalg as L
from lociform.plans import lasso, models
from lociform.operators import geno
from lociform.plans.kernels import DenseKernel, SoftKernel, WeightKernel, blocks, pack, unpack
from lociform.plans.krylov import Preconditioner, lanczos, low_rank, pcg, rademacher, slq_logdet
from lociform.plans.reml import Options, Problem, merge_z, replicates
from lociform.sources.specs import weight_table


def spd(n, seed=0):
    a = np.random.default_rng(seed).normal(size=(n, 2 * n))
    return a @ a.T / (2 * n) + 0.2 * np.eye(n)


def test_conjugate_gradients_and_preconditioner():
    a, b = spd(60), np.random.default_rng(1).normal(size=(60, 3))
    x, worst, _ = pcg(lambda v: a @ v, b, tol=1e-9)
    assert worst <= 1e-9 and np.allclose(a @ x, b, atol=1e-6)
    assert pcg(lambda v: a @ v, b, start=x, tol=1e-6)[2] == 0
    k = a - 0.2 * np.eye(60)
    u = low_rank(lambda v: k @ v, 60, 20)
    pre = Preconditioner(u, (u.T @ k @ u)[None], np.array([np.trace(k) / 60]))
    inverse, root, logdet = pre.at(np.array([1.0]), 0.2)
    m = np.linalg.inv(inverse(np.eye(60)))
    assert np.allclose(root(root(np.eye(60))), inverse(np.eye(60))) and abs(logdet - np.linalg.slogdet(m)[1]) < 1e-6
    assert np.allclose(pcg(lambda v: a @ v, b, inverse=inverse, tol=1e-9)[0], x, atol=1e-6)


def test_quadrature():
    a = spd(80)
    quads = lanczos(lambda v: a @ v, rademacher(80, 60, 0), 25)
    for scale, shift in ((1.0, 0.0), (2.0, 0.5)):
        each = [slq_logdet([q], 80, scale, shift) for q in quads]
        want = np.linalg.slogdet(scale * a + shift * np.eye(80))[1]
        assert abs(slq_logdet(quads, 80, scale, shift) - want) < 4 * np.std(each) / math.sqrt(len(each))
    assert np.array_equal(rademacher(10, 3, 1)[:, :2], rademacher(10, 2, 1))


@pytest.mark.parametrize("change,message", [({"h2": 1.0}, "share"), ({"probes": 0}, "positive"), ({"method": "guess"}, "unknown"), ({"tolerances": ()}, "positive")])
def test_arguments_are_checked(change, message):
    with pytest.raises(ValueError, match=message):
        Problem(np.arange(6.0), np.ones((6, 1)), DenseKernel([np.eye(6)]), None, Options(**change))


def test_design_is_checked():
    kernel, y = DenseKernel([np.eye(6)]), np.arange(6.0)
    for x, message in ((np.ones((6, 2)), "depend"), (np.ones((5, 1)), "rows"), (np.full((6, 1), np.nan), "finite"), (np.eye(6), "too few")):
        with pytest.raises(ValueError, match=message):
            Problem(y, x, kernel)


def test_tail_of_t_of_many():
    t = np.concatenate([np.linspace(-40, 40, 401), [0.0, np.nan, 1e-9, 300.0, np.inf]])
    for dof in (1, 2, 7, 96, 5000):
        got = L.t_two_sided_many(t, dof)
        for x, p in zip(t[:-1], got):
            want = L.t_two_sided(float(x), dof)
            assert (np.isnan(want) and np.isnan(p)) or abs(p - want) <= 1e-10 + 1e-8 * want
        assert got[-1] == 0


def test_tail_of_t():
    for t in (0.0, 0.3, 2.0, 9.0):
        assert abs(L.t_two_sided(t, 1) - (1 - 2 * math.atan(t) / math.pi)) < 1e-12
        assert abs(L.t_two_sided(-t, 2) - (1 - t / math.sqrt(2 + t * t))) < 1e-12
    assert 0 < L.t_two_sided(40.0, 500) < 1e-150 and math.isnan(L.t_two_sided(math.nan, 3))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_bounded_least_squares(n, seed):
    r = np.random.default_rng(seed)
    q, c, low = spd(n, seed), r.normal(size=n), -np.abs(r.normal(size=n)) * r.integers(0, 2, n)
    x = L.nnls(q, c, low)
    g = q @ x - c
    assert (x >= low - 1e-9).all() and (g >= -1e-6).all() and np.abs(g * (x - low)).max() < 1e-5


def test_columns_and_scalars():
    a = np.random.default_rng(0).normal(size=(30, 4))
    a = np.concatenate([a, a[:, :1] * 2], 1)
    q, chosen = L.pivoted_qr(a)
    assert q.shape[1] == 4 and np.allclose(q.T @ q, np.eye(4)) and not L.well_conditioned(a.T @ a)
    assert list(L.independent_columns(a[:, :2], a[:, [0, 2, 3]])) == [1, 2]
    assert abs(L.ebic(100, 50, 3, 20.0) + 137.24499584) < 1e-6
    assert np.allclose(L.lambda_path(2, 0.05, 3), [2, 0.4472136, 0.1])
    assert np.allclose(L.spd_solve(spd(5), np.ones(5)), np.linalg.solve(spd(5), np.ones(5)))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.integers(0, 99))
def test_packing(n, m, seed):
    codes = np.random.default_rng(seed).integers(0, 4, (m, n)).astype(np.uint8)
    assert np.array_equal(unpack(pack(codes), m, n), codes)


def test_lasso_conditions():
    r = np.random.default_rng(2)
    z = r.normal(size=(200, 30))
    y = z[:, 3] * 2 - z[:, 7] + r.normal(0, 0.3, 200)
    gram, q = z.T @ z, z.T @ y
    b, settled = lasso.descend(gram, q, 40.0)
    g = q - gram @ b
    assert settled and np.abs(g).max() <= 40.0 + 1e-3 and np.allclose(g[b != 0], 40.0 * np.sign(b[b != 0]), atol=1e-3)
    got = lasso.select(gram, q, float(y @ y), 200, 30)
    assert set(np.flatnonzero(got.beta)) == {3, 7}


def simulate(n=300, m=400, h2=0.6, seed=0):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, m))
    k = z @ z.T / m
    return k, z @ r.normal(0, math.sqrt(h2 / m), m) + r.normal(0, math.sqrt(1 - h2), n)


def test_exact_and_stochastic_fits_agree():
    k, y = simulate()
    x = np.ones((300, 1))
    exact = Problem(y, x, DenseKernel([k]), options=Options(method="exact")).fit()
    assert exact.converged and 0.3 < exact.h2 < 0.9 and np.abs(exact.score).max() < 1e-3
    fast = Problem(y, x, DenseKernel([k]), options=Options(method="stochastic", probes=60, slq_probes=30, slq_steps=30, rank=20)).fit()
    assert abs(fast.h2 - exact.h2) < 0.12
    fits, mean, se = replicates(lambda s: Problem(y, x, DenseKernel([k]), options=Options(method="stochastic", seed=s, probes=20, slq_probes=10, slq_steps=20)), 3)
    assert len(fits) == 3 and abs(mean[0] - exact.theta[0]) < 6 * se[0] + 0.1
    se, z = merge_z(exact, 300)
    assert z[0] > 2 and se[0] > 0
    two = Problem(y, x, DenseKernel([k, spd(300, 5)]), options=Options(method="exact", optimizer="scoring")).fit()
    assert two.theta[0] > 0 and two.theta[1] >= 0


@pytest.fixture(scope="module")
def cohort(spark):
    r = np.random.default_rng(3)
    g = r.binomial(2, r.uniform(0.1, 0.5, 24), (90, 24))
    z = (g - g.mean(0)) / g.std(0)
    y = 1.5 * z[:, 4] - 1.2 * z[:, 10] + z @ r.normal(0, 0.1, 24) + r.normal(0, 0.7, 90)
    cells = [(int(s), int(v), int(g[s, v])) for s, v in zip(*np.nonzero(g))]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    variants = frame([(v,) for v in range(24)], "variant_idx long")
    return models.Data(spark, frame(cells, "sample_idx long, variant_idx long, dosage byte"), variants, frame([(s, str(s)) for s in range(90)], "sample_idx long, iid string"), y, np.ones((90, 1)), variants.select((F.col("variant_idx") % 3).cast("int").alias("component_idx"), "variant_idx"))


def test_sparse_selection(cohort):
    one = models.Data(cohort.spark, cohort.geno, cohort.variants, cohort.samples, cohort.y, cohort.x, cohort.components.withColumn("component_idx", F.lit(0)))
    got = models.sparse(one, Options(method="exact"), models.SparseOptions(outer=2, screen=6, candidates=6))
    assert {4, 10} <= set(got.support) and 0 < got.h2 < 1 and 0 < got.h2_gls < 1


def test_merge_and_relax(cohort):
    got = models.merge(cohort, Options(method="exact"), cutoff=100.0)
    assert got.components.select("component_idx").distinct().count() == 1 and got.second is not None and len(got.z) == 3
    start = np.full((24, 2), 0.5)
    start[::2, 0] = 0.7
    out = models.relax(cohort, start, rate=50.0, outers=1, options=Options(method="exact"))
    assert np.allclose(out.theta.sum(1), 1) and out.history[-1]["loglik"] >= out.history[0]["loglik"]


def test_kernels_with_weights_against_dense(cohort):
    one = cohort.components.select(F.lit(0).alias("component_idx"), "variant_idx")
    z = cohort.columns(list(range(24)))
    w = np.random.default_rng(2).uniform(0.1, 1, (24, 2))
    w /= w.sum(1, keepdims=True)
    rows = cohort.spark.createDataFrame([(v, k, float(w[v, k])) for v in range(24) for k in range(2)], "variant_idx long, group_idx int, w double")
    table = blocks(cohort.geno, cohort.stats, geno.component_map(one), cohort.n, 7)
    soft = SoftKernel.build(table, cohort.stats, rows, cohort.n, 2)
    dense = [(z * w[:, k]) @ z.T / w[:, k].sum() for k in range(2)]
    assert np.allclose(DenseKernel.of(soft).k, dense) and np.allclose(soft.mean_diag(), [np.trace(k) / 90 for k in dense])
    a = np.random.default_rng(4).normal(size=(24, 24))
    matrices = [np.eye(15) + 0.02 * (a + a.T)[:15, :15], np.eye(9)]
    kernel = WeightKernel.build(cohort.geno, cohort.stats, weight_table(cohort.spark, matrices), cohort.n)
    full = z[:, :15] @ matrices[0] @ z[:, :15].T + z[:, 15:] @ z[:, 15:].T
    assert np.allclose(DenseKernel.of(kernel).k[0], full / (np.trace(full) / 90)) and np.allclose(kernel.mean_diag(), 1)


def test_gradient_of_weights_against_dense(cohort):
    r = np.random.default_rng(2)
    z, signs, theta = cohort.columns(list(range(24))), rademacher(90, 64, 0), np.array([0.4, 0.2, 0.5])
    w = r.uniform(0.1, 1, (24, 2))
    w /= w.sum(1, keepdims=True)
    rows = cohort.spark.createDataFrame([(v, k, float(w[v, k])) for v in range(24) for k in range(2)], "variant_idx long, group_idx int, w double")
    table = blocks(cohort.geno, cohort.stats, geno.component_map(cohort.components.select(F.lit(0).alias("component_idx"), "variant_idx")), cohort.n, 24)
    kernel = SoftKernel.build(table, cohort.stats, rows, cohort.n, 2)
    problem = Problem(cohort.y, cohort.x, kernel, None, Options(method="stochastic", probes=1, slq_probes=1, slq_steps=2, tolerances=(1e-7,)))
    got = np.zeros((24, 2))
    for row in models.weight_gradient(rows, theta, problem, signs).collect():
        got[row.variant_idx, row.group_idx] = row.grad
    k = np.stack([(z * w[:, g]) @ z.T / w[:, g].sum() for g in range(2)])
    hi = np.linalg.inv(np.einsum("g,gij->ij", theta[:2], k) + theta[2] * np.eye(90))
    p = hi - np.outer(hi.sum(1), hi.sum(1)) / hi.sum()
    py, ps = p @ problem.y, p @ signs
    own = (z.T @ py) ** 2 - ((z.T @ signs) * (z.T @ ps)).mean(1)
    shared = np.array([py @ m @ py - (signs * (m @ ps)).sum() / 64 for m in k])
    assert np.allclose(got, theta[:2] * (own[:, None] - shared) / (2 * w.sum(0)), rtol=1e-4, atol=1e-5)

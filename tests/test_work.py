"""What stochastic fits cost, in counted products, and that cheaper ways reach the same place."""

import numpy as np
import pytest

from lociform.plans import krylov, models
from lociform.plans.kernels import DenseKernel
from lociform.plans.reml import Options, Problem, check_rank


class Counting(DenseKernel):
    def __init__(self, matrices):
        super().__init__(matrices)
        self.seen = 0

    def stacked(self, v):
        self.seen += 1
        return super().stacked(v)

    def weighted(self, theta, v):
        self.seen += 1
        return np.einsum("g,gij,jc->ic", theta, self.k, v)


def two_kernels(n=220, seed=1):
    r = np.random.default_rng(seed)
    za, zb = r.normal(size=(n, 30)), r.normal(size=(n, 400))
    y = za @ r.normal(0, np.sqrt(0.5 / 30), 30) + zb @ r.normal(0, np.sqrt(0.2 / 400), 400) + r.normal(0, np.sqrt(0.3), n)
    return [za @ za.T / 30, zb @ zb.T / 400], y


def options(**more):
    return Options(method="stochastic", probes=80, slq_probes=20, slq_steps=20, tolerances=(1e-6,), iterations=30, **more)


def test_scoring_carries_the_log_determinant():
    k, y = two_kernels()
    x = np.ones((len(y), 1))
    strict = Problem(y, x, DenseKernel(k), options=Options(method="exact")).fit()
    counted = {}
    for share in (0.0, 0.05):
        kernel = Counting(k)
        p = Problem(y, x, kernel, options=options(optimizer="scoring", first_order=share))
        fit = p.fit()
        counted[share] = (kernel.seen, p.work.quadratures, fit)
        assert p.work.products == kernel.seen and fit.converged
    (seen_all, quadratures_all, whole), (seen, quadratures, carried) = counted[0.0], counted[0.05]
    assert quadratures < quadratures_all and seen <= seen_all - (quadratures_all - quadratures)
    assert np.allclose(whole.theta, carried.theta, rtol=1e-6) and abs(whole.loglik - carried.loglik) < 2e-3
    assert np.abs(carried.theta - strict.theta).max() < 0.15  # the probes' error; both solve the same equations


def test_carried_value_is_second_order():
    k, y = two_kernels()
    p = Problem(y, np.ones((len(y), 1)), DenseKernel(k), options=options(optimizer="scoring"))
    a, slopes = np.concatenate([p.kernel.k, np.eye(len(y))[None]]), {}
    h = lambda t: np.einsum("g,gij->ij", t, a)
    exact = lambda t: np.linalg.slogdet(h(t))[1]
    slope = lambda t: np.array([np.trace(np.linalg.solve(h(t), m)) for m in a])
    start, end = np.array([0.5, 0.2, 0.3]), np.array([0.51, 0.205, 0.295])
    p.known = (start, exact(start), slope(start))
    assert abs(p._logdet(end, slope(end), None, None, 0.0) - exact(end)) < 0.02 * abs(exact(end) - exact(start))
    assert p.known[0] is start  # the place of the last quadrature stays


def test_one_component_takes_its_core_from_ritz_values():
    k, y = two_kernels()
    kernel = Counting(k[:1])
    p = Problem(y, np.ones((len(y), 1)), kernel, options=options(rank=20))
    before = kernel.seen
    pre = p._precondition(p.start_theta())
    assert kernel.seen - before == 2 and np.allclose(pre.cores[0], pre.u.T @ k[0] @ pre.u, atol=1e-8)
    p._precondition(np.array([5.0, 0.1]))
    assert kernel.seen - before == 2  # one component never needs another basis
    several = Problem(y, np.ones((len(y), 1)), Counting(k), options=options(rank=20))
    before = several.kernel.seen
    several._precondition(several.start_theta())
    assert several.kernel.seen - before == 3


def test_preconditioner_is_built_anew_after_a_far_move():
    r = np.random.default_rng(5)
    n = 200
    a, b = np.linalg.qr(r.normal(size=(n, 15)))[0], np.linalg.qr(r.normal(size=(n, 15)))[0]
    k, y = [a @ a.T * n / 15 * 20, b @ b.T * n / 15 * 20], r.normal(size=n)
    near, far = np.array([1.0, 0.001, 0.01]), np.array([0.001, 1.0, 0.01])
    steps = {}
    for refresh in (0.2, 10.0):
        p = Problem(y, np.ones((n, 1)), DenseKernel(k), options=options(rank=15, refresh=refresh))
        p.evaluate(near, 1e-6)
        p.evaluate(near * [1.05, 1.0, 1.0], 1e-6)
        assert p.work.bases == 1
        before = p.work.steps
        p.warm = None
        p.evaluate(far, 1e-6)
        steps[refresh] = (p.work.steps - before, p.work.bases)
    assert steps[0.2][1] == 2 and steps[10.0][1] == 1 and steps[0.2][0] < steps[10.0][0]


def test_ritz_values_are_the_core():
    k, _ = two_kernels()
    u, values = krylov.ritz(lambda v: k[1] @ v, len(k[1]), 12)
    assert np.allclose(u.T @ k[1] @ u, np.diag(values), atol=1e-9)


def test_design_rank_by_scaled_eigenvalues():
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 3))
    check_rank(x * [1.0, 1e-9, 1e9])  # units do not matter
    for bad in (np.c_[x, x[:, 0] + 1e-9 * x[:, 1]], np.c_[x, np.zeros(50)], np.c_[x, x.sum(1)]):
        with pytest.raises(ValueError, match="depend"):
            check_rank(bad)



@pytest.mark.parametrize("rounds,refits,outer", [(1, 2, 2), (2, 2, 3), (3, 2, 4)])
def test_repeated_support_skips_refits(spark, monkeypatch, rounds, refits, outer):
    """The second refit finds components at rest under the same support; rounds after it are not refitted."""
    r = np.random.default_rng(3)
    g = r.binomial(2, r.uniform(0.1, 0.5, 10), (60, 10))
    z = (g - g.mean(0)) / g.std(0)
    y = 1.5 * z[:, 4] + r.normal(0, 0.6, 60)
    cells = [(int(s), int(v), int(g[s, v])) for s, v in zip(*np.nonzero(g))]
    frame = spark.createDataFrame
    variants = frame([(v,) for v in range(10)], "variant_idx long")
    data = models.Data(spark, frame(cells, "sample_idx long, variant_idx long, dosage byte"), variants, frame([(s, str(s)) for s in range(60)], "sample_idx long, iid string"), y, np.ones((60, 1)), variants.selectExpr("0 as component_idx", "variant_idx"))
    fits = []
    fit = Problem.fit
    monkeypatch.setattr(Problem, "fit", lambda self: fits.append(fit(self)) or fits[-1])
    got = models.sparse(data, Options(method="exact"), models.SparseOptions(outer=8, screen=4, candidates=4, active=4, still_rounds=rounds))
    assert 4 in got.support and len(got.history) == outer and len(fits) == refits
    assert [h["refit"] for h in got.history] == [True] * refits + [False] * (outer - refits)
    data.close()


def test_streamed_soft_grouping_whole(spark, tmp_path):
    """A whole run over the blocks of a file: weights stay a distribution, and what is taken is no worse under the same probes."""
    from lociform.sources import bed

    r = np.random.default_rng(12)
    g = r.binomial(2, 0.4, (12, 40)).astype(np.uint8)
    bed.write_bed(str(tmp_path / "s.bed"), g)
    z = (g - g.mean(1, keepdims=True)) / g.std(1, keepdims=True)
    y = z[:4].T @ r.normal(0, 0.6, 4) + r.normal(0, 0.5, 40)
    people = spark.createDataFrame([(k, f"i{k}") for k in range(40)], "sample_idx long, iid string")
    aligned = spark.createDataFrame([(k, f"i{k}", float(y[k]), [1.0]) for k in range(40)], "sample_idx long, iid string, y double, x array<double>")
    variants = spark.range(12).withColumnRenamed("id", "variant_idx")
    data = models.Data.of_bed(spark, str(tmp_path / "s.bed"), people, variants, aligned, variants.selectExpr("0 as component_idx", "variant_idx"))
    start = spark.createDataFrame([(v, k, 0.7 if k == (v >= 4) else 0.3) for v in range(12) for k in range(2)], "variant_idx long, group_idx int, w double")
    o = Options(probes=8, slq_probes=4, slq_steps=6, iterations=3, rank=12, tolerances=(1e-3,))
    got = models.relax_streamed(data, start, 2, rate=5.0, outers=1, trials=1, probes=8, options=o)
    rows = got.weights.collect()
    sums = {}
    for row in rows:
        sums[row.variant_idx] = sums.get(row.variant_idx, 0.0) + row.w
    assert len(rows) == 24 and np.allclose(list(sums.values()), 1) and len(got.history) == 2
    assert got.history[1]["loglik"] >= got.history[0]["loglik"] and (got.fit.theta >= 0).all()
    changed = max(abs(row.w - (0.7 if row.group_idx == (row.variant_idx >= 4) else 0.3)) for row in rows)
    assert (changed > 1e-6) == got.history[1]["taken"]
    data.close()

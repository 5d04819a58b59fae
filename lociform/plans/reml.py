"""Restricted maximum likelihood for variance components, exact or by stochastic probes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.linalg import limit_threads, logdet_spd, nnls, spd_solve
from .kernels import DenseKernel, Kernel
from .krylov import Preconditioner, lanczos, pcg, rademacher, ritz, slq_logdet


@dataclass
class Options:
    method: str = "auto"  # exact, stochastic, or exact up to ``exact_up_to`` samples
    exact_up_to: int = 4096
    h2: float = 0.5
    iterations: int = 50
    probes: int = 100
    slq_probes: int = 4
    slq_steps: int = 8
    tolerances: tuple[float, ...] = (1e-2, 5e-3, 1e-3)
    pcg_iterations: int = 400
    rank: int = 0
    floor: float = 1e-2  # of residual components
    zero: float = 1e-8
    seed: int = 0
    optimizer: str = "strict"  # or "scoring": one trial a step, downhill allowed
    scoring_tol: float = 1e-4
    first_order: float = 0.05  # share of the variance that may move before scoring takes the log determinant anew
    solve_tol: float = 1e-3  # of the solves behind effects
    refresh: float = 0.2  # share of the genetic variance that may move between components before the preconditioner is built anew


@dataclass
class Fit:
    theta: np.ndarray  # genetic, then residual
    loglik: float
    score: np.ndarray
    ai: np.ndarray
    h2: float
    converged: bool
    history: list[dict] = field(default_factory=list)
    y_mean: float = 0.0
    y_scale: float = 1.0


@dataclass
class _Evaluation:
    loglik: float
    score: np.ndarray
    ai: np.ndarray
    py: np.ndarray


def _validate(o: Options, y: np.ndarray, x: np.ndarray) -> None:
    """Arguments that no fit can do with."""
    if o.method not in ("auto", "exact", "stochastic") or o.optimizer not in ("strict", "scoring"):
        raise ValueError("unknown method or optimizer")
    if not 0 < o.h2 < 1:
        raise ValueError("the first share of variance lies between 0 and 1")
    if min(o.iterations, o.probes, o.slq_probes, o.slq_steps, o.pcg_iterations) < 1 or o.rank < 0 or not o.tolerances or min(o.tolerances) <= 0:
        raise ValueError("counts and tolerances must be positive")
    if o.first_order < 0 or o.refresh < 0:
        raise ValueError("shares that may move are not negative")
    if y.ndim != 1 or x.ndim != 2 or len(x) != len(y):
        raise ValueError("the response and the design differ in their rows")
    if not (np.isfinite(y).all() and np.isfinite(x).all()):
        raise ValueError("the response and the design must be finite")
    check_rank(x)
    if len(y) <= x.shape[1]:
        raise ValueError("too few samples for the design")


#: Least ratio of the smallest to the largest eigenvalue of a design's normalised cross products.
RANK_RATIO = 1e-10


def check_rank(x: np.ndarray) -> None:
    """Raises where columns of a design depend on each other: they are scaled to length 1 first, so units don't matter."""
    size = np.linalg.norm(x, axis=0)
    if (size == 0).any():
        raise ValueError("a column of the design is zero: columns depend on each other")
    if x.shape[1]:
        values = np.linalg.eigvalsh((x / size).T @ (x / size))
        if values[0] <= RANK_RATIO * values[-1]:
            raise ValueError("columns of the design depend on each other")


@dataclass
class Work:
    """What a stochastic fit has cost: products with the kernel, the columns in them, and runs of each part."""

    products: int = 0
    columns: int = 0
    quadratures: int = 0
    steps: int = 0  # of conjugate gradients
    bases: int = 0


@dataclass
class Whole:
    """What the coordinates of a standardised response leave out: samples, mean, scale, and the coordinates of random signs."""

    n: int
    mean: float
    scale: float
    probes: np.ndarray | None = None
    start: np.ndarray | None = None


class Problem:
    """One response, its fixed effects, a kernel, and residual kernels that are diagonal."""

    def __init__(self, y: np.ndarray, x: np.ndarray, kernel: Kernel, residual: np.ndarray | None = None, options: Options | None = None, whole: Whole | None = None):
        limit_threads()
        self.o = options or Options()
        self.x, self.n, self.whole = x, whole.n if whole else len(y), whole
        _validate(self.o, y, x)
        if whole:
            if residual is not None:
                raise ValueError("coordinates of a span go with one residual component, the identity")
            self.mean, self.scale, self.y, residual = whole.mean, whole.scale, y, np.ones((1, len(y)))
        else:
            self.mean, self.scale = float(y.mean()), float(y.std() + 1e-6)
            self.y = (y - self.mean) / self.scale
        self.r = np.ones((1, self.n)) if residual is None else residual  # components x n
        exact = self.o.method == "exact" or (self.o.method == "auto" and len(y) <= self.o.exact_up_to)
        self.kernel = DenseKernel.of(kernel) if exact and not isinstance(kernel, DenseKernel) else kernel
        self.exact, self.source = exact, kernel
        self.atoms = np.concatenate([kernel.mean_diag(), self.r.mean(1)])
        self.g = kernel.size
        self.work = Work()
        if not exact:
            self.z = whole.probes if whole else rademacher(self.n, self.o.probes, self.o.seed)
            self.kz = np.concatenate([self._stacked(self.z), self.r[:, :, None] * self.z[None]])
            start = whole.start if whole else rademacher(self.n, self.o.slq_probes, self.o.seed + 1)
            if self.g == 1 and len(self.r) == 1 and (self.r == 1).all():
                self.affine = self._spectrum(self.z) if whole else self._quadrature(lambda v: self._stacked(v)[0], start)
            else:
                self.affine = None
            self.start = start
            self.pre: Preconditioner | None = None
            self.known: tuple[np.ndarray, float, np.ndarray] | None = None  # theta, log determinant and its gradient there
            self.warm: np.ndarray | None = None
            self.warm_ai: np.ndarray | None = None

    def _stacked(self, v: np.ndarray) -> np.ndarray:
        self.work.products, self.work.columns = self.work.products + 1, self.work.columns + v.shape[1]
        return self.kernel.stacked(v)

    def _quadrature(self, apply, start: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        self.work.quadratures += 1
        return lanczos(apply, start, self.o.slq_steps)

    def _spectrum(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Exact quadratures on coordinates: with the probes of the traces, the likelihood's gradient is the score that they give."""
        self.work.quadratures += 1
        values, vectors = np.linalg.eigh(self._stacked(np.eye(len(self.y)))[0])
        weights = (vectors.T @ v / np.linalg.norm(v, axis=0)) ** 2
        return [(values, w) for w in weights.T]

    def _precondition(self, theta: np.ndarray) -> Preconditioner | None:
        """A basis of the weighted kernel and every component's core in it.

        One component's core is its Ritz values.  Several need a product more,
        and all is built anew once the components' shares of the variance have
        moved by ``refresh``; warm starts stay.
        """
        own = theta[: self.g] * self.atoms[: self.g]
        if not self.o.rank or not own.sum() > 0:
            return self.pre
        share = own / own.sum()
        if self.pre is not None and (self.g == 1 or 0.5 * np.abs(share - self.pre_share).sum() <= self.o.refresh):
            return self.pre
        weights = share / np.where(self.atoms[: self.g] > 0, self.atoms[: self.g], 1)

        def weighted(v: np.ndarray) -> np.ndarray:
            return np.einsum("g,gnc->nc", weights, self._stacked(v))

        u, values = ritz(weighted, len(self.y), self.o.rank, self.o.seed)
        core = np.diag(values / weights[0])[None] if self.g == 1 else np.einsum("nk,gnl->gkl", u, self._stacked(u))
        self.work.bases += 1
        self.pre, self.pre_share = Preconditioner(u, core, self.kernel.mean_diag(), self.n), share
        return self.pre

    def start_theta(self) -> np.ndarray:
        """The first guess spreads ``h2`` and its rest by traces."""
        own = self.atoms[: self.g] > 0
        theta = np.zeros(len(self.atoms))
        theta[: self.g][own] = self.o.h2 / self.atoms[: self.g].sum()
        theta[self.g :] = (1 - self.o.h2) / self.atoms[self.g :].sum()
        return theta

    def h2(self, theta: np.ndarray) -> float:
        part = theta * self.atoms
        return float(part[: self.g].sum() / part.sum())

    def hv(self, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        self.work.products, self.work.columns = self.work.products + 1, self.work.columns + v.shape[1]
        return self.kernel.weighted(theta[: self.g], v) + (theta[self.g :] @ self.r)[:, None] * v

    def products(self, v: np.ndarray) -> np.ndarray:
        """``A_i v`` of all components, genetic and residual: components x n."""
        return np.concatenate([self._stacked(v[:, None])[:, :, 0], self.r * v[None]])

    def evaluate(self, theta: np.ndarray, tol: float) -> _Evaluation:
        return self._exact(theta) if self.exact else self._stochastic(theta, tol)

    def _exact(self, theta: np.ndarray) -> _Evaluation:
        a = np.concatenate([self.kernel.k, np.stack([np.diag(r) for r in self.r])])
        h = np.einsum("g,gij->ij", theta, a)
        hi = np.linalg.inv(h)
        hx = hi @ self.x
        xhx = self.x.T @ hx
        p = hi - hx @ np.linalg.solve(xhx, hx.T)
        py = p @ self.y
        ay = a @ py
        n, rest = self.n, self.n - len(self.y)  # outside a span H is its residual part alone
        traces = np.einsum("ij,gji->g", p, a)
        traces[-1] += rest / theta[-1] if rest else 0.0
        outside = rest * np.log(theta[-1]) if rest else 0.0
        loglik = -0.5 * (self.y @ py + logdet_spd(h) + outside + logdet_spd(xhx)) / n
        score = 0.5 * (ay @ py - traces) / n
        return _Evaluation(float(loglik), score, 0.5 * (ay @ p @ ay.T) / n, py)

    def _stochastic(self, theta: np.ndarray, tol: float) -> _Evaluation:
        n, o = self.n, self.o
        hv = lambda v: self.hv(theta, v)
        pre = self._precondition(theta)
        inverse, root, log_m = (None, None, 0.0) if pre is None else pre.at(theta[: self.g], float(theta[self.g :] @ self.r.mean(1)))
        rhs = np.concatenate([self.x, self.y[:, None], self.z], 1)
        sol, worst, steps = pcg(hv, rhs, self.warm, inverse, tol, o.pcg_iterations)
        if worst > 1.05 * tol:
            raise RuntimeError(f"conjugate gradients stopped at {worst:.2e}, asked for {tol:.2e}")
        self.warm = sol
        self.work.steps += steps
        k = self.x.shape[1]
        hx, hy, hz = sol[:, :k], sol[:, k], sol[:, k + 1 :]
        xhx = self.x.T @ hx
        fix = lambda hv_, xv: hv_ - hx @ spd_solve(xhx, xv)
        py = fix(hy, hx.T @ self.y)
        pz = fix(hz, hx.T @ self.z)
        traces = np.einsum("nr,gnr->g", pz, self.kz) / o.probes
        ay = self.products(py).T
        hay, worst, _ = pcg(hv, ay, self.warm_ai, inverse, tol, o.pcg_iterations)
        if worst > 1.05 * tol:
            raise RuntimeError(f"conjugate gradients stopped at {worst:.2e}, asked for {tol:.2e}")
        self.warm_ai = hay
        pay = fix(hay, hx.T @ ay)
        logdet = self._logdet(theta, np.einsum("nr,gnr->g", hz, self.kz) / o.probes, hv, root, log_m)
        loglik = -0.5 * (self.y @ py + logdet + logdet_spd(xhx)) / n
        ai = 0.5 * (ay.T @ pay) / n
        return _Evaluation(float(loglik), 0.5 * (ay.T @ py - traces) / n, (ai + ai.T) / 2, py)

    def _logdet(self, theta: np.ndarray, slope: np.ndarray, hv, root, log_m: float) -> float:
        """Log determinant of H, whose gradient at ``theta`` is ``slope``, the traces of ``H^-1 A_i``.

        Scoring carries the last quadrature's value over small steps by the mean
        of the gradients at both ends, which the probes give in any case.
        """
        if self.affine is not None:
            return slq_logdet(self.affine, self.n, theta[0], theta[1])
        if self.o.optimizer == "scoring" and self.known is not None:
            there, value, before = self.known
            if np.abs((theta - there) * self.atoms).sum() <= self.o.first_order * (there * self.atoms).sum():
                return value + 0.5 * float((before + slope) @ (theta - there))
        if root is not None:
            value = log_m + slq_logdet(self._quadrature(lambda v: root(hv(root(v))), self.start), self.n)
        else:
            value = slq_logdet(self._quadrature(hv, self.start), self.n)
        self.known = (theta.copy(), value, slope)
        return value

    def floors(self) -> np.ndarray:
        return np.concatenate([np.zeros(self.g), np.full(len(self.r), self.o.floor)])

    def step(self, theta: np.ndarray, e: _Evaluation) -> np.ndarray:
        """Newton step with average information under the bounds."""
        q = e.ai + 1e-4 * np.trace(e.ai) / len(e.ai) * np.eye(len(e.ai))
        new = nnls(q, e.score + q @ theta, self.floors())
        return new - theta

    def project(self, theta: np.ndarray) -> np.ndarray:
        out = np.maximum(theta, self.floors())
        out[: self.g][out[: self.g] <= self.o.zero] = 0.0
        return out

    def gradient_norm(self, theta: np.ndarray, score: np.ndarray) -> float:
        bound = (theta <= self.floors() + self.o.zero) & (score <= 0)
        return float(np.abs(np.where(bound, 0.0, score)).max())

    def fit(self) -> Fit:
        o = self.o
        theta = self.project(self.start_theta())
        e = self.evaluate(theta, o.tolerances[0])
        history, converged = [], False
        for k in range(o.iterations):
            tol = o.tolerances[min(k, len(o.tolerances) - 1)]
            full, accepted = self.step(theta, e), False
            for trial in range(3 if o.optimizer == "strict" else 1):
                new = self.project(theta + 0.5**trial * full)
                f = self.evaluate(new, tol)
                if o.optimizer != "strict" or f.loglik >= e.loglik - 1e-12:
                    accepted = True
                    break
            if not accepted:
                converged = self.gradient_norm(theta, e.score) < 1e-3
                break
            moved = float((np.abs(new - theta) / np.maximum(np.abs(theta), 1e-8)).max())
            gain = abs(f.loglik - e.loglik) / max(abs(e.loglik), 1e-12)
            theta, e = new, f
            grad = self.gradient_norm(theta, e.score)
            history.append({"iteration": k, "loglik": e.loglik, "gradient": grad, "step": 0.5**trial, "moved": moved, "theta": theta.tolist()})
            tight = tol == o.tolerances[-1] or self.exact
            if o.optimizer == "strict":
                converged = tight and gain < 1e-3 and (grad < 1e-4 or moved < 1e-4)
            else:
                converged = moved < o.scoring_tol
            if converged:
                break
        return Fit(theta, e.loglik, e.score, e.ai, self.h2(theta), converged, history, self.mean, self.scale)

    def solve(self, theta: np.ndarray, b: np.ndarray, tol: float) -> np.ndarray:
        """``H^-1 b``: exactly, or by conjugate gradients that must reach ``tol``."""
        if self.exact:
            return np.linalg.solve(np.einsum("g,gij->ij", theta[: self.g], self.kernel.k) + np.diag(theta[self.g :] @ self.r), b)
        pre = self._precondition(theta)
        inverse = pre.at(theta[: self.g], float(theta[self.g :] @ self.r.mean(1)))[0] if pre else None
        x, worst, _ = pcg(lambda v: self.hv(theta, v), b, None, inverse, tol, self.o.pcg_iterations)
        if worst > 1.05 * tol:
            raise RuntimeError(f"conjugate gradients stopped at {worst:.2e}, asked for {tol:.2e}")
        return x

    def projected_response(self, theta: np.ndarray, tol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``P y`` and the fixed effects at ``theta``."""
        sol = self.solve(theta, np.concatenate([self.x, self.y[:, None]], 1), tol or self.o.solve_tol)
        k = self.x.shape[1]
        beta = spd_solve(self.x.T @ sol[:, :k], self.x.T @ sol[:, k])
        return sol[:, k] - sol[:, :k] @ beta, beta


def replicates(make, count: int, seed: int = 0) -> tuple[list[Fit], np.ndarray, np.ndarray]:
    """Fits with different probe seeds; their mean and Monte-Carlo standard error."""
    fits = [make(seed + 9973 * r).fit() for r in range(count)]
    theta = np.stack([f.theta for f in fits])
    se = np.sqrt(((theta - theta.mean(0)) ** 2).sum(0) / max(count * (count - 1), 1))
    return fits, theta.mean(0), se


def merge_z(fit: Fit, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Standard errors and z-scores of the genetic components; there must be one residual component."""
    ai = fit.ai * n
    ai = ai + 1e-8 * np.trace(ai) / len(ai) * np.eye(len(ai))
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(ai)), 0, None))
    z = np.where(se > 0, fit.theta / np.where(se > 0, se, 1), 0.0)
    return se[:-1], z[:-1]

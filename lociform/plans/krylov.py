"""Krylov methods over kernel products: conjugate gradients, Lanczos quadrature, low-rank preconditioning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Apply = Callable[[np.ndarray], np.ndarray]


def pcg(apply: Apply, b: np.ndarray, start: np.ndarray | None = None, inverse: Apply | None = None, tol: float = 1e-3, most: int = 400, every: int = 2) -> tuple[np.ndarray, float, int]:
    """Conjugate gradients for many right-hand sides at once; each product covers all of them.

    Returns the solution, the largest relative residual and the iterations; a
    warm start that is good enough returns at once.
    """
    inverse = inverse or (lambda r: r)
    x = np.zeros_like(b) if start is None else start.copy()
    r = b - apply(x) if start is not None else b.copy()
    size = np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    worst = float((np.linalg.norm(r, axis=0) / size).max(initial=0.0))
    if worst <= tol:
        return x, worst, 0
    z = inverse(r)
    p, rz = z.copy(), (r * z).sum(0)
    for k in range(1, most + 1):
        ap = apply(p)
        alpha = _ratio(rz, (p * ap).sum(0))
        x += alpha * p
        r -= alpha * ap
        if k % every == 0 or k == most:
            worst = float((np.linalg.norm(r, axis=0) / size).max())
            if worst <= tol:
                return x, worst, k
        z = inverse(r)
        new = (r * z).sum(0)
        p = z + _ratio(new, rz) * p
        rz = new
    return x, worst, most


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quotients, 0 where a column has converged to the last digit."""
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def lanczos(apply: Apply, start: np.ndarray, steps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tridiagonal matrices of each column's Krylov space, as eigenvalues and squared first components."""
    n, c = start.shape
    q = start / np.linalg.norm(start, axis=0)
    before, beta = np.zeros_like(q), np.zeros(c)
    alphas, betas, basis = [], [], [q]
    for _ in range(min(steps, n)):
        w = apply(q) - beta * before
        alpha = (q * w).sum(0)
        w -= alpha * q
        for u in basis:
            w -= (u * w).sum(0) * u
        beta = np.linalg.norm(w, axis=0)
        alphas.append(alpha)
        betas.append(beta)
        before, q = q, w / np.maximum(beta, 1e-12)
        basis.append(q)
    out = []
    for k in range(c):
        length = next((i + 1 for i, b in enumerate(betas) if b[k] < 1e-10), len(alphas))
        t = np.diag([a[k] for a in alphas[:length]]) + np.diag([b[k] for b in betas[: length - 1]], 1) + np.diag([b[k] for b in betas[: length - 1]], -1)
        values, vectors = np.linalg.eigh(t)
        out.append((values, vectors[0] ** 2))
    return out


def slq_logdet(quadratures: list[tuple[np.ndarray, np.ndarray]], n: int, scale: float = 1.0, shift: float = 0.0) -> float:
    """Log determinant of ``scale * A + shift * I`` from quadratures of A."""
    each = []
    for values, weights in quadratures:
        values = scale * values + shift
        floor = max(np.finfo(float).eps * values.max(), 1e-6)
        each.append(n * float(weights @ np.log(np.maximum(values, floor))))
    return float(np.mean(each))


def rademacher(n: int, columns: int, seed: int) -> np.ndarray:
    """Signs keyed by (seed, column), whatever the partitioning."""
    return np.stack([np.random.default_rng([seed, k]).integers(0, 2, n) * 2.0 - 1.0 for k in range(columns)], 1)


def low_rank(apply: Apply, n: int, rank: int, seed: int = 0, extra: int = 8) -> np.ndarray:
    """Basis of the leading eigenvectors by a Gaussian sketch: two products."""
    return ritz(apply, n, rank, seed, extra)[0]


def ritz(apply: Apply, n: int, rank: int, seed: int = 0, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``low_rank`` and its Ritz values, which are ``U' A U`` without another product."""
    rank = min(rank, n)
    sketch = np.random.default_rng([seed, 99]).normal(size=(n, min(rank + extra, n)))
    q, _ = np.linalg.qr(apply(sketch))
    values, vectors = np.linalg.eigh(q.T @ apply(q))
    order = np.argsort(values)[::-1][:rank]
    return q @ vectors[:, order], values[order]


@dataclass
class Preconditioner:
    """``M = d I + U (sum theta C) U'`` with ``C_g = U' K_g U - a_g I``."""

    u: np.ndarray
    cores: np.ndarray
    atoms: np.ndarray
    n: int | None = None  # samples, where ``u`` holds coordinates of a span

    def at(self, theta: np.ndarray, residual: float) -> tuple[Apply, Apply, float]:
        """Inverse, inverse square root and log determinant."""
        d = max(float(theta @ self.atoms) + residual, 1e-8)
        core = np.einsum("g,gij->ij", theta, self.cores - self.atoms[:, None, None] * np.eye(self.u.shape[1]))
        values, vectors = np.linalg.eigh(core)
        values = np.maximum(values + d, 1e-8)
        w = self.u @ vectors

        def power(p: float) -> Apply:
            return lambda r: d**p * r + w @ ((values**p - d**p)[:, None] * (w.T @ r))

        return power(-1.0), power(-0.5), ((self.n or len(self.u)) - len(values)) * np.log(d) + float(np.log(values).sum())

"""Small dense algebra on the driver, in double precision; numpy only."""

from __future__ import annotations

import ctypes
import math
from pathlib import Path

import numpy as np


def limit_threads(most: int = 2) -> None:
    """Threads of numpy's own linear algebra library on the driver; as many as cores stall each other beside a busy JVM."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("libscipy_openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(most)


def spd_solve(a: np.ndarray, b: np.ndarray, tries: int = 8) -> np.ndarray:
    """Solves ``a x = b`` for a symmetric positive matrix; a growing ridge helps where rounding broke it."""
    scale = float(np.trace(a)) / max(len(a), 1) or 1.0
    for k in range(tries):
        try:
            c = np.linalg.cholesky(a + (0.0 if k == 0 else 1e-6 * scale * 10 ** (k - 1)) * np.eye(len(a)))
        except np.linalg.LinAlgError:
            continue
        return np.linalg.solve(c.T, np.linalg.solve(c, b))
    return np.linalg.lstsq(a, b, rcond=None)[0]


def logdet_spd(a: np.ndarray) -> float:
    return float(np.linalg.slogdet(a)[1])


def nnls(q: np.ndarray, c: np.ndarray, lower: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Least ``x'qx/2 - c'x`` with ``x >= lower``: an active-set method whose optimality conditions are checked."""
    n = len(c)
    free = np.zeros(n, bool)
    x = lower.astype(float).copy()
    tol = 1e-9 * (1 + np.abs(c).max(initial=0.0) + np.abs(q).max(initial=0.0))
    for _ in range(rounds * max(n, 1)):
        w = c - q @ x
        if free.all() or (w[~free] <= tol).all():
            break
        free[np.flatnonzero(~free)[np.argmax(w[~free])]] = True
        while True:
            s = x.copy()
            s[free] = np.linalg.lstsq(q[np.ix_(free, free)], c[free] - q[np.ix_(free, ~free)] @ x[~free], rcond=None)[0]
            bad = free & (s < lower)
            if not bad.any():
                x = s
                break
            step = np.min((x[bad] - lower[bad]) / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            free &= x > lower + 1e-14
            x[~free] = lower[~free]
    return x


def pivoted_qr(a: np.ndarray, tol: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of the columns of ``a`` and the columns chosen, largest remainder first."""
    rest = a.astype(float).copy()
    limit = (tol if tol is not None else max(a.shape) * np.finfo(float).eps) * np.linalg.norm(rest, axis=0).max(initial=0.0)
    q: list[np.ndarray] = []
    chosen: list[int] = []
    for _ in range(min(a.shape)):
        norms = np.linalg.norm(rest, axis=0)
        norms[chosen] = 0
        k = int(norms.argmax())
        if norms[k] <= limit:
            break
        v = rest[:, k] / norms[k]
        for u in q:  # once more, against rounding
            v = v - u * (u @ v)
        v /= np.linalg.norm(v)
        q.append(v)
        chosen.append(k)
        rest = rest - np.outer(v, v @ rest)
    return (np.stack(q, 1) if q else np.zeros((len(a), 0))), np.array(chosen, int)


def well_conditioned(gram: np.ndarray, floor: float = 1e-7) -> bool:
    """Whether a Gram matrix, scaled to unit diagonal, keeps its eigenvalues apart from zero."""
    d = np.sqrt(np.clip(np.diag(gram), 0, None))
    if (d <= 0).any():
        return False
    values = np.linalg.eigvalsh(gram / np.outer(d, d))
    return bool(values[0] > floor * values[-1])


def independent_columns(base: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Which columns of ``extra`` can join ``base`` as fixed effects; those of ``base`` always stay."""
    if not extra.shape[1]:
        return np.zeros(0, int)
    q, _ = pivoted_qr(base)
    scale = np.maximum(np.linalg.norm(extra, axis=0), 1e-300)
    rest = (extra - q @ (q.T @ extra)) / scale
    _, chosen = pivoted_qr(rest, 1e-6)
    chosen = chosen[np.linalg.norm(rest[:, chosen], axis=0) > 1e-6]
    while len(chosen):
        x = np.concatenate([base, extra[:, np.sort(chosen)]], 1)
        if well_conditioned(x.T @ x):
            break
        chosen = chosen[:-1]
    return np.sort(chosen)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def log_incomplete_beta(a: float, b: float, x: float) -> float:
    """Logarithm of the regularised incomplete beta function."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_beta_fraction(a, b, x) / a)
    return math.log(max(1 - math.exp(front) * _beta_fraction(b, a, 1 - x) / b, 1e-300))


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if math.isnan(t) or dof <= 0:
        return math.nan
    return math.exp(log_incomplete_beta(dof / 2, 0.5, dof / (dof + t * t)))


def t_two_sided_many(t: np.ndarray, dof: float) -> np.ndarray:
    """``t_two_sided`` of many values at once: the continued fraction of the incomplete beta function by modified Lentz steps."""
    t = np.asarray(t, float)
    x = dof / (dof + t * t)
    a, b = np.full_like(x, dof / 2), np.full_like(x, 0.5)
    flip = x >= (a + 1) / (a + b + 2)
    a, b, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / guard(1 - (a + b) * z / (a + 1))
    c, h = np.ones_like(z), d.copy()
    for m in range(1, 400):
        even = m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h *= c * d
        odd = -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        h *= c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-15:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - math.lgamma(0.5) + dof / 2 * np.log(x) + 0.5 * np.log1p(-x)
        part = np.exp(front + np.log(h / a))
    out = np.where(flip, 1 - part, part)
    out = np.where(x >= 1, 1.0, np.where(x <= 0, 0.0, out))
    return np.where(np.isnan(t) | (dof <= 0), np.nan, out)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def ebic(n: int, p: int, k: int, rss: float, gamma: float = 0.5) -> float:
    """Extended Bayesian information criterion from a residual sum of squares."""
    return n * math.log(max(rss, 1e-300) / n) + k * math.log(n) + 2 * gamma * (log_choose(p, k) if 0 < k <= p else 0.0)


def lambda_path(top: float, ratio: float = 0.05, count: int = 60) -> np.ndarray:
    """Penalties from ``top`` down to ``top * ratio``, evenly spaced in logarithm."""
    if top <= 0:
        return np.zeros(1)
    return np.exp(np.linspace(math.log(top), math.log(max(top * ratio, top * 1e-6)), count)) if count > 1 else np.array([top])


def soft(x: float, limit: float) -> float:
    return math.copysign(max(abs(x) - limit, 0.0), x)

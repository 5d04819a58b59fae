"""Weighted LASSO on small dense systems: coordinate descent on a Gram matrix, a path, and selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.linalg import ebic, lambda_path, soft, spd_solve


@dataclass
class LassoOptions:
    ratio: float = 0.05
    count: int = 60
    gamma: float = 0.5
    tol: float = 1e-6
    rounds: int = 2000
    period: int = 5
    patience: int = 10
    ridge: float = 1e-6


def descend(gram: np.ndarray, q: np.ndarray, penalty: float, start: np.ndarray | None = None, o: LassoOptions | None = None) -> tuple[np.ndarray, bool]:
    """Least ``b'Gb/2 - q'b + penalty |b|_1``; all coordinates in the first and every few rounds, active ones between."""
    o = o or LassoOptions()
    b = np.zeros(len(q)) if start is None else start.copy()
    g = gram @ b
    diag = np.maximum(np.diag(gram), 1e-8)

    def sweep(which: np.ndarray) -> float:
        most = 0.0
        for j in which.tolist():
            new = soft(q[j] - g[j] + diag[j] * b[j], penalty) / diag[j]
            if new != b[j]:
                g[:] += gram[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        return most

    every = np.arange(len(q))
    for k in range(1, o.rounds + 1):
        whole = k == 1 or k % o.period == 0
        moved = sweep(every if whole else np.flatnonzero(b))
        if moved < o.tol and (whole or sweep(every) < o.tol):
            return b, True
    return b, False


@dataclass
class Selected:
    beta: np.ndarray
    penalty: float
    criterion: float
    path: list[dict]


def select(gram: np.ndarray, q: np.ndarray, rss0: float, n: int, p: int, o: LassoOptions | None = None) -> Selected:
    """Path from the largest useful penalty down; the least criterion wins, ties to the smaller support."""
    o = o or LassoOptions()
    best: Selected | None = None
    b, worse, path = np.zeros(len(q)), 0, []
    for penalty in lambda_path(float(np.abs(q).max(initial=0.0)), o.ratio, o.count):
        b, settled = descend(gram, q, float(penalty), b, o)
        k = int((b != 0).sum())
        rss = max(rss0 - 2 * b @ q + b @ gram @ b, 0.0)
        value = ebic(n, max(p, k), k, rss, o.gamma)
        path.append({"penalty": float(penalty), "k": k, "rss": rss, "ebic": value, "settled": settled})
        if best is None or (value, k) < (best.criterion, int((best.beta != 0).sum())):
            best, worse = Selected(b.copy(), float(penalty), value, path), 0
        else:
            worse += 1
            if worse >= o.patience:
                break
    return best


def profile(z: np.ndarray, hz: np.ndarray, x: np.ndarray, hx: np.ndarray, y: np.ndarray, hy: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Gram matrix, right-hand side and residual square with fixed effects profiled out; ``h*`` are solves with H."""
    xx = x.T @ hx + ridge * np.eye(x.shape[1])
    xz = x.T @ hz
    gram = z.T @ hz - xz.T @ spd_solve(xx, xz)
    q = z.T @ hy - xz.T @ spd_solve(xx, x.T @ hy)
    rss = float(y @ hy - (x.T @ hy) @ spd_solve(xx, x.T @ hy))
    gram = (gram + gram.T) / 2
    gram[np.diag_indices(len(gram))] = np.maximum(np.diag(gram), 1e-8)
    return gram, q, rss

"""Small gradient-boosted trees, trained on the driver and compiled to Column expressions.

Trees are trained on some thousand examples.  Scoring is a sum of CASE
expressions that Catalyst compiles.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple | float


def _leaf(rows: list[int], grad: list[float], hess: list[float]) -> float:
    return -sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1.0)


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1.0)


def _grow(x: list[dict[str, float]], rows: list[int], grad: list[float], hess: list[float], depth: int) -> Tree:
    g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (1e-6, "", 0.0)
    for name in x[0] if depth and len(rows) > 8 else ():
        order = sorted(rows, key=lambda i: x[i][name])
        a = b = 0.0
        for i, j in zip(order, order[1:]):
            a, b = a + grad[i], b + hess[i]
            if x[i][name] < x[j][name]:
                gain = _gain(a, b) + _gain(g - a, h - b) - _gain(g, h)
                if gain > best[0]:
                    best = (gain, name, (x[i][name] + x[j][name]) / 2)
    if not best[1]:
        return _leaf(rows, grad, hess)
    _, name, cut = best
    return (name, cut, _grow(x, [i for i in rows if x[i][name] < cut], grad, hess, depth - 1), _grow(x, [i for i in rows if x[i][name] >= cut], grad, hess, depth - 1))


def _run(tree: Tree, row: dict[str, float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


class Boosted:
    """Logistic boosting with a threshold calibrated on held-out examples."""

    def __init__(self, rounds: int = 12, depth: int = 2, rate: float = 0.4):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.trees: list[Tree] = []
        self.threshold = 0.5

    def margin(self, row: dict[str, float]) -> float:
        return sum(self.rate * _run(t, row) for t in self.trees)

    def fit(self, x: list[dict[str, float]], y: list[int], precision: float = 0.98, seed: int = 3) -> Boosted:
        """Trains on three quarters; the threshold is the least at which precision on the rest reaches ``precision``."""
        order = list(range(len(x)))
        random.Random(seed).shuffle(order)
        cut = len(order) * 3 // 4
        rows, rest = order[:cut], order[cut:]
        score = [0.0] * len(x)
        for _ in range(self.rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            tree = _grow(x, rows, [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], self.depth)
            self.trees.append(tree)
            score = [s + self.rate * _run(tree, r) for s, r in zip(score, x)]
        own = sorted(((1 / (1 + math.exp(-self.margin(x[i]))), y[i]) for i in rest), reverse=True)
        hits = 0
        for k, (p, label) in enumerate(own, 1):
            hits += label
            tied = k < len(own) and own[k][0] == p
            if hits / k >= precision and not tied:
                self.threshold = p - 1e-9  # the JVM may round otherwise
        return self

    def column(self, feature: Callable[[str], Column]) -> Column:
        """Probability as a Column; ``feature`` gives the Column of a feature."""

        def build(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(self.rate * tree)
            return F.when(feature(tree[0]) < F.lit(float(tree[1])), build(tree[2])).otherwise(build(tree[3]))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + build(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

"""Linear machines by Newton's method on their primal objectives.

Both objectives are strictly convex, so their optimum is unique, whatever the
way there:

* classification: 1/2 |w|^2 + sum of c_i max(0, 1 - y_i w.x_i)^2, where c_i is the
  cost of the row's class (ten times that of positives where ``compat``);
* regression: 1/2 |w|^2 + C sum of max(0, |w.x_i - t_i| - tube)^2.

A step solves the Newton equations by conjugate gradients.  This is for rows in
memory, as a check; ``dual`` solves the same for rows of a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Of margins: each row's loss, and its first and second derivative.
Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def hinge(y: np.ndarray, costs: np.ndarray) -> Loss:
    def loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        short = np.maximum(1 - y * margin, 0)
        return costs * short**2, -2 * costs * y * short, 2 * costs * (short > 0)

    return loss


def tube(target: np.ndarray, cost: float, width: float) -> Loss:
    def loss(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        error = value - target
        over = np.maximum(np.abs(error) - width, 0)
        return cost * over**2, 2 * cost * np.sign(error) * over, 2 * cost * (over > 0)

    return loss


def classification_costs(y: np.ndarray, cost_pos: float, cost_neg: float, compat: bool = True) -> np.ndarray:
    return np.where(y > 0, cost_pos * (10 if compat else 1), cost_neg)


@dataclass
class Rows:
    """Sparse rows as (row, column, value) entries."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    height: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.height)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * v[self.row], self.width)

    def squares(self) -> np.ndarray:
        return np.bincount(self.row, self.value**2, self.height)


class Local:
    """An objective over rows in memory."""

    def __init__(self, rows: Rows, loss: Loss):
        self.rows, self.loss = rows, loss

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient; products are of this place from now on."""
        value, first, self.second = self.loss(self.rows.dot(w))
        return 0.5 * float(w @ w) + float(value.sum()), w + self.rows.back(first)

    def product(self, v: np.ndarray) -> np.ndarray:
        return v + self.rows.back(self.second * self.rows.dot(v))


def _direction(product: Callable[[np.ndarray], np.ndarray], gradient: np.ndarray, most: int) -> np.ndarray:
    """Conjugate gradients towards the step that the second derivatives ask for."""
    step, rest = np.zeros_like(gradient), -gradient
    way, size = rest.copy(), float(rest @ rest)
    enough = size * min(0.25, math.sqrt(size)) ** 2
    for _ in range(most):
        if size <= enough:
            break
        turned = product(way)
        far = size / float(way @ turned)
        step += far * way
        rest -= far * turned
        before, size = size, float(rest @ rest)
        way = rest + size / before * way
    return step


def minimum(objective: Local, start: np.ndarray, tolerance: float = 1e-6, rounds: int = 100, most: int = 200) -> np.ndarray:
    """The plane where the gradient is no longer than ``tolerance`` of that at 0; begins at ``start``, which saves
    most steps where it is the optimum of a like objective."""
    scale = math.sqrt(float(np.square(objective.at(np.zeros_like(start))[1]).sum()))
    w = start.copy()
    value, gradient = objective.at(w)
    for _ in range(rounds):
        if math.sqrt(float(gradient @ gradient)) <= tolerance * scale:
            break
        step, share = _direction(objective.product, gradient, most), 1.0
        slope = float(gradient @ step)
        while share > 1e-9:
            there = w + share * step
            new, turned = objective.at(there)
            if new <= value + 1e-4 * share * slope:
                break
            share /= 2
        else:
            break
        w, value, gradient = there, new, turned
    return w

"""Small sparse linear models in numpy, fitted on bounded samples and applied to whole tables."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of 0/1 features: ``column`` of each entry and ``row`` it belongs to."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n_rows: int, n_columns: int):
        self.row, self.column, self.n_rows, self.n_columns = row, column, n_rows, n_columns

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n_rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, r[self.row], self.n_columns)

    def columns(self, keep: np.ndarray) -> Sparse:
        """With only the columns to keep, numbered anew."""
        place = np.cumsum(keep) - 1
        ok = keep[self.column]
        return Sparse(self.row[ok], place[self.column[ok]], self.n_rows, int(keep.sum()))

    def rows(self, keep: np.ndarray) -> Sparse:
        place = np.cumsum(keep) - 1
        ok = keep[self.row]
        return Sparse(place[self.row[ok]], self.column[ok], int(keep.sum()), self.n_columns)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05, steps: int = 200, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (features, extra columns, intercept) by accelerated gradient descent in scaled coordinates, until a step changes none by more than the tolerance."""
    dense = np.hstack([extra, np.ones((x.n_rows, 1))])
    curve = np.concatenate([x.back(weight), (weight[:, None] * dense**2).sum(0)]) * 0.25 + l2
    scale = 1.0 / np.sqrt(curve * 4.0)
    w = np.zeros(x.n_columns + dense.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 0.0

    def gradient(w):
        r = weight * (sigmoid(x.dot(w[: x.n_columns]) + dense @ w[x.n_columns :]) - y)
        return np.concatenate([x.back(r), dense.T @ r]) + ridge * w

    # The largest eigenvalue of the scaled curvature, by power iteration, sets the step.
    v = np.ones(len(w))
    top = 1.0
    for _ in range(12):
        u = v * scale
        h = 0.25 * weight * (x.dot(u[: x.n_columns]) + dense @ u[x.n_columns :])
        v = scale * (np.concatenate([x.back(h), dense.T @ h]) + ridge * u)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step, z, before, t = scale**2 / (1.05 * top), w.copy(), w, 1.0
    for _ in range(steps):
        w = z - step * gradient(z)
        if np.abs(w - before).max() < tolerance:
            return w
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w + (t - 1) / t_next * (w - before)
        before, t = w, t_next
    return w


def telling(have: np.ndarray, have_y: np.ndarray, n: float, n_y: float, chance: float) -> np.ndarray:
    """Which of some columns have a share of y unlike the rest's: ``have`` rows have the column, ``have_y`` of them y, of n and n_y in all.

    The likelihood ratio must be so large that among all these columns one as unlike by chance is expected
    ``chance`` times (exp(-ratio / 2) bounds the chance of a column whose rows all have y).
    """
    def fit(k, m):
        p = k / np.maximum(m, 1e-12)
        return np.where(k > 1e-9, k * np.log(np.maximum(p, 1e-12)), 0.0) + np.where(m - k > 1e-9, (m - k) * np.log(np.maximum(1 - p, 1e-12)), 0.0)

    ratio = 2 * (fit(have_y, have) + fit(n_y - have_y, n - have) - fit(n_y, n))
    return ratio >= 2 * np.log(max(1, len(have)) / chance)


def groups_of_copies(signatures: np.ndarray) -> np.ndarray:
    """A group number for each row; rows that share a value in any column of ``signatures`` are one group."""
    n = len(signatures)
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for column in signatures.T:
        order = np.argsort(column, kind="stable")
        same = np.flatnonzero(column[order][1:] == column[order][:-1])
        for k in same:
            a, b = root(order[k]), root(order[k + 1])
            up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], dtype=np.int64)

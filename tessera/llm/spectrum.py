"""Leading eigenpairs of a dense symmetric matrix: Householder, Sturm counts, inverse iteration.

The matrix is a covariance of the columns of a long table, so its size is the number of
columns and does not grow with the rows.
"""

from __future__ import annotations

import numpy as np

CLUSTER = 1e-3  # eigenvalues closer than this part of the norm are made orthogonal to each other
EPS = np.finfo(np.float64).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(diagonal, off-diagonal, reflectors)`` of ``H' a H``; reflector k acts on places k+1 and up."""
    a = np.array(a, np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        v = x
        v[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(v)
        if length == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v /= length
        # two-sided update of the trailing square: a - 2 v w' - 2 w v'
        part = a[k + 1:, k + 1:]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        below = a[k + 1:, k] - 2.0 * v * (v @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = below
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of the shifted matrix (Sturm)."""
    tiny = EPS * max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny) * 1e-8
    shifts = np.asarray(shifts, np.float64)
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for d, b in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - shifts - b * b / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection of their Gershgorin interval."""
    n = len(diagonal)
    reach = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    rank = n - 1 - np.arange(count)  # this many eigenvalues are smaller
    for _ in range(200):
        middle = 0.5 * (low + high)
        if np.all((middle <= low) | (middle >= high)):
            break
        above = count_below(diagonal, off, middle) > rank
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return 0.5 * (low + high)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray) -> np.ndarray:
    """``(T - shift) x = rhs`` by elimination with row exchanges; a zero pivot becomes tiny."""
    n = len(diagonal)
    tiny = EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    d, u, uu = (diagonal - shift).tolist(), off.tolist() + [0.0], [0.0] * n
    x = rhs.tolist()
    for k in range(n - 1):
        low = off[k]
        if abs(d[k]) < abs(low):
            # the next row has the larger pivot: exchange
            m = d[k] / low
            d[k], u[k], uu[k], old_u = low, d[k + 1], u[k + 1], u[k]
            d[k + 1] = old_u - m * u[k]
            u[k + 1] = -m * uu[k]
            x[k], x[k + 1] = x[k + 1], x[k] - m * x[k + 1]
        else:
            pivot = d[k] if abs(d[k]) > tiny else tiny
            m, d[k] = low / pivot, pivot
            d[k + 1] -= m * u[k]
            x[k + 1] -= m * x[k]
    for k in range(n - 1, -1, -1):
        pivot = d[k] if abs(d[k]) > tiny else tiny
        s = x[k]
        if k + 1 < n:
            s -= u[k] * x[k + 1]
        if k + 2 < n:
            s -= uu[k] * x[k + 2]
        x[k] = s / pivot
    return np.array(x)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix for falling ``values``, one per column.

    Inverse iteration from fixed starts; within a cluster of close values each iterate is
    made orthogonal to the cluster's earlier vectors, twice, so that ties give a whole basis."""
    n, norm = len(diagonal), max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    out = np.zeros((n, len(values)))
    first, used = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        used = value if k == first else min(value, used - 4 * EPS * norm)  # equal shifts are set apart a little
        x = np.random.default_rng(k).standard_normal(n)
        for _ in range(8):
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, used, x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_pairs(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values falling, unit vectors in columns)`` of a symmetric matrix.

    A vector's sign is fixed: its largest entry by size (the first of equal ones) is positive."""
    n = len(a)
    count = min(count, n)
    if count == 0 or not np.any(a):
        return np.zeros(count), np.eye(n, count)
    diagonal, off, reflectors = tridiagonal(a)
    values = leading_values(diagonal, off, count)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1:] -= 2.0 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(count)] < 0, -1.0, 1.0)

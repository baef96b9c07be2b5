"""Leading eigenvectors of a symmetric matrix: Householder tridiagonalisation, Sturm-count bisection for the
largest eigenvalues, inverse iteration with reorthogonalisation inside clusters.

The matrix is a covariance of embeddings, d x d for d coordinates; nothing here grows with the data.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of T = Q' A Q, and the unit reflectors whose product is Q (one a row)."""
    a = np.array(a, float)
    n = len(a)
    reflectors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1:, k]
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).any():
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors[k, k + 1:] = v
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * v * (v @ x)
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diagonal: np.ndarray, off2: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """Number of eigenvalues below each point of ``at``: the negative terms of the Sturm sequence."""
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - (off2[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)  # a vanishing term counts as negative
        below += q < 0
    return below


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, by bisection to the last bit."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    size = max(np.abs(diagonal).max() + reach.max(), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - reach).min() - EPS * size), np.full(k, (diagonal + reach).max() + EPS * size)
    wanted = n - np.arange(1, k + 1)  # the i-th largest has this many eigenvalues below it
    least = EPS * EPS * size
    for _ in range(120):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = sturm_counts(diagonal, off * off, middle, least) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; zero pivots become ``least``."""
    n = len(diagonal)
    d, u, u2, b = diagonal - shift, np.append(off, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(d[i]):
            m = d[i] / below
            d[i], u[i], u2[i], d[i + 1], u[i + 1] = below, d[i + 1], u[i + 1], u[i] - m * d[i + 1], -m * u[i + 1]
            b[i], b[i + 1] = b[i + 1], b[i] - m * b[i + 1]
        else:
            if abs(d[i]) < least:
                d[i] = least
            m = below / d[i]
            d[i + 1] -= m * u[i]
            b[i + 1] -= m * b[i]
    if abs(d[-1]) < least:
        d[-1] = least
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - u[i] * x[i + 1] - u2[i] * x[i + 2]) / d[i]
    return x[:n]


def leading_eigenvectors(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``a``, falling, and unit eigenvectors as columns (those of
    a zero matrix are the first axes)."""
    n = len(a)
    k = min(k, n)
    if k == 0:
        return np.empty(0), np.empty((n, 0))
    scale = float(np.abs(a).max())
    if scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    a = np.asarray(a, float) / scale
    diagonal, off, reflectors = tridiagonalise(a)
    values = largest_eigenvalues(diagonal, off, k)
    size = max(np.abs(diagonal).max() + 2 * np.abs(np.append(off, 0.0)).max(), np.finfo(float).tiny)
    least, near = EPS * size, 1e-3 * size
    rng = np.random.default_rng(n)
    vectors = np.zeros((n, k))
    first = 0  # of the cluster of close eigenvalues
    shift = np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > near:
            first = j
        shift = min(values[j], shift - 10 * least) if j > first else values[j]  # equal eigenvalues: distinct shifts
        mates = vectors[:, first:j]
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= mates @ (mates.T @ x)
            x /= np.linalg.norm(x)
            before = x
            x = _solve(diagonal, off, shift, x, least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= mates @ (mates.T @ x)
            x /= np.linalg.norm(x)
            if 1 - abs(before @ x) < 4 * EPS:
                break
        vectors[:, j] = x
    for v in reflectors[::-1]:
        vectors -= 2 * np.outer(v, v @ vectors)
    # the Rayleigh quotient of a vector is its eigenvalue to twice the vector's precision
    values = ((a @ vectors) * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, vectors[:, order]

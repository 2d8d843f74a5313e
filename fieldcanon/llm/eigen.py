"""Leading eigenvectors of a symmetric matrix: tridiagonal form, bisection, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues nearer to each other than this share of the norm form a cluster, whose vectors are
#: made orthogonal in each step of the iteration.
CLUSTER = 1e-3
#: Steps of inverse iteration; two nearly always do.
STEPS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder's form of a symmetric matrix: diagonal, off-diagonal, and the reflections' vectors.

    Reflection k leaves the first k + 1 coordinates as they are.
    """
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale > 0:
            v /= scale
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k:]
            rest -= 2 * np.outer(v, v @ rest)
            rest = a[k:, k + 1 :]
            rest -= 2 * np.outer(rest @ v, v)
        mirrors.append(v)
    return a.diagonal().copy(), a.diagonal(1).copy(), mirrors


def reflected(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the tridiagonal form as those of the matrix."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal form are less than each shift."""
    least = max(EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)), np.finfo(np.float64).tiny) * EPS
    squares = off * off
    found = np.zeros(len(shifts), np.int64)
    pivot = np.ones_like(shifts)
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        found += pivot < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until no number lies between the bounds."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[1:] += np.abs(off)
    reach[:-1] += np.abs(off)
    margin = EPS * n * max(np.abs(diagonal).max(), reach.max()) + np.finfo(np.float64).tiny
    low = np.full(k, (diagonal - reach).min() - margin)
    high = np.full(k, (diagonal + reach).max() + margin)
    ranks = n - np.arange(k)  # of each value from below
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        less = below(diagonal, off, middle) >= ranks
        high = np.where(less, middle, high)
        low = np.where(less, low, middle)


def shifted_solver(diagonal: np.ndarray, off: np.ndarray, shift: float):
    """A function that solves ``(T - shift) x = b``, by elimination with row exchanges."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    least = max(EPS * norm, np.finfo(np.float64).tiny)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        under = float(off[i])
        swap = abs(under) > abs(main[i])
        if swap:
            # The row below goes up: it has entries in three columns.
            main[i], under = under, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        if abs(main[i]) < least:
            main[i] = least
        factor = under / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            s = x[i]
            if i + 1 < n:
                s -= upper[i] * x[i + 1]
            if i + 2 < n:
                s -= second[i] * x[i + 2]
            x[i] = s / main[i]
        return np.array(x)

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns for the falling ``values``, by inverse iteration.

    A vector is made orthogonal to the earlier ones of its cluster after each solution; values that
    are equal to rounding are moved apart a little, so that the solutions differ.
    """
    n = len(diagonal)
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(11)
    vectors = np.zeros((n, len(values)))
    first, last_shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        shift = min(float(value), last_shift - 10 * EPS * norm) if j > first else float(value)
        last_shift = shift
        solve = shifted_solver(diagonal, off, shift)
        x = rng.standard_normal(n)
        x /= np.linalg.norm(x)
        for _ in range(STEPS):
            y = solve(x)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
            x = y / np.linalg.norm(y)
        vectors[:, j] = x
    return vectors


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    A vector's largest entry is positive, as either sign would do.
    """
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = np.abs(matrix).max()
    if not scale > 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = reflected(tridiagonal_vectors(diagonal, off, values), mirrors)
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * scale, vectors * signs

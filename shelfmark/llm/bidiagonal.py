"""Singular values and right singular vectors of a small matrix by way of its bidiagonal form.

Householder reflections bring R to an upper bidiagonal B; dqds finds the singular values of
B with high relative accuracy, since it only adds, multiplies and divides positive numbers;
the right singular vectors are eigenvectors of B'B, each read from a twisted
factorisation of B'B - s^2 I (stationary from the top, progressive from the bottom, joined where
the twist is smallest) and carried back by the reflections.  Vectors of values that
nearly coincide are taken from different twists, made orthogonal, and separated by Rayleigh-Ritz.

Matrices have as many rows and columns as an embedding has dimensions; nothing here grows with the rows of a table.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 2.0**-52
#: Off-diagonal squares below this share of a value's square leave it unchanged.
NEGLIGIBLE = (10 * EPS) ** 2
#: Relative gaps below which vectors are made orthogonal to each other.
CLOSE = 1e-4


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, where ``matrix`` = U B V'; fewer rows than columns are filled up with zeros."""
    d = matrix.shape[1]
    work = np.zeros((max(d, len(matrix)), d))
    work[: len(matrix)] = matrix
    v = np.eye(d)
    for k in range(d):
        u = reflector(work[k:, k])
        work[k:, k:] -= np.outer(u, u @ work[k:, k:])
        if k + 2 < d:
            u = reflector(work[k, k + 1 :])
            work[k:, k + 1 :] -= np.outer(work[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, u)
    return np.diagonal(work).copy(), np.diagonal(work, 1).copy(), v


def reflector(x: np.ndarray) -> np.ndarray:
    """u with (I - uu')x along the first axis; zero where x already is."""
    big = np.abs(x).max()
    u = x / big if big else np.zeros_like(x)
    if not u[1:].any():
        return np.zeros_like(x)
    u[0] += math.copysign(np.linalg.norm(u), u[0])
    return u * (math.sqrt(2) / np.linalg.norm(u))


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values, largest first, from the squares of diagonal and superdiagonal.

    A sweep without shift also yields the diagonal of an inverse, hence a lower bound of the smallest value;
    the next sweep is shifted by it.  A shift that rounding makes too large is cut until the sweep stays positive.
    """
    found, todo = [], [(q, e, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e)) if e[i] <= NEGLIGIBLE * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # small values sink to the end
                q, e = flipped(q, e)
            q, e, d = sweep(q, e, 0.0)
            if min(d) <= 0.0:
                continue  # a zero on the diagonal has moved to the end and splits off next
            shift = 1.0 / math.fsum(1.0 / x for x in d)
            while shift > EPS * min(q[-1], shift + moved):
                new_q, new_e, d = sweep(q, e, shift)
                if min(d) >= 0.0:
                    q, e, moved = new_q, new_e, moved + shift
                    break
                shift *= 0.5 if shift > EPS * q[-1] * 8 else 0.0
        found += [x + moved for x in q]
    return sorted(found, reverse=True)


def flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same product read from the other end: the values of B are those of its transpose turned about."""
    return q[::-1], e[::-1]


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step."""
    d, new_q, new_e, all_d = q[0] - shift, [], [], []
    for i, x in enumerate(e):
        all_d.append(d)
        pivot = d + x
        ratio = q[i + 1] / pivot if pivot else 0.0
        new_q.append(pivot)
        new_e.append(x * ratio)
        d = d * ratio - shift
    all_d.append(d)
    return [*new_q, d], new_e, all_d


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twists at every place, and the multipliers above and below, of B'B - value."""
    n, tiny = len(a), EPS * EPS * max(value, float(np.max(a * a)), 1e-290)
    s, up, p, down = np.empty(n), np.empty(n - 1), np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + a[i] * a[i] or tiny
        up[i] = a[i] * b[i] / pivot
        s[i + 1] = s[i] * (b[i] * b[i] / pivot) - value
    p[-1] = a[-1] * a[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = p[i + 1] + b[i] * b[i] or tiny
        down[i] = a[i] * b[i] / pivot
        p[i] = p[i + 1] * (a[i] * a[i] / pivot) - value
    return s + p + value, up, down


def from_twist(k: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The vector that solves all rows but the twisted one."""
    z = np.empty(len(up) + 1)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, len(up)):
        z[i + 1] = -down[i] * z[i]
    big = np.abs(z).max()
    return z / (big * np.linalg.norm(z / big))


def block_vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of B'B, a column for each value (largest first)."""
    n = len(a)
    t = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    out, first = np.zeros((n, n)), 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLOSE * values[i - 1]:
            first = i
        twists, up, down = twisted(a, b, value)
        near, best, left = out[:, first:i], None, -1.0
        for k in np.argsort(np.abs(np.nan_to_num(twists, nan=np.inf)), kind="stable"):
            z = from_twist(int(k), up, down)
            for _ in range(2):
                z = z - near @ (near.T @ z)
            size = np.linalg.norm(z)
            if np.isfinite(size) and size > left:
                best, left = z / size if size else z, size
            if left > 0.1:
                break
        for _ in range(2):  # what little is left may point anywhere
            best = best - near @ (near.T @ best)
            best /= np.linalg.norm(best)
        out[:, i] = best
        if i > first and (i + 1 == len(values) or values[i] - values[i + 1] > CLOSE * values[i]):
            group = out[:, first : i + 1]
            _, turn = np.linalg.eigh(group.T @ t @ group)
            out[:, first : i + 1] = group @ turn[:, ::-1]
    return out


def singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values, largest first, and the right singular vectors as columns."""
    d = matrix.shape[1]
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    a, b, v = bidiagonalise(matrix / size)
    cuts = [i + 1 for i in range(d - 1) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1]))]
    values, vectors = np.empty(d), np.zeros((d, d))
    for lo, hi in zip([0, *cuts], [*cuts, d], strict=True):
        squares = dqds((a[lo:hi] ** 2).tolist(), (b[lo : hi - 1] ** 2).tolist())
        values[lo:hi] = squares
        vectors[lo:hi, lo:hi] = block_vectors(a[lo:hi], b[lo : hi - 1], squares) if hi - lo > 1 else 1.0
    order = np.argsort(-values, kind="stable")
    return np.sqrt(values[order]) * size, (v @ vectors)[:, order]

"""Right singular vectors of a small square matrix by its bidiagonal form and qd transforms.

Householder reflections make the matrix bidiagonal; dqds finds the squares of its singular values to high relative
accuracy; each vector is read off the twisted factorisation of B'B - s that has the smallest pivot at its twist. Vectors
of values that nearly agree are told apart by inverse iteration with the same factors.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper neighbours of U' A V, and the reflections that make up V."""
    a = np.array(matrix, float)
    m = len(a)
    rights = []

    def reflection(x: np.ndarray) -> np.ndarray:
        """Unit vector u (or zeros) so that x - 2 u (u'x) is a multiple of the first axis."""
        u = x.copy()
        length = np.linalg.norm(x)
        u[0] += np.copysign(length, x[0])
        size = np.linalg.norm(u)
        return u / size if size > 0 else u

    for k in range(m):
        u = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 1 < m:
            v = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            rights.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), rights


def back(vector: np.ndarray, rights: list[np.ndarray]) -> np.ndarray:
    """V times a vector."""
    out = vector.copy()
    for k in range(len(rights) - 1, -1, -1):
        out[k + 1 :] -= 2 * rights[k] * (rights[k] @ out[k + 1 :])
    return out


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential quotient-difference step; the least pivot is negative if the shift went too far."""
    m = len(q)
    up, off = np.empty(m), np.empty(m - 1)
    d = least = q[0] - shift
    for i in range(m - 1):
        up[i] = d + e[i]
        if up[i] <= 0:
            return q, e, -1.0
        t = q[i + 1] / up[i]
        off[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    up[m - 1] = d
    return up, off, least


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix with squared entries q (diagonal) and e."""
    found = []
    blocks = [(np.array(q, float), np.array(e, float), 0.0)]
    while blocks:
        q, e, done = blocks.pop()
        while len(q):
            if len(q) == 1:
                found.append(q[0] + done)
                break
            small = np.flatnonzero(e <= _EPS * _EPS * (np.minimum(q[:-1], q[1:]) + done))
            if len(small):
                at = int(small[-1])
                blocks.append((q[: at + 1], e[:at], done))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            # The smaller value of the last two rows, if it is not too far; else less of it, at last none.
            a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
            half, mean = (a - c) / 2, (a + c) / 2
            shift = max(0.0, min(mean - float(np.hypot(half, np.sqrt(b))), float(q.min())))
            for part in (1.0, 0.9, 0.5, 0.1, 0.0):
                up, off, least = _transform(q, e, shift * part)
                if least >= 0:
                    q, e, done = up, off, done + shift * part
                    break
            else:
                raise ArithmeticError("qd transform lost positivity")
    return np.sort(np.array(found))[::-1]


class _Twisted:
    """N diag N' = L D L' - s, with the twist where the pivot is least."""

    def __init__(self, pivots: np.ndarray, links: np.ndarray, value: float, floor: float):
        m = len(pivots)
        guard = lambda x: x if abs(x) > floor else -floor
        down, lower = np.empty(m), np.zeros(m)
        up, upper = np.empty(m), np.zeros(m)
        s, p = np.empty(m), np.empty(m)
        s[0] = -value
        for i in range(m - 1):
            down[i] = guard(s[i] + pivots[i])
            lower[i] = pivots[i] * links[i] / down[i]
            s[i + 1] = lower[i] * links[i] * s[i] - value
        p[m - 1] = pivots[m - 1] - value
        for i in range(m - 2, -1, -1):
            up[i + 1] = guard(pivots[i] * links[i] ** 2 + p[i + 1])
            t = pivots[i] / up[i + 1]
            upper[i] = links[i] * t
            p[i] = p[i + 1] * t - value
        gamma = s + p + value
        self.at = int(np.argmin(np.abs(gamma)))
        self.lower, self.upper = lower, upper
        self.diagonal = np.concatenate([down[: self.at], [guard(gamma[self.at])], up[self.at + 1 :]])

    def _outward(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.at - 1, -1, -1):
            z[i] -= self.lower[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] -= self.upper[i] * z[i]
        return z / np.linalg.norm(z)

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.diagonal))
        z[self.at] = 1.0
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            return self._outward(z)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The direction of (L D L' - s)^-1 b."""
        y = b.copy()
        for i in range(self.at):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(len(y) - 1, self.at, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        y /= self.diagonal
        return self._outward(y / np.abs(y).max())


def _apart(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z without its part along the others, and how much of it is left."""
    for _ in range(2):
        for o in others:
            z = z - o * (o @ z)
    left = float(np.linalg.norm(z))
    return (z / left if left > 0 else z), left


def right_singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and as columns the unit right singular vectors of the first `most`.

    Values below the rounding of the largest one are left out, so a matrix of lower rank gives fewer; the entry of a
    vector that is largest in size is positive.
    """
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    m = len(matrix)
    if size == 0 or not np.isfinite(size):
        return np.empty(0), np.empty((m, 0))
    d, f, rights = bidiagonal(matrix / size)
    # A pivot of zero is raised to one far below the rounding of the others.
    d = np.where(np.abs(d) < _EPS**2, _EPS**2, d)
    squares = dqds(d * d, f * f)
    squares = squares[squares > (8 * m * _EPS) ** 2 * squares[0]]
    pivots, links = d * d, f / d[:-1]
    found: list[np.ndarray] = []
    rng = np.random.default_rng(3)
    for k, value in enumerate(squares[:most]):
        near = [found[j] for j in range(k) if squares[j] - value < 1e-3 * squares[j]]
        z = _Twisted(pivots, links, float(value), 1e-200).vector()
        z, left = _apart(z, near) if np.isfinite(z).all() else (z, 0.0)
        for _ in range(8):
            if left > 0.99:
                break
            factors = _Twisted(pivots, links, float(value), _EPS * float(value))
            z, _ = _apart(rng.normal(size=m), near)
            for _ in range(6):
                z, left = _apart(factors.solve(z), near)
        found.append(z)
    vectors = [back(z, rights) for z in found]
    vectors = [v / np.linalg.norm(v) * (1 if v[np.argmax(np.abs(v))] > 0 else -1) for v in vectors]
    return squares * size * size, np.stack(vectors, axis=1)

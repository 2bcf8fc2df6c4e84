"""Singular values and right singular vectors of a small upper triangle.

Householder reflections bring the triangle to bidiagonal form, dqds sweeps find the singular values to
high relative accuracy, and twisted factorisations of the bidiagonal's normal matrix give the vectors.
The triangle has the data's dimension on a side, whatever the number of rows behind it.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-290


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): U' R V is upper bidiagonal with orthogonal U and V."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        v = x / size
        v[0] += np.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < n:
            v = reflector(a[k, k + 1:].copy())
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, float, bool]:
    """One dqds step: new q and e, least d, last d, and whether every d stayed non-negative."""
    n = len(q)
    q2, e2 = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least, fine = d, d >= 0
    for i in range(n - 1):
        if d < 0:
            return q2, e2, d, -np.inf, False
        q2[i] = d + e[i]
        if q2[i] <= 0:
            # d and e are both nil: the chain parts here.
            e2[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / q2[i]
            e2[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
        fine = fine and (d >= 0 or i == n - 2)
    q2[n - 1] = d
    return q2, e2, least, d, fine and d >= 0


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All singular values of an upper bidiagonal matrix by dqds, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = (diagonal / scale) ** 2, (above / scale) ** 2
    found: list[float] = []
    work = [(q, e, 0.0)]
    while work:
        q, e, base = work.pop()
        least = None
        while True:
            n = len(q)
            if n == 1:
                found.append(q[0] + base)
                break
            # An off-diagonal that is nil beside its neighbours parts the chain.
            nil = np.flatnonzero(e <= EPS * EPS * np.maximum(np.minimum(q[:-1], q[1:]) + base, TINY))
            if len(nil):
                at = int(nil[-1])
                work.append((q[:at + 1], e[:at], base))
                q, e, least = q[at + 1:], e[at + 1:], None
                continue
            if q[0] * 1.5 < q[-1]:  # small values belong at the end
                q, e = q[::-1].copy(), e[::-1].copy()
            shift = 0.0
            if least is not None and least > 0:
                shift = least * (1 - min(0.75, np.sqrt(e[-1] / max(q[-1], TINY))))
            for attempt in range(5):
                q2, e2, least2, last, good = _sweep(q, e, shift)
                if good:
                    break
                # Only the last d fell below nil: shift + d is still a lower bound.
                shift = max(0.0, shift + last) if attempt == 0 and np.isfinite(last) else shift * 0.25
                if attempt == 3:
                    shift = 0.0
            if not good:
                q2 = np.maximum(q2, 0.0)  # without a shift only rounding can fall below nil
            q, e, least, base = q2, e2, least2, base + shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _twisted(a: np.ndarray, b: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """A vector of the normal matrix of bidiagonal (a, b) for the eigenvalue: the stationary and the
    progressive factorisation of the shifted matrix, twisted where they meet with the least pivot.
    With ``start`` the twisted factors solve for it (a step of inverse iteration)."""
    n = len(a)
    tiny = EPS * max(float(np.max(a * a)), TINY)

    def solid(x: float) -> float:
        return x if abs(x) > tiny * EPS else (tiny * EPS if x >= 0 else -tiny * EPS)

    d0 = np.maximum(a * a, tiny * EPS)
    low = np.zeros(max(n - 1, 0))
    upper = np.zeros(max(n - 1, 0))
    plus, minus = np.empty(n), np.empty(n)
    s = np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # T - value = L+ D+ L+'
        l = a[i] * b[i] / d0[i]
        plus[i] = solid(s[i] + d0[i])
        low[i] = d0[i] * l / plus[i]
        s[i + 1] = low[i] * l * s[i] - value
    plus[n - 1] = solid(s[n - 1] + d0[n - 1])
    p = np.empty(n)
    p[n - 1] = d0[n - 1] - value
    for i in range(n - 2, -1, -1):  # T - value = U- D- U-'
        l = a[i] * b[i] / d0[i]
        minus[i + 1] = solid(d0[i] * l * l + p[i + 1])
        t = d0[i] / minus[i + 1]
        upper[i] = l * t
        p[i] = p[i + 1] * t - value
    minus[0] = solid(p[0])
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if start is None:
        z[r] = 1.0
    else:
        y = start.copy()
        for i in range(r):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, r, -1):
            y[i - 1] -= upper[i - 1] * y[i]
        for i in range(n):
            if i != r:
                z[i] = y[i] / (plus[i] if i < r else minus[i])
        z[r] = y[r] / solid(float(gamma[r]))
    for i in range(r - 1, -1, -1):
        z[i] -= low[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] -= upper[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size > 0 else np.full(n, 1 / np.sqrt(n))


def right_vectors(diagonal: np.ndarray, above: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the k largest singular values and the right singular vectors.

    Chains between nil off-diagonals are solved apart, so equal values in different chains get
    orthogonal vectors.  Values of high multiplicity leave couplings a little above rounding; where the
    residual shows that, wider cuts are tried and the best result is kept."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0), 1e-150)
    best = None
    for nil in (8 * EPS, 1e-14, 1e-13, 1e-12):
        values, vectors = _chains(diagonal, above, k, nil * scale)
        image = diagonal[:, None] * vectors
        image[:-1] += above[:, None] * vectors[1:]
        back = diagonal[:, None] * image
        back[1:] += above[:, None] * image[:-1]
        residual = float(np.abs(back - vectors * values ** 2).max(initial=0.0)) / scale ** 2
        residual = max(residual, float(np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max(initial=0.0)))
        if best is None or residual < best[0]:
            best = residual, values, vectors
        if residual <= 1e-12:
            break
    if best[0] > 1e-10:
        return best[1], _clusters(diagonal, above, best[1], scale)
    return best[1], best[2]


def _clusters(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, scale: float) -> np.ndarray:
    """Vectors by block inverse iteration, for values of such multiplicity that single vectors fail:
    each cluster of values is solved as one space and turned to its own axes."""
    b = np.diag(diagonal) + np.diag(above, 1)
    normal = b.T @ b
    n = len(diagonal)
    rng = np.random.default_rng(7)
    found = np.zeros((n, 0))
    edges = [0, *(np.flatnonzero(values[:-1] - values[1:] > 1e-5 * values[:-1]) + 1).tolist(), len(values)]
    for lo, hi in zip(edges, edges[1:]):
        z = rng.standard_normal((n, hi - lo))
        shifted = normal - (float(values[lo:hi].mean()) ** 2 + 1e-13 * scale ** 2) * np.eye(n)
        for _ in range(4):
            z = np.linalg.solve(shifted, z)
            for _ in range(2):
                z = np.linalg.qr(z - found @ (found.T @ z))[0]
        turn = np.linalg.eigh(z.T @ normal @ z)[1][:, ::-1]
        found = np.hstack([found, z @ turn])
    return found


def _chains(diagonal: np.ndarray, above: np.ndarray, k: int, nil: float) -> tuple[np.ndarray, np.ndarray]:
    """``right_vectors`` with off-diagonals up to ``nil`` cut.  Within a chain, vectors of values that
    lie close together are found by inverse iteration with the twisted factors and made orthogonal."""
    n = len(diagonal)
    cuts = [0, *(np.flatnonzero(np.abs(above) <= nil) + 1).tolist(), n]
    some: list[tuple[float, int, np.ndarray]] = []
    rng = np.random.default_rng(7)
    for lo, hi in zip(cuts, cuts[1:]):
        a, b = diagonal[lo:hi], above[lo:hi - 1]
        values = singular_values(a, b)[:k]
        near: list[np.ndarray] = []
        for i, sigma in enumerate(values):
            if i and values[i - 1] - sigma > 1e-3 * values[i - 1]:
                near = []
            close = bool(near) or (i + 1 < len(values) and sigma - values[i + 1] <= 1e-3 * sigma)
            z = _twisted(a, b, float(sigma) ** 2)
            if close:
                for step in range(4):
                    if step:
                        z = _twisted(a, b, float(sigma) ** 2, z)
                    for _ in range(2):
                        for y in near:
                            z = z - y * (y @ z)
                    size = np.linalg.norm(z)
                    z = z / size if size > 1e-8 else rng.standard_normal(hi - lo)
                for y in near:
                    z = z - y * (y @ z)
                z /= np.linalg.norm(z)
                near.append(z)
            some.append((float(sigma), lo, z))
    some.sort(key=lambda x: -x[0])
    some = some[:k]
    vectors = np.zeros((n, len(some)))
    for j, (_, lo, z) in enumerate(some):
        vectors[lo:lo + len(z), j] = z
    return np.array([x[0] for x in some]), vectors


def principal_directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, directions as columns) of a triangle R: the k largest and their right vectors."""
    diagonal, above, right = bidiagonalise(r)
    values, vectors = right_vectors(diagonal, above, k)
    return values, right @ vectors

"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, the differential
quotient-difference algorithm with shifts, and twisted factorisations. Sizes are a vector's dimension, never a row count."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Sweeps a singular value may take on average, and relative distances below which values count as one group.
SWEEPS, GROUP_GAP = 60, 1e-6


def blockwise_r(blocks, width: int) -> np.ndarray:
    """R (width x width, upper triangular) with R^T R = A^T A, where ``blocks`` are consecutive rows of A."""
    r = np.zeros((0, width))
    for b in blocks:
        r = np.linalg.qr(np.vstack([r, b]), mode="r")
    return np.vstack([r, np.zeros((max(0, width - len(r)), width))])


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v^T) x = (alpha, 0, ...)."""
    v, norm = x.copy(), np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return v, 0.0
    v[0] += np.copysign(norm, x[0])
    return v, 2 / (v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): r = U B V^T, B upper bidiagonal with diagonal a and superdiagonal b, by Householder reflections."""
    m, n = r.astype(np.float64).copy(), len(r)
    v_all = np.eye(n)
    for k in range(n):
        v, beta = _reflector(m[k:, k])
        if beta:
            m[k:, k:] -= np.outer(beta * v, v @ m[k:, k:])
        if k < n - 2:
            v, beta = _reflector(m[k, k + 1 :])
            if beta:
                m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ v, beta * v)
                v_all[:, k + 1 :] -= np.outer(v_all[:, k + 1 :] @ v, beta * v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v_all


def _dqds(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], float, bool]:
    """One transform with shift s: (q, e, the least d, whether all but the last d are positive)."""
    n = len(q)
    new_q, new_e, d, least = [0.0] * n, [0.0] * (n - 1), q[0] - s, q[0] - s
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if d < 0 or new_q[i] <= 0:
            return new_q, new_e, min(least, d), False
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - s
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least, True


def _shift(q: list[float], e: list[float]) -> float:
    """What lies just below the least eigenvalue, from the last two rows of B B^T's tridiagonal form, less what ties them
    to the rest; 0 where that says nothing."""
    x, y, off = q[-2] + e[-1], q[-1], (e[-1] * q[-1])
    half = (x - y) / 2
    low = y - off / (half + np.copysign(np.sqrt(half * half + off), half or 1.0)) if off else min(x, y)
    low = min(low, x + y - low)
    if len(q) > 2:
        tie = np.sqrt(e[-2] * q[-2])
        share = np.sqrt(off) / max(np.hypot(np.sqrt(off), x - low), 1e-300)
        low -= tie * min(1.0, share)
    return max(0.0, low)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    dqds: shifts are taken off while all stays positive; one that is too large is given up for a smaller one, in the end
    for none, which can't fail. A superdiagonal entry that is negligible beside its row cuts the matrix in two."""
    done: list[float] = []
    q, e = (np.asarray(a, np.float64) ** 2).tolist(), (np.asarray(b, np.float64) ** 2).tolist()
    work = [(q, e, 0.0)] if q else []
    while work:
        q, e, total = work.pop()
        if len(q) == 1:
            done.append(total + q[0])
            continue
        if q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # small values at the end: a reflected matrix has the same singular values
        for _ in range(SWEEPS * len(q)):
            cuts = [i for i, x in enumerate(e) if x <= (10 * EPS) ** 2 * (total + min(q[i], q[i + 1])) or x == 0]
            zero = min(q) == 0
            if cuts:
                edges = [0, *[i + 1 for i in cuts], len(q)]
                work += [(q[i:j], e[i : j - 1], total) for i, j in zip(edges, edges[1:], strict=False)]
                break
            s = 0.0 if zero else _shift(q, e)
            for attempt in (s, s * 0.5, s * 0.1, 0.0):
                new_q, new_e, least, fine = _dqds(q, e, attempt)
                if (fine and least >= 0) or attempt == 0:
                    q, e, total = [max(x, 0.0) for x in new_q], new_e, total + attempt
                    break
        else:
            raise RuntimeError("singular values did not settle")
    return np.sort(np.array(done))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The eigenvector of L D L^T (L unit lower bidiagonal with ``low``) nearest ``value``: stationary factors from the
    top, progressive ones from the bottom, glued where the remainder is least."""
    n, tiny = len(d), EPS * EPS * max(abs(value), 1e-300)
    s, p, down, up = np.empty(n), np.empty(n), np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = (d[i] + s[i]) or tiny
        down[i] = d[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = (d[i] * low[i] ** 2 + p[i + 1]) or tiny
        ratio = d[i] / pivot
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _group(a: np.ndarray, b: np.ndarray, z: np.ndarray, value: float, rounds: int = 3) -> np.ndarray:
    """Orthonormal vectors for values too close to tell their vectors apart: inverse iteration on all of them together.
    What an eigenvector of a group is within its space is free."""
    n = len(a)
    t = np.diag(a * a + np.concatenate(([0.0], b * b))) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    z = z + 1e-3 * np.random.default_rng(1).standard_normal(z.shape)
    for grow in (4, 64, 1024):
        try:
            factor = np.linalg.inv(t - (value * (1 + grow * EPS) + grow * EPS * EPS * np.abs(t).max()) * np.eye(n))
            break
        except np.linalg.LinAlgError:  # the value itself: a little further off
            continue
    for _ in range(rounds):
        z = np.linalg.qr(factor @ z)[0]
    values, turn = np.linalg.eigh(z.T @ t @ z)
    return z @ turn[:, np.argsort(-values)]


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values of r, largest first; unit right singular vectors of the first ``most``, as columns)."""
    n = len(r)
    most, scale = min(most, n), float(np.abs(r).max()) if n else 0.0
    if not n or scale == 0:
        return np.zeros(n), np.eye(n)[:, :most]
    a, b, v = bidiagonal(r / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * EPS * norm, EPS * EPS * norm, a)  # far below what rounding has already done
    b = np.where(np.abs(b) < EPS * EPS * norm, 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    found: list[tuple[float, int, int]] = []  # value, and the unreduced block that it comes from
    for i, j in zip(edges, edges[1:], strict=False):
        found += [(x, i, j) for x in squared_singular_values(a[i:j], b[i : j - 1])]
    found.sort(key=lambda x: (-x[0], x[1]))
    out = np.zeros((n, most))
    k = 0
    while k < most:
        value, i, j = found[k]
        same = [m for m in range(k, n) if found[k][0] - found[m][0] <= GROUP_GAP * found[k][0] and found[m][1] == i]
        same = [m for at, m in enumerate(same) if m == k + at]  # neighbours in one block
        a1, b1 = a[i:j], b[i : j - 1]
        z = np.stack([_twisted(a1 * a1, b1 / a1[:-1], found[m][0]) for m in same], axis=1)
        if len(same) > 1:
            z = _group(a1, b1, z, value)
        for at, m in enumerate(same):
            if m < most:
                out[i:j, m] = z[:, at]
        k += len(same)
    return np.array([x[0] for x in found]) * scale * scale, v @ out

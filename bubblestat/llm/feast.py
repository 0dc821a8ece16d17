"""The largest eigenvalues of a symmetric matrix by contour integration, interval by interval, with counts that tell whether any was missed."""

from __future__ import annotations

import numpy as np

#: Points of the quadrature on a half circle, eigenvalues that one interval holds unless they are closer than it can part, and vectors beyond them.
NODES, EACH, SPARE = 12, 6, 8


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side of a tridiagonal matrix with v's eigenvalues, by reflections from both sides."""
    a = np.array(v, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = p - (x @ p) * x
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each of some points: positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    at = np.atleast_1d(np.asarray(at, float))
    least = np.finfo(float).tiny * 1e10
    pivot = diagonal[0] - at
    above = (pivot > 0).astype(int)
    for d, s in zip(diagonal[1:], side, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - at - s * s / pivot
        above += pivot > 0
    return above


def located(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by halving with counts, to some 15 digits of the largest."""
    reach = np.abs(np.append(side, 0)) + np.abs(np.append(0, side))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    span = max(high[0] - low[0], np.finfo(float).tiny)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    wanted = np.arange(1, k + 1)
    for _ in range(60):
        middle = (low + high) / 2
        enough = count_above(diagonal, side, middle) >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return (low + high) / 2


def intervals(diagonal: np.ndarray, side: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues within) of intervals that hold at least the k largest, falling, with bounds well off all of them.

    Eigenvalues that are zero but for rounding are left out, so there may be fewer than k, or no interval."""
    values = located(diagonal, side, len(diagonal))
    zero = 1e-13 * len(diagonal) * max(values[0], 0.0)
    found = int((values > zero).sum())
    if not found or values[0] <= 0:
        return []
    close = 1e-10 * values[0]
    gaps = np.append(values[:-1] - values[1:], values[-1] - values[0])[:found]
    gaps[-1] = max(values[found - 1], close) if found == len(values) else gaps[-1]
    out, start = [], 0
    while start < min(k, found):
        ends = [e for e in range(start, found) if gaps[e] > close or e == found - 1]
        tried = []  # how far bounds are from what they part, as a share of the interval
        for e in [e for e in ends if e < start + EACH] or ends[:1]:
            margin = min(gaps[e], gaps[start - 1] if start else np.inf) / 2
            tried.append((margin / (values[start] - values[e] + 2 * margin), e, margin))
        _, end, margin = max((t for t in tried if t[0] > 0.04), key=lambda t: t[1], default=max(tried))
        low, high = values[end] - margin, values[start] + margin
        inside = count_above(diagonal, side, [low, high])
        out.append((float(low), float(high), int(inside[0] - inside[1])))
        if inside[0] != end + 1 or inside[1] != start:
            raise ArithmeticError(f"{inside} eigenvalues are counted above {low} and {high}, {end + 1} and {start} are known")
        start = end + 1
    return out


def extracted(v: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors in columns) within an interval that holds `count` of them.

    Each round solves with v shifted to points on a circle around the interval, sums the solutions to a projection onto the interval's eigenvectors, and takes the
    eigenvectors of v within that space. Rounds end once residuals no longer shrink. Another number of eigenvalues than `count` raises."""
    n, size = len(v), np.abs(v).sum(1).max()
    m = min(n, count + SPARE)
    block = np.random.default_rng(7).standard_normal((n, m))
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (points + 1)) * (high - low) / 2
    before = np.inf
    for _ in range(rounds):
        projected = sum(w / 2 * (t * np.linalg.solve(((low + high) / 2 + t) * np.eye(n) - v, block)).real for w, t in zip(weights, turn, strict=True))
        basis, _ = np.linalg.qr(projected)
        basis, _ = np.linalg.qr(basis)
        values, inner = np.linalg.eigh(basis.T @ v @ basis)
        block = basis @ inner
        inside = (values > low) & (values <= high)
        if inside.sum() == count:
            x, e = block[:, inside], values[inside]
            residual = np.abs(v @ x - x * e).max() / size
            if residual < 1e-17 or residual < 1e-13 and residual >= before / 2:
                return e[::-1], x[:, ::-1]
            before = residual
    raise ArithmeticError(f"{count} eigenvalues are counted from {low} to {high}; contour integration doesn't find them")

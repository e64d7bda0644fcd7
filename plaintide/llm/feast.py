"""Eigenpairs of a symmetric matrix inside intervals by contour integration, with counts that show none is missing."""

from __future__ import annotations

import numpy as np

#: Quadrature nodes on the upper half of the circle; rounds of one try; eigenvalues wanted in an interval at most.
NODES, ROUNDS, PER_INTERVAL = 8, 12, 12


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and second diagonal of a matrix with the same inertia for every shift (Householder)."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed `shift`: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    diagonal, beside = tri
    tiny = np.finfo(float).tiny
    found, pivot = 0, 1.0
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if pivot == 0:
            pivot = -tiny
        found += pivot > 0
    return found


def intervals(matrix: np.ndarray, most: int) -> tuple[list[tuple[float, float, int]], float]:
    """Intervals (low, high, eigenvalues inside) from the top, which hold the `most` largest eigenvalues or more.

    Edges are found by bisection on inertia counts, until an interval holds no more than PER_INTERVAL or is as
    narrow as rounding allows. Eigenvalues that rounding can't tell from zero are left out. The second result is a
    bound of the matrix's norm.
    """
    norm = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    if norm == 0 or most < 1:
        return [], norm
    tri = tridiagonal(matrix)
    zero = 4 * len(matrix) * np.finfo(float).eps * norm
    found: list[tuple[float, float, int]] = []
    taken = 0
    # Open stretches from the top down, with the counts above their edges.
    todo = [(zero, norm * (1 + 1e-12) + zero, count_above(tri, zero), 0)]
    while todo and taken < most:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        middle = (low + high) / 2
        if inside > PER_INTERVAL and high - low > 1e-13 * norm:
            between = count_above(tri, middle)
            todo += [(low, middle, above_low, between), (middle, high, between, above_high)]
            continue
        if taken + inside > most and inside > 1 and high - low > 1e-9 * norm:
            # The last wanted one lies in here: the lower part needn't be solved.
            between = count_above(tri, middle)
            todo += [(low, middle, above_low, between), (middle, high, between, above_high)]
            continue
        found.append((float(low), float(high), int(inside)))
        taken += inside
    return found, norm


def project(matrix: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int = NODES) -> np.ndarray:
    """`block` projected on the eigenvectors with eigenvalues in (low, high).

    The spectral projector is the integral of the resolvent along the circle over the interval; Gauss-Legendre
    nodes on the upper half do, as the matrix is real and symmetric.
    """
    points, weights = np.polynomial.legendre.leggauss(nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    total = np.zeros_like(block)
    unit = np.eye(len(matrix))
    for x, w in zip(points, weights):
        turn = np.exp(1j * np.pi / 2 * (1 - x))
        solved = np.linalg.solve((middle + radius * turn) * unit - matrix, block.astype(complex))
        total += w / 2 * (radius * turn * solved).real
    return total


def eigenpairs(matrix: np.ndarray, low: float, high: float, inside: int, norm: float,
               seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `inside` eigenvalues in (low, high), falling, and unit eigenvectors as columns.

    Subspace iteration with the projector, each followed by a Rayleigh-Ritz step. A try ends when as many Ritz
    values lie in the interval as the inertia counts say and their residuals are at rounding level; otherwise the
    subspace and the nodes are doubled, up to the whole space, where Rayleigh-Ritz is exact.
    """
    n, size, nodes = len(matrix), max(inside + 4, int(1.5 * inside)), NODES
    random = np.random.default_rng(seed)
    good = 16 * np.sqrt(n) * np.finfo(float).eps * norm
    edge = 4 * n * np.finfo(float).eps * norm
    while True:
        size = min(size, n)
        block = np.eye(n) if size == n else random.standard_normal((n, size))
        for _ in range(1 if size == n else ROUNDS):
            # Widened a little, so eigenvalues at the edge are well inside.
            wide = max(0.05 * (high - low), edge)
            block = block if size == n else project(matrix, low - wide, high + wide, block, nodes)
            basis = np.linalg.qr(block)[0]
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turned
            chosen = np.flatnonzero((values > low - edge) & (values <= high + edge))
            residual = np.linalg.norm(matrix @ block[:, chosen] - block[:, chosen] * values[chosen], axis=0)
            if len(chosen) == inside and residual.max(initial=0) <= good:
                order = chosen[::-1]
                return values[order], block[:, order]
        if size == n:
            # Rounding moved a value over an edge: the `inside` nearest to the interval are the ones counted.
            distance = np.maximum(np.maximum(low - values, values - high), 0)
            order = np.sort(np.argsort(distance, kind="stable")[:inside])[::-1]
            return values[order], block[:, order]
        size, nodes = 2 * size, 2 * nodes


def polished(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rayleigh-Ritz step over the vectors of all intervals: falling eigenvalues, orthonormal vectors."""
    basis = np.linalg.qr(vectors)[0]
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], basis @ turned[:, ::-1]

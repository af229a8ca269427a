"""Eigenvectors of a symmetric matrix by spectral divide and conquer over polar decompositions.

The polar factor U of A - s I is the sign of A - s I, so (I + U) / 2 projects on the eigenvectors
above the shift s.  Bases of that subspace and of its complement split A in two blocks, which are
split again until one row is left.  Polar factors come from the dynamically weighted Halley iteration,
each step one QR factorisation of a stacked matrix, without any inverse.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray, most: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a square matrix (QDWH iteration)."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)  # singular values at most one
    low = EPS  # a lower bound of them; too small a bound only costs a step or two
    for _ in range(most):
        root = np.cbrt(4 * (1 - low * low) / low**4)
        step = np.sqrt(1 + root)
        alpha = step + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - low * low) / (low * low * step), 0))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(n)]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * q[:n] @ q[n:].T
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (alpha + beta * low * low) / (1 + gamma * low * low), 1.0)
        if abs(1 - low) < 10 * EPS and moved < 10 * EPS * np.sqrt(n):
            break
        if abs(1 - low) < 10 * EPS:
            low = 1.0
    return x


def _split(a: np.ndarray, shift: float, start: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis, first the directions with eigenvalues above ``shift``, and how many these are;
    None where the shift leaves one side empty."""
    n = len(a)
    projector = (np.eye(n) + polar_factor(a - shift * np.eye(n))) / 2
    projector = (projector + projector.T) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return None
    basis = start.standard_normal((n, k))
    for _ in range(2):  # the second time clears what rounding left
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        whole, basis = basis, basis[:, :k]
    return whole, k


def _parts(a: np.ndarray, basis: np.ndarray, size: float, start: np.random.Generator):
    """(eigenvalue, eigenvector) pairs of ``a``, whose rows stand for the columns of ``basis``."""
    n = len(a)
    spread = a - np.diag(np.full(n, np.trace(a) / n))
    if n == 1 or np.linalg.norm(spread) <= 4 * n * EPS * size:  # any basis of a multiple of the identity will do
        return [(float(a[i, i]), basis[:, i]) for i in range(n)]
    middle = float(np.median(np.diag(a)))
    bound = np.linalg.norm(spread)
    centre = np.trace(a) / n
    # Eigenvalues lie around their mean; were all on one side of a shift, the next halves what is left.
    low, high, shift, best = centre - bound, centre + bound, middle, None
    for _ in range(80):
        found = _split(a, shift, start)
        if found is None:
            above = np.trace(polar_factor(a - shift * np.eye(n))) > 0
            low, high = (shift, high) if above else (low, shift)
        else:
            q, k = found
            turned = q.T @ a @ q
            left = np.linalg.norm(turned[k:, :k])
            if best is None or left < best[0]:
                best = left, q, k, turned
            if left <= 16 * n * EPS * size:
                break
            # The shift lies on an eigenvalue: move it aside.
            shift += (high - low) * 1e-3 * start.uniform(-1, 1)
            continue
        shift = (low + high) / 2
        if high - low <= EPS * size:
            break
    if best is None:
        return [(float(a[i, i]), basis[:, i]) for i in range(n)]
    _, q, k, turned = best
    turned = (turned + turned.T) / 2
    wide = basis @ q
    return _parts(turned[:k, :k], wide[:, :k], size, start) + _parts(turned[k:, k:], wide[:, k:], size, start)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    A sign is chosen so that the entry of largest size is positive.  Equal eigenvalues get some
    orthonormal basis of their space; a matrix without rows gives none.
    """
    n = len(a)
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    a = (a + a.T) / 2
    parts = _parts(a, np.eye(n), max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny), np.random.default_rng(0))
    vectors = np.stack([v for _, v in parts], axis=1)
    # Rounding of the recursion is taken out by one Gram-Schmidt pass and first-order mixing.
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.sign(np.diag(r))
    inner = vectors.T @ a @ vectors
    values = np.diag(inner).copy()
    gap = values[None, :] - values[:, None]
    mix = np.where(np.abs(gap) > 1e3 * np.abs(inner), inner, 0) / np.where(gap == 0, 1, gap)
    np.fill_diagonal(mix, 0)
    vectors, r = np.linalg.qr(vectors + vectors @ mix)
    vectors = vectors * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(n)]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)

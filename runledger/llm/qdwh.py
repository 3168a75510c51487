"""Symmetric eigenvectors by spectral divide and conquer on QDWH polar decompositions."""
from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
ROUNDS = 40               # a polar decomposition needs six or seven


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix: its matrix sign, where it has no zero
    eigenvalue.

    Dynamically weighted Halley iterations: the weights follow a lower bound of the smallest
    singular value, which they drive to 1. Badly conditioned steps go through a QR
    decomposition of the stacked matrix, the others through a Cholesky decomposition."""
    n = len(a)
    size = np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    if not size:
        return np.zeros((n, n))
    x, low, one = a / size, EPS, np.eye(n)
    for _ in range(ROUNDS):
        low = min(low, 1.0)
        d = np.cbrt(4 * max(1 - low * low, 0.0) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + wc * (x.T @ x))
            half = np.linalg.solve(lower, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        low = low * (wa + wb * low * low) / (1 + wc * low * low)
        moved, x = np.linalg.norm(new - x), new
        if abs(low - 1) < 10 * EPS and moved < np.cbrt(5 * EPS):
            break
    return x


def _shifts(a: np.ndarray):
    """Numbers strictly inside the spectrum's hull, the likeliest even split first."""
    diagonal = np.sort(np.diag(a))
    low, high, mean = diagonal[0], diagonal[-1], diagonal.mean()
    middle = float(np.median(diagonal))
    if low < middle < high:
        yield middle
    yield mean
    radius = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    for part in (0.31, -0.31, 0.073, -0.073, 0.57, -0.57, 0.017, -0.017):
        yield mean + part * radius


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """``(basis, k)``: an orthogonal basis whose first k columns span the invariant subspace of
    the eigenvalues above a shift; None where no shift separates any."""
    n = len(a)
    draw = np.random.default_rng(n).standard_normal((n, n))
    best = None
    for shift in _shifts(a):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        # the projector's range and that of its complement, each from random combinations
        upper, _ = np.linalg.qr(projector @ draw[:, :k])
        upper, _ = np.linalg.qr(projector @ upper)
        rest = draw[:, k:] - projector @ draw[:, k:]
        basis, _ = np.linalg.qr(np.hstack([upper, rest - upper @ (upper.T @ rest)]))
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 100 * EPS * n * np.linalg.norm(a):
            break
    return None if best is None else best[1:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a symmetric matrix, largest value first; vectors are unit columns
    whose largest entry (the first of equals) is positive.

    Blocks are split by spectral projectors until they hold one value or are diagonal to
    rounding (equal values)."""
    n = len(a)
    a = (a + a.T) / 2
    size = np.linalg.norm(a)
    vectors = np.zeros((n, n))
    work, at = [(a, np.eye(n))] if n else [], 0
    while work:
        block, basis = work.pop()
        m = len(block)
        parts = None
        if m > 1 and np.linalg.norm(block - np.diag(np.diag(block))) > EPS * size:
            parts = _split(block)
        if parts is None:
            vectors[:, at:at + m] = basis
            at += m
            continue
        turn, k = parts
        for columns in (turn[:, :k], turn[:, k:]):
            part = columns.T @ block @ columns
            work.append(((part + part.T) / 2, basis @ columns))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    if n:
        lead = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[lead, np.arange(n)] < 0, -1.0, 1.0)
    return values, vectors

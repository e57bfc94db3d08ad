"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The orthogonal polar factor of ``A - shift`` has the eigenvalues 1 and -1: half of its sum with the identity projects
on the space of all eigenvectors above the shift. That factor is found by the dynamically weighted Halley iteration
with QR and Cholesky steps. Both spaces are then divided again, down to single vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EPS = np.finfo(float).eps
#: Above this weight a step is done by QR, which is stable for ill-conditioned matrices, else by solving.
QR_WEIGHT, STEPS, SHIFTS = 100, 60, 8


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix."""
    n = len(a)
    one = np.eye(n)
    x = a / np.linalg.norm(a)
    try:
        least = min(1.0, 1 / np.linalg.norm(np.linalg.inv(x)))
    except np.linalg.LinAlgError:
        least = EPS
    least = max(least, EPS)
    for _ in range(STEPS):
        sq = least * least
        d = (4 * max(0.0, 1 - sq) / sq**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - sq) / (sq * root))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > QR_WEIGHT:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            step = both[:n] @ both[n:].T / np.sqrt(r)
        else:
            step = np.linalg.solve(one + r * x.T @ x, x.T).T
        after = q / r * x + (p - q / r) * step
        after = (after + after.T) / 2
        least = min(1.0, least * (p + q * sq) / (1 + r * sq))
        moved, x = np.linalg.norm(after - x), after
        if moved <= (5 * EPS) ** (1 / 3) and 1 - least < 1e-8:
            break
    return x


def _divided(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first ``k`` columns span the eigenvectors above some shift, and ``k``; None if no shift divides."""
    n, diagonal = len(a), np.diag(a)
    middle = np.trace(a) / n
    for k in range(SHIFTS):
        # The median makes halves; the mean lies between the outer eigenvalues; others near it, should it be one of them.
        shift = [np.median(diagonal), middle][k] if k < 2 else middle + np.linalg.norm(a - middle * np.eye(n)) / n * rng.uniform(-0.9, 0.9)
        part = a - shift * np.eye(n)
        if not part.any():
            return None
        sign = polar(part)
        above = int(round((n + np.trace(sign)) / 2))
        if 0 < above < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-10 * n:
            project = (sign + np.eye(n)) / 2
            space = np.linalg.qr(project @ rng.standard_normal((n, above)))[0]
            return np.linalg.qr(project @ space, mode="complete")[0], above
    return None


def _vectors(a: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> Iterator[np.ndarray]:
    n = len(a)
    flat = np.linalg.norm(a - np.trace(a) / n * np.eye(n)) <= EPS * n * scale
    found = None if n == 1 or flat else _divided(a, rng)
    if found is None:  # one vector, or equal eigenvalues: any basis will do
        yield from basis.T
        return
    turn, k = found
    for part in (turn[:, :k], turn[:, k:]):
        inner = part.T @ a @ part
        yield from _vectors((inner + inner.T) / 2, basis @ part, scale, rng)


def eigenvectors(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit vectors (rows, the largest entry positive); spaces below are not divided."""
    n = len(a)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    rows = []
    for v in _vectors(a, np.eye(n), np.linalg.norm(a), np.random.default_rng(n)):
        rows.append(v / np.linalg.norm(v))
        if len(rows) == most:
            break
    c = np.array(rows)
    c *= np.sign(c[np.arange(len(c)), np.abs(c).argmax(axis=1)])[:, None]
    values = np.einsum("ij,jk,ik->i", c, a, c)
    order = np.argsort(-values, kind="stable")
    return values[order], c[order]

"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

How many eigenvalues lie above a number follows from the signs of an LDL' factorisation of the
shifted matrix (Sylvester's law of inertia). Bisection by such counts isolates each eigenvalue,
Rayleigh quotient iteration then converges to it cubically, and two more counts certify its number.
The matrix is dimensions by dimensions; nothing here grows with the rows it was made of.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(float).eps
# Growth bound of Bunch-Kaufman pivoting.
_ALPHA = (1 + 17**0.5) / 8
# Of eigenvalues closer than this share of the trace, the vectors are kept orthogonal as they are found.
_CLOSE = 1e-6


def positive_inertia(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues, from LDL' with pivots of one or two rows."""
    a = np.array(matrix, dtype=float)
    positive = 0
    while len(a):
        below = np.abs(a[1:, 0])
        r = int(np.argmax(below)) + 1 if len(below) else 0
        largest = below[r - 1] if r else 0.0
        if largest == 0.0:
            positive += a[0, 0] > 0
            a = a[1:, 1:]
            continue
        size, swap = 1, 0
        if abs(a[0, 0]) < _ALPHA * largest:
            row = np.abs(a[r])
            row[r] = 0.0
            beside = row.max()
            if abs(a[0, 0]) * beside < _ALPHA * largest**2:
                size, swap = (1, r) if abs(a[r, r]) >= _ALPHA * beside else (2, r)
        to = size - 1
        if swap and swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        if size == 1:
            positive += a[0, 0] > 0
            column = a[1:, 0].copy()
            pivot = a[0, 0]
            a = a[1:, 1:]
            a -= np.outer(column / pivot, column)
        else:
            # Such a pivot has one positive and one negative eigenvalue.
            positive += 1
            columns, pivot = a[2:, :2].copy(), a[:2, :2].copy()
            a = a[2:, 2:]
            a -= columns @ np.linalg.solve(pivot, columns.T)
    return int(positive)


@dataclass
class Eigenpair:
    value: float
    vector: np.ndarray
    below: float  #: a number with exactly as many eigenvalues above it as this one's number, or more if equal ones follow
    above: float  #: a number with fewer above it


def _solve(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``a`` inverse times ``v``; an exactly singular matrix is shifted by a rounding error."""
    for shift in (0.0, _EPS, 4 * _EPS, 64 * _EPS):
        try:
            return np.linalg.solve(a + shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("singular at every shift")


def _rayleigh(a: np.ndarray, shift: float, start: np.ndarray, found: list[np.ndarray]) -> tuple[float, np.ndarray, float]:
    """Eigenvalue near ``shift``, its vector and the residual; found vectors are kept out."""
    v, rho = start, shift
    best = (rho, v, np.inf)
    identity = np.eye(len(a))
    for step in range(50):
        w = _solve(a - rho * identity, v)
        for u in found:
            w -= (u @ w) * u
        v = w / np.linalg.norm(w)
        # Two steps with the fixed shift turn the start towards the isolated eigenvector.
        value = float(v @ a @ v)
        residual = float(np.linalg.norm(a @ v - value * v))
        if residual >= best[2] and step > 2:
            break
        if residual < best[2]:
            best = (value, v, residual)
        if step:
            rho = value
    return best


def leading_eigenpairs(matrix: np.ndarray, k: int) -> list[Eigenpair]:
    """Up to ``k`` eigenpairs of a positive semidefinite matrix, by falling eigenvalue.

    Eigenvalues that rounding cannot tell from zero are left out. Vectors of equal eigenvalues are
    orthogonal and in no particular order. Raises ArithmeticError if counts contradict a numbering.
    """
    d = len(matrix)
    scale = float(np.trace(matrix)) if d else 0.0
    if not scale > 0.0:
        return []
    a = (matrix + matrix.T) / (2 * scale)
    top = float(np.abs(a).sum(axis=1).max()) * (1 + 8 * _EPS)
    tiny = 4 * d * _EPS
    counts = {top: 0, tiny: positive_inertia(a - tiny * np.eye(d))}

    def above(number: float) -> int:
        if number not in counts:
            counts[number] = positive_inertia(a - number * np.eye(d))
        return counts[number]

    rng = np.random.default_rng(1)
    pairs: list[Eigenpair] = []
    for i in range(1, min(k, counts[tiny]) + 1):
        low = max(s for s, c in counts.items() if c >= i)
        high = min(s for s, c in counts.items() if c < i)
        while True:
            middle = (low + high) / 2
            narrow = high - low <= 8 * _EPS * max(abs(high), tiny)
            if narrow or (above(low) == i and above(high) == i - 1):
                start = rng.standard_normal(d)
                close = [p.vector for p in pairs if narrow or p.value / scale - middle < _CLOSE]
                value, vector, residual = _rayleigh(a, middle, start / np.linalg.norm(start), close)
                error = 4 * residual + 4 * d * _EPS
                inside = low - error <= value <= high + error and error < max(1e-3 * (high - low), 1e-10)
                if inside and above(value - error) >= i > above(value + error):
                    break
                if narrow:
                    raise ArithmeticError(f"counts contradict eigenvalue {i} between {low} and {high}")
            if above(middle) >= i:
                low = middle
            else:
                high = middle
        pairs.append(Eigenpair(value * scale, vector, (value - error) * scale, (value + error) * scale))
    return pairs

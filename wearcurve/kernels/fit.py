"""Fits of a * (exp(b t) - 1) with 1e-6 <= a <= 10 and 1e-4 <= b <= 10 by variable projection.

For a given b the best a has a closed form, so the fit is a search over b: a fixed grid (which SQL can repeat), then
golden sections around its best point.
"""

from __future__ import annotations

import numpy as np

A_MIN, A_MAX, B_MIN, B_MAX = 1e-6, 10.0, 1e-4, 10.0
#: The grid of b.
GRID = np.array([0.05 * k for k in range(1, 201)])
_RATIO = (np.sqrt(5) - 1) / 2
#: Golden sections of a refined fit.
ROUNDS = 60


def curve(t, a, b):
    return a * (np.exp(b * t) - 1)


def best_a(t: np.ndarray, y: np.ndarray, b: float) -> tuple[float, float]:
    """The clipped best a for this b, and its squared error."""
    g = np.exp(b * t) - 1
    gg = float(g @ g)
    a = min(A_MAX, max(A_MIN, float(y @ g) / gg)) if gg > 0 else A_MIN
    r = y - a * g
    return a, float(r @ r)


def fit_grid(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) with the least squared error over the grid; the smaller b of equals."""
    g = np.exp(np.outer(GRID, t)) - 1
    gg = np.maximum((g * g).sum(axis=1), 1e-300)
    a = np.clip(g @ y / gg, A_MIN, A_MAX)
    k = int(((y - a[:, None] * g) ** 2).sum(axis=1).argmin())
    return float(a[k]), float(GRID[k])


def fit(t: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[float, float]:
    """(a, b), refined between the neighbours of the grid's best point."""
    _, b = fit_grid(t, y)
    low, high = max(B_MIN, b - 0.05), min(B_MAX, b + 0.05)
    for _ in range(rounds):
        x1, x2 = high - _RATIO * (high - low), low + _RATIO * (high - low)
        if best_a(t, y, x1)[1] <= best_a(t, y, x2)[1]:
            high = x2
        else:
            low = x1
    b = (low + high) / 2
    return best_a(t, y, b)[0], b


def normalised(y: np.ndarray) -> tuple[np.ndarray, float, float]:
    low, high = float(y.min()), float(y.max())
    high = low + 1 if high - low < 1e-8 else high
    return (y - low) / (high - low), low, high


def static(y: np.ndarray, fit_window: int | None, threshold: float, fitter=fit) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Fitted curve, remaining life, a and b. The curve rises, so the life counts down to its first crossing."""
    z, low, high = normalised(y)
    n = len(y)
    m = min(fit_window or n, n)
    a, b = fitter(np.arange(m) / n, z[:m])
    fitted = curve(np.arange(n) / n, a, b) * (high - low) + low
    over = np.flatnonzero(fitted >= threshold * (high - low) + low)
    left = n - np.arange(n)
    return fitted, (np.maximum(0, over[0] - np.arange(n)) if len(over) else left).astype(float), a, b


def rolling(y: np.ndarray, window: int, every: int, threshold: float, fitter=fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fitted value, remaining life and whether a refit happened. Between refits only the default life changes."""
    z, low, high = normalised(y)
    n = len(y)
    fitted, life, refit = y.astype(float).copy(), (n - np.arange(n)).astype(float), np.zeros(n, bool)
    ahead = np.linspace(1.0, 3.0, 200)
    scaled = np.arange(window + 1) / max(window, 1)
    for i in range(window, n):
        if i == window or i % every == 0:
            a, b = fitter(scaled, z[i - window : i + 1])
            refit[i] = True
            now = curve(1.0, a, b) * (high - low) + low
            over = np.flatnonzero(curve(ahead, a, b) >= threshold)
        fitted[i] = now
        if len(over):
            life[i] = int(over[0] * window / 2)
    return fitted, life, refit

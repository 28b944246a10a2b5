"""Trends with few bends among many candidates, and bounds that widen as bends may come: for one series at a time, inside tasks."""

from __future__ import annotations

import numpy as np

#: Candidate bends, the part of the history that they lie in, and the scale of the prior of their sizes (with y and time scaled to 1).
CANDIDATES, PART, PRIOR = 25, 0.8, 0.05


def candidates(t: np.ndarray, most: int = CANDIDATES) -> np.ndarray:
    """Times of bends: as many observations apart in the first part of an ascending series."""
    last = int(PART * len(t))
    k = min(most, last - 1)
    return np.unique(t[np.linspace(0, last - 1, k + 1).round().astype(int)[1:]]) if k > 0 else np.zeros(0)


def hinges(t: np.ndarray, bends: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, t[:, None] - bends)


def lasso(gram: np.ndarray, target: np.ndarray, penalty: float, start: np.ndarray, sweeps: int = 1000, tolerance: float = 1e-9) -> np.ndarray:
    """Weights w of least w'Gw/2 - c'w + penalty * sum|w|, by coordinate descent."""
    w, slack = start.copy(), target - gram @ start
    for _ in range(sweeps):
        most = 0.0
        for k in range(len(w)):
            g = gram[k, k]
            if g <= 1e-12:
                continue
            pull = slack[k] + g * w[k]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / g
            if new != w[k]:
                slack -= gram[:, k] * (new - w[k])
                most, w[k] = max(most, abs(new - w[k]) * g**0.5), new
        if most < tolerance:
            break
    return w


class Fit:
    """y = level + slope * t + hinges + waves, with a ridge on the waves and a sparse prior on the hinges; scale multiplies each row's trend (1 if none)."""

    def __init__(self, t: np.ndarray, y: np.ndarray, waves: np.ndarray, ridge: float, prior: float = PRIOR, scale: np.ndarray | None = None, start: np.ndarray | None = None):
        self.unit = max(float(np.abs(y).max()), 1e-12)
        self.bends = candidates(t)
        times = np.ones(len(t)) if scale is None else scale
        free = np.hstack([np.stack([np.ones_like(t), t], axis=1) * times[:, None], waves])
        bent = hinges(t, self.bends) * times[:, None]
        y = y / self.unit
        inner = free.T @ free + np.diag([1e-9, 1e-9, *[ridge] * waves.shape[1]])
        solve = lambda b: np.linalg.lstsq(inner, b, rcond=None)[0]
        # What the free columns explain is taken out of both sides, so that bends alone are left to find.
        gram = bent.T @ bent - bent.T @ free @ solve(free.T @ bent)
        target = bent.T @ y - bent.T @ free @ solve(free.T @ y)
        w = np.zeros(len(self.bends)) if start is None else start
        dense = np.linalg.lstsq(gram + 1e-6 * np.eye(len(w)), target, rcond=None)[0] if len(w) else w
        for guess in (dense, None, None):  # the noise, and with it the penalty, comes from the residuals of the fit before
            guess = w if guess is None else guess
            left = y - bent @ guess - free @ solve(free.T @ (y - bent @ guess))
            noise = float(left @ left) / max(len(y) - free.shape[1], 1)
            w = lasso(gram, target, noise / prior, w)
        self.weights, self.free = w, solve(free.T @ (y - bent @ w))
        used = np.hstack([free, bent[:, w != 0]])
        left = y - free @ self.free - bent @ w
        self.freedom = max(len(y) - min(used.shape[1], len(y) - 1), 1)
        self.variance = float(left @ left) / self.freedom
        self.spread = np.linalg.pinv(used.T @ used + np.diag([1e-9, 1e-9, *[ridge] * waves.shape[1], *[1e-9] * int((w != 0).sum())]))

    def trend(self, t: np.ndarray) -> np.ndarray:
        return self.unit * (np.stack([np.ones_like(t), t], axis=1) @ self.free[:2] + hinges(t, self.bends) @ self.weights)

    def waves(self, waves: np.ndarray) -> np.ndarray:
        return self.unit * (waves @ self.free[2:])

    def deviation(self, t: np.ndarray, waves: np.ndarray, end: float) -> np.ndarray:
        """The standard deviation of a new value at t: noise, uncertain weights, and beyond the end bends to come.

        Bends come as often as candidates did, with sizes of their mean; at a distance h such bends add a variance of h^3 (rate * 2 size^2 / 3).
        """
        rows = np.hstack([np.stack([np.ones_like(t), t], axis=1), waves, hinges(t, self.bends)[:, self.weights != 0]])
        own = self.variance * (1 + np.einsum("ij,jk,ik->i", rows, self.spread, rows))
        size = float(np.abs(self.weights).mean()) if len(self.weights) else 0.0
        ahead = np.maximum(0.0, t - end)
        return self.unit * np.sqrt(np.maximum(own, 0.0) + len(self.bends) * 2 * size**2 * ahead**3 / 3)

"""Numpy kernels for short series, called inside tasks.

Parameters are found by a grid that shrinks around its best point; all grid
points of many series of one length run through the recursion together as one array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def grid_minimise(
    loss: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, series: int = 1, points: int = 5, rounds: int = 7
) -> np.ndarray:
    """Best parameters of each series; ``loss`` maps (series, candidates, parameters) to one number each."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    a, b = (np.repeat(x[None, :], series, axis=0) for x in (low, high))
    best, best_loss = (a + b) / 2, np.full(series, np.inf)
    places = np.indices((points,) * len(low)).reshape(len(low), -1)
    every = np.arange(series)
    for _ in range(rounds):
        axes = np.linspace(a, b, points, axis=-1)
        grid = np.stack([axes[:, j, at] for j, at in enumerate(places)], axis=2)
        values = np.nan_to_num(loss(grid), nan=np.inf, posinf=np.inf)
        i = values.argmin(axis=1)
        better = values[every, i] < best_loss
        best = np.where(better[:, None], grid[every, i], best)
        best_loss = np.where(better, values[every, i], best_loss)
        half = (b - a) / (points - 1)
        a, b = np.maximum(low, best - half), np.minimum(high, best + half)
    return best


def _smooth(y: np.ndarray, weights: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Additive level, trend and (period > 1) season of (series, time); a cell per candidate in ``weights``."""
    alpha, beta = weights[:, :, 0], weights[:, :, 1]
    shape = alpha.shape
    if period > 1:
        gamma = weights[:, :, 2]
        first = y[:, :period].mean(axis=1)
        level = np.repeat(first[:, None], shape[1], axis=1)
        slope = np.repeat(((y[:, period : 2 * period].mean(axis=1) - first) / period)[:, None], shape[1], axis=1)
        season = np.repeat((y[:, :period] - first[:, None]).T[:, :, None], shape[1], axis=2)
    else:
        gamma = np.zeros(shape)
        slope = np.repeat((y[:, 1] - y[:, 0] if y.shape[1] > 1 else np.zeros(len(y)))[:, None], shape[1], axis=1)
        level = y[:, :1] - slope
        season = np.zeros((1, *shape))
    fitted = np.empty((y.shape[1], *shape))
    for t in range(y.shape[1]):
        value = y[:, t, None]
        s = season[t % len(season)]
        fitted[t] = level + slope + s
        before = level
        level = alpha * (value - s) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        season[t % len(season)] = gamma * (value - level) + (1 - gamma) * s
    return fitted, level, slope, season


BLOCK_CELLS = 250_000
"""Series x time x candidates that run through a recursion together."""


def _in_blocks(y: np.ndarray, candidates: int, run: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The arrays of ``run`` over bounded numbers of series of one length."""
    y = np.ascontiguousarray(y, float)
    step = max(1, BLOCK_CELLS // max(1, candidates * y.shape[1]))
    return tuple(np.concatenate(parts) for parts in zip(*[run(y[i : i + step]) for i in range(0, len(y), step)]))


def smooth_many(y: np.ndarray, steps: int, period: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, forecast) of Holt (period 1) or additive Holt-Winters for every row of (series, time)."""
    size = 3 if period > 1 else 2

    def run(y: np.ndarray) -> tuple[np.ndarray, ...]:
        def loss(w: np.ndarray) -> np.ndarray:
            return ((y.T[:, :, None] - _smooth(y, w, period)[0]) ** 2).sum(axis=0)

        w = grid_minimise(loss, np.full(size, 0.001), np.full(size, 0.999), len(y))[:, None, :]
        fitted, level, slope, season = _smooth(y, w, period)
        ahead = np.arange(1, steps + 1)
        seasonal = season[(y.shape[1] + ahead - 1) % len(season), :, 0].T
        return fitted[:, :, 0].T, level + ahead * slope + seasonal

    return _in_blocks(y, 5**size, run)


def exponential_smoothing(y: np.ndarray, steps: int, period: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, forecast) of one series."""
    fitted, ahead = smooth_many(np.asarray(y, float)[None, :], steps, period)
    return fitted[0], ahead[0]


def _errors(z: np.ndarray, w: np.ndarray, period: int) -> np.ndarray:
    """Conditional one-step errors of the (1,1) x (1,1) model on differenced series (series, time)."""
    phi, theta = w[:, :, 0], w[:, :, 1]
    ar, ma = {1: phi}, {1: theta}
    if period > 1:
        big_phi, big_theta = w[:, :, 2], w[:, :, 3]
        ar = {1: phi, period: big_phi, period + 1: -phi * big_phi}
        ma = {1: theta, period: big_theta, period + 1: theta * big_theta}
    e = np.zeros((z.shape[1], *phi.shape))
    for t in range(z.shape[1]):
        guess = sum((c * z[:, t - lag, None] for lag, c in ar.items() if t >= lag), np.zeros(phi.shape))
        guess = guess + sum((c * e[t - lag] for lag, c in ma.items() if t >= lag), np.zeros(phi.shape))
        e[t] = z[:, t, None] - guess
    return e


def arima_many(y: np.ndarray, steps: int, period: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forecast, standard error, parameters) of (1,1,1), seasonal (1,1,1) added when period > 1, for every row of (series, time).

    Least conditional squares; the errors of the forecast follow from the
    moving-average weights of the integrated model.
    """
    difference = np.array([1.0, -1.0])
    seasonal = np.zeros(period + 1)
    seasonal[0], seasonal[-1] = 1.0, -1.0
    unit = np.convolve(difference, seasonal) if period > 1 else difference
    size = 4 if period > 1 else 2
    points = 7 if size == 2 else 5
    lost = period + 1 if period > 1 else 1

    def run(y: np.ndarray) -> tuple[np.ndarray, ...]:
        n = y.shape[1]
        z = np.stack([np.convolve(one, unit, mode="valid") for one in y])

        def loss(w: np.ndarray) -> np.ndarray:
            return (_errors(z, w, period)[min(lost, z.shape[1] - 1) :] ** 2).sum(axis=0)

        w = grid_minimise(loss, np.full(size, -0.98), np.full(size, 0.98), len(y), points)
        e = _errors(z, w[:, None, :], period)[:, :, 0]
        polynomials = []
        for one in w:
            ar, ma = np.array([1.0, -one[0]]), np.array([1.0, one[1]])
            if period > 1:
                far, fma = np.zeros(period + 1), np.zeros(period + 1)
                far[0], far[-1], fma[0], fma[-1] = 1.0, -one[2], 1.0, one[3]
                ar, ma = np.convolve(ar, far), np.convolve(ma, fma)
            polynomials.append((np.convolve(ar, unit), ma))
        full, ma = (np.stack(p, axis=1) for p in zip(*polynomials))
        values, errors = list(y.T), [*np.zeros((n - len(e), len(y))), *e]
        for _ in range(steps):
            at = len(values)
            past = sum(-full[i] * values[at - i] for i in range(1, len(full)) if at >= i)
            noise = sum(ma[j] * errors[at - j] for j in range(1, len(ma)) if at >= j)
            values.append(past + noise)
            errors.append(np.zeros(len(y)))
        psi = np.zeros((steps, len(y)))
        for j in range(steps):
            psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1))
        used = max(len(e) - lost, 1)
        sigma2 = np.ascontiguousarray((e[min(lost, len(e) - 1) :] ** 2).T).sum(axis=1) / used
        ahead = np.array(values[n:]).reshape(steps, len(y)).T
        return ahead, np.sqrt(sigma2[:, None] * np.cumsum(psi**2, axis=0).T), w

    return _in_blocks(y, points**size, run)


def arima(y: np.ndarray, steps: int, period: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forecast, standard error, parameters) of one series."""
    ahead, se, w = arima_many(np.asarray(y, float)[None, :], steps, period)
    return ahead[0], se[0], w[0]

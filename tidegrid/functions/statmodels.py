"""State-space smoothing and autoregression of one series, chosen by the corrected information criterion."""

from __future__ import annotations

import itertools

import numpy as np

from tidegrid.functions.kernels import trim_zeros

ALPHAS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8)
BETAS = (0.01, 0.05, 0.15)
GAMMAS = (0.01, 0.05, 0.15, 0.3)


def _aicc(squares: np.ndarray, n: int, k: int) -> np.ndarray:
    spare = n - k - 1
    return n * np.log(np.maximum(squares, 1e-12) / n) + 2 * k + (2 * k * (k + 1) / spare if spare > 0 else 1e6)


def ets(x: np.ndarray, horizon: int, season: int = 7, models: tuple[str, ...] | None = None) -> np.ndarray:
    """The best exponential smoothing model's mean forecast, clipped at zero.

    Models are error, trend and season letters: additive A, multiplicative M (series without zeros
    only), none N. All grid values of the smoothing factors run through the series at once.
    """
    x = trim_zeros(np.asarray(x, float))
    n = len(x)
    seasonal = n >= 2 * season + 3
    if models is None:
        models = ("ANN", "AAN", *(("ANA", "AAA") if seasonal else ()), *(("ANM",) if seasonal and (x > 0).all() else ()))
    if n < 4:
        return np.full(horizon, max(0.0, float(x.mean()))) if n else np.zeros(horizon)
    best, out = np.inf, np.zeros(horizon)
    for model in models:
        trend, kind = model[1] != "N", model[2]
        grids = (ALPHAS, BETAS if trend else (0.0,), GAMMAS if kind != "N" else (0.0,))
        a, b, g = (np.array(v) for v in zip(*itertools.product(*grids)))
        m = season if kind != "N" else 1
        head = x[: 2 * m] if kind != "N" else x[: min(n, 10)]
        level = np.full(len(a), head.mean())
        slope = np.full(len(a), (x[min(n, 10) - 1] - x[0]) / max(1, min(n, 10) - 1) if trend else 0.0)
        s = np.zeros((m, len(a))) if kind != "M" else np.ones((m, len(a)))
        if kind != "N":
            pattern = head.reshape(2, m).mean(axis=0)
            pattern = pattern - pattern.mean() if kind == "A" else pattern / max(pattern.mean(), 1e-9)
            s = np.repeat(pattern[:, None], len(a), axis=1)
        squares = np.zeros(len(a))
        for t, v in enumerate(x.tolist()):
            base, i = level + slope, t % m
            fit = base * s[i] if kind == "M" else base + s[i]
            e = v - fit
            squares += e * e
            step = e / np.maximum(s[i], 1e-9) if kind == "M" else e
            level = base + a * step
            if trend:
                slope = slope + b * a * step
            if kind == "A":
                s[i] = s[i] + g * (1 - a) * e
            elif kind == "M":
                s[i] = s[i] + g * (1 - a) * e / np.maximum(base, 1e-9)
        k = 2 + 2 * trend + (m if kind != "N" else 0)
        score = _aicc(squares, n, k)
        j = int(np.argmin(score))
        if score[j] < best:
            h = np.arange(1, horizon + 1)
            base = level[j] + slope[j] * h
            cycle = s[(n + h - 1) % m, j]
            best, out = score[j], base * cycle if kind == "M" else base + cycle
    return np.maximum(out, 0)


def _lags(y: np.ndarray, orders: tuple[int, ...], start: int) -> np.ndarray:
    return np.stack([y[start - k : len(y) - k] for k in orders], 1) if orders else np.zeros((len(y) - start, 0))


def arima(x: np.ndarray, horizon: int, season: int = 7, most: int = 2) -> np.ndarray:
    """The best small ARIMA model's mean forecast, clipped at zero: orders up to `most`, one difference at most, a seasonal lag or none.

    Estimated by two linear regressions: a long autoregression gives residuals, which stand in for
    the shocks of the moving-average terms.
    """
    x = trim_zeros(np.asarray(x, float))
    if len(x) < 4 * season:
        return np.full(horizon, max(0.0, float(x.mean()))) if len(x) else np.zeros(horizon)
    best, out = np.inf, np.full(horizon, x.mean())
    for d in (0, 1):
        y = np.diff(x) if d else x
        long = min(2 * season, len(y) // 4)
        design = np.column_stack([np.ones(len(y) - long), _lags(y, tuple(range(1, long + 1)), long)])
        coefficients, *_ = np.linalg.lstsq(design, y[long:], rcond=None)
        shocks = np.zeros(len(y))
        shocks[long:] = y[long:] - design @ coefficients
        start = long + season
        for p, q, seasonal in itertools.product(range(most + 1), range(most + 1), (False, True)):
            ar = tuple(sorted({*range(1, p + 1), *((season,) if seasonal else ())}))
            ma = tuple(range(1, q + 1))
            z = np.column_stack([np.ones(len(y) - start), _lags(y, ar, start), _lags(shocks, ma, start)])
            if len(z) <= z.shape[1] + 2:
                continue
            c, *_ = np.linalg.lstsq(z, y[start:], rcond=None)
            score = float(_aicc(((y[start:] - z @ c) ** 2).sum(), len(z), z.shape[1] + 1)) / len(z)
            if score < best - 1e-9 and np.abs(c[1 : 1 + len(ar)]).sum() < 1.5:
                values, noise = y.tolist(), shocks.tolist()
                for _ in range(horizon):
                    values.append(c[0] + sum(w * values[-k] for w, k in zip(c[1:], ar)) + sum(w * noise[-k] for w, k in zip(c[1 + len(ar) :], ma)))
                    noise.append(0.0)
                path = np.array(values[len(y) :])
                best, out = score, x[-1] + np.cumsum(path) if d else path
    return np.maximum(out, 0)

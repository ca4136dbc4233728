"""Volatility forecasters as numpy kernels that run inside grouped-map tasks.

A forecaster sees only the slice up to its origin. ``fit`` estimates, ``update`` moves the origin and keeps what was estimated,
``forecast`` gives a point and quantiles. A point goes back to volatility, through the insanity filter (models in levels), then to
the floor; quantiles are only floored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from emberpanel.operators.scores import LEVELS

#: Least forecast, factor above the largest value that counts as insane, and minimal samples (fixed values).
FLOOR, INSANE = 1e-8, 10.0
HAR_LAGS, HAR_MIN_ROWS, ARMA_MIN_ROWS = (1, 5, 22), 30, 100
EWMA_DECAY, PERSISTENCE = 0.94, 0.9995


class NotEnoughData(Exception):
    """Too little history, or a missing input; the harness records a missing forecast."""


class Forecaster:
    name = "forecaster"
    filtered = False
    needs: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.floored = self.insane = 0
        self.y, self.exog = np.zeros(0), {}

    def fit(self, y: np.ndarray, exog: dict[str, np.ndarray] | None = None) -> None:
        self._store(y, exog)
        self._estimate()

    def update(self, y: np.ndarray, exog: dict[str, np.ndarray] | None = None) -> None:
        self.fit(y, exog)

    def _store(self, y, exog) -> None:
        exog = exog or {}
        for name, values in exog.items():
            if len(values) > len(y):
                raise ValueError(f"{self.name}: {name} reaches past the origin")
        self.y, self.exog = np.asarray(y, float), {k: np.asarray(v, float) for k, v in exog.items()}
        if not len(self.y):
            raise NotEnoughData(f"{self.name}: empty history")

    def _estimate(self) -> None: ...

    def column(self, name: str) -> np.ndarray:
        if name not in self.exog:
            raise NotEnoughData(f"{self.name}: needs column {name}")
        return self.exog[name]

    # what a model defines, in its own space
    def point(self, h: int) -> float:
        raise NotImplementedError

    def centre(self, h: int) -> float:
        return self.point(h)

    def residuals(self, h: int) -> np.ndarray:
        return np.zeros(0)

    def inverse(self, value):
        return value

    def forecast(self, h: int, levels: tuple[float, ...] = LEVELS) -> tuple[float, dict[float, float]]:
        value = float(self.inverse(self.point(h)))
        if self.filtered and (not math.isfinite(value) or value <= 0 or value > INSANE * float(self.y.max())):
            self.insane += 1
            value = float(self.y.mean())
        if not math.isfinite(value) or value < FLOOR:
            self.floored += 1
            value = FLOOR
        own = self.residuals(h)
        own = own[np.isfinite(own)]
        if len(own) < 2:
            return value, {}
        spread = np.asarray(self.inverse(self.centre(h) + np.quantile(own, levels)), float)
        return value, dict(zip(levels, np.maximum(spread, FLOOR).tolist(), strict=True))


class RandomWalk(Forecaster):
    name = "random_walk"

    def point(self, h):
        return self.y[-1]

    def residuals(self, h):
        return self.y[h:] - self.y[:-h]


class HistoricalMean(Forecaster):
    def __init__(self, window: int | None = None):
        if window is not None and window < 2:
            raise ValueError("window must be at least 2")
        self.window = window
        self.name = "historical_mean" if window is None else f"historical_mean_{window}"
        super().__init__()

    def _running(self) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(self.y)))
        end = np.arange(1, len(self.y) + 1)
        start = np.zeros_like(end) if self.window is None else np.maximum(0, end - self.window)
        return (sums[end] - sums[start]) / (end - start)

    def point(self, h):
        return self.y.mean() if self.window is None else self.y[-self.window :].mean()

    def residuals(self, h):
        return self.y[h:] - self._running()[:-h]


class EWMA(Forecaster):
    def __init__(self, decay: float = EWMA_DECAY):
        if not 0 < decay < 1:
            raise ValueError("decay must be between 0 and 1")
        self.decay, self.name = decay, f"ewma_{decay:g}"
        super().__init__()

    def _estimate(self):
        if len(self.y) < 2:
            raise NotEnoughData(f"{self.name}: needs 2 values")
        inputs = (1 - self.decay) * self.y
        inputs[0] = self.y[0]  # seeded by the slice's first value
        self.level = decayed_sums(inputs, self.decay)

    def point(self, h):
        return self.level[-1]

    def residuals(self, h):
        return self.y[h:] - self.level[:-h]


def decayed_sums(x: np.ndarray, decay: float) -> np.ndarray:
    """s[k] = x[k] + decay s[k - 1], by doubling spans: after each step a value has twice as many terms."""
    out, power, span = np.array(x, float), decay, 1
    while span < len(out) and abs(power) > 1e-300:
        out[span:] += power * out[:-span].copy()
        power *= power
        span *= 2
    return out


def trailing_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last ``n`` values, NaN until there are ``n``."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.convolve(x, np.ones(n) / n, "valid") if np.isfinite(x).all() else np.lib.stride_tricks.sliding_window_view(x, n).mean(1)
    return out


def har_features(x: np.ndarray) -> np.ndarray:
    """[1, day, week, month] means, of full windows only."""
    return np.column_stack([np.ones(len(x)), *(trailing_mean(x, n) for n in HAR_LAGS)])


class HAR(Forecaster):
    """Direct least squares of the value h ahead on day, week and month means; estimated when a horizon is first asked for."""

    name, filtered = "har", True

    def transform(self, y):
        return y

    def design(self) -> np.ndarray:
        return har_features(self.z)

    def least_rows(self, k: int) -> int:
        return HAR_MIN_ROWS

    def fit(self, y, exog=None):
        self.fits: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        self.update(y, exog)

    def update(self, y, exog=None):
        self._store(y, exog)
        self.z = self.transform(self.y)
        self.x = self.design()

    def _fit(self, h):
        if h not in self.fits:
            a, b = self.x[:-h], self.z[h:]
            good = np.isfinite(a).all(1) & np.isfinite(b)
            k = a.shape[1]
            if good.sum() < self.least_rows(k):
                raise NotEnoughData(f"{self.name}: {int(good.sum())} rows")
            a, b = a[good], b[good]
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            error = b - a @ beta
            self.fits[h] = beta, error, float(error @ error) / max(1, len(b) - k)
        return self.fits[h]

    def centre(self, h):
        if not np.isfinite(self.x[-1]).all():
            raise NotEnoughData(f"{self.name}: last row incomplete")
        return float(self.x[-1] @ self._fit(h)[0])

    def point(self, h):
        return self.centre(h)

    def residuals(self, h):
        return self._fit(h)[1]


class LogHAR(HAR):
    """In logarithms; the point has the lognormal correction, quantiles have not."""

    filtered = False

    def __init__(self, correction: bool = True):
        self.correction, self.name = correction, "log_har"
        super().__init__()

    def transform(self, y):
        return np.log(np.where(y > 0, y, np.nan))

    def point(self, h):
        return self.centre(h) + (self._fit(h)[2] / 2 if self.correction else 0.0)

    def inverse(self, value):
        return np.exp(value)


class VarianceHAR(HAR):
    """In variances, back by the root."""

    def transform(self, y):
        return y * y

    def least_rows(self, k):
        return max(HAR_MIN_ROWS, 5 * k)

    def inverse(self, value):
        return np.sqrt(np.maximum(value, 0.0))


class HARJ(VarianceHAR):
    name, needs = "har_j", ("jump",)

    def design(self):
        return np.column_stack([har_features(self.z), self.column("jump")])


class HARRS(VarianceHAR):
    name, needs = "har_rs", ("var_rsp", "var_rsn")

    def design(self):
        base = har_features(self.z)
        return np.column_stack([base[:, 0], self.column("var_rsp"), self.column("var_rsn"), base[:, 2:]])


class HARQ(VarianceHAR):
    name, needs = "harq", ("var_rq",)

    def design(self):
        base = har_features(self.z)
        root = np.sqrt(np.where(self.column("var_rq") >= 0, self.column("var_rq"), np.nan))
        return np.column_stack([base, root / np.nanmean(root) * base[:, 1]])


def simplex(objective: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, rounds: int = 600, tolerance: float = 1e-9) -> np.ndarray:
    """Downhill simplex minimum from ``start``."""
    n = len(start)
    points = [np.array(start, float)]
    for k in range(n):
        p = points[0].copy()
        p[k] += step * (abs(p[k]) or 1.0)
        points.append(p)
    values = [objective(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        middle = np.mean(points[:-1], axis=0)
        reflected = middle + (middle - points[-1])
        value = objective(reflected)
        if value < values[0]:
            far = middle + 2 * (middle - points[-1])
            better = objective(far)
            points[-1], values[-1] = (far, better) if better < value else (reflected, value)
        elif value < values[-2]:
            points[-1], values[-1] = reflected, value
        else:
            near = middle + 0.5 * ((reflected if value < values[-1] else points[-1]) - middle)
            better = objective(near)
            if better < min(value, values[-1]):
                points[-1], values[-1] = near, better
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[objective(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


class MEM(Forecaster):
    """Multiplicative error model mu_t = omega + alpha x_{t-1} + beta mu_{t-1} by quasi maximum likelihood."""

    name = "mem"

    @staticmethod
    def recursion(x: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
        inputs = np.empty(len(x))
        inputs[0] = x.mean()
        inputs[1:] = omega + alpha * x[:-1]
        return decayed_sums(inputs, beta)

    def _loss(self, p) -> float:
        omega, alpha, beta = p
        if not (1e-10 <= omega <= max(self.y.mean(), 1.0) and 0 <= alpha <= 0.999 and 0 <= beta <= 0.999) or alpha + beta >= PERSISTENCE:
            return 1e12
        mu = self.recursion(self.y, omega, alpha, beta)
        return float((np.log(mu) + self.y / mu).sum()) if (mu > 0).all() and np.isfinite(mu).all() else 1e12

    def fit(self, y, exog=None):
        self._store(y, exog)
        if len(self.y) < ARMA_MIN_ROWS or (self.y <= 0).any():
            raise NotEnoughData(f"{self.name}: needs {ARMA_MIN_ROWS} positive values")
        start = np.array([0.1 * self.y.mean(), 0.3, 0.6])
        self.p = simplex(self._loss, simplex(self._loss, start))
        self.mu = self.recursion(self.y, *self.p)

    def update(self, y, exog=None):
        self._store(y, exog)
        if not hasattr(self, "p"):
            raise NotEnoughData(f"{self.name}: not fitted")
        self.mu = self.recursion(self.y, *self.p)

    def _ahead(self, one, h):
        omega, alpha, beta = self.p
        s = alpha + beta
        return omega * (1 - s ** (h - 1)) / (1 - s) + s ** (h - 1) * one

    def point(self, h):
        omega, alpha, beta = self.p
        return self._ahead(omega + alpha * self.y[-1] + beta * self.mu[-1], h)

    def residuals(self, h):
        omega, alpha, beta = self.p
        return self.y[h:] - self._ahead(omega + alpha * self.y[:-h] + beta * self.mu[:-h], h)


class AMEM(Forecaster):
    """Asymmetric variant; not defined, as its leverage term needs signed returns."""

    name = "amem"

    def fit(self, y, exog=None):
        raise NotImplementedError("AMEM is not implemented")


def arma_innovations(x: np.ndarray, mean: float, phi: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and their relative variances of a stationary ARMA(1, 1), exactly from the first value on."""
    n, z = len(x), x - mean
    error, scale = np.empty(n), np.ones(n)
    guess, r = 0.0, (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    t = 0
    while t < n and abs(r - 1.0) > 1e-14:  # the variance settles in a few steps
        error[t], scale[t] = z[t] - guess, r
        guess = phi * z[t] + theta / r * error[t]
        r = 1 + theta * theta - theta * theta / r
        t += 1
    if t < n:  # from there on the gain stands still
        inputs = z[t:].copy()
        inputs[0] -= guess
        inputs[1:] -= phi * z[t:-1]
        error[t:] = decayed_sums(inputs, -theta)
    return error, scale


class ARMA(Forecaster):
    """ARMA(1, 1) with a mean on log volatility by exact Gaussian likelihood; between fits its parameters stay."""

    name = "arma"

    def inverse(self, value):
        return np.exp(value)

    def _logs(self) -> np.ndarray:
        if len(self.y) < ARMA_MIN_ROWS or not (self.y > 0).all():
            raise NotEnoughData(f"{self.name}: needs {ARMA_MIN_ROWS} positive values")
        return np.log(self.y)

    @staticmethod
    def _loss(p, x) -> float:
        error, scale = arma_innovations(x, p[0], math.tanh(p[1]), math.tanh(p[2]))
        return len(x) * math.log(float((error**2 / scale).mean())) + float(np.log(scale).sum())

    def _learn(self, x: np.ndarray) -> None:
        spread = float(x.std()) or 1.0
        z = (x - x.mean()) / spread
        best = simplex(lambda p: self._loss(p, z), np.array([0.0, 1.0, -0.5]))
        self.p = x.mean() + best[0] * spread, math.tanh(best[1]), math.tanh(best[2])
        self.stale = arma_innovations(x, *self.p)[0]

    def _filter(self, x: np.ndarray) -> None:
        self.last, self.error = x[-1], arma_innovations(x, *self.p)[0][-1]

    def _path(self, h: int) -> np.ndarray:
        mean, phi, theta = self.p
        one = phi * (self.last - mean) + theta * self.error
        return mean + one * phi ** np.arange(h)

    def fit(self, y, exog=None):
        self._store(y, exog)
        x = self._logs()
        self._learn(x)
        self._filter(x)

    def update(self, y, exog=None):
        self._store(y, exog)
        if not hasattr(self, "p"):
            raise NotEnoughData(f"{self.name}: not fitted")
        self._filter(self._logs())

    def point(self, h):
        return float(self._path(h)[-1])

    def residuals(self, h):
        return self.stale * math.sqrt(h)


def gph_memory(x: np.ndarray, power: float = 0.5) -> float:
    """Memory d from the slope of the log periodogram at the lowest n^power frequencies, within [0, 0.499]."""
    n = len(x)
    m = min(max(4, int(n**power)), (n - 1) // 2)
    level = np.abs(np.fft.rfft(x - x.mean())[1 : m + 1]) ** 2 / (2 * math.pi * n)
    at = np.log(4 * np.sin(math.pi * np.arange(1, m + 1) / n) ** 2)
    good = level > 0
    if good.sum() < 2:
        return 0.0
    a = at[good] - at[good].mean()
    return float(np.clip(-(a @ np.log(level[good])) / (a @ a), 0.0, 0.499))


def binomial_weights(d: float, n: int) -> np.ndarray:
    """Coefficients of (1 - L)^d."""
    k = np.arange(1, n)
    return np.concatenate(([1.0], np.cumprod((k - 1 - d) / k)))


def fractional_difference(x: np.ndarray, d: float, truncation: int = 500) -> np.ndarray:
    return np.convolve(x, binomial_weights(d, min(len(x), truncation)))[: len(x)]


class ARFIMA(ARMA):
    """ARMA on fractionally differenced log volatility; memory and mean stay between fits."""

    name = "arfima"

    def fit(self, y, exog=None):
        self._store(y, exog)
        x = self._logs()
        self.d, self.mean = gph_memory(x), x.mean()
        self._learn(fractional_difference(x - self.mean, self.d))
        self._differences(x)

    def _differences(self, x):
        self.x = x - self.mean
        self._filter(fractional_difference(self.x, self.d))

    def update(self, y, exog=None):
        self._store(y, exog)
        if not hasattr(self, "p"):
            raise NotEnoughData(f"{self.name}: not fitted")
        self._differences(self._logs())

    def point(self, h):
        w = binomial_weights(self.d, 501)[1:]
        past = list(self.x[::-1][:500])
        for u in self._path(h):
            use = np.array(past[:500])
            past.insert(0, float(u - w[: len(use)] @ use))
        return past[0] + self.mean


class Foundation(Forecaster):
    """Adapter of a pretrained model: ``predict(context, past, future, horizon, levels)`` gives (horizon, levels) quantiles.

    One call serves all horizons of an origin. Missing values of past covariates are their median; covariates without any value
    and incomplete future ones are left out. ``companions`` are columns of other tickers' series on the same dates; one that is
    missing on more than half of them (so a ticker's own) is left out. A ``seed`` is set before every call, so a model that
    draws gives the same for an origin in whatever task it runs.
    """

    def __init__(self, predict, name: str = "foundation", past: tuple[str, ...] = (), future: str | None = None, longest: int = 22, context: int = 2048, companions: tuple[str, ...] = (), seed: int | None = None):
        self.predict, self.name, self.past, self.future, self.longest, self.context = predict, name, past, future, longest, context
        self.companions, self.seed = companions, seed
        super().__init__()

    def _estimate(self):
        past = {}
        for c in self.past:
            if c in self.exog and np.isfinite(self.exog[c]).any():
                v = self.exog[c][-self.context :]
                past[c] = np.where(np.isfinite(v), v, np.nanmedian(v))
        for c in self.companions:
            if c in self.exog and np.isfinite(v := self.exog[c][-self.context :]).mean() >= 0.5:
                past[c] = np.where(np.isfinite(v), v, np.nanmedian(v))
        if self.seed is not None:
            np.random.seed(self.seed)  # noqa: NPY002 - models draw from the global generator
        ahead = self.exog.get(f"{self.future}_ahead") if self.future else None
        future = ahead[: self.longest] if ahead is not None and len(ahead) >= self.longest and np.isfinite(ahead[: self.longest]).all() else None
        self.grid = np.asarray(self.predict(self.y[-self.context :], past, future, self.longest, LEVELS), float)

    def forecast(self, h, levels=LEVELS):
        row = np.maximum(self.grid[h - 1], FLOOR)
        return float(row[LEVELS.index(0.5)]), dict(zip(LEVELS, row.tolist(), strict=True))


def resolve_device(device: str = "auto") -> str:
    """``device``, or for "auto" the graphics card if there is one that a model can use, else the processor."""
    if device != "auto":
        return device
    try:
        from torch import cuda
    except ImportError:
        return "cpu"
    return "cuda" if cuda.is_available() else "cpu"


_PIPELINES: dict[tuple[str, str], object] = {}


def load_pipeline(checkpoint: str, device: str, loader: Callable[[str, str], object]) -> object:
    """A pretrained model, loaded once in a Python worker."""
    device = resolve_device(device)
    if (checkpoint, device) not in _PIPELINES:
        _PIPELINES[checkpoint, device] = loader(checkpoint, device)
    return _PIPELINES[checkpoint, device]


def clear_pipelines() -> None:
    _PIPELINES.clear()


def baseline_models(with_mem: bool = False) -> dict[str, Callable[[], Forecaster]]:
    made = [RandomWalk, HistoricalMean, EWMA, HAR, LogHAR, *([MEM] if with_mem else [])]
    return {f().name: f for f in made}


def published_models(exog: bool = True, slow: bool = True, mem: bool = True, naive: bool = False) -> dict[str, Callable[[], Forecaster]]:
    made = [HAR, LogHAR, *([MEM] if mem else []), *([HARJ, HARRS, HARQ] if exog else []), *([ARMA, ARFIMA] if slow else []), *([RandomWalk, HistoricalMean, EWMA] if naive else [])]
    return {f().name: f for f in made}

"""Regression with seasonal ARMA errors by exact likelihood.

Differences start diffuse: given the first values of a series, the likelihood of what is left is that of the differenced
series, whose ARMA part starts from its stationary distribution. A Kalman filter in blocks of rows whitens the series and
the exogenous columns alike, so that coefficients and variance are worked out for any ARMA parameters (profile likelihood)
and only these are searched for, by a quasi-Newton method over partial autocorrelations, which keeps polynomials stationary
and invertible. The filter takes many parameter sets at once: all points of a gradient are one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 16
#: Partial autocorrelations stay this far within 1, so that stationary covariances are finite.
MARGIN = 1e-6


def _stable(free: np.ndarray) -> np.ndarray:
    """c of stationary polynomials 1 - c1 B - c2 B^2 ..., from a row of unbounded numbers for each."""
    partial = (1 - MARGIN) * np.tanh(free)
    c = partial[:, :0]
    for k in range(free.shape[1]):
        last = partial[:, k : k + 1]
        c = np.concatenate([c - last * c[:, ::-1], last], axis=1)
    return c


def _free(c: np.ndarray) -> np.ndarray:
    """The numbers that ``_stable`` makes ``c`` of; what isn't stationary is moved inside."""
    c, partial = np.array(c, dtype=float), []
    while len(c):
        last = float(np.clip(c[-1], -0.9, 0.9))
        partial.append(last)
        c = (c[:-1] + last * c[-2::-1]) / (1 - last * last) if len(c) > 1 else c[:0]
    return np.arctanh(partial[::-1])


def _product(short: np.ndarray, seasonal: np.ndarray, period: int) -> np.ndarray:
    """The polynomials' product, its leading 1 left out."""
    out = np.zeros((len(short), 1 + short.shape[1] + period * seasonal.shape[1]))
    for j in range(seasonal.shape[1] + 1):
        factor = -seasonal[:, j - 1 : j] if j else np.ones((len(short), 1))
        out[:, period * j] += factor[:, 0]
        out[:, period * j + 1 : period * j + 1 + short.shape[1]] -= factor * short
    return out[:, 1:]


def _t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, 1, 2)


class Filter:
    """ARMA processes of unit shocks in state-space form, one for each row of ``phi`` and ``theta``."""

    def __init__(self, phi: np.ndarray, theta: np.ndarray):
        self.size = max(phi.shape[1], theta.shape[1] + 1)
        self.step = np.zeros((len(phi), self.size, self.size))
        self.step[:, : phi.shape[1], 0] = phi
        self.step[:, np.arange(self.size - 1), np.arange(1, self.size)] = 1
        self.shock = np.zeros((len(phi), self.size, 1))
        self.shock[:, 0, 0], self.shock[:, 1 : theta.shape[1] + 1, 0] = 1, theta

    def stationary(self) -> np.ndarray:
        """The state's covariance before anything is seen, by doubling: the sum over all powers of ``step``."""
        cov, power = self.shock @ _t(self.shock), self.step
        for _ in range(64):
            cov, power = cov + power @ cov @ _t(power), power @ power
            if np.abs(power).max() < 1e-15:
                break
        return cov

    def block(self, rows: int) -> tuple[np.ndarray, ...]:
        """(seen, noise, jump, spread): what ``rows`` values show of the state before them and of the shocks since, and what the state becomes by both."""
        m, weights, power, seen = len(self.step), [self.shock], np.broadcast_to(np.eye(self.size), self.step.shape), []
        for _ in range(rows):
            seen.append(power[:, :1])
            power = power @ self.step
            weights.append(self.step @ weights[-1])
        noise = np.zeros((m, rows, rows))
        for i in range(1, rows):
            for j in range(i):
                noise[:, i, j] = weights[i - j - 1][:, 0, 0]
        return np.concatenate(seen, 1), noise, power, np.concatenate(weights[rows - 1 :: -1], 2)

    def run(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each process: the columns of ``data`` whitened, the sum of the variances' logarithms, the last state's means and covariance."""
        n, mean, cov = len(data), np.zeros((len(self.step), self.size, data.shape[1])), self.stationary()
        logs, white, settled, at = np.zeros(len(self.step)), [], False, 0
        whole = self.block(BLOCK)
        while at < n:
            rows = n % BLOCK if at == 0 and n % BLOCK else BLOCK
            seen, noise, jump, spread = whole if rows == BLOCK else self.block(rows)
            v = data[at : at + rows] - seen @ mean
            if not settled:
                root = np.linalg.cholesky(seen @ cov @ _t(seen) + noise @ _t(noise))
                undo = np.linalg.inv(root)
                gain = undo @ _t(jump @ cov @ _t(seen) + spread @ _t(noise))
                new = jump @ cov @ _t(jump) + spread @ _t(spread) - _t(gain) @ gain
                settled = rows == BLOCK and bool(np.abs(new - cov).max() <= 1e-13 * np.abs(new).max())
                log, cov = 2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1), new
            got = undo @ v
            white.append(got)
            mean, logs, at = jump @ mean + _t(gain) @ got, logs + log, at + rows
        return np.concatenate(white, 1), logs, mean, cov


def minimum(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tolerance: float = 1e-7, rounds: int = 200) -> np.ndarray:
    """Where ``f``, of many points at once, is least near ``x`` (BFGS); ArithmeticError if it isn't reached in ``rounds``."""
    k, h = len(x), 1e-6
    if not k:
        return x

    def slope_at(p: np.ndarray, value: float) -> np.ndarray:
        return (f(p + h * np.eye(k)) - value) / h

    value = f(x[None])[0]
    slope, inverse, plain = slope_at(x, value), np.eye(k), True
    for _ in range(rounds):
        way = -inverse @ slope
        if not way @ slope < 0:
            way, inverse, plain = -slope, np.eye(k), True
        tried = x + (way * min(1.0, 1.0 / max(np.abs(way).max(), 1e-300))) * 0.25 ** np.arange(5)[:, None]
        values = f(tried)
        best = int(np.argmin(values))
        if not value - values[best] > tolerance:
            if plain:
                return x
            inverse, plain = np.eye(k), True
            continue
        new = slope_at(tried[best], values[best])
        s, g = tried[best] - x, new - slope
        if (sg := s @ g) > 1e-14:
            turn = np.eye(k) - np.outer(s, g) / sg
            inverse, plain = turn @ inverse @ turn.T + np.outer(s, s) / sg, False
        x, value, slope = tried[best], values[best], new
    raise ArithmeticError("no minimum was reached")


def differenced(a: np.ndarray, d: int, sd: int, period: int) -> np.ndarray:
    for _ in range(sd):
        a = a[period:] - a[:-period]
    return np.diff(a, n=d, axis=0) if d else a


class SeasonalArma:
    """y = X beta + errors; the errors' differences follow an ARMA process whose polynomials are products of a short and a seasonal one."""

    def __init__(self, order: tuple[int, int, int], seasonal: tuple[int, int, int, int]):
        (self.p, self.d, self.q), (self.sp, self.sd, self.sq, self.period) = order, seasonal

    def polynomials(self, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phi, theta) of the rows of unbounded parameters."""
        short, seasonal, ma, seasonal_ma = (_stable(part) for part in np.split(free, np.cumsum([self.p, self.sp, self.q]), axis=1))
        return -_product(short, seasonal, self.period), _product(ma, seasonal_ma, self.period)

    def _start(self, e: np.ndarray) -> np.ndarray:
        """Parameters by Hannan-Rissanen: residuals of a long autoregression stand in for the shocks, one regression follows."""
        ar, ma = ([*range(1, short + 1), *(self.period * j for j in range(1, seasonal + 1))] for short, seasonal in ((self.p, self.sp), (self.q, self.sq)))
        reach = max([*ar, *ma, 1])
        long = min(reach + 10, len(e) // 4)
        behind = lambda a, lags, start: np.column_stack([a[start - k : len(a) - k] for k in lags])
        lagged, shock = behind(e, range(1, long + 1), long), np.zeros_like(e)
        shock[long:] = e[long:] - lagged @ np.linalg.lstsq(lagged, e[long:], rcond=None)[0]
        columns = [behind(a, lags, long + reach) for a, lags in ((e, ar), (shock, ma)) if lags]
        c = np.linalg.lstsq(np.column_stack(columns), e[long + reach :], rcond=None)[0]
        short, seasonal, ma, seasonal_ma = np.split(c, np.cumsum([self.p, self.sp, self.q]))
        return np.concatenate([_free(short), _free(seasonal), _free(-ma), _free(-seasonal_ma)])

    def fit(self, y: np.ndarray, x: np.ndarray, near: np.ndarray | None = None) -> SeasonalArma:
        """``near``: parameters (``free``) of a fit to much the same series, tried as a start besides. ArithmeticError where nothing settles."""
        x = np.column_stack([x, np.ones(len(x))]) if not self.d + self.sd else x
        w, z = differenced(y, self.d, self.sd, self.period), differenced(x, self.d, self.sd, self.period)
        if len(w) < 4 * (2 + z.shape[1] + self.p + self.q + self.period * (self.sp + self.sq)):
            raise ArithmeticError("too short")
        left, scale, right = np.linalg.svd(z, full_matrices=False)
        kept = scale > 1e-10 * scale[0]
        basis, n = left[:, kept], len(w)
        data, e = np.column_stack([w, basis]), w - basis @ (basis.T @ w)

        def regress(white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            gram = _t(white) @ white
            c = np.linalg.solve(gram[:, 1:, 1:], gram[:, 1:, :1])
            return c, np.maximum(gram[:, 0, 0] - (gram[:, :1, 1:] @ c)[:, 0, 0], 1e-300)

        def lack(free: np.ndarray) -> np.ndarray:
            white, logs, _, _ = Filter(*self.polynomials(free)).run(data)
            out = np.log(regress(white)[1] / n) + logs / n
            return np.where(np.isfinite(out), out, np.inf)

        self.free = np.zeros(self.p + self.sp + self.q + self.sq)
        if np.abs(e).max() > 1e-9 * max(1.0, np.abs(y).max()):  # else there is nothing left to follow
            starts = np.array([self.free + 0.1, self._start(e), *([] if near is None else [near])])
            self.free = minimum(lack, starts[np.argmin(lack(starts))])
        phi, theta = self.polynomials(self.free[None])
        white, logs, mean, cov = Filter(phi, theta).run(data)
        c, rss = regress(white)
        self.phi, self.theta, self.cov, self.mean = phi[0], theta[0], cov[0], mean[0, :, 0] - mean[0, :, 1:] @ c[0, :, 0]
        self.beta = right[kept].T @ (c[0, :, 0] / scale[kept])
        self.sigma, self.errors = float(np.sqrt(rss[0] / n)), y - x @ self.beta
        self.likelihood = float(-(n * (np.log(2 * np.pi * rss[0] / n) + 1) + logs[0]) / 2)
        return self

    def differences(self) -> dict[int, float]:
        """Lags of the polynomial that takes the differences."""
        lags = {0: 1.0}
        for period in [self.period] * self.sd + [1] * self.d:
            new = dict(lags)
            for k, v in lags.items():
                new[k + period] = new.get(k + period, 0.0) - v
            lags = new
        return lags

    def state(self) -> dict[str, list[float] | float]:
        """All that a forecast needs: coefficients, the filter's last state and the last values that differences look back to."""
        tail = self.errors[-max(1, *self.differences()) :]
        parts = {"beta": self.beta, "phi": self.phi, "theta": self.theta, "mean": self.mean, "cov": self.cov.ravel(), "errors": tail}
        return {"sigma": self.sigma} | {k: v.tolist() for k, v in parts.items()}

    def restored(self, state: dict) -> SeasonalArma:
        """A model of a state, which forecasts as the one that it was taken of."""
        for name in ("beta", "phi", "theta", "mean", "cov", "errors"):
            setattr(self, name, np.asarray(state[name], dtype=float))
        self.sigma, self.cov = float(state["sigma"]), self.cov.reshape(len(self.mean), -1)
        return self

    def forecast(self, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard errors for the rows of exogenous values ``ahead``."""
        h = len(ahead)
        ahead = np.column_stack([ahead, np.ones(h)]) if not self.d + self.sd else ahead
        seen, noise, _, _ = (a[0] for a in Filter(self.phi[None], self.theta[None]).block(h))
        lags, summed = self.differences(), np.eye(h)  # each row of ``summed`` is a level's share of the differences so far
        out = np.r_[self.errors, seen @ self.mean]
        for t in range(h):
            at = len(self.errors) + t
            out[at] -= sum(v * out[at - k] for k, v in lags.items() if k)
            summed[t] -= sum(v * summed[t - k] for k, v in lags.items() if 0 < k <= t)
        spread = summed @ (seen @ self.cov @ seen.T + noise @ noise.T) @ summed.T
        return out[len(self.errors) :] + ahead @ self.beta, self.sigma * np.sqrt(np.diagonal(spread))

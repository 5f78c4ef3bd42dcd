import numpy as np
import pytest

from isotherm.operators import state_space


def simulated(draw, model, free, n):
    """A series of ``n`` rows of a model's ARMA part, shocks of variance 1."""
    phi, theta = (a[0] for a in model.polynomials(np.array([free])))
    shock, out = draw.normal(size=n + 400), np.zeros(n + 400)
    for t in range(20, n + 400):
        out[t] = shock[t] + phi @ out[t - 1 - np.arange(len(phi))] + theta @ shock[t - 1 - np.arange(len(theta))]
    return out[400:]


@pytest.mark.parametrize("rows", [7, 16, 75])
def test_the_filter_gives_the_likelihood_of_the_whole_covariance(rows):
    model = state_space.SeasonalArma((2, 0, 1), (1, 0, 1, 7))
    phi, theta = model.polynomials(np.array([[0.5, -0.3, 0.4, 0.6, -0.2], [0.9, 0.1, -0.4, -1.5, 2.0]]))
    data = np.random.default_rng(0).normal(size=(rows, 2))
    white, logs, _, _ = state_space.Filter(phi, theta).run(data)
    for i in range(2):
        psi = np.zeros(9000)
        for t in range(len(psi)):
            psi[t] = (t == 0) + (theta[i][t - 1] if 0 < t <= len(theta[i]) else 0) + sum(f * psi[t - 1 - k] for k, f in enumerate(phi[i]) if k < t)
        gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(rows)])
        cov = gamma[np.abs(np.subtract.outer(np.arange(rows), np.arange(rows)))]
        assert np.allclose(white[i].T @ white[i], data.T @ np.linalg.solve(cov, data), rtol=1e-7)
        assert logs[i] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-7)


@pytest.mark.parametrize("order,seasonal,free", [((1, 1, 1), (1, 0, 0, 7), [0.7, 0.5, -0.4]), ((2, 0, 1), (0, 0, 1, 7), [0.5, -0.3, 0.6, 0.4]), ((0, 1, 1), (0, 1, 1, 7), [0.4, 0.5])])
def test_a_fit_finds_the_parameters_of_a_simulated_series(order, seasonal, free):
    model = state_space.SeasonalArma(order, seasonal)
    y = simulated(np.random.default_rng(5), model, free, 3000)
    for period in [1] * order[1] + [7] * seasonal[1]:
        for start in range(period):
            y[start::period] = np.cumsum(y[start::period])
    x = np.random.default_rng(6).normal(size=(3000, 2))
    model.fit(y + x @ [2.0, -1.0], x)
    for got, want in zip((model.phi, model.theta), (a[0] for a in model.polynomials(np.array([free]))), strict=True):
        assert np.allclose(got, want, atol=0.09), (got, want)
    assert model.sigma == pytest.approx(1, abs=0.05) and np.allclose(model.beta[:2], [2, -1], atol=0.1)
    # no point near by has a greater likelihood
    for move in (0.02, -0.02):
        for k in range(len(free)):
            other = state_space.SeasonalArma(order, seasonal)
            phi, theta = other.polynomials((model.free + move * np.eye(len(free))[k])[None])
            full = np.column_stack([x, np.ones(len(x))]) if not order[1] + seasonal[1] else x
            w = state_space.differenced(np.column_stack([y + x @ [2.0, -1.0], full]), order[1], seasonal[1], 7)
            white, logs, _, _ = state_space.Filter(phi, theta).run(w)
            rest = white[0, :, 0] - white[0, :, 1:] @ np.linalg.lstsq(white[0, :, 1:], white[0, :, 0], rcond=None)[0]
            n = len(w)
            assert -(n * (np.log(2 * np.pi * (rest @ rest) / n) + 1) + logs[0]) / 2 <= model.likelihood + 0.01


def test_intervals_hold_their_share():
    """Forecasts of 120 simulated series: about 95 of 100 true values lie within, at each step ahead."""
    order, seasonal, draw, held = (1, 1, 1), (1, 0, 0, 7), np.random.default_rng(8), []
    for _ in range(120):
        model = state_space.SeasonalArma(order, seasonal)
        y = np.cumsum(simulated(draw, model, [0.5, 0.4, -0.5], 430))
        x = np.random.default_rng(9).normal(size=(430, 1))
        mean, error = model.fit(y[:400], x[:400]).forecast(x[400:])
        held.append(np.abs(y[400:] - mean) <= 1.959964 * error)
    share = np.mean(held, axis=0)
    assert share.min() > 0.86 and 0.92 < share.mean() < 0.98, share


def test_series_without_noise_and_short_ones():
    x = np.random.default_rng(1).normal(size=(120, 2))
    flat = state_space.SeasonalArma((1, 1, 1), (1, 0, 1, 7)).fit(np.full(120, 4.0), x)
    mean, error = flat.forecast(x[:5])
    assert np.allclose(mean, 4) and np.allclose(error, 0, atol=1e-6)
    with pytest.raises(ArithmeticError):
        state_space.SeasonalArma((1, 1, 1), (1, 0, 1, 7)).fit(np.arange(20.0), x[:20])

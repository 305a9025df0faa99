"""Vectorised numerics for the negative-binomial fits (numpy only; runs inside Arrow batches).

scipy is not assumed: differences of log gamma and its derivatives are taken by recurrence and Stirling
series, ``trigamma`` likewise, the normal tail uses ``math.erfc``.
"""

from __future__ import annotations

import math

import numpy as np

COARSE = 12                # candidates a gene on the grid that brackets its best dispersion
NEWTON_STEPS = 80          # at most; a step that leaves the bracket is replaced by halving it
NEWTON_TOL = 1e-13         # change of log dispersion that ends a gene's search
BLOCK_VALUES = 2_000_000   # doubles in one (genes, candidates, samples) array
CACHE_VALUES = 16_384      # doubles of such an array worked on at a time, few enough for the processor's caches


def trigamma(x: float) -> float:
    """psi'(x) for scalar x > 0."""
    acc = 0.0
    while x < 10.0:
        acc += 1.0 / (x * x)
        x += 1.0
    xi = 1.0 / x
    xi2 = xi * xi
    return acc + xi + xi2 / 2 + xi2 * xi * (1.0 / 6 - xi2 * (1.0 / 30 - xi2 * (1.0 / 42 - xi2 / 30)))


def norm_two_sided_p(z):
    """2 * P(Z > |z|) = erfc(|z| / sqrt 2), elementwise; null stays NaN."""
    z = np.asarray(z, dtype=np.float64)
    out = np.full(z.shape, np.nan)
    ok = np.isfinite(z)
    out[ok] = np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z[ok]])
    return out


def gene_blocks(batches, n_samples: int):
    """Batches cut so that the (genes, candidates, samples) arrays of a search hold at most BLOCK_VALUES."""
    size = max(1, BLOCK_VALUES // (COARSE * n_samples))
    for pdf in batches:
        for start in range(0, max(len(pdf), 1), size):
            yield pdf.iloc[start:start + size].reset_index(drop=True)


def f_quantile_df1_2(p: float, d2: float) -> float:
    """Quantile of F(2, d2): P(F <= x) = 1 - (1 + 2x/d2)^(-d2/2)."""
    return (d2 / 2.0) * ((1.0 - p) ** (-2.0 / d2) - 1.0)


_STEPS = np.arange(10.0)


def _stirling(z):
    """lgamma(z) - ((z - 1/2) log z - z + log(2 pi) / 2) for z >= 10."""
    u = 1.0 / (z * z)
    return (1.0 / 12 - u * (1.0 / 360 - u * (1.0 / 1260 - u * (1.0 / 1680 - u / 1188)))) / z


def lgamma(x):
    """log Gamma(x) for x > 0, elementwise."""
    x = np.asarray(x, dtype=np.float64)
    z = x + 10.0
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2.0 * math.pi) + _stirling(z) - sum(np.log(x + i) for i in _STEPS)


def _stirling_slopes(z):
    """First and second derivative of log gamma less log z and 1 / z, for z >= 10."""
    i, u = 1.0 / z, 1.0 / (z * z)
    one = -0.5 * i - u * (1.0 / 12 - u * (1.0 / 120 - u * (1.0 / 252 - u * (1.0 / 240 - u / 132))))
    two = 0.5 * u + i * u * (1.0 / 6 - u * (1.0 / 30 - u * (1.0 / 42 - u * (1.0 / 30 - u * 5.0 / 66))))
    return one, two


def _rising(r, y):
    """lgamma(y + r) - lgamma(r) - y log(r + y + 10) + y, without cancellation for large r: ten steps of the
    recurrence as one product, the rest as a difference of Stirling series."""
    ratio = np.ones(np.broadcast(r, y).shape)
    for i in _STEPS:
        ratio *= (r + i) / (r + y + i)
    z = r + 10.0
    return (z - 0.5) * np.log1p(y / z) + _stirling(z + y) - _stirling(z) + np.log(ratio)


def nb_loglik_cr(log_alpha, y, mu, groups, n_groups: int):
    """Cox-Reid adjusted NB profile log-likelihood of log(dispersion), per gene.

    ``log_alpha``: (G, K) candidate values; ``y``, ``mu``: (G, S); ``groups``: (S,) group index.
    Returns (G, K). The adjustment for a cell-means design is -1/2 * sum_g log(sum_{j in g} W_j),
    W = mu / (1 + alpha mu).
    """
    a = np.exp(log_alpha)[:, :, None]          # G, K, 1
    r = 1.0 / a
    yy, mm = y[:, None, :], mu[:, None, :]
    ll = (_rising(r, yy) - yy + yy * np.log1p((10.0 + yy - mm) / (mm + r)) - r * np.log1p(mm * a)).sum(axis=2)
    w = mm / (1.0 + a * mm)
    for g in range(n_groups):
        ll -= 0.5 * np.log(w[:, :, groups == g].sum(axis=2))
    return ll


def nb_slopes_cr(log_alpha, y, mu, groups, n_groups: int):
    """First and second derivative of :func:`nb_loglik_cr` at one log(dispersion) per gene."""
    a = np.exp(log_alpha)[:, None]
    r = 1.0 / a
    z = r + 10.0
    (e1, e2), (f1, f2) = _stirling_slopes(z + y), _stirling_slopes(z)
    one = np.log1p(y / z) + e1 - f1
    two = -y / (z * (z + y)) + e2 - f2
    for i in _STEPS:
        p, q = 1.0 / (r + i), 1.0 / (r + y + i)
        one += y * p * q
        two -= y * p * q * (p + q)
    one += (mu - y) / (mu + r) - np.log1p(mu * a)          # d / dr
    two += mu * a / (r + mu) - (mu - y) / (mu + r) ** 2    # d2 / dr2
    d1 = (-r * one).sum(axis=1)
    d2 = (r * one + r * r * two).sum(axis=1)
    w = mu / (1.0 + a * mu)
    s1, s2 = -a * w * w, a * w * w * (2.0 * a * w - 1.0)
    for g in range(n_groups):
        m = groups == g
        s, t, u = w[:, m].sum(axis=1), s1[:, m].sum(axis=1), s2[:, m].sum(axis=1)
        d1 -= 0.5 * t / s
        d2 -= 0.5 * (u / s - (t / s) ** 2)
    return d1, d2


def best_log_alpha(y, mu, groups, n_groups: int, lo: float, hi: float, prior_mean=None, prior_var: float = np.inf):
    """log(dispersion) of the largest Cox-Reid likelihood in [lo, hi], with a normal prior if ``prior_mean`` is given.

    A grid of COARSE points brackets the best one, then Newton steps on the derivative inside the bracket,
    halving it where a step would leave it; an end of the range is the answer where the slope points out of it."""
    prior = np.zeros(len(y)) if prior_mean is None else prior_mean
    weight = 0.0 if prior_mean is None else 1.0 / prior_var

    def slopes(la, rows):
        d1, d2 = nb_slopes_cr(la, y[rows], mu[rows], groups, n_groups)
        return d1 - (la - prior[rows]) * weight, d2 - weight

    grid = np.linspace(lo, hi, COARSE)
    size = max(1, CACHE_VALUES // (COARSE * y.shape[1]))
    value = np.empty((len(y), COARSE))
    for k in range(0, len(y), size):
        some = y[k:k + size]
        value[k:k + size] = nb_loglik_cr(np.tile(grid, (len(some), 1)), some, mu[k:k + size], groups, n_groups)
    value -= 0.5 * weight * (grid[None, :] - prior[:, None]) ** 2
    top = value.argmax(axis=1)
    low, high = grid[np.maximum(top - 1, 0)], grid[np.minimum(top + 1, COARSE - 1)]
    at, live = grid[top].copy(), np.arange(len(y))
    for _ in range(NEWTON_STEPS):
        d1, d2 = slopes(at[live], live)
        up = d1 > 0
        low[live[up]], high[live[~up]] = at[live[up]], at[live[~up]]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = at[live] - d1 / d2
        inside = (d2 < 0) & (step > low[live]) & (step < high[live])
        step = np.where(inside, step, 0.5 * (low[live] + high[live]))
        # at an end of the range whose slope points outwards, the bracket has no width left
        step = np.where(up & (at[live] >= hi), hi, np.where(~up & (at[live] <= lo), lo, step))
        moved = np.abs(step - at[live])
        at[live] = step
        live = live[moved > NEWTON_TOL * np.maximum(1.0, np.abs(step))]
        if not len(live):
            break
    return at


def group_fit(y, sf, groups, n_groups: int, alpha, minmu: float = 0.5, maxit: int = 100, tol: float = 1e-8):
    """NB GLM with log link on a cell-means design, fixed dispersion: one IRLS per group.

    Returns (log group means (G, n_groups), fitted mu (G, S), weights (G, S)). mu is clamped at
    ``minmu`` inside the iterations, as the published fitting routine does.
    """
    G, S = y.shape
    beta = np.zeros((G, n_groups))
    for g in range(n_groups):
        m = groups == g
        beta[:, g] = np.log(np.maximum(y[:, m].mean(axis=1) / sf[m].mean(), minmu / sf[m].mean()))
    a = alpha[:, None]
    for _ in range(maxit):
        mu = np.maximum(sf[None, :] * np.exp(beta[:, groups]), minmu)
        w = mu / (1.0 + a * mu)
        z = np.log(mu / sf[None, :]) + (y - mu) / mu
        new = np.empty_like(beta)
        for g in range(n_groups):
            m = groups == g
            new[:, g] = (w[:, m] * z[:, m]).sum(axis=1) / w[:, m].sum(axis=1)
        done = np.nanmax(np.abs(new - beta)) < tol
        beta = new
        if done:
            break
    mu = np.maximum(sf[None, :] * np.exp(beta[:, groups]), minmu)
    w = mu / (1.0 + a * mu)
    return beta, mu, w


def lowess(x, y, frac: float = 0.2, iters: int = 3):
    """Cleveland's robust locally weighted linear fit (tricube weights, bisquare robustness)."""
    x = np.asarray(x, float)
    y = np.asarray(y, float)
    n = len(x)
    r = max(2, int(math.ceil(frac * n)))
    fitted = np.zeros(n)
    rw = np.ones(n)
    for it in range(iters + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[r - 1]
            w = np.zeros(n) if h == 0 else np.clip(1 - (d / h) ** 3, 0, None) ** 3
            if h == 0:
                w[d == 0] = 1.0
            w = w * rw
            sw = w.sum()
            if sw <= 0:
                fitted[i] = y[i]
                continue
            xm = (w * x).sum() / sw
            ym = (w * y).sum() / sw
            sxx = (w * (x - xm) ** 2).sum()
            b = 0.0 if sxx <= 1e-12 * max(1.0, (x.max() - x.min()) ** 2) else (w * (x - xm) * (y - ym)).sum() / sxx
            fitted[i] = ym + b * (x[i] - xm)
        if it == iters:
            break
        res = y - fitted
        s = np.median(np.abs(res))
        if s == 0:
            break
        u = res / (6.0 * s)
        rw = np.where(np.abs(u) < 1, (1 - u ** 2) ** 2, 0.0)
    return fitted

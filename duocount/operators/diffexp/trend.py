"""Dispersion trends (D05): the parametric curve, and a local regression for where it does not fit.

A trend gives the dispersion of a mean, as numpy values inside the batch passes and as a column. The local
trend is fitted from mergeable bins: weighted sums of log mean and log dispersion per bin of log mean, one
aggregate whatever the number of genes; local lines through the bins give its value at knots.
"""

from __future__ import annotations

import math
from typing import NamedTuple, Union

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_WIDTH = 0.1       # of log mean
NEAREST = 0.7         # share of the genes (weighted as below) that a local line sees
TABLE = 512           # points of the numerically integrated transform


class Parametric(NamedTuple):
    """alpha(mu) = a1 / mu + a0."""

    a0: float
    a1: float
    name = "parametric"

    def at(self, mean: np.ndarray) -> np.ndarray:
        return self.a0 + self.a1 / mean

    def column(self, mean: Column) -> Column:
        return F.lit(self.a0) + F.lit(self.a1) / mean

    def transform(self, q: Column, top: float) -> Column:
        """Integral of 1 / sqrt(mu + alpha mu^2) in closed form, scaled to approach log2 q."""
        a0, a1 = max(self.a0, 1e-12), self.a1
        root = F.sqrt(F.lit(a0) * q * (F.lit(1.0 + a1) + F.lit(a0) * q))
        return F.log2((F.lit(1.0 + a1) + F.lit(2.0 * a0) * q + F.lit(2.0) * root) / F.lit(4.0 * a0))

    def transform_at(self, q: np.ndarray, top: float) -> np.ndarray:
        a0, a1 = max(self.a0, 1e-12), self.a1
        return np.log2((1.0 + a1 + 2.0 * a0 * q + 2.0 * np.sqrt(a0 * q * (1.0 + a1 + a0 * q))) / (4.0 * a0))


class Local(NamedTuple):
    """Log dispersion by linear interpolation over log mean, constant beyond the first and last knot."""

    knots: tuple
    values: tuple
    name = "local"

    def at(self, mean: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(np.log(mean), self.knots, self.values))

    def column(self, mean: Column) -> Column:
        return F.exp(interpolate(F.log(mean), self.knots, self.values))

    def transform(self, q: Column, top: float) -> Column:
        """The integral by the trapezium rule on TABLE points even in asinh up to ``top``, scaled so that doubling
        a value near ``top`` adds one."""
        return interpolate(F.asinh(q), *self._integral(top))

    def transform_at(self, q: np.ndarray, top: float) -> np.ndarray:
        return np.interp(np.arcsinh(q), *self._integral(top))

    def _integral(self, top: float) -> tuple:
        """Points in asinh and the scaled integral there."""
        x = np.sinh(np.linspace(0.0, math.asinh(max(top, 2.0)), TABLE))
        mid = np.maximum((x[1:] + x[:-1]) / 2, 1e-9)
        total = np.concatenate([[0.0], np.cumsum(np.diff(x) / np.sqrt(mid + self.at(mid) * mid ** 2))])
        half = np.interp(x[-1] / 2, x, total)
        scaled = np.log2(x[-1]) + (total - total[-1]) / (total[-1] - half)
        return np.arcsinh(x), scaled


Trend = Union[Parametric, Local]


def as_trend(trend) -> Trend:
    """A trend, or the two coefficients of a parametric one."""
    return trend if isinstance(trend, (Parametric, Local)) else Parametric(*trend)


def interpolate(x: Column, knots, values) -> Column:
    """Linear interpolation between ascending knots, constant beyond them: a balanced tree of comparisons."""
    k, v = [float(a) for a in knots], [float(a) for a in values]

    def piece(i: int) -> Column:   # between knots i - 1 and i
        if i == 0:
            return F.lit(v[0])
        if i == len(k):
            return F.lit(v[-1])
        return F.lit(v[i - 1]) + (x - F.lit(k[i - 1])) * F.lit((v[i] - v[i - 1]) / (k[i] - k[i - 1]))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return piece(low)
        mid = (low + high) // 2
        return F.when(x > F.lit(k[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(k))


def local_lines(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Value at each bin centre of a line through the bins near it. ``sums``: per bin n, w, wx, wy, wxx, wxy.

    A line sees the least width around its centre that holds NEAREST of the genes, with tricube weights on the
    distance of bin centres, times the weights of the genes."""
    n, w, wx, wy, wxx, wxy = sums.T
    out = np.empty(len(x))
    for i, c in enumerate(x):
        far = np.abs(x - c)
        order = np.argsort(far, kind="stable")
        reach = far[order[np.searchsorted(np.cumsum(n[order]), NEAREST * n.sum(), side="left").clip(max=len(x) - 1)]] + BIN_WIDTH
        t = (1.0 - np.minimum(far / reach, 1.0) ** 3) ** 3
        sw, sx, sy, sxx, sxy = ((t * v).sum() for v in (w, wx, wy, wxx, wxy))
        mx, my = sx / sw, sy / sw
        spread = sxx / sw - mx * mx
        slope = (sxy / sw - mx * my) / spread if spread > 1e-9 else 0.0
        out[i] = my + slope * (c - mx)
    return out


def local_bins(usable: DataFrame, by=()) -> list:
    """Rows (``by``..., bin, n, w, wx, wy, wxx, wxy) of ``mean``, ``disp`` (both over 0), a gene's weight its mean, in order of bin."""
    x, y, w = F.log("mean"), F.log("disp"), F.col("mean")
    return usable.groupBy(*by, F.floor(x / F.lit(BIN_WIDTH)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * x * y)).orderBy("bin").collect()


def local_trend(bins: list) -> Trend:
    """The local trend of rows (bin, n, w, wx, wy, wxx, wxy) in order of bin; None without rows."""
    if not bins:
        return None
    centre = (np.array([r[0] for r in bins], float) + 0.5) * BIN_WIDTH
    values = local_lines(centre, np.array([tuple(r)[1:] for r in bins], float))
    return Local(tuple(centre.tolist()), tuple(values.tolist()))


def fit_local(usable: DataFrame) -> Trend:
    """The local trend of ``mean``, ``disp``; None without genes."""
    return local_trend(local_bins(usable))

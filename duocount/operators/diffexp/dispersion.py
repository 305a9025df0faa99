"""Dispersions: gene-wise (D04), trend (D05), prior width and MAP.

Gene-wise and MAP estimates are vectorised over whole Arrow batches in ``mapInPandas`` (a matrix of
genes x samples per batch, no per-gene Python loop and no group per gene). The trend is a gamma GLM
with identity link fitted by IRLS where each iteration is one aggregate of five sums over the
gene table; the prior width uses two exact distributed medians. Constants are named here.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp.trend import Parametric, Trend, as_trend, fit_local
from duocount.operators.ordered import exact_quantiles
from duocount.spec import CountDataError

# Fixed values of the published method (Love, Huber & Anders 2014), in one place.
MIN_DISP = 1e-8            # lower bound of a dispersion estimate
MIN_MU = 0.5               # lower bound of a fitted mean inside the fits
OUTLIER_SD = 2.0           # gene-wise estimates this many residual SDs above the trend are kept
PRIOR_VAR_FLOOR = 0.25     # smallest prior variance of log dispersion
TREND_RESID_RANGE = (1e-4, 15.0)   # genes used in each trend refit: residual ratio inside this range
TREND_MAX_OUTER = 10
TREND_TOL = 1e-6
TREND_MAX_INNER = 25       # IRLS steps per refit, as a GLM fit's default iteration cap
TREND_INNER_TOL = 1e-8     # relative coefficient change that ends one refit
MAD_SCALE = 1.4826


def max_disp(n_samples: int) -> float:
    return max(10.0, float(n_samples))


def count_rows(series) -> np.ndarray:
    """Equal-length count arrays as one (genes, samples) matrix."""
    return np.concatenate(series.to_numpy()).astype(np.float64).reshape(len(series), -1)


def genewise_mapper(sf: Sequence[float], groups: Sequence[int]):
    """mapInPandas function: adds ``allZero``, ``dispGeneEst`` to rows with ``counts``, ``baseMean``, ``rowVar``."""
    sf = np.asarray(sf, float)
    groups = np.asarray(groups, int)
    n_groups = int(groups.max()) + 1
    S = len(sf)
    lo, hi = math.log(MIN_DISP / 10.0), math.log(max_disp(S))

    def run(batches):
        for pdf in M.gene_blocks(batches, S):
            if pdf.empty:
                yield pdf.assign(allZero=pd.Series(dtype=bool), dispGeneEst=pd.Series(dtype=float))
                continue
            y = count_rows(pdf["counts"])
            all_zero = (y == 0).all(axis=1)
            q = y / sf[None, :]
            mu = np.empty_like(q)
            for g in range(n_groups):
                m = groups == g
                mu[:, m] = q[:, m].mean(axis=1)[:, None] * sf[None, m]
            mu = np.maximum(mu, MIN_MU)
            est = np.full(len(pdf), np.nan)
            nz = ~all_zero
            if nz.any():
                yy, mm = y[nz], mu[nz]
                best = M.best_log_alpha(yy, mm, groups, n_groups, lo, hi)
                est[nz] = np.clip(np.exp(best), MIN_DISP, max_disp(S))
            yield pdf.assign(allZero=all_zero, dispGeneEst=est)

    return run


def fit_trend(genes: DataFrame, n_samples: int):
    """Parametric trend alpha(mu) = a1 / mu + a0 (D05), or ``None`` if the fit fails or does not settle
    within its iteration limits.

    Gamma family, identity link, on genes with a gene-wise estimate above 100 x the lower bound;
    refitted on genes whose ratio to the current trend lies in TREND_RESID_RANGE until the
    coefficients are stable. Each IRLS step is one aggregate (weights 1/mu^2).
    """
    base = (usable(genes).select((F.lit(1.0) / F.col("baseMean")).alias("x"), F.col("dispGeneEst").alias("y")))
    # two doubles per gene, read by every IRLS step: kept in executor memory (spilling to disk) for
    # the duration of the fit; a lost block is recomputed from the materialised gene table
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_trend_iterations(base)
    finally:
        base.unpersist()


def trend_sums(a0, a1, b0, b1) -> list:
    """The five sums of one IRLS step over ``x`` = 1 / mean and ``y`` = dispersion: weights by the coefficients ``b`` of the
    step before, genes in range of the trend ``a`` of the refit before (columns or numbers)."""
    a0, a1, b0, b1 = (F.lit(c) for c in (a0, a1, b0, b1))
    x, y = F.col("x"), F.col("y")
    ratio = y / (a0 + a1 * x)
    mu = b0 + b1 * x
    w = F.when((ratio > TREND_RESID_RANGE[0]) & (ratio < TREND_RESID_RANGE[1]), F.lit(1.0) / (mu * mu))
    return [F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"),
            F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy")]


class TrendFit:
    """Where the fit of one parametric trend stands. ``coef`` is None unless it settled."""

    def __init__(self):
        self.a = self.b = (0.1, 1.0)
        self.refits = self.steps = 0
        self.done, self.coef = False, None

    def _end(self, coef=None):
        self.done, self.coef = True, coef

    def advance(self, w, wx, wxx, wy, wxy) -> None:
        """Take the sums of one step."""
        det = 0 if w is None else w * wxx - wx ** 2
        if det == 0:
            return self._end()
        new = ((wy * wxx - wx * wxy) / det, (w * wxy - wx * wy) / det)
        settled = all(abs(n - b) <= TREND_INNER_TOL * (abs(b) + 1e-12) for n, b in zip(new, self.b))
        self.b = new
        self.steps += 1
        if not settled:
            if max(new) <= 0 or self.steps == TREND_MAX_INNER:   # the latter: the refit did not converge
                self._end()
            return None
        if min(new) <= 0:
            return self._end()
        change = sum(math.log(n / a) ** 2 for n, a in zip(new, self.a))
        self.a, self.steps = new, 0
        self.refits += 1
        if change < TREND_TOL:
            return self._end(new)
        if self.refits == TREND_MAX_OUTER:   # the set of genes in range never settled
            self._end()
        return None


def _fit_trend_iterations(base: DataFrame):
    fit = TrendFit()
    while not fit.done:
        fit.advance(*base.agg(*trend_sums(*fit.a, *fit.b)).first())
    return fit.coef


def usable(genes: DataFrame) -> DataFrame:
    """Genes that a trend is fitted on."""
    return genes.where(~F.col("allZero") & (F.col("dispGeneEst") >= F.lit(100 * MIN_DISP)))


def trend_of(genes: DataFrame, n_samples: int) -> Trend:
    """The parametric trend, or the local one where that fails; genes none of which is usable cannot be fitted."""
    coef = fit_trend(genes, n_samples)
    trend = Parametric(*coef) if coef else fit_local(usable(genes).select(F.col("baseMean").alias("mean"), F.col("dispGeneEst").alias("disp")))
    if trend is None:
        raise CountDataError("all gene-wise dispersions are at the lower bound; no trend can be fitted")
    return trend


def prior_variance(genes: DataFrame, trend, n_samples: int, n_coef: int = 2) -> tuple[float, float]:
    """(prior variance, residual SD) of log dispersions about the trend.

    The residual SD is the scaled MAD of the log residuals, by which outliers are told; the prior's
    variance is its square minus the expected sampling variance trigamma((m - p) / 2), at least
    PRIOR_VAR_FLOOR."""
    trend = as_trend(trend)
    r = usable(genes).select((F.log("dispGeneEst") - F.log(trend.column(F.col("baseMean")))).alias("r"))
    med = exact_quantiles(r, "r", {"m": 0.5}).first()
    if med is None or med["m"] is None:
        return PRIOR_VAR_FLOOR, math.sqrt(PRIOR_VAR_FLOOR)
    dev = r.select(F.abs(F.col("r") - F.lit(med["m"])).alias("d"))
    mad = MAD_SCALE * exact_quantiles(dev, "d", {"m": 0.5}).first()["m"]
    df = n_samples - n_coef
    expected = M.trigamma(df / 2.0) if df > 0 else 0.0
    return max(mad * mad - expected, PRIOR_VAR_FLOOR), mad

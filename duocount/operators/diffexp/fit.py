"""MAP dispersion, group means, Wald test, Cook's distance (D06-D09) in one vectorised batch pass."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd

from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp.trend import as_trend
from duocount.operators.diffexp.dispersion import MIN_DISP, MIN_MU, OUTLIER_SD, count_rows, max_disp

RESULT_SCHEMA = ("entity_id string, baseMean double, log2FoldChange double, lfcSE double, stat double, "
                 "pvalue double, dispGeneEst double, dispFit double, dispersion double, maxCooks double, "
                 "nAbove int, allZero boolean, replaced boolean")

# Fixed values of the published method's outlier replacement.
MIN_REPLICATES_FOR_REPLACE = 7
REPLACE_TRIM = 0.2
COOKS_QUANTILE = 0.99


def trimmed_mean(q, trim: float = REPLACE_TRIM):
    """Row-wise mean after dropping floor(n * trim) values at each end (R's ``mean(x, trim=)``)."""
    n = q.shape[1]
    k = int(math.floor(n * trim))
    srt = np.sort(q, axis=1)
    return srt[:, k:n - k].mean(axis=1)


# Fixed values of the published robust moment dispersion used for Cook's distances: trim ratio and
# variance scale per cell size bin (n <= 3, 4..23, >= 24), and its lower bound. Recalled from the
# method's public source; named here so they can be corrected in one place.
ROBUST_TRIM = (1.0 / 3.0, 1.0 / 4.0, 1.0 / 8.0)
ROBUST_SCALE = (2.04, 1.86, 1.51)
ROBUST_MIN_DISP = 0.04


def _size_bin(n: int) -> int:
    return 0 if n <= 3 else (1 if n <= 23 else 2)


def robust_moments_dispersion(q, groups, n_groups: int):
    """Dispersion for Cook's distances, resistant to the outlier being measured.

    Per cell with 3 or more replicates: trimmed mean, then scaled trimmed mean of squared errors;
    the largest cell variance is kept. Without such a cell: the same over all samples with trim 1/8.
    alpha = (v - m) / m^2 with m the row mean, at least ROBUST_MIN_DISP.
    """
    sizes = np.bincount(groups, minlength=n_groups)
    cells = [g for g in range(n_groups) if sizes[g] >= 3]
    if cells:
        v = np.full(q.shape[0], -np.inf)
        for g in cells:
            sub = q[:, groups == g]
            b = _size_bin(sub.shape[1])
            cm = trimmed_mean(sub, ROBUST_TRIM[b])
            v = np.maximum(v, ROBUST_SCALE[b] * trimmed_mean((sub - cm[:, None]) ** 2, ROBUST_TRIM[b]))
    else:
        cm = trimmed_mean(q, ROBUST_TRIM[2])
        v = ROBUST_SCALE[2] * trimmed_mean((q - cm[:, None]) ** 2, ROBUST_TRIM[2])
    m = q.mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (v - m) / (m * m)
    return np.maximum(np.nan_to_num(a, nan=ROBUST_MIN_DISP), ROBUST_MIN_DISP)


def _fit_block(yy, sf, groups, n_groups, lf, prior_var, lo, hi, S, sd, gene=None):
    """Gene-wise (when ``gene`` is None) and MAP dispersion, group fit, Wald and Cook's for a block."""
    q = yy / sf[None, :]
    mu0 = np.empty_like(yy)
    for g in range(n_groups):
        m = groups == g
        mu0[:, m] = q[:, m].mean(axis=1)[:, None] * sf[None, m]
    mu0 = np.maximum(mu0, MIN_MU)
    if gene is None:
        gene = np.clip(np.exp(M.best_log_alpha(yy, mu0, groups, n_groups, lo, hi)), MIN_DISP, max_disp(S))
    best = np.clip(np.exp(M.best_log_alpha(yy, mu0, groups, n_groups, lo, hi, lf, prior_var)), MIN_DISP, max_disp(S))
    alpha = np.where(np.log(gene) > lf + OUTLIER_SD * sd, gene, best)
    beta, mu, w = M.group_fit(yy, sf, groups, n_groups, alpha)
    lfc = (beta[:, 1] - beta[:, 0]) / math.log(2.0)
    sw = np.stack([w[:, groups == g].sum(axis=1) for g in range(n_groups)], axis=1)
    se = np.sqrt((1.0 / sw).sum(axis=1)) / math.log(2.0)
    h = w / sw[:, groups]
    rob = robust_moments_dispersion(q, groups, n_groups)
    pr2 = (yy - mu) ** 2 / (mu + rob[:, None] * mu ** 2)
    cooks = pr2 / n_groups * h / (1.0 - h) ** 2
    return gene, alpha, lfc, se, cooks


def wald_mapper(sf: Sequence[float], groups: Sequence[int], trend, prior_var: float, residual_sd: float,
                cooks_min_reps: int = 3, replace: bool = False):
    """mapInPandas function: MAP dispersion, Wald test and Cook's distance per gene.

    A gene-wise estimate more than OUTLIER_SD times ``residual_sd`` above the trend is kept as it is.
    With ``replace`` and at least MIN_REPLICATES_FOR_REPLACE replicates in a group, counts whose
    Cook's distance exceeds the F(p, m - p) 0.99 quantile (samples of such groups only) are replaced
    by trimmed-mean normalised count x size factor (truncated to an integer) and those genes are
    refitted (gene-wise and MAP dispersion, Wald) with the same size factors, trend and prior. Their base mean is that of
    the replaced counts, at which the trend is read; a gene left without counts has base mean 0 and no test.

    ``maxCooks`` is the largest distance among the samples that the cut-off can still judge: those of groups of at
    least ``cooks_min_reps``, without the samples whose counts were open to replacement (null if none is left).
    ``nAbove`` counts the samples with a larger count than the sample of the largest distance of all.
    """
    trend = as_trend(trend)
    sf = np.asarray(sf, float)
    groups = np.asarray(groups, int)
    n_groups = int(groups.max()) + 1
    S = len(sf)
    lo, hi = math.log(MIN_DISP / 10.0), math.log(max_disp(S))
    sd = residual_sd
    counts_per_group = np.bincount(groups, minlength=n_groups)
    cooks_cols = counts_per_group[groups] >= cooks_min_reps
    replace_cols = counts_per_group[groups] >= MIN_REPLICATES_FOR_REPLACE
    replace = bool(replace and replace_cols.any() and S > n_groups)
    judged_cols = cooks_cols & ~replace_cols if replace else cooks_cols
    cutoff = M.f_quantile_df1_2(COOKS_QUANTILE, float(S - n_groups)) if S > n_groups else np.inf

    def run(batches):
        for pdf in M.gene_blocks(batches, S):
            n = len(pdf)
            out = pd.DataFrame({"entity_id": pdf["entity_id"].astype(str), "baseMean": pdf["baseMean"].astype(float)})
            for c in ("log2FoldChange", "lfcSE", "stat", "pvalue", "dispFit", "dispersion", "maxCooks"):
                out[c] = np.nan
            out["dispGeneEst"] = pdf["dispGeneEst"].astype(float).values
            out["allZero"] = pdf["allZero"].astype(bool).values
            out["replaced"] = False
            out["nAbove"] = 0
            if n == 0:
                yield out
                continue
            y = count_rows(pdf["counts"])
            nz = ~out["allZero"].values
            bm = out["baseMean"].values
            fit = np.where(nz, trend.at(np.where(bm > 0, bm, 1.0)), np.nan)
            out["dispFit"] = fit
            if nz.any():
                yy = y[nz]
                lf = np.log(fit[nz])
                gene = out["dispGeneEst"].values[nz]
                gene, alpha, lfc, se, cooks = _fit_block(yy, sf, groups, n_groups, lf, prior_var, lo, hi, S, sd, gene)
                worst = np.argmax(np.where(np.isfinite(cooks), cooks, -np.inf), axis=1)
                above = (yy > yy[np.arange(len(yy)), worst][:, None]).sum(axis=1)
                mc = (np.nanmax(np.where(judged_cols[None, :], cooks, -np.inf), axis=1)
                      if judged_cols.any() else np.full(yy.shape[0], np.nan))
                repl = np.zeros(yy.shape[0], bool)
                if replace:
                    hit = (cooks > cutoff) & replace_cols[None, :]
                    repl = hit.any(axis=1)
                    if repl.any():
                        tm = trimmed_mean(yy[repl] / sf[None, :])
                        new = yy[repl].copy()
                        sub = hit[repl]
                        new[sub] = np.floor((tm[:, None] * sf[None, :]))[sub]
                        mean = (new / sf[None, :]).mean(axis=1)
                        at = np.flatnonzero(nz)[repl]
                        left = mean > 0
                        fit[at] = np.where(left, trend.at(np.where(left, mean, 1.0)), np.nan)
                        out.loc[at, "baseMean"], out.loc[at, "dispFit"], out.loc[at, "allZero"] = mean, fit[at], ~left
                        refit = np.flatnonzero(repl)
                        for part in (gene, alpha, lfc, se, mc):
                            part[refit[~left]] = np.nan
                        refit = refit[left]
                        if len(refit):
                            gene[refit], alpha[refit], lfc[refit], se[refit], _ = _fit_block(
                                new[left], sf, groups, n_groups, np.log(fit[at[left]]), prior_var, lo, hi, S, sd)
                stat = lfc / se
                out.loc[nz, "dispGeneEst"] = gene
                out.loc[nz, "dispersion"] = alpha
                out.loc[nz, "log2FoldChange"] = lfc
                out.loc[nz, "lfcSE"] = se
                out.loc[nz, "stat"] = stat
                out.loc[nz, "pvalue"] = M.norm_two_sided_p(stat)
                out.loc[nz, "maxCooks"] = mc
                out.loc[nz, "replaced"] = repl
                out.loc[nz, "nAbove"] = above
            yield out

    return run

"""Brute force for the rows-only DE queries: the unfiltered pipeline recomputed in numpy on the
driver (small fixture) must agree with the distributed one."""

import math

import numpy as np
import pandas as pd

from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp.run import differential_abundance
from tests.test_diffexp import simulate


def numpy_pipeline(pdf_long):
    samples = sorted(pdf_long[["condition", "sample"]].drop_duplicates().itertuples(index=False))
    names = [s for _, s in samples]
    groups = np.array([0 if c == "control" else 1 for c, _ in samples])
    wide = pdf_long.pivot_table(index="entity_id", columns="sample", values="cnt", aggfunc="sum", fill_value=0)[names]
    Y = wide.to_numpy(float)
    pos = (Y > 0).all(axis=1)
    L = np.log(Y[pos])
    sf = np.exp(np.median(L - L.mean(axis=1, keepdims=True), axis=0))
    q = Y / sf
    base = q.mean(axis=1)
    pdf = pd.DataFrame({"entity_id": wide.index.astype(str), "counts": list(Y.astype(np.int64)), "baseMean": base})
    gw = next(D.genewise_mapper(sf, groups)(iter([pdf])))
    use = (~gw.allZero) & (gw.dispGeneEst >= 100 * D.MIN_DISP)
    x, y = 1.0 / gw.baseMean[use].to_numpy(), gw.dispGeneEst[use].to_numpy()
    a0, a1 = 0.1, 1.0
    for _ in range(D.TREND_MAX_OUTER):
        r = y / (a0 + a1 * x)
        keep = (r > D.TREND_RESID_RANGE[0]) & (r < D.TREND_RESID_RANGE[1])
        b0, b1 = a0, a1
        for _ in range(D.TREND_MAX_INNER):
            w = 1.0 / (b0 + b1 * x[keep]) ** 2
            A = np.array([[w.sum(), (w * x[keep]).sum()], [(w * x[keep]).sum(), (w * x[keep] ** 2).sum()]])
            n0, n1 = np.linalg.solve(A, [(w * y[keep]).sum(), (w * x[keep] * y[keep]).sum()])
            done = abs(n0 - b0) <= D.TREND_INNER_TOL * abs(b0) and abs(n1 - b1) <= D.TREND_INNER_TOL * abs(b1)
            b0, b1 = n0, n1
            if done:
                break
        change = math.log(b0 / a0) ** 2 + math.log(b1 / a1) ** 2
        a0, a1 = b0, b1
        if change < D.TREND_TOL:
            break
    res = np.log(y) - np.log(a0 + a1 * x)
    mad = D.MAD_SCALE * np.median(np.abs(res - np.median(res)))
    prior = max(mad ** 2 - M.trigamma((len(names) - 2) / 2.0), D.PRIOR_VAR_FLOOR)
    out = next(FT.wald_mapper(sf, groups, (a0, a1), prior, mad)(iter([gw])))
    p = out.pvalue.to_numpy()
    ok = ~np.isnan(p)
    n = ok.sum()
    order = np.argsort(p[ok])
    ranks_max = np.searchsorted(np.sort(p[ok]), p[ok], side="right")
    qv = p[ok] * n / ranks_max
    desc = np.argsort(-p[ok], kind="stable")
    adj = np.empty(n)
    adj[desc] = np.minimum(np.minimum.accumulate(qv[desc]), 1.0)
    padj = np.full(len(p), np.nan)
    padj[ok] = adj
    out["padj"] = padj
    return out.set_index("entity_id"), sf, (a0, a1)


def test_distributed_matches_numpy(spark):
    df = simulate(spark, n_genes=250, planted=25, seed=11)
    r = differential_abundance(df, filtering=False, with_pca=False)
    got = r.results.toPandas().set_index("entity_id")
    ref, sf, trend = numpy_pipeline(df.toPandas())
    assert np.allclose(sorted(r.log["size_factors"].values()), sorted(sf), rtol=1e-9)
    assert np.allclose(r.log["trend_coef"], trend, rtol=1e-6)
    j = got.join(ref, rsuffix="_np")
    assert len(j) == 250
    for c in ("baseMean", "log2FoldChange", "lfcSE", "pvalue", "padj"):
        a, b = j[c].to_numpy(float), j[c + "_np"].to_numpy(float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-6, atol=1e-9), c


def bh(p):
    p = np.asarray(p, float)
    ok = ~np.isnan(p)
    out = np.full(len(p), np.nan)
    if ok.sum() == 0:
        return out
    v = p[ok]
    n = len(v)
    rmax = np.searchsorted(np.sort(v), v, side="right")
    q = v * n / rmax
    desc = np.argsort(-v, kind="stable")
    adj = np.empty(n)
    adj[desc] = np.minimum(np.minimum.accumulate(q[desc]), 1.0)
    out[ok] = adj
    return out


def test_independent_filtering_matches_numpy(spark):
    from duocount.operators.diffexp import select as SEL
    rng = np.random.default_rng(21)
    n = 3000
    base = np.round(rng.gamma(0.6, 80.0, n), 3)
    base[:150] = 0.0
    p = np.where(rng.uniform(size=n) < 0.15, rng.uniform(0, 1e-3, n), rng.uniform(0, 1, n))
    p[base < 5] = rng.uniform(0, 1, (base < 5).sum())
    p[:150] = np.nan
    pdf = pd.DataFrame({"entity_id": [str(i) for i in range(n)], "baseMean": base,
                        "pvalue": [None if np.isnan(v) else float(v) for v in p]})
    res = spark.createDataFrame(pdf, "entity_id string, baseMean double, pvalue double")
    out, info = SEL.independent_filtering(res)
    got = out.toPandas().set_index("entity_id").loc[pdf.entity_id]
    lower = np.mean(base == 0)
    theta = np.linspace(lower, 0.95 if lower < 0.95 else 1.0, SEL.N_THETA)
    cut = np.percentile(base, 100 * theta)
    num = np.array([np.sum(bh(np.where(base >= c, p, np.nan)) < SEL.ALPHA) for c in cut], float)
    assert info["rejections"] == num.tolist()
    if num.max() <= SEL.MIN_REJECTIONS:
        j = 0
    else:
        fit = M.lowess(theta, num, SEL.LOWESS_FRAC)
        pos = num > 0
        thresh = fit.max() - np.sqrt(np.mean((num[pos] - fit[pos]) ** 2))
        j = int(np.nonzero(num > thresh)[0][0])
    assert abs(info["baseMean_cutoff"] - cut[j]) < 1e-9
    exp = bh(np.where(base >= cut[j], p, np.nan))
    a = got.padj.to_numpy(float)
    assert np.array_equal(np.isnan(a), np.isnan(exp))
    assert np.allclose(a[~np.isnan(a)], exp[~np.isnan(exp)], rtol=1e-9)

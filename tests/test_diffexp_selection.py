"""Rejections per cut-off, the local trend, dispersion search and failing runs against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp import select as SEL
from duocount.operators.diffexp import trend as TR
from duocount.operators.diffexp.run import differential_abundance, logged_run


def single_run(p, alpha):
    """Rejections of one Benjamini-Hochberg run."""
    p = np.sort(p)
    ok = np.nonzero(p <= np.arange(1, len(p) + 1) * alpha / max(len(p), 1))[0]
    return int(ok[-1]) + 1 if len(ok) else 0


@pytest.mark.parametrize("kind", ["mixed", "line", "ties", "none", "tiny"])
def test_rejections_equal_fifty_single_runs(spark, kind):
    rng = np.random.default_rng(11)
    n, alpha = 3000, 0.1
    base = np.round(rng.gamma(0.5, 100, n), 1)
    p = {"mixed": np.where(rng.random(n) < 0.3, rng.beta(0.2, 8, n), rng.random(n)),
         "line": (np.arange(1, n + 1) * alpha / n) * (1 + rng.normal(0, 1e-3, n)),      # every p near the step-up line
         "ties": rng.choice([0.001, 0.02, 0.0999, 0.1, 0.5], n), "none": np.full(n, 0.7),
         "tiny": 10.0 ** -rng.uniform(0, 300, n)}[kind]
    rows = [(float(b), None if rng.random() < 0.05 else float(min(x, 1.0))) for b, x in zip(base, p)] + [(None, 0.01)]
    df = spark.createDataFrame(rows, "baseMean double, pvalue double")
    cuts = np.quantile(base, np.linspace(0, 0.95, 50)).tolist()
    wanted = [single_run(np.array([x for b, x in rows if b is not None and x is not None and b >= c]), alpha) for c in cuts]
    for cells in (512, 7):
        assert SEL.rejections_per_cutoff(df, cuts, alpha, cells) == wanted
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text


def test_local_trend_is_chosen_and_equals_numpy(spark):
    rng = np.random.default_rng(4)
    mean = rng.gamma(1, 300, 4000) + 1
    disp = np.exp(-1 + 0.4 * np.sin(np.log(mean)) + 0.6 * np.log(mean) + rng.normal(0, 0.2, 4000))   # grows with the mean: no a1 / mu + a0
    genes = spark.createDataFrame([(float(m), float(d), False) for m, d in zip(mean, disp)], "baseMean double, dispGeneEst double, allZero boolean")
    assert D.fit_trend(genes, 6) is None
    trend = D.trend_of(genes, 6)
    assert trend.name == "local"
    bins = np.floor(np.log(mean) / TR.BIN_WIDTH)
    ids = np.unique(bins)
    centre = (ids + 0.5) * TR.BIN_WIDTH
    fitted = []
    for c in centre:   # every gene weighted by its bin's distance: a direct weighted least-squares line
        far = np.abs((bins + 0.5) * TR.BIN_WIDTH - c)
        reach = np.sort(far)[math.ceil(TR.NEAREST * len(mean)) - 1] + TR.BIN_WIDTH
        w = (1 - np.minimum(far / reach, 1) ** 3) ** 3 * mean
        slope, cut = np.polyfit(np.log(mean) - c, np.log(disp), 1, w=np.sqrt(w))
        fitted.append(cut)
    assert np.allclose(trend.knots, centre) and np.allclose(trend.values, fitted, atol=1e-8)
    got = np.array([r[0] for r in genes.select(trend.column(F.col("baseMean")), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()])
    assert np.allclose(got, trend.at(mean))
    inner = (mean > 20) & (mean < 2000)
    assert np.abs(np.log(trend.at(mean)) - (-1 + 0.4 * np.sin(np.log(mean)) + 0.6 * np.log(mean)))[inner].mean() < 0.25
    parametric = spark.createDataFrame([(float(m), float(0.1 + 3 / m), False) for m in mean[:500]], "baseMean double, dispGeneEst double, allZero boolean")
    assert D.trend_of(parametric, 6).name == "parametric"


def test_transform_of_the_local_trend_is_the_integral(spark):
    knots = np.linspace(0.0, 9.0, 40)
    trend = TR.Local(tuple(knots), tuple(np.log(0.1 + 3 / np.exp(knots))))
    same = TR.Parametric(0.1, 3.0)
    q = spark.createDataFrame([(float(x),) for x in (5, 20, 100, 400, 1000, 3000)], "q double")
    a, b = (np.array([r[0] for r in q.select(t.transform(F.col("q"), 4000.0)).collect()]) for t in (trend, same))
    assert np.abs(np.diff(a) - np.diff(b)).max() < 0.05   # both are the same integral up to scale, which both take from large q


def test_dispersion_search_beats_a_fine_grid_and_equals_slopes():
    rng = np.random.default_rng(8)
    groups = np.array([0, 0, 0, 1, 1, 1])
    y = np.concatenate([rng.negative_binomial(3, 3 / (3 + m), (60, 6)) for m in (2.0, 30.0, 4000.0)] + [rng.poisson(50, (60, 6))]).astype(float)
    y = y[y.sum(1) > 0]
    mu = np.maximum(np.stack([y[:, groups == g].mean(1) for g in groups], axis=1), 0.5)
    lo, hi = math.log(1e-9), math.log(10.0)
    for prior, var in ((None, 1.0), (np.full(len(y), -1.0), 0.5)):
        def value(la):
            out = np.empty(la.shape)
            for i in range(len(y)):
                for k, v in enumerate(la[i]):
                    r = math.exp(-v)
                    ll = sum(math.lgamma(a + r) - math.lgamma(r) - a * math.log(m + r) - r * math.log1p(m / r) for a, m in zip(y[i], mu[i]))
                    w = [m / (1 + m / r) for m in mu[i]]
                    out[i, k] = ll - 0.5 * (math.log(sum(w[:3])) + math.log(sum(w[3:]))) - (0 if prior is None else (v - prior[i]) ** 2 / (2 * var))
            return out
        best = M.best_log_alpha(y, mu, groups, 2, lo, hi, prior, var)
        near = value(np.clip(best[:, None] + np.array([[0, -1e-3, 1e-3]]), lo, hi))
        big = best > math.log(1e-6)   # below, differences of math.lgamma are noise
        assert (near[big, 0] >= near[big, 1:].max(axis=1) - 1e-9).all()
        fine = value(np.tile(np.linspace(math.log(1e-5), hi, 80), (len(y), 1)))
        assert (near[big, 0] >= fine[big].max(axis=1) - 1e-6).all()
        d1, _ = M.nb_slopes_cr(best, y, mu, groups, 2)
        if prior is not None:
            d1 = d1 - (best - prior) / var
        inside = (best > lo) & (best < hi)
        assert np.abs(d1[inside]).max() < 1e-6 and inside.mean() > 0.5


def pools(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, sample string, condition string, cnt double")


def test_failing_runs_are_logged_as_started(spark):
    half = [(f"g{i}", s, s.split("_")[-1], i + 0.5) for i in range(5) for s in ("a_MP_control", "b_MP_test")]
    assert logged_run("r", pools(spark, half))[1] == ("r", 2, True, False, "10 counts are negative or not integers")
    odd = [(f"g{i}", "a_MP_third", "third", 3.0) for i in range(5)]
    result, row = logged_run("r", pools(spark, odd))
    assert result is None and row[1:4] == (1, True, False) and "third" in row[4]
    zero = [(f"g{i}", s, s.split("_")[-1], 0.0) for i in range(5) for s in ("a_MP_control", "b_MP_test")]
    assert logged_run("r", pools(spark, zero))[1][1:4] == (2, True, False)
    none = logged_run("r", pools(spark, []))[1]
    assert none[2:4] == (False, False) and none[1] == 0


def test_thousands_of_samples_need_no_expression_each(spark):
    from duocount.operators.diffexp import counts as C
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", f"s{s}", "control" if s % 2 else "test", float(rng.integers(0, 9))) for g in range(3) for s in range(1500)]
    long = pools(spark, rows + rows[:7])
    design = C.design_of(long)
    m = {r.entity_id: r.counts for r in C.count_matrix(long, design, 3).collect()}
    wanted = {f"g{g}": dict.fromkeys(design.samples, 0) for g in range(3)}
    for g, s, _, n in rows + rows[:7]:
        wanted[g][s] += int(n)
    assert m == {g: [wanted[g][s] for s in design.samples] for g in wanted}


# --- outlier rules (D09) on hand-made genes ------------------------------------------------------

def _wald(counts, groups, replace=True, trend=(0.1, 1.0)):
    counts = np.asarray(counts, float)
    genes = pd.DataFrame({"entity_id": [f"g{i}" for i in range(len(counts))], "counts": list(counts.astype(int)),
                          "baseMean": counts.mean(axis=1), "allZero": (counts == 0).all(axis=1), "dispGeneEst": 0.1})
    parts = FT.wald_mapper([1.0] * len(groups), groups, trend, 0.5, 1.0, replace=replace)(iter([genes]))
    return pd.concat(list(parts)).reset_index(drop=True)


def test_replaced_gene_takes_the_mean_and_trend_of_its_new_counts():
    rng = np.random.default_rng(3)
    plain = rng.poisson(60, (1, 16))
    spiked = plain.copy()
    spiked[0, 4] = 20000
    empty = np.zeros((1, 16), int)
    empty[0, 11] = 5000
    out = _wald(np.concatenate([plain, spiked, empty]), [0] * 8 + [1] * 8)
    assert list(out.replaced) == [False, True, True]
    k = 3  # floor(16 * 0.2) values dropped at either end
    new = spiked[0].copy()
    new[4] = int(np.sort(spiked[0])[k:16 - k].mean())
    assert abs(out.baseMean[1] - new.mean()) < 1e-9 and abs(out.dispFit[1] - (0.1 + 1.0 / new.mean())) < 1e-9
    # refitted as the gene of the new counts would be, but for its own gene-wise estimate
    alone = _wald([new], [0] * 8 + [1] * 8)
    assert abs(out.log2FoldChange[1] - alone.log2FoldChange[0]) < 0.02
    # every sample was open to replacement: nothing is left for the cut-off to judge
    assert out.maxCooks.isna().all()
    # a gene without counts after replacement has no test
    assert out.baseMean[2] == 0 and out.allZero[2] and np.isnan(out.pvalue[2]) and np.isnan(out.dispFit[2])
    assert abs(out.baseMean[0] - plain.mean()) < 1e-9


def test_cut_off_judges_only_samples_that_were_not_replaceable():
    rng = np.random.default_rng(4)
    low, high = rng.poisson(50, 12), rng.poisson(50, 12)
    low[2] = 9000      # of the group of 8: replaced
    high[10] = 9000    # of the group of 4: judged
    out = _wald([low, high], [0] * 8 + [1] * 4)
    cut = (10 / 2) * (0.01 ** (-2 / 10) - 1)
    assert list(out.replaced) == [True, False]
    assert out.maxCooks[0] < cut < out.maxCooks[1] and out.nAbove[1] == 0
    unreplaced = _wald([low], [0] * 8 + [1] * 4, replace=False)
    assert unreplaced.maxCooks[0] > cut and not unreplaced.replaced[0]


def test_larger_counts_than_the_outlier_exempt_a_gene(spark):
    # the odd sample is the low one of the control: every test count and both other controls are larger
    out = _wald([[400, 400, 0, 900, 900, 900], [10, 10, 500, 12, 12, 12]], [0, 0, 0, 1, 1, 1], replace=False)
    assert list(out.nAbove) == [5, 0]
    rows = [("cut", 50.0, 2, 0.01), ("exempt", 50.0, 3, 0.02), ("below", 1.0, 0, 0.03), ("unjudged", None, 0, 0.04)]
    res = spark.createDataFrame(rows, "entity_id string, maxCooks double, nAbove int, pvalue double")
    got = {r.entity_id: r.pvalue for r in SEL.apply_cooks_cutoff(res, 6).collect()}
    assert got == {"cut": None, "exempt": 0.02, "below": 0.03, "unjudged": 0.04}

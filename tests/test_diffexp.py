import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duocount.operators.diffexp import counts as C
from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp.run import differential_abundance
from duocount.spec import CountDataError


def simulate(spark, n_genes=300, reps=3, planted=30, fold=4.0, seed=1, sf=(1.0, 1.3, 0.8, 1.1, 0.9, 1.2),
             a0=0.05, a1=1.0):
    rng = np.random.default_rng(seed)
    base = rng.gamma(1.5, 150.0, n_genes) + 5
    rows = []
    samples = [f"rep{i}_MP_control" for i in range(reps)] + [f"rep{i}_MP_test" for i in range(reps)]
    for g in range(n_genes):
        alpha = a0 + a1 / base[g]
        for j, s in enumerate(samples):
            mu = base[g] * sf[j] * (fold if (g < planted and s.endswith("test")) else 1.0)
            r = 1.0 / alpha
            lam = rng.gamma(r, mu / r)
            rows.append((str(g), s, s.split("_")[-1], int(rng.poisson(lam))))
    return spark.createDataFrame(rows, "entity_id string, sample string, condition string, cnt long")


@pytest.fixture(scope="module")
def sim(spark):
    return simulate(spark)


@pytest.fixture(scope="module")
def fit(sim):
    return differential_abundance(sim, filtering=True)


def test_planted_changes_recovered(fit):
    r = fit.results.toPandas().set_index("entity_id")
    planted = r.loc[[str(g) for g in range(30)]]
    rest = r.drop(index=[str(g) for g in range(30)])
    assert abs(planted.log2FoldChange.median() - 2.0) < 0.3
    assert abs(rest.log2FoldChange.median()) < 0.2
    assert (planted.padj < 0.1).mean() > 0.8
    assert (rest.padj < 0.1).mean() < 0.05
    assert fit.log["success"] and fit.log["replicates"] == 6


def test_size_factors_recover_scaling(spark, sim):
    design = C.design_of(sim)
    sf = np.array(C.size_factors(C.count_matrix(sim, design), design))
    truth = np.array([1.0, 1.3, 0.8, 1.1, 0.9, 1.2])
    order = [["rep0_MP_control", "rep1_MP_control", "rep2_MP_control", "rep0_MP_test", "rep1_MP_test", "rep2_MP_test"].index(s)
             for s in design.samples]
    est = sf / np.exp(np.mean(np.log(sf)))
    tr = truth[order] / np.exp(np.mean(np.log(truth[order])))
    assert np.allclose(est, tr, rtol=0.08)
    doubled = sim.withColumn("cnt", F.when(F.col("sample") == "rep0_MP_control", F.col("cnt") * 2).otherwise(F.col("cnt")))
    sf2 = np.array(C.size_factors(C.count_matrix(doubled, design), design))
    ratio = sf2 / sf
    k = list(design.samples).index("rep0_MP_control")
    assert abs(ratio[k] / np.median(np.delete(ratio, k)) - 2.0) < 1e-6


def test_swap_labels_flips_sign(spark, sim, fit):
    swapped = sim.withColumn("condition", F.when(F.col("condition") == "test", "control").otherwise("test"))
    r2 = differential_abundance(swapped, filtering=False, with_pca=False).results.toPandas().set_index("entity_id")
    r1 = differential_abundance(sim, filtering=False, with_pca=False).results.toPandas().set_index("entity_id")
    j = r1.join(r2, rsuffix="_s")
    assert np.allclose(j.log2FoldChange, -j.log2FoldChange_s, atol=1e-6)
    assert np.allclose(j.pvalue, j.pvalue_s, atol=1e-9)


def test_null_pvalues_near_uniform(spark):
    sim0 = simulate(spark, n_genes=400, planted=0, seed=5)
    r = differential_abundance(sim0, filtering=False, with_pca=False).results.toPandas()
    p = r.pvalue.dropna().to_numpy()
    assert 0.35 < np.mean(p) < 0.65 and np.mean(p < 0.05) < 0.12


def test_group_fit_matches_direct_likelihood():
    rng = np.random.default_rng(0)
    y = rng.poisson(50, (5, 6)).astype(float)
    sf = np.array([1.0, 1.2, 0.9, 1.1, 0.8, 1.0])
    groups = np.array([0, 0, 0, 1, 1, 1])
    alpha = np.full(5, 0.1)
    beta, mu, w = M.group_fit(y, sf, groups, 2, alpha)
    for gi in range(5):
        for g in range(2):
            m = groups == g
            grid = np.linspace(beta[gi, g] - 0.05, beta[gi, g] + 0.05, 2001)
            r = 1 / alpha[gi]
            ll = [np.sum(y[gi, m] * np.log(sf[m] * np.exp(b)) - (y[gi, m] + r) * np.log(r + sf[m] * np.exp(b))) for b in grid]
            assert abs(grid[int(np.argmax(ll))] - beta[gi, g]) < 1e-4


def test_trend_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    mu = rng.gamma(1.2, 200, 4000) + 1
    alpha = (0.1 + 2.0 / mu) * rng.gamma(5.0, 1 / 5.0, 4000)
    df = spark.createDataFrame([(float(m), float(a), False) for m, a in zip(mu, alpha)], "baseMean double, dispGeneEst double, allZero boolean")
    a0, a1 = D.fit_trend(df, 6)
    assert abs(a0 - 0.1) < 0.02 and abs(a1 - 2.0) < 0.3


def test_all_zero_gene_and_missing_pair(spark):
    rows = [(str(g), s, s.split("_")[-1], 10 + g) for g in range(60) for s in
            ["a_MP_control", "b_MP_control", "c_MP_test", "d_MP_test"]]
    rows = [r for r in rows if not (r[0] == "5" and r[1] == "a_MP_control")]  # missing pair -> 0
    rows += [("z", s, s.split("_")[-1], 0) for s in ["a_MP_control", "b_MP_control", "c_MP_test", "d_MP_test"]]
    df = spark.createDataFrame(rows, "entity_id string, sample string, condition string, cnt long")
    design = C.design_of(df)
    m = {r.entity_id: r.counts for r in C.count_matrix(df, design).collect()}
    assert m["5"][list(design.samples).index("a_MP_control")] == 0
    res = differential_abundance(df, filtering=False, with_pca=False).results.where("entity_id = 'z'").first()
    assert res.baseMean == 0 and res.log2FoldChange is None and res.pvalue is None and res.padj is None


def test_non_integer_counts_raise(spark):
    df = spark.createDataFrame([("a", "x_MP_control", "control", 1.5), ("a", "y_MP_test", "test", 2.0)],
                               "entity_id string, sample string, condition string, cnt double")
    with pytest.raises(CountDataError):
        differential_abundance(df)


def test_pca_matches_numpy_up_to_sign(spark, sim, fit):
    from duocount.operators.diffexp import pca as P
    design = C.design_of(sim)
    m = C.count_matrix(sim, design)
    sf = C.size_factors(m, design)
    trend = tuple(fit.log["trend_coef"])
    tr = P.transformed(C.normalised(m, sf), trend)
    top = P.top_variable(tr, 100).toPandas()
    X = np.vstack(top.vst.to_numpy()).T
    Xc = X - X.mean(axis=0)
    U, s, Vt = np.linalg.svd(Xc, full_matrices=False)
    rows, explained = P.sample_pca(tr, design.samples, design.conditions, ntop=100)
    got = np.array([[r[2], r[3]] for r in rows])
    ref = U[:, :2] * s[:2]
    for k in range(2):
        assert np.allclose(np.abs(got[:, k]), np.abs(ref[:, k]), atol=1e-6)
    assert abs(sum(explained) - 1) < 1e-9


def test_spread_over_means_takes_even_steps(spark):
    from duocount.operators.diffexp import pca as P
    rng = np.random.default_rng(5)
    for n, wanted in ((137, 20), (20, 20), (39, 20), (19, 20), (5, 1)):
        means = np.round(rng.gamma(1.0, 40.0, n) + 5.2, 1)   # ties among them
        rows = [(f"g{i:03d}", float(m)) for i, m in enumerate(means)] + [("low", 5.0), ("zero", 0.0)]
        df = spark.createDataFrame(rows, "entity_id string, baseMean double")
        got = sorted(r.entity_id for r in P.spread_over_means(df, wanted).collect())
        order = [e for m, e in sorted((m, e) for e, m in rows if m > 5)]
        at = [round(x) - 1 for x in np.linspace(1, n, wanted)] if n >= wanted and wanted > 1 else []
        if wanted > 1:
            assert got == sorted(order[i] for i in at), (n, wanted)
            assert len(set(at)) == len(at)


def test_transform_variant_is_picked_by_the_counts(spark, sim, fit, monkeypatch):
    from duocount.operators.diffexp import pca as P
    from duocount.operators.diffexp import dispersion as D
    design = C.design_of(sim)
    m = C.count_matrix(sim, design)
    S = len(design.samples)
    sf = C.size_factors(m, design)
    gw = C.normalised(m, sf).mapInPandas(D.genewise_mapper(sf, design.groups), "entity_id string, counts array<bigint>, norm array<double>, "
                                         "baseMean double, rowVar double, allZero boolean, dispGeneEst double").persist()
    least = min(gw.agg(*[F.count_if(F.col("counts")[j] != 0) for j in range(S)]).first())
    means = gw.where("baseMean > 5").count()
    full = D.trend_of(gw, S)
    assert P.transform_trend(gw, full, S, "full") == ("full", full)
    monkeypatch.setattr(P, "FAST_GENES", max(least, means) + 1)
    assert P.transform_trend(gw, full, S) == ("full", full)
    with pytest.raises(CountDataError, match="fast transform"):
        P.transform_trend(gw, full, S, "fast")
    monkeypatch.setattr(P, "FAST_GENES", min(least, means) // 2)
    name, fast = P.transform_trend(gw, full, S)
    assert name == "fast" and fast != full and fast == D.trend_of(P.spread_over_means(gw), S)
    at = np.array([20.0, 100.0, 400.0])
    assert np.all(np.abs(np.log(fast.at(at) / full.at(at))) < 0.7)   # the same curve from fewer genes
    with pytest.raises(ValueError):
        P.transform_trend(gw, full, S, "quick")
    gw.unpersist()


def test_numerics():
    for x in (1e-3, 0.5, 1.0, 2.5, 7.9, 8.0, 150.0, 1e7):
        assert abs(M.lgamma(np.array([x]))[0] - math.lgamma(x)) < 1e-9 * max(1, abs(math.lgamma(x)))
    assert abs(M.f_quantile_df1_2(0.99, 4) - 18.0) < 1e-9
    assert abs(M.norm_two_sided_p(np.array([1.959963985]))[0] - 0.05) < 1e-8


def test_outlier_replacement_with_seven_replicates(spark):
    rng = np.random.default_rng(8)
    samples = [f"r{i}_MP_control" for i in range(7)] + [f"r{i}_MP_test" for i in range(7)]
    rows = []
    for g in range(150):
        for s in samples:
            c = int(rng.poisson(rng.gamma(20.0, 100.0 / 20.0)))
            if g == 0 and s == "r0_MP_test":
                c = 5000  # one wild count
            rows.append((str(g), s, s.split("_")[-1], c))
    df = spark.createDataFrame(rows, "entity_id string, sample string, condition string, cnt long")
    with_rep = differential_abundance(df, filtering=True, with_pca=False).results.where("entity_id = '0'").first()
    without = differential_abundance(df, filtering=False, with_pca=False).results.where("entity_id = '0'").first()
    assert with_rep.replaced
    assert abs(with_rep.log2FoldChange) < 0.5 < abs(without.log2FoldChange)

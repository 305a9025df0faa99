"""Cook's cut-off (D09), independent filtering (D10), Benjamini-Hochberg."""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.operators.diffexp import nbmath as M
from duocount.operators.ordered import bh_adjust, count_below, exact_quantiles

# Fixed values of the published method: Cook's quantile, target FDR, filter grid and smoother span.
COOKS_QUANTILE = 0.99
ALPHA = 0.1
N_THETA = 50
UPPER_THETA = 0.95
LOWESS_FRAC = 1.0 / 5.0
MIN_REJECTIONS = 10
EXEMPT_ABOVE = 3       # larger counts than the outlier's that keep a gene's p-value
P_CELLS = 512          # equal cells of p between 0 and the target FDR in the first counting pass


def apply_cooks_cutoff(res: DataFrame, n_samples: int, n_coef: int = 2) -> DataFrame:
    """p-value becomes null for genes whose largest Cook's distance exceeds the 0.99 quantile of
    F(p, m - p), unless at least EXEMPT_ABOVE samples have a larger count than the outlier: a low count among
    higher ones does not make a difference look larger. Only defined for p = 2 here (two-group design)."""
    if n_coef != 2 or n_samples <= n_coef:
        return res
    cutoff = M.f_quantile_df1_2(COOKS_QUANTILE, float(n_samples - n_coef))
    return res.withColumn("pvalue", F.when((F.col("maxCooks") > F.lit(cutoff)) & (F.col("nAbove") < EXEMPT_ABOVE),
                                            F.lit(None).cast("double")).otherwise(F.col("pvalue")))


class _Cells:
    """p-value cells in ascending order, each with count, least and largest p per number of kept cut-offs k."""

    def __init__(self, n_cutoffs: int):
        self.T, self.keys, self.n, self.low, self.high = n_cutoffs, [], [], [], []

    def read(self, rows, depth: int):
        """(keys, counts, least, largest) of one pass's rows (cell, k, n, low, high), summed over k > t for each cut-off t."""
        ids = sorted({r["cell"] for r in rows})
        place = {c: i for i, c in enumerate(ids)}
        n = np.zeros((len(ids), self.T + 1), np.int64)
        low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for r in rows:
            at = place[r["cell"]], r["k"]
            n[at], low[at], high[at] = r["n"], r["low"], r["high"]
        over = slice(None), slice(None, 0, -1)   # k = T .. 1
        return ([(depth, c) for c in ids], np.cumsum(n[over], axis=1)[:, ::-1], np.minimum.accumulate(low[over], axis=1)[:, ::-1],
                np.maximum.accumulate(high[over], axis=1)[:, ::-1])

    def replace(self, key, parts):
        """Put the parts of a cell in its place (``key`` None: the first pass)."""
        keys, *tables = parts
        at = 0 if key is None else self.keys.index(key)
        drop = 0 if key is None else 1
        self.keys[at:at + drop] = keys
        for name, table in zip(("n", "low", "high"), tables):
            getattr(self, name)[at:at + drop] = list(table)

    def decide(self, t: int, total: int, alpha: float):
        """``(rejections, None)`` at cut-off t, or ``(None, key)`` of the cell that has to be divided first.

        From the top: the largest p of a cell has the cell's running count as its rank, so it decides for certain; if
        it fails, a smaller p of the cell can still pass only if the least one could pass at that rank."""
        n = np.array([x[t] for x in self.n], np.int64)
        rank = np.cumsum(n)
        for i in range(len(n) - 1, -1, -1):
            if n[i]:
                limit = rank[i] * alpha / total
                if self.high[i][t] <= limit:
                    return int(rank[i]), None
                if self.low[i][t] <= limit and self.low[i][t] < self.high[i][t]:
                    return None, self.keys[i]
        return 0, None


def rejections_per_cutoff(res: DataFrame, cutoffs: Sequence[float], alpha: float = ALPHA, cells: int = P_CELLS) -> list:
    """BH rejections at level ``alpha`` among genes with baseMean >= each cutoff: R = the largest rank r with
    p_(r) <= r * alpha / n (step-up rule), for all cutoffs at once and without multiplying genes by cutoffs.

    Genes are counted once by (number of cut-offs that keep them, p cell); p over ``alpha`` can never be rejected and
    only counts in n. A cell in which a cut-off's decision falls is divided again (256 parts between its least and largest
    p), until every decision is exact. At most (cutoffs + 1) * max(cells, 256 * cutoffs) numbers reach the driver a pass."""
    ordered = sorted(float(c) for c in cutoffs)
    T = len(ordered)
    above = count_below([-c for c in reversed(ordered)], "_neg_base")   # cut-offs over baseMean
    x = (res.where(F.col("pvalue").isNotNull() & F.col("baseMean").isNotNull())
         .select((-F.col("baseMean")).alias("_neg_base"), F.col("pvalue").alias("p"))
         .select((F.lit(T) - above).cast("int").alias("k"), "p").where("k > 0")
         .withColumn("cell", F.when(F.col("p") <= alpha, F.least(F.floor(F.col("p") * F.lit(cells / alpha)), F.lit(cells)).cast("long"))
                     .otherwise(F.lit(-1).cast("long"))))
    measures = [F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("high")]
    rows = x.groupBy("cell", "k").agg(*measures).collect()
    total = np.zeros(T, np.int64)
    for r in rows:
        total[:r["k"]] += r["n"]
    table, depths = _Cells(T), [x]
    table.replace(None, table.read([r for r in rows if r["cell"] >= 0], 0))
    while True:
        found = [table.decide(t, int(total[t]), alpha) if total[t] else (0, None) for t in range(T)]
        wanted = {key for _, key in found if key}
        if not wanted:
            return [r for r, _ in found]
        for depth in sorted({d for d, _ in wanted}):
            split = []
            for d, cell in wanted:
                if d == depth:
                    at = table.keys.index((d, cell))
                    low, high = table.low[at].min(), table.high[at].max()
                    split.append((cell, float(low), float(255.0 / (high - low))))
            parts = depths[depth].join(F.broadcast(x.sparkSession.createDataFrame(split, "cell long, low double, scale double")), "cell")
            parts = parts.select("k", "p", F.col("cell").alias("parent"), F.least(F.floor((F.col("p") - F.col("low")) * F.col("scale")), F.lit(255)).cast("long").alias("cell"))
            rows = parts.groupBy("parent", "cell", "k").agg(*measures).collect()
            for cell, _, _ in split:
                level = len(depths)
                depths.append(parts.where(F.col("parent") == cell).drop("parent"))
                table.replace((depth, cell), table.read([r for r in rows if r["parent"] == cell], level))


def filter_grid(res: DataFrame) -> tuple[np.ndarray, list]:
    """The N_THETA shares of genes that cut-offs leave out, and the cut-offs: exact quantiles of baseMean."""
    lower = res.agg(F.avg((F.col("baseMean") == 0).cast("double"))).first()[0] or 0.0
    upper = UPPER_THETA if lower < UPPER_THETA else 1.0
    theta = np.linspace(lower, upper, N_THETA)
    q = exact_quantiles(res, "baseMean", {f"t{i}": float(t) for i, t in enumerate(theta)}).first()
    return theta, [float(q[f"t{i}"]) for i in range(N_THETA)]


def chosen_cutoff(theta: np.ndarray, num_rej: np.ndarray) -> int:
    """Index of the cut-off that independent filtering takes: the first whose rejections come within the residual
    spread of the smoothed curve's top; the first of all where rejections are few."""
    if num_rej.max() <= MIN_REJECTIONS:
        return 0
    fit = M.lowess(theta, num_rej, LOWESS_FRAC)
    pos = num_rej > 0
    resid = num_rej[pos] - fit[pos] if pos.any() else np.zeros(1)
    thresh = fit.max() - np.sqrt(np.mean(resid ** 2))
    above = np.nonzero(num_rej > thresh)[0]
    return int(above[0]) if len(above) else 0


def independent_filtering(res: DataFrame, alpha: float = ALPHA):
    """Choose the baseMean quantile cut that maximises rejections (D10); returns ``(res with padj, info)``.

    The theta grid, the 50 cut values and the 50 rejection counts are the only things on the driver.
    """
    theta, cutoffs = filter_grid(res)
    num_rej = np.asarray(rejections_per_cutoff(res, cutoffs, alpha), float)
    j = chosen_cutoff(theta, num_rej)
    cut = cutoffs[j]
    kept = res.withColumn("_p_f", F.when(F.col("baseMean") >= F.lit(cut), F.col("pvalue")))
    out = bh_adjust(kept, "_p_f", "padj").drop("_p_f")
    info = {"theta": float(theta[j]), "baseMean_cutoff": cut, "rejections": num_rej.tolist()}
    return out, info


def adjust_all(res: DataFrame) -> DataFrame:
    """Unfiltered mode: BH over every non-null p-value."""
    return bh_adjust(res, "pvalue", "padj")

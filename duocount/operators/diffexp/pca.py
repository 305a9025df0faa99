"""Variance-stabilising transform (D12), most variable genes (O04) and sample PCA."""

from __future__ import annotations

from typing import Optional, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duocount.operators.diffexp.dispersion import trend_of
from duocount.operators.diffexp.trend import Parametric, Trend, as_trend
from duocount.operators.ranges import number_rows
from duocount.spec import CountDataError

NTOP = 500
# Fixed values of the published method's fast variant: genes its trend is fitted on, and the base mean they exceed.
FAST_GENES = 1000
FAST_MEAN = 5.0


def spread_over_means(genes: DataFrame, n_genes: int = None, by: Sequence[str] = ()) -> DataFrame:
    """``n_genes`` genes (FAST_GENES by default) of each group ``by`` with a base mean above FAST_MEAN, at even steps of its order, least and
    largest included (ties by id); no genes if fewer qualify. Positions come from ranges with prefix offsets, so no
    task sorts all genes."""
    n_genes = n_genes or FAST_GENES
    placed = number_rows(genes.where(F.col("baseMean") > FAST_MEAN), by, ["baseMean", "entity_id"], "_at", "_total")
    step = (F.col("_total") - 1).cast("double") / F.lit(float(max(n_genes - 1, 1)))
    # with steps of one or more, only the step nearest to a position can land on it
    nearest = F.rint(F.col("_at") / step)
    on = F.when(step > 0, F.rint(nearest * step + 1) == F.col("_at") + 1).otherwise(True)
    return placed.where((F.col("_total") >= n_genes) & on).drop("_at", "_total")


def transform_trend(genes: DataFrame, trend: Optional[Trend], n_samples: int, variant: str = "auto") -> tuple[str, Trend]:
    """(variant used, trend of the transform), D12. ``full``: the trend of all genes, ``trend`` or, if None, fitted here. ``fast``: one fitted on
    genes spread over the means, an error with fewer than FAST_GENES to choose from. ``auto``: full where some sample has fewer
    than FAST_GENES non-zero counts (or too few genes have the mean), else fast."""
    if variant not in ("auto", "full", "fast"):
        raise ValueError(f"variant must be 'auto', 'full' or 'fast', not {variant!r}")
    if variant == "full":
        return "full", trend or trend_of(genes, n_samples)
    seen = genes.agg(F.count_if(F.col("baseMean") > FAST_MEAN).alias("means"), *[
        F.count_if(F.col("counts")[j] != 0).alias(f"n{j}") for j in range(n_samples)]).first()
    enough = seen["means"] >= FAST_GENES
    if variant == "fast" and not enough:
        raise CountDataError(f"the fast transform needs {FAST_GENES} entities with a mean above {FAST_MEAN}, there are {seen['means']}")
    if not enough or (variant == "auto" and min(seen[f"n{j}"] for j in range(n_samples)) < FAST_GENES):
        return "full", trend or trend_of(genes, n_samples)
    return "fast", trend_of(spread_over_means(genes), n_samples)


def vst(q: Column, trend: Trend, top: float = 1.0) -> Column:
    """Integral of 1/sqrt(mu + alpha(mu) mu^2), scaled to approach log2 q; ``top``: the largest value (used by the local trend)."""
    return as_trend(trend).transform(q, top)


def transformed(norm_matrix: DataFrame, trend: Trend) -> DataFrame:
    """``entity_id, vst ARRAY<DOUBLE>, vstVar`` from the normalised counts."""
    trend = as_trend(trend)
    top = 1.0 if isinstance(trend, Parametric) else norm_matrix.agg(F.max(F.array_max("norm"))).first()[0] or 1.0
    out = norm_matrix.select("entity_id", F.transform("norm", lambda q: vst(q, trend, top)).alias("vst"))
    n = F.size("vst").cast("double")
    mean = F.aggregate("vst", F.lit(0.0), lambda a, x: a + x) / n
    out = out.withColumn("_mean", mean)
    var = F.aggregate("vst", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / (n - F.lit(1.0))
    return out.withColumn("vstVar", var).drop("_mean")


def top_variable(tr: DataFrame, ntop: int = NTOP) -> DataFrame:
    """The ``ntop`` most variable entities, ties by id (O04; the limit is the method's own)."""
    return tr.orderBy(F.col("vstVar").desc(), F.col("entity_id")).limit(int(ntop))


def sample_pca(tr: DataFrame, samples: Sequence[str], conditions: Sequence[str], ntop: int = NTOP):
    """PCA of samples over the top entities, through the samples x samples Gram matrix.

    Entities are centred across samples; one aggregate sums the S x S outer products (S^2 numbers to
    the driver), which is eigen-decomposed there. Scores = U * sqrt(eigenvalue); sign fixed so the
    largest absolute score of each component is positive. Returns ``(rows, explained)``.
    """
    S = len(samples)
    top = top_variable(tr, ntop)
    c = top.select(F.transform("vst", lambda x: x - F.aggregate("vst", F.lit(0.0), lambda a, y: a + y) / F.lit(float(S))).alias("c"))
    pairs = c.select(F.posexplode("c").alias("i", "xi"), "c").select("i", "xi", F.posexplode("c").alias("j", "xj"))
    g = pairs.groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("v")).collect()
    gram = np.zeros((S, S))
    for r in g:
        gram[r["i"], r["j"]] = r["v"]
    return components(gram, samples, conditions)


def components(gram: np.ndarray, samples: Sequence[str], conditions: Sequence[str]):
    """Scores of the first two components and the shares of variance, from a Gram matrix of centred samples."""
    S = len(samples)
    vals, vecs = np.linalg.eigh(gram)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    scores = vecs * np.sqrt(vals)[None, :]
    for k in range(scores.shape[1]):
        if scores[np.argmax(np.abs(scores[:, k])), k] < 0:
            scores[:, k] = -scores[:, k]
    explained = (vals / vals.sum()).tolist() if vals.sum() > 0 else [0.0] * S
    rows = [(samples[i], conditions[i], float(scores[i, 0]), float(scores[i, 1]) if S > 1 else 0.0) for i in range(S)]
    return rows, explained


def axis_labels(explained) -> dict:
    return {"x_label": f"PC1: {round(100 * explained[0])}% variance",
            "y_label": f"PC2: {round(100 * explained[1]) if len(explained) > 1 else 0}% variance"}


def split_by_condition(pca: DataFrame, condition: str) -> DataFrame:
    """PCA rows of one condition."""
    return pca.where(F.col("condition") == F.lit(condition))

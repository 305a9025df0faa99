"""Differential abundance of one two-condition design, end to end."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duocount.operators.diffexp import counts as C
from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.diffexp import pca as P
from duocount.operators.diffexp import select as SEL
from duocount.schemas import DE_RESULT_COLUMNS
from duocount.session import cut_lineage
from duocount.spec import ComparisonSpec, CountDataError


@dataclass
class DEResult:
    results: DataFrame                  # entity_id + baseMean, log2FoldChange, lfcSE, stat, pvalue, padj (+ diagnostics)
    pca: Optional[DataFrame]            # sample, condition, pc1, pc2
    log: dict = field(default_factory=dict)


def differential_abundance(long_counts: DataFrame, filtering: bool = True, levels=("control", "test"),
                           with_pca: bool = True, results: bool = True, materialise: bool = True,
                           transform: str = "auto") -> DEResult:
    """Negative-binomial two-group test of ``entity_id, sample, condition, cnt`` (test over control).

    ``filtering=True``: Cook's cut-off and independent filtering (the default mode); ``False``: neither,
    BH over every p-value (D16). In filtered mode, counts flagged by Cook's distance in groups with
    at least 7 replicates are replaced and those genes refitted (D09), as in the published default. ``results=False`` stops after the dispersion trend (all
    the PCA needs). ``transform``: variant of the PCA's transform (``pca.transform_trend``). Per-gene tables are materialised in the checkpoint folder between passes.
    """
    log = {"replicates": None, "run": False, "success": False, "reason": None}
    try:
        # the replicates are counted before anything is asked of them: with some, the run has started and its
        # failure is a failed run
        design, bad_counts = C.read_design(long_counts, levels)
        log["replicates"] = len(design.samples)
        log["run"] = bool(design.samples)
        C.check_design(design, bad_counts)
        if len(set(design.conditions)) < 2:
            raise CountDataError("both conditions need replicates")
        # the dispersion and Wald passes are compute-bound numpy over Arrow batches: the entities are spread over
        # at least every core in the aggregation's own exchange (byte-sized partitions of a small table collapse to one)
        spark = long_counts.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        matrix = C.count_matrix(long_counts, design, parts)
        if materialise:
            matrix = cut_lineage(matrix, "counts")
        sf = C.size_factors(matrix, design)
        norm = C.normalised(matrix, sf)
        gw = norm.mapInPandas(D.genewise_mapper(sf, design.groups),
                              "entity_id string, counts array<bigint>, norm array<double>, baseMean double, "
                              "rowVar double, allZero boolean, dispGeneEst double")
        if materialise:
            gw = cut_lineage(gw, "genewise")
        S = len(design.samples)
        # the PCA alone asks for the trend of all genes only where its transform uses that one
        trend = D.trend_of(gw, S) if results or not with_pca else None
        res = None
        if results:
            prior_var, residual_sd = D.prior_variance(gw, trend, S)
            log["prior_var"] = prior_var
            res = gw.select("entity_id", "counts", "baseMean", "allZero", "dispGeneEst").mapInPandas(
                FT.wald_mapper(sf, design.groups, trend, prior_var, residual_sd, replace=filtering), FT.RESULT_SCHEMA)
            if materialise:
                res = cut_lineage(res, "wald")
            if filtering:
                res = SEL.apply_cooks_cutoff(res, S)
                res, info = SEL.independent_filtering(res)
                log["filter"] = info
            else:
                res = SEL.adjust_all(res)
        pca = None
        if with_pca:
            log["transform"], smooth = P.transform_trend(gw, trend, S, transform)
            trend = trend or smooth
            rows, explained = P.sample_pca(P.transformed(gw, smooth), design.samples, design.conditions)
            pca = long_counts.sparkSession.createDataFrame(rows, "sample string, condition string, pc1 double, pc2 double")
            log["explained"] = explained
            log.update(P.axis_labels(explained))
        log["trend"] = trend.name
        log.update({"success": True, "size_factors": dict(zip(design.samples, sf)), "trend_coef": list(trend) if trend.name == "parametric" else None})
        return DEResult(res, pca, log)
    except Exception as e:
        log["reason"] = str(e)
        e.log = log   # type: ignore[attr-defined]
        raise


def attach_results(df: DataFrame, res: DataFrame, entity: str, spec: ComparisonSpec = ComparisonSpec(),
                   prefix: str = "de_", columns: Sequence[str] = DE_RESULT_COLUMNS):
    """Prefix the result columns and left-join them back on the entity (D14, P12, J03). Returns
    ``(df, spec)`` with every attached column registered as a metric."""
    r = res.select(F.col("entity_id").alias("_eid"), *[F.col(c).alias(prefix + c) for c in columns])
    for c in columns:
        spec = spec.with_metric(prefix + c)
    return df.join(r, F.col(entity).cast("string") == F.col("_eid"), "left").drop("_eid"), spec


def run_log_row(run_id: str, log: dict) -> tuple:
    """One row of the run log (D15): run_id, replicates, run, success, reason."""
    return (run_id, log.get("replicates"), bool(log.get("run")), bool(log.get("success")), log.get("reason"))


def logged_run(run_id: str, long_counts: DataFrame, **kwargs):
    """``(result, log row)`` of one run; a run that fails, for whatever reason, gives no result but its row."""
    try:
        result = differential_abundance(long_counts, **kwargs)
    except Exception as e:
        return None, run_log_row(run_id, getattr(e, "log", {"reason": str(e)}))
    return result, run_log_row(run_id, result.log)


def run_log(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Log rows as a table, one row per run."""
    return spark.createDataFrame(list(rows), "run_id string, replicates long, run boolean, success boolean, reason string")
